"""Text columns: missing words, lists and maps in text, names and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count as missing (case-folded), by the operator that reads them.
MISSING = {
    "cluster": ("", "nan", "none", "not available", "not assessable"),
    "class_layer": ("", "none", "n/a", "not assessable", "unclassified", "not further subclassified", "unknown"),
    "layer": ("", "none", "n/a", "not assessable", "unknown", "not implemented"),
    "topology": ("", "none", "n/a", "not assessable", "unknown", "not implemented", "unclassified"),
    "corpus": ("", "nan", "none", "null"),
    "dashboard": ("", "nan", "none", "not available", "not assessable"),
}
#: Case-sensitive, for feature profiles.
MISSING_PROFILE = ("", "None", "Not assessable", "N/A")


def present(text: Column, words: tuple[str, ...] = ("",)) -> Column:
    """The trimmed text, or null where it is one of the missing words."""
    t = F.trim(text)
    return F.when(t.isNotNull() & ~F.lower(t).isin(*words), t)


def first_present(*texts: Column, words: tuple[str, ...] = ("",)) -> Column:
    return F.coalesce(*[present(t, words) for t in texts])


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical(text: Column) -> Column:
    """One blank between words, no NUL, null as empty: what stable ids are made of."""
    return collapse(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(" ")))


def parse_list(text: Column, sep: str = ";", words: tuple[str, ...] = ("",)) -> Column:
    """Sorted distinct trimmed items of a delimited text, without missing words."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: ~F.lower(x).isin(*words))))


def parse_map(text: Column, sep: str = "|") -> Column:
    """``K: v | K2: v2`` to a map; each pair is cut at its first colon."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), rf"\{sep}"), lambda p: p.contains(":"))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.substr(p, F.position(F.lit(":"), p) + 1)).alias("v"))
    made = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(made, lambda e: e["k"]))
    # The last pair of a repeated key stands, as in a dict.
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(made, lambda e: e["k"] == k), -1)["v"]))


def parse_path(text: Column, sep: str = "→") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def render_list(items: Column, empty: str = "None") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, "; ")).otherwise(F.lit(empty))


# Parts of reported names that are not part of the name, in this order.
NAME_NOISE = (
    r"(?i)\brelated\s+component\b",
    r"(?i)\brelated\s+compou?nd\s*\d*\b",
    r"(?i)\s*\(n=\d+\)",
    r"(?i),\s*loss\s+of\s+.*$",
    r"(?i),\s*(hydroxy|methyl|oxy)$",
    r"(?i)\s+dimer$",
    r",\s*$",
)


def clean_name(name: Column) -> Column:
    out = name
    for pattern in NAME_NOISE:
        out = F.regexp_replace(out, pattern, "")
    return collapse(out)


def parse_amount(text: Column) -> Column:
    """The first run of digits and dots, without commas; -1 where that is no number."""
    run = F.regexp_extract(F.replace(text.cast("string"), F.lit(","), F.lit("")), r"[0-9.]+", 0)
    return F.coalesce(F.nullif(run, F.lit("")).try_cast("double"), F.lit(-1.0))


def digest_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    """Stable id: prefix and the first hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)))


def contains_any(text: Column, terms) -> Column:
    """Whether the case-folded text contains any of the terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return out


def formula_pairs(elements: Column, counts: Column) -> Column:
    """``C H`` and ``6 12`` to ``C6H12``; a count of one is not written."""
    return F.array_join(
        F.transform(F.arrays_zip(elements.alias("e"), counts.alias("n")), lambda z: F.concat(z["e"], F.when(z["n"] == "1", F.lit("")).otherwise(F.coalesce(z["n"], F.lit(""))))), ""
    )
