"""Secret scans: fixed patterns, plus a randomness test battery over token-like runs.

The base kinds (assign, access, hex) are patterns. The battery looks at every run of 20
or more of ``[A-Za-z0-9+/_=-]``, infers its encoding (hex, base32, base36, base62, base64) from the
characters it uses (a run of one case with ``- _ + /`` in it is judged without these), and asks

* does it look random in that encoding? A chi-squared test of alphabet uniformity, a
  runs test about the alphabet's middle and a lag-one serial correlation; each must not
  reject randomness at ``REJECT``;
* could ordinary text look like this? A name, path or camel-case word changes its class
  of character (lower, upper, digit, other) at a rate of at most ``TEXT_RATE``; the Chernoff
  bound of seeing as many changes as the run has, given its length, is its p-value, and 1 if
  the tests rejected it.

Over all documents the p-values are held to a false-discovery rate of ``FDR``
(Benjamini-Hochberg), separately in each class of length, since the same share of
changes proves more in a longer run. The corpus is reduced to counts by (length class, tenth
of a decade of p), some hundreds of rows at any size, so the second pass compares each
run with its class's limit inside the projection. No text is shuffled in either pass.

Everything is built-in functions. Defined cases: null text is empty and has no span;
repeated rows are scanned alike (each counts as a test); spans of one start are in the order of
their kinds; very long texts and tokens take work linear in their length; runs without a digit or
without a letter are not tested; an empty table gives an empty result; other columns, whatever
their names, are carried or ignored, never read. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, table

#: Fixed patterns; ASCII letters of either case are written out.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: The battery's parameters.
SHORTEST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
REJECT = 1e-5
TEXT_RATE = 0.15
FDR = 0.01
LENGTH_CLASSES = (20, 32, 64)
TENTHS = 400

_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


#: Elements that are folded one after the other; what lies before them comes from sums of whole runs.
RUN = 128


def before(xs: Column, zero: int, combine) -> Column:
    """Of each element what ``combine`` makes of all before it, for an associative ``combine`` on whole
    numbers: runs of ``RUN`` elements are reduced, and only these reductions are folded through, so
    that no long array is copied for each element."""

    def fold(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, start, step, lambda acc: acc["out"])

    def in_runs(values: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, RUN))
        return let(runs, lambda rs: let(
            fold(F.transform(rs, lambda r: F.aggregate(r, F.lit(zero), combine)), F.lit(zero)),
            lambda firsts: F.flatten(F.transform(rs, lambda r, i: fold(r, F.get(firsts, i)))),
        ))

    return let(xs, lambda v: F.when(F.size(v) <= RUN, fold(v, F.lit(zero))).otherwise(in_runs(v)))


def _find(text: Column, pattern: str, kind: int, gate: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans: the text between matches gives their
    places. ``gate`` is a cheaper pattern without which there is no match to keep."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(hs: Column) -> Column:
        lengths = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hs)).alias("gap"), hs.alias("hit")), lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit")))
        return let(lengths, lambda ls: let(
            before(F.transform(ls, lambda x: x["gap"] + x["hit"]), 0, lambda x, y: x + y),
            lambda at: F.transform(hs, lambda h, i: F.struct(
                (F.get(at, i) + F.get(ls, i)["gap"]).alias("start"), F.lit(kind).alias("kind"),
                (F.get(at, i) + F.get(ls, i)["gap"] + F.get(ls, i)["hit"]).alias("end"), h.alias("text"),
            )),
        ))

    found = let(hits, placed)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["text"]))
    return F.when(text.rlike(gate), found).otherwise(_none())


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` (of one kind, so apart from one another) that overlap with none of ``others``: one
    ordered pass. Another one overlaps if it begins no later and ends after the start, or is next and begins inside."""
    row = lambda s, flag: F.struct(s["start"].alias("start"), F.lit(flag).alias("flag"), s["end"].alias("end"), s.alias("span"))
    merged = F.sort_array(F.concat(F.transform(others, lambda s: row(s, 0)), F.transform(spans, lambda s: row(s, 1))))

    def passed(ms: Column) -> Column:
        ends = before(F.transform(ms, lambda m: F.when(m["flag"] == 0, m["end"]).otherwise(-1)), -1, lambda x, y: F.greatest(x, y))
        inside = lambda m, i: F.coalesce((F.get(ms, i + 1)["flag"] == 0) & (F.get(ms, i + 1)["start"] < m["end"]), F.lit(False))
        return let(ends, lambda es: F.transform(F.filter(ms, lambda m, i: (m["flag"] == 1) & (F.get(es, i) <= m["start"]) & ~inside(m, i)), lambda m: m["span"]))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(merged, passed)).otherwise(spans)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": _find(text, ASSIGN, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        # A run of 20 (24) or more is the maximal run, so asking for the length in the pattern finds the same.
        "access": _find(text, "AKIA[A-Z0-9]{16,}", 1, "AKIA[A-Z0-9]{16}"),
        "hex": _find(text, "[0-9a-f]{24,}", 2, "[0-9a-f]{24}"),
    }


# ---- the battery ----


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, error under 1e-7)."""

    def up(x: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * let(1 / (1 + 0.2316419 * x), poly)

    return let(z, lambda v: let(up(F.abs(v)), lambda u: F.when(v >= 0, u).otherwise(1 - u)))


#: Encoding: characters in order; base64 takes both of its usual pairs of extra symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def encoding(body: Column) -> Column:
    """Inferred from the characters used; null for what has no digit or no letter."""
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return (
        F.when(~mixed, F.lit(None).cast("string"))
        .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(body.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(body.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), F.lit("base36"))
        .when(body.rlike("^[A-Za-z0-9]+$"), F.lit("base62"))
        .when(body.rlike("[A-Z]") & body.rlike("[a-z]"), F.lit("base64"))
    )


def battery(token: Column) -> Column:
    """struct(encoding, random, tenth, length_class) of a token; null where no encoding fits. Work
    and memory are linear in the token's length."""

    def of_body(body: Column) -> Column:
        # Without a case of its own, -, _, + and / only part a key's groups (of a UUID, say): they are left out.
        plain = F.regexp_replace(body, "[-_+/=]", "")
        parted = F.when(F.length(plain) >= SHORTEST, plain)
        return let(F.when(encoding(body).isNotNull(), body).otherwise(parted), lambda used: let(encoding(used), lambda enc: F.when(enc.isNotNull(), with_encoding(used, enc))))

    def with_encoding(body: Column, enc: Column) -> Column:
        # Place of each character in its alphabet, from 0; url-safe symbols stand for + and /.
        folded = F.when(enc == "hex", F.translate(body, "ABCDEF", "abcdef")).when(enc == "base36", F.lower(body)).otherwise(F.replace(F.translate(body, "-_", "+/"), F.lit("="), F.lit("")))
        alphabet = F.lit(ALPHABETS["base64"])
        for k in ("hex", "base32", "base36", "base62"):
            alphabet = F.when(enc == k, F.lit(ALPHABETS[k])).otherwise(alphabet)
        return let(F.struct(folded.alias("s"), alphabet.alias("a")), lambda x: tests(x["s"], x["a"], body, enc))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def tests(s: Column, alphabet: Column, body: Column, enc: Column) -> Column:
        size, n = F.length(alphabet).cast("double"), F.length(s).cast("double")
        # Chi-squared: one count for each letter of the alphabet.
        squares = total(F.transform(F.split(alphabet, ""), lambda c: F.pow(n - F.length(F.replace(s, c, F.lit(""))), 2.0)))
        chi = size / n * squares - n
        z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        codes = F.transform(F.split(s, ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        return let(codes, lambda xs: let(F.struct(z_chi.alias("z"), total(xs).alias("sum")), lambda y: judged(xs, y["z"], y["sum"] / n, n, size, body, enc)))

    def judged(xs: Column, z_chi: Column, mean: Column, n: Column, size: Column, body: Column, enc: Column) -> Column:
        # One pass: values above the middle, changes of side, squares and lagged products about the mean.
        steps = F.transform(xs, lambda x, i: F.struct(
            F.when(x >= size / 2, 1.0).otherwise(0.0).alias("h"), F.when((i > 0) & ((x >= size / 2) != (F.get(xs, i - 1) >= size / 2)), 1.0).otherwise(0.0).alias("c"),
            ((x - mean) * (x - mean)).alias("ss"), F.when(i > 0, (x - mean) * (F.get(xs, i - 1) - mean)).otherwise(0.0).alias("lag"),
        ))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("h", "c", "ss", "lag")])
        sums = F.aggregate(steps, zero, lambda a, x: F.struct(*[(a[c] + x[c]).alias(c) for c in ("h", "c", "ss", "lag")]))

        def worst(t: Column) -> Column:
            n1, n2 = t["h"], n - t["h"]
            expected = 1 + 2 * n1 * n2 / n
            var = (expected - 1) * (expected - 2) / (n - 1)
            z_runs = let(F.struct(var.alias("v"), (1 + t["c"] - expected).alias("d")), lambda x: F.when(x["v"] > 0, x["d"] / F.sqrt(F.when(x["v"] > 0, x["v"]))).otherwise(F.lit(99.0)))
            z_serial = F.when(t["ss"] > 0, (t["lag"] / F.when(t["ss"] > 0, t["ss"]) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
            return F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))

        return let(F.coalesce(let(sums, worst) >= REJECT, F.lit(False)), lambda random: weighed(random, body, enc))

    def weighed(random: Column, body: Column, enc: Column) -> Column:
        # Changes of class: of lower case, upper case and digits, each run is one letter.
        kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[^0aA]+", "-")
        m = (F.length(body) - 1).cast("double")
        rate = (F.length(kinds) - 1) / m
        kl = lambda r: r * F.log(r / TEXT_RATE) + F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - TEXT_RATE))).otherwise(0.0)
        p = F.when(random, let(rate, lambda r: F.when(r > TEXT_RATE, F.exp(-m * kl(r))).otherwise(1.0))).otherwise(1.0)
        group = F.lit(0)
        for i, least in enumerate(LENGTH_CLASSES):
            group = F.when(F.length(body) >= least, F.lit(i)).otherwise(group)
        # What the battery rejects is no discovery, whatever its p: it counts as p = 1.
        tenth = let(p, lambda v: F.when(v > 0, F.least(F.floor(-10 * F.log10(F.when(v > 0, v))), F.lit(TENTHS))).otherwise(F.lit(TENTHS)).cast("int"))
        return F.struct(enc.alias("encoding"), random.alias("random"), tenth.alias("tenth"), group.alias("length_class"))

    return let(F.regexp_replace(token, "=+$", ""), of_body)


def limits(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[int, int]:
    """By length class the least tenth (of a decade of p) that is a discovery. All tested tokens
    are hypotheses; only those that the battery lets pass count as discoveries."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.where(text.rlike(TOKEN)).select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("token"))
    tested = tokens.select(battery(F.col("token")).alias("b")).where(F.col("b").isNotNull())
    rows = tested.groupBy("b.length_class", "b.tenth").agg(F.count("*").alias("n"), F.count_if("b.random").alias("r")).collect()
    return thresholds([(r["length_class"], r["tenth"], r["n"], r["r"]) for r in rows], fdr)


def thresholds(rows: list[tuple[int, int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg in each length class from rows of (class, tenth, tested, passed)."""
    out = {}
    for g in range(len(LENGTH_CLASSES)):
        mine = sorted(((tenth, r) for k, tenth, _, r in rows if k == g), reverse=True)
        m, found = sum(n for k, _, n, _ in rows if k == g), 0
        for tenth, r in mine:
            found += r
            if r and m * 10 ** (-tenth / 10) <= fdr * found:
                out[g] = tenth
    return out


def scan(docs: DataFrame, text_col: str = "text", out: str = "_secrets", found_limits: dict[int, int] | None = None) -> DataFrame:
    """``docs`` with a struct column ``out``: n_assign, n_access, n_hex, base and spans (both
    arrays of (start, kind number, end, text) in order)."""
    lim = limits(docs, text_col) if found_limits is None else found_limits
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)

    def discovered(span: Column) -> Column:
        def judged(b: Column) -> Column:
            good = F.lit(False)
            for g, least in lim.items():
                good = good | ((b["length_class"] == g) & (b["tenth"] >= least))
            return F.coalesce(b["random"] & good, F.lit(False))

        return let(battery(span["text"]), judged)

    more = _find(text, TOKEN, 3, TOKEN)
    one = docs.withColumn(out, F.struct(kinds["assign"].alias("a"), kinds["access"].alias("k"), kinds["hex"].alias("h"), more.alias("m")))
    x = F.col(out)
    base = F.sort_array(F.concat(x["a"], x["k"], x["h"]))
    two = one.withColumn(out, F.struct(
        F.size(x["a"]).cast("long").alias("n_assign"), F.size(x["k"]).cast("long").alias("n_access"), F.size(x["h"]).cast("long").alias("n_hex"),
        base.alias("base"),
        apart(x["m"], F.concat(x["a"], x["k"], x["h"])).alias("m"),
    ))
    added = F.when(F.size(x["m"]) > 0, F.filter(x["m"], discovered)).otherwise(x["m"])
    return two.withColumn(out, F.struct(x["n_assign"], x["n_access"], x["n_hex"], x["base"], F.sort_array(F.concat(x["base"], added)).alias("spans")))


def listing(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of the pieces from which parts of a text are taken: a part of a long string is found by
#: counting from its start.
PART = 4096


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``. ``spans`` are in order."""

    def cut(ss: Column, parts: Column) -> Column:
        ends = before(F.concat(F.transform(ss, lambda s: s["end"]), F.array(F.lit(0))), 0, lambda x, y: F.greatest(x, y))

        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / PART).cast("int")
            held = F.array_join(F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1), "")
            return F.substring(held, start - first * PART + 1, end - start)

        # A span that begins where all before it have ended starts a run; the text before it is kept.
        kept = lambda es: F.filter(F.transform(ss, lambda s, i: F.struct(F.get(es, i).alias("a"), s["start"].alias("b"))), lambda x: x["b"] >= x["a"])
        return let(ends, lambda es: F.concat(
            F.array_join(F.transform(kept(es), lambda x: F.concat(between(x["a"], x["b"]), F.lit(mark))), ""),
            F.substring(text, F.element_at(es, -1) + 1, F.length(text)),
        ))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(spans.alias("s"), parts.alias("p")), lambda x: cut(x["s"], x["p"]))).otherwise(text)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("_secrets")
    return found.select("doc_id", x["n_assign"].alias("n_assign"), x["n_access"].alias("n_access"), x["n_hex"].alias("n_hex"), F.sha2(listing(x["base"]), 256).alias("base_sha256"), listing(x["spans"]).alias("spans"))
