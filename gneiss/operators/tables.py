"""Ingest, export and audit of tables: names and amounts, forward fill, contracts, orders,
differences, dashboards, graphs."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_name, parse_amount, present
from .stage import fresh_path, materialize, scratch

# ---- ingest ----


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def column_like(df: DataFrame, token: str) -> str | None:
    """The first column whose lower-case name contains the token."""
    return next((c for c in df.columns if token.lower() in c.lower()), None)


def forward_fill(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.nullif(F.col(c), F.lit("")), True).over(w) for c in columns})


def captions(lines: DataFrame, page: str = "page", no: str = "line_no", text: str = "line") -> DataFrame:
    """Table captions of page lines: number and description, taken from the next line where its own
    has none; footnotes are no captions; a (page, caption) counts once."""
    nxt = F.lead(text).over(Window.partitionBy(page).orderBy(no))
    m = lines.withColumn("_next", nxt).where(F.col(text).rlike(r"(?i)^\s*table\s+[0-9A-Z.\-]+\s*[:.]?") & ~F.col(text).rlike(r"(?i)^\s*(note|\*|†)"))
    own = F.trim(F.regexp_extract(text, r"(?i)^\s*table\s+[0-9A-Z.\-]+\s*[:.]?\s*(.*)$", 1))
    out = m.select(page, no, F.regexp_extract(text, r"(?i)^\s*(table\s+[0-9A-Z.\-]+)", 1).alias("caption"), F.coalesce(F.nullif(own, F.lit("")), F.trim("_next"), F.lit("")).alias("description"))
    first = F.row_number().over(Window.partitionBy(page, "caption").orderBy(no))
    return out.withColumn("_r", first).where("_r = 1").drop("_r")


def reduce_records(df: DataFrame, name: str, amount: str, order: str) -> DataFrame:
    """One row per reported name: that of the largest amount, ties the first; names are cleaned.
    Where no cleaned name is left at all, the rows pass unreduced."""
    made = df.withColumns({"cleaned_name": clean_name(F.col(name)), "amount": parse_amount(F.col(amount))})
    real = made.where((F.col("cleaned_name") != "") & F.col(name).isNotNull())
    if real.isEmpty():
        return made
    w = Window.partitionBy(name).orderBy(F.col("amount").desc(), order)
    return real.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# ---- identity ----

# Openings of carbon-chain names that must not differ between a name and its correction.
CHAINS = ("meth", "eth", "prop", "but", "pent", "hex", "hept", "oct", "non", "dec")


def rescue_reason(name: str, match: str, ratio: float) -> str | None:
    """Why an unresolved name may borrow the structure of a resolved one, or None."""
    a, b = name.lower(), match.lower()
    strip = lambda p, s: re.sub(p, "", s).strip()
    for pattern, why in ((r"\(n=\d+\)", "Homologue"), (r"\s*(related compound|isomer of|derivative|isomer)\s*", "Related Compound/Isomer")):
        if strip(pattern, a) and strip(pattern, a) == strip(pattern, b):
            return f"Surrogate SMILES ({why})"
    same_digits = re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    same_chains = all((p in a) == (p in b) for p in CHAINS)
    return "Surrogate SMILES (Typo Corrected)" if ratio >= 0.85 and same_digits and same_chains else None


#: A sequence ratio from which a name may stand for another, and what a name inside a longer one counts as.
RESCUE_RATIO, INSIDE_RATIO, INSIDE_LENGTH = 0.85, 0.95, 6


#: Keys that a name is looked up by; one with more meets the known names block against block.
LOOKUPS = 4096
#: Known names from this length on have letters that ``difflib`` leaves out.
COMMON_LEFT_OUT = 200


def _letters(words: list[str], width: int = 64) -> np.ndarray:
    """Letters of each word, counted by their code modulo ``width``."""
    out = np.zeros((len(words), width), np.int32)
    for r, w in enumerate(words):
        codes, n = np.unique(np.fromiter(map(ord, w), np.int64, len(w)) % width, return_counts=True)
        out[r, codes] = n
    return out


def _score(name: str, known: str, long: bool, matcher: difflib.SequenceMatcher) -> float:
    """The ratio of two lower-cased names, ``INSIDE_RATIO`` where that is too small and ``known`` is long and inside ``name``."""
    matcher.set_seqs(name, known)
    r = matcher.ratio()
    return INSIDE_RATIO if r < RESCUE_RATIO and long and known in name else r


def best_names(names: list[str], known: list[str], least: list[float] | None = None) -> list[tuple[int, float]]:
    """For each name the place of the known one of the highest ratio from ``RESCUE_RATIO`` (and the name's ``least``) up, the first of
    equals, or -1. Only names whose common letters allow that ratio, or one inside the other, are compared, the most promising first."""
    low, kl = [n.lower() for n in names], [k.lower() for k in known]
    sizes, long = np.array([len(k) for k in kl], np.int32), np.array([len(k) >= INSIDE_LENGTH for k in known], bool)
    counts = np.ascontiguousarray(_letters(kl).T)
    out, matcher = [], difflib.SequenceMatcher()
    for name, have, floor in zip(low, _letters(low), least or [RESCUE_RATIO] * len(low), strict=True):
        common = np.zeros(len(kl), np.int32)
        for c in np.flatnonzero(have):
            common += np.minimum(counts[c], have[c])
        bound = 2.0 * common / (len(name) + sizes)
        bound[(common == sizes) & long & (bound < INSIDE_RATIO)] = INSIDE_RATIO
        near = np.flatnonzero(bound >= floor)
        best, top = -1, floor
        for k in near[np.argsort(-bound[near], kind="stable")]:
            if bound[k] < top:
                break
            r = _score(name, kl[k], bool(long[k]), matcher)
            if r > top or r == top and (best < 0 or k < best):
                best, top = int(k), r
        out.append((best, top if best >= 0 else 0.0))
    return out


def _without_one(names: DataFrame, low: str, *keep: str) -> DataFrame:
    """``keep`` and the hash ``h`` of each name's text without one of its letters."""
    n = F.length(low)
    each = names.select("batch", low, *[k for k in keep if k not in ("batch", low)], F.explode(F.sequence(F.lit(1), n)).alias("i"))
    return each.select(*keep, F.xxhash64("batch", F.concat(F.substring(low, F.lit(1), F.col("i") - 1), F.substring(low, F.col("i") + 1, n))).alias("h"))


def _looked_up(asked: DataFrame, heads: DataFrame) -> DataFrame:
    """(batch, low, score, at): the best known name among those inside a name, equal to it or one letter from it. Texts meet by
    hashes, and every pair is compared."""
    low, size = F.col("low"), F.length("low")
    brief = asked.where("not wide").withColumn("of", F.xxhash64("batch", "low"))
    own = brief.select("of", F.col("of").alias("h"))
    cut = brief.select("batch", "low", "of", F.explode("inner").alias("k")).where(F.col("k") < size)
    cut = cut.select("batch", "low", "of", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("i"))
    inside = cut.select("of", F.xxhash64("batch", F.substring("low", F.col("i"), F.col("k"))).alias("h"))
    shorter = _without_one(brief.where(F.array_contains("sizes", size - 1)), "low", "of")
    known = heads.select("batch", F.col("low").alias("klow"), "long", "at", F.xxhash64("batch", "low").alias("h"))
    keys = own.unionByName(inside).unionByName(shorter).join(known.select("h"), "h", "left_semi")  # few keys are those of a name
    longer = _without_one(known.where(F.length("klow") <= LOOKUPS + 1), "klow", "batch", "klow", "long", "at")
    met = keys.join(known, "h").unionByName(own.join(longer, "h")).drop("h").join(brief.select("batch", "low", "of"), ["batch", "of"])

    # A short known name that is inside a name is its longest common part, and all of it.
    plain = F.contains(low, F.col("klow")) & (F.length("klow") < COMMON_LEFT_OUT)
    ratio = 2.0 * F.length("klow") / (F.length("klow") + size)
    closed = met.where(plain).withColumn("score", F.when((ratio < RESCUE_RATIO) & F.col("long"), F.lit(INSIDE_RATIO)).otherwise(ratio))

    def scores(names: pd.Series, others: pd.Series, long: pd.Series) -> pd.Series:
        matcher = difflib.SequenceMatcher()
        return pd.Series([_score(n, k, bool(w), matcher) for n, k, w in zip(names, others, long, strict=True)], dtype=float)

    compared = met.where(~plain).withColumn("score", F.pandas_udf(scores, "double")("low", "klow", "long"))
    both = closed.unionByName(compared).where(F.col("score") >= RESCUE_RATIO)
    best = both.groupBy("batch", "low").agg(F.min(F.struct((-F.col("score")).alias("r"), "at")).alias("best"))
    return best.select("batch", "low", (-F.col("best.r")).alias("score"), F.col("best.at").alias("at"))


def _can_be_better() -> Column:
    """Whether a known name two letters or more away could reach ``least``, by the lengths of those that there are."""

    def reaches(k: Column) -> Column:
        total = F.length("low") + k
        apart = F.greatest(F.abs(F.length("low") - k), 2 + F.pmod(total, F.lit(2)))
        return 2.0 * F.floor((total - apart) / 2) / total >= F.col("least")

    return F.exists("sizes", reaches)


def fuzzy_rescue(unresolved: DataFrame, resolved: DataFrame, name: str, batch: str | None = None, order: str | None = None, block: int = 2048) -> DataFrame:
    """(batch, name, match, ratio, reason) of each row of ``unresolved`` with a name, against the resolved names of
    its batch (null is a batch of its own). ``ratio`` is that of the best name, the first in ``order`` (null first; without
    it by text) of equals, and null where none reaches the least ratio; ``match`` is null too where the chemistry
    forbids it. Names are looked up first by their parts and by their texts without a letter. Only those for which a name further away
    could be as good as what was found meet the known names, block against block: no task gets more than two blocks of about ``block`` names."""
    at = F.col(batch) if batch else F.lit(0)
    kind = unresolved.schema[batch].dataType.simpleString() if batch else "int"
    lower = F.pandas_udf(lambda names: pd.Series([n.lower() for n in names], dtype=object), "string")
    trimmed = lambda df, *more: df.select(F.struct(at.alias("b")).alias("batch"), F.trim(F.col(name)).alias("name"), *more).where("name <> ''")
    rows = trimmed(unresolved).withColumn("low", lower("name"))
    first = trimmed(resolved, (F.col(order) if order else F.trim(F.col(name))).alias("o")).groupBy("batch", "name").agg(F.min("o").alias("o"))
    o = first.schema["o"].dataType.simpleString()
    # Names that differ in their letters' case alone have the same ratio; the first stands for all.
    cased = first.withColumns({"low": lower("name"), "long": F.length("name") >= INSIDE_LENGTH})
    spark, path = unresolved.sparkSession, fresh_path(unresolved.sparkSession, "rescue-best")
    with scratch(spark, [path]):
        heads = materialize(cased.groupBy("batch", "low", "long").agg(F.min(F.struct("o", "name")).alias("at")), "rescue-known")
        lengths = heads.groupBy("batch").agg(F.collect_set(F.length("low")).alias("sizes"), F.collect_set(F.when(F.col("long"), F.length("low"))).alias("inner"))
        # Without a batch there is one row of lengths, and the join has no key left.
        lookups = 1 + F.length("low") + F.aggregate("inner", F.lit(0).cast("long"), lambda n, k: n + F.greatest(F.length("low") - k + 1, F.lit(0)))
        asked = materialize(rows.select("batch", "low").distinct().join(lengths if batch else F.broadcast(lengths), "batch").withColumn("wide", lookups > LOOKUPS), "rescue-asked")
        found = asked.join(_looked_up(asked, heads), ["batch", "low"], "left").withColumn("least", F.coalesce("score", F.lit(RESCUE_RATIO)))
        found = materialize(found.select("batch", "low", "score", "at", "least", (F.col("wide") | _can_be_better()).alias("open")), "rescue-found")

        n = lambda out: F.ceil(F.count("*") / block).cast("int").alias(out)
        still = found.where("open")
        shape = still.groupBy("batch").agg(n("np")).join(heads.groupBy("batch").agg(n("nq")), "batch")

        def cells(df: DataFrame, side: int, own: str, n: str, other: str, m: str) -> DataFrame:
            placed = df.join(shape, "batch").withColumn(own, F.pmod(F.xxhash64("low"), F.col(n)).cast("int"))
            return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).select("batch", "p", "q", F.lit(side).alias("side"), "name", "o", "least")

        asking = still.select("batch", "low", F.col("low").alias("name"), F.lit(None).cast(o).alias("o"), "least")
        known = heads.select("batch", "low", "at.name", "at.o", F.lit(None).cast("double").alias("least"))
        each = cells(asking, 0, "p", "np", "q", "nq").unionByName(cells(known, 1, "q", "nq", "p", "np"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values(["o", "name"], na_position="first")
            known, orders = b["name"].to_list(), b["o"].to_list()
            found = [(r, *kr) for r, kr in enumerate(best_names(a["name"].to_list(), known, a["least"].to_list())) if kr[0] >= 0]
            rows = [(a["batch"].iloc[r]["b"], a["name"].iloc[r], known[k], None if pd.isna(orders[k]) else orders[k], ratio) for r, k, ratio in found]
            return pd.DataFrame(rows, columns=["b", "low", "match", "o", "ratio"], dtype=object)

        def reasons(names: pd.Series, matches: pd.Series, ratios: pd.Series) -> pd.Series:
            return pd.Series([rescue_reason(n, m, r) for n, m, r in zip(names, matches, ratios, strict=True)], dtype=object)

        near = each.groupBy("batch", "p", "q").applyInPandas(run, f"b {kind}, low string, match string, o {o}, ratio double")
        near = near.select(F.struct("b").alias("batch"), "low", F.col("ratio").alias("score"), F.struct("o", F.col("match").alias("name")).alias("at"))
        best = found.where("at is not null").select("batch", "low", "score", "at").unionByName(near)
        best = best.groupBy("batch", "low").agg(F.min(F.struct((-F.col("score")).alias("r"), "at")).alias("best"))
        best = best.select("batch", "low", F.col("best.at.name").alias("match"), (-F.col("best.r")).alias("ratio"))
        judged = materialize(best.withColumn("why", F.pandas_udf(reasons, "string")("low", "match", "ratio")), "rescue-best", path)
    return rows.join(judged, ["batch", "low"], "left").select(
        F.col("batch.b").alias("batch"), "name", F.when(F.col("why").isNotNull(), F.col("match")).alias("match"), F.round("ratio", 6).alias("ratio"),
        F.coalesce("why", F.lit("Tier 3: Class Fallback Required (No Structure)")).alias("reason"),
    )


def merge_identity(supplied: DataFrame, lookup: DataFrame, key: str, fields: list[str], status: str) -> DataFrame:
    """Supplied fields stay; blanks are filled from the lookup; its status wins unless unresolved."""
    look = lookup.select(key, *[F.col(f).alias(f"_l_{f}") for f in fields], F.col(status).alias("_l_status"))
    j = supplied.join(look, key, "left")
    use = present(F.col("_l_status")).isNotNull() & ~F.lower("_l_status").contains("unresolved")
    return j.select(key, *[F.coalesce(present(F.col(f).cast("string")), F.col(f"_l_{f}").cast("string")).alias(f) for f in fields], F.when(use, F.col("_l_status")).otherwise(F.col(status)).alias(status))


# Names that stand for a family, a mixture or an unknown, and need no look-up.
NOT_A_NAME = (
    r"\brelated\s+compound\b",
    r"\bloss\s+of\b",
    r"\bdegradant\b",
    r"\badduct\b",
    r"\b(?:co)?polymer\b",
    r"\bpoly[a-z]*\b",
    r"\b(?:di|tri|tetra)mer\b",
    r"\bunknown\b",
    r"\bunidentified\b",
    r"\bnot\s+given\b",
    r"\bmixture\b",
    r"\bcompound\s*\d+\b",
    r"\b(?:cyanox|irganox|tinuvin)\b",
    r"\(\s*[nc]\s*=\s*\d+\s*\)",
    r"\bc\s*=\s*\d+\b",
)
FAST_FAIL = ("poly(", "copolymer", "related", "degradant", "adduct", "dimer", "trimer", "unknown", "unidentified")


def name_eligible(name: Column, most: int = 180) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n != "") & (F.length(n) <= most) & ~n.rlike("(?i)" + "|".join(NOT_A_NAME))


def input_errors(cas: Column, formula: Column, name: Column) -> Column:
    c, f, n = (F.trim(F.coalesce(v, F.lit(""))) for v in (cas, formula, name))
    return F.array_compact(F.array(
        F.when((c == "") & (f == "") & (n == ""), F.lit("nothing_supplied")), F.when((c != "") & ~c.rlike(r"^\d{2,7}-\d{2}-\d$"), F.lit("bad_cas")),
        F.when((f != "") & ~f.rlike(r"^([A-Z][a-z]?\d*)+$"), F.lit("bad_formula")),
    ))


# ---- curation ----


def curation_route(name: Column, structure: Column, original: Column, valid: Column, cas: Column) -> Column:
    """struct(status, tier, eligibility) of a row for a reviewer."""
    blank = present(structure, ("", "nan", "none", "null")).isNull() & present(original, ("", "nan", "none", "null")).isNull()
    vague = F.coalesce(name, F.lit("")).rlike(r"(?i)\b(related compound|loss of|c=\d+)\b")
    status = F.when(~blank & valid, F.lit("Structured")).when(vague, F.lit("Ambiguous identity")).when(blank, F.lit("Needs structure")).otherwise(F.lit("Invalid structure"))
    has_cas = present(cas, ("", "not given", "nan", "none")).isNotNull()
    tier = F.when(status == "Structured", F.lit("Structure available")).when(status == "Ambiguous identity", F.lit("Insufficient identity evidence")).when(has_cas, F.lit("CASRN supplied — verify scope")).otherwise(F.lit("Name-only evidence"))
    use = F.when(status == "Structured", F.lit("Eligible")).when(status == "Ambiguous identity", F.lit("Ineligible until identity is approved")).otherwise(F.lit("Ineligible until structure is reviewer-approved"))
    return F.struct(status.alias("status"), tier.alias("tier"), use.alias("eligibility"))


def differences(current: DataFrame, baseline: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(key, field, baseline_value, current_value, change) of changed fields; of repeated baseline
    keys the last counts. Both sides are unpivoted after the join, so it is one exchange each."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    base = baseline.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(f"_b_{f}").alias("baseline_value"), text(f).alias("current_value")) for f in fields]))
    long = current.select(key, *fields).join(base, key, "left").select(key, pairs.alias("p")).select(key, "p.*")
    return long.where("baseline_value <> current_value").withColumn("change", F.when(F.col("baseline_value") == "", F.lit("Added field")).otherwise(F.lit("Changed")))


# ---- export ----


def apply_contract(df: DataFrame, contract: list[str], retired: list[str] = (), renames: dict[str, str] | None = None) -> DataFrame:
    """Contract columns in order (absent ones blank), then further columns; retired ones dropped."""
    out = df
    for old, new in (renames or {}).items():
        if old in out.columns:
            out = out.drop(old) if new in out.columns else out.withColumnRenamed(old, new)
    extras = [c for c in out.columns if c not in contract and c not in retired]
    return out.select(*[F.col(f"`{c}`") if c in out.columns else F.lit("").alias(c) for c in contract], *[F.col(f"`{c}`") for c in extras])


def contract_table(spark, contract: list[str], definitions: dict[str, str], retired: list[str] = ()) -> DataFrame:
    rows = [(i, c, definitions.get(c, ""), "active") for i, c in enumerate(contract, 1)] + [(None, c, "", "retired") for c in retired]
    return spark.createDataFrame(rows, "place int, column string, definition string, state string")


def release_errors(df: DataFrame, required: list[str], retired: list[str], status: str, decision: str) -> list[str]:
    """What stands against an export; one aggregate over the rows."""
    errors = [f"missing:{c}" for c in required if c not in df.columns] + [f"retired:{c}" for c in retired if c in df.columns]
    if status in df.columns and decision in df.columns:
        bad = df.agg(F.count_if(F.lower(status).contains("unresolved") & F.upper(decision).isin("PASS", "INSIDE")).alias("n")).first()["n"]
        errors += ["unresolved_pass"] if bad else []
    return errors


def export_order(cluster: str, group: str, size: str, name: str) -> list[Column]:
    """Clustered rows first, then by group and cluster number, larger clusters, and name."""
    number = lambda c: F.coalesce(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(999_999))
    return [F.coalesce(F.col(cluster), F.lit("")).startswith("Cluster_").desc(), number(group), number(cluster), F.col(size).desc(), F.col(name)]


def reconcile(df: DataFrame, has_structure: Column, texts: dict[str, str], reason: str, identity: str) -> DataFrame:
    """Rows without a structure get the fixed review texts; a surrogate identity gets its reason; a
    stale reason of a resolved row is cleared."""
    out = df.withColumns({c: F.when(has_structure, F.col(c)).otherwise(F.lit(v)) for c, v in texts.items()})
    who = F.lower(F.coalesce(F.col(identity), F.lit("")))
    why = F.when(~has_structure, F.lit("Structure missing or invalid")).when(who.contains("surrogate"), F.concat(F.lit("Identity requires verification: "), F.col(identity))).when(who.isin("resolved", "exact match"), F.lit("")).otherwise(F.col(reason))
    return out.withColumn(reason, why)


# ---- graph ----


def graph_nodes(*sets: tuple[str, DataFrame, str, str]) -> DataFrame:
    """(label, id, name) of node sets (label, frame, id column, name column), each node once."""
    return union_all(*[df.select(F.lit(label).alias("label"), F.col(i).cast("string").alias("id"), F.col(n).cast("string").alias("name")) for label, df, i, n in sets]).distinct()


def graph_edges(*sets: tuple[str, str, str, DataFrame, str, str]) -> DataFrame:
    """(kind, from_label, from_id, to_label, to_id) of edge sets."""
    return union_all(*[df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit(k).alias("kind"), F.lit(la).alias("from_label"), F.col(a).cast("string").alias("from_id"), F.lit(lb).alias("to_label"), F.col(b).cast("string").alias("to_id")) for k, la, lb, df, a, b in sets]).distinct()


def merge_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(statement) texts that create the graph; quotes and backslashes in values are escaped."""
    q = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    n = nodes.select(F.format_string("MERGE (:%s {id: '%s', name: '%s'});", F.col("label"), q("id"), q("name")).alias("statement"))
    e = edges.select(F.format_string("MATCH (a:%s {id: '%s'}), (b:%s {id: '%s'}) MERGE (a)-[:%s]->(b);", F.col("from_label"), q("from_id"), F.col("to_label"), q("to_id"), F.col("kind")).alias("statement"))
    return n.unionByName(e)
