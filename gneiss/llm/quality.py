"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data: a rule names a statistic of the text and the range in which a
document is kept. ``flags`` compiles the table to boolean columns; ``statistics``
computes each statistic with built-in functions only. Everything about a document
is computed in its own row, so nothing is shuffled and no group can be hot.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``. Windows of five words are compared by a
64-bit hash; within one text of 20,000 words a false match has probability 1e-11.

Defined cases: a null or empty text has no words and is not kept; ties and repeated
rows are judged one by one, alike; very long texts are arrays of their words in one row's memory,
without a prefix; an empty table gives an empty result; further columns, whatever their names, are
carried and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, table, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the languages served, all without a claim to be complete.
STOP_WORDS = (
    "the of and to in a is that for it was with as on be at by are this from or an not "
    "der die und das ist ein eine zu den von mit sich auf nicht im dem des "
    "le la les de et un une que qui dans en pour est du au sur pas avec par "
    "el los las y que un una con por para es del se no lo su al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document whose ``statistic`` lies in [least, most]. Ratios say little on
    short texts: a rule applies from ``from_words`` words on."""

    name: str
    statistic: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Fixed by the base definition.
BASE = (
    Rule("too_short", "n_words", least=10),
    Rule("repetitive", "repeat_percent", most=20),
)
#: The method's own thresholds.
RULES = (
    Rule("word_length_low", "mean_word_chars", least=2.0),
    Rule("word_length_high", "mean_word_chars", most=14.0),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.02, from_words=50),
    Rule("dup_lines", "dup_line_ratio", most=0.5, from_words=20),
    Rule("bullets", "bullet_line_ratio", most=0.9, from_words=20),
    Rule("ellipsis", "ellipsis_line_ratio", most=0.5, from_words=20),
)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows found twice or more; ``hashes`` of the words in order."""
    n = F.size(hashes)
    starts = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        keyed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        at = let(keyed, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        # Each repeated window adds the words up to the next one's start, five at most.
        gaps = let(at, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    some = let(starts, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.lit(0)).otherwise(covered(s)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(some)


def statistics(docs: DataFrame, text_col: str = "text", out: str = "_q") -> DataFrame:
    """``docs`` with a struct column ``out`` of all statistics. The steps are kept apart
    so that words, lines and hashes are arrays in memory before lambdas read them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(ws: Column) -> Column:
        total = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
        low = F.transform(ws, lambda w: F.lower(w))
        stops = F.size(F.filter(low, lambda w: w.isin(STOP_WORDS)))
        repeats = let(F.transform(ws, lambda w: F.xxhash64(w)), _repeat_words)
        return F.struct(F.size(ws).cast("long").alias("n_words"), total.cast("long").alias("word_chars"), stops.alias("stops"), repeats.cast("long").alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
            F.size(F.filter(ls, lambda x: x.rlike(r"^\s*[-*•]\s"))).alias("bullets"),
            F.size(F.filter(ls, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).alias("dots"),
        )

    names = fresh(docs, "_w", "_l", "_s")
    w, ln, symbols = (F.col(c) for c in names)
    each = docs.withColumns({
        names[0]: let(words(F.col(text_col)), of_words),
        names[1]: let(lines, of_lines),
        names[2]: F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return each.withColumn(out, F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
        ln["dup"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        ratio(w["word_chars"], w["n_words"]).alias("mean_word_chars"), ratio(symbols, w["n_words"]).alias("symbols_per_word"),
        ratio(w["stops"], w["n_words"]).alias("stop_word_ratio"), ratio(ln["dup"], ln["n"]).alias("dup_line_ratio"),
        ratio(ln["bullets"], ln["n"]).alias("bullet_line_ratio"), ratio(ln["dots"], ln["n"]).alias("ellipsis_line_ratio"),
        ratio(100 * w["n_repeat_words"], w["n_words"]).alias("repeat_percent"),
    )).drop(*names)


def fails(rule: Rule, stats: str = "_q") -> Column:
    x = F.col(f"{stats}.{rule.statistic}")
    low = F.lit(False) if rule.least is None else x < rule.least
    high = F.lit(False) if rule.most is None else x > rule.most
    return (F.col(f"{stats}.n_words") >= rule.from_words) & (low | high)


def score(docs: DataFrame, text_col: str = "text", rules=RULES, base=BASE, out: str = "_q") -> DataFrame:
    """``docs`` with the struct ``out``: the statistics, base_failed, failed (names of the rules that
    fail) and kept."""
    (q,) = fresh(docs, "_q")
    base_failed = F.lit(False)
    for r in base:
        # The base rule compares whole numbers; 100 * n > 20 * m is exact.
        bad = 100 * F.col(f"{q}.n_repeat_words") > r.most * F.col(f"{q}.n_words") if r.statistic == "repeat_percent" else fails(r, q)
        base_failed = base_failed | bad
    failed = F.array_compact(F.array(*[F.when(fails(r, q), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    found = statistics(docs, text_col, q)
    known = [F.col(f"{q}.{c}").alias(c) for c in found.schema[q].dataType.names]
    judged = found.withColumn(q, F.struct(*known, base_failed.alias("base_failed"), failed.alias("failed")))
    kept = ~F.col(f"{q}.base_failed") & (F.size(f"{q}.failed") == 0)
    done = judged.withColumn(q, F.col(q).withField("kept", kept))
    return done if q == out else done.withColumn(out, F.col(q)).drop(q)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
e AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (lower(w) IN ({_STOPS})) AS stops FROM e GROUP BY rid),
g AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)
),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(5) t(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
ls AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup,
         count(*) FILTER (regexp_matches(l, '^\s*[-*\x{{2022}}]\s')) AS bullets, count(*) FILTER (regexp_matches(l, '(\.\.\.|\x{{2026}})\s*$')) AS dots
  FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
),
s AS (
  SELECT d.doc_id, coalesce(ws.n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(stops, 0) AS stops, coalesce(n, 0) AS n, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots
  FROM d LEFT JOIN ws USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN ls USING (rid)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3
  AND NOT (n_words >= 50 AND stops / n_words < 0.02)
  AND NOT (n_words >= 20 AND (n_dup_lines / n > 0.5 OR bullets / n > 0.9 OR dots / n > 0.5)) AS kept
FROM b
"""
