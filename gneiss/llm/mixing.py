"""Mixing sources to target weights.

Every row gets a hash-random key (MD5 of a seed and its id). Within a source the
keys define a random order; the mix takes the source's whole budget off the front
of that order, repeating full epochs when the budget exceeds the source. Nothing
sorts a whole source: the key's leading hex digits range-partition it, the
distributed prefix sum of words by (source, range) finds the one range in which
each source's cut lies, the next digits do the same within that range, and only the rows
of the range that is left are ordered. What is
taken of a row is then a map-side expression over one small row per source.

Defined cases: a null text has no words; a null source is a source of its own,
ranked last; rows with equal keys (repeated ids) at the cut share what is left in
proportion to their size, rounded down; an empty table gives an empty result; a
source without words has target 0; a very long text is one row of its size, cut like any other.
Columns of the input that clash with the result's names are not read unless named as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .shared import count_words, forget, fresh_path, materialize, table

#: A mixture names a weight for each source, so the table of sources is small by
#: nature. Beyond this number the caller has passed an id as the source.
MAX_SOURCES = 1_000_000

#: Hex digits of the key that make a range: 16**3 ranges per source, and as many in the range of
#: its cut, so that one in 16**6 of a source's rows is put in order.
RANGE_DIGITS = 3
LEVELS = 2


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: ``share`` of all words by weight, no source
    above ``most`` times its size, the excess shared again by weight until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


_PLAN = StructType([
    StructField("_src", StringType()), StructField("_n", LongType()), StructField("source_size", LongType()),
    StructField("target", DoubleType()), StructField("_epochs", LongType()), StructField("_rest", LongType()),
])


_RANGE = StructType([StructField("_n", LongType()), StructField("_src", StringType()), StructField("_to", StringType()), StructField("_before", LongType()), StructField("_rest", LongType())])


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, most=2.0, seed="mix-0", keep=()) -> DataFrame:
    """Rows of ``docs`` as (id, size, source_size, target, taken, source, *keep).
    ``taken`` is the words that the mix takes of the row, repeats counted: a value
    above ``size`` means whole epochs, a remainder means the row's first words."""
    spark = docs.sparkSession
    one = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_src"),
        count_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_key"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    path = fresh_path(spark, "mix-sizes")
    narrow = materialize(one.select("_src", "size", "_key"), "mix-sizes", path)
    part = F.substring("_key", 1, RANGE_DIGITS).alias("_range")
    sums = narrow.groupBy("_src", part).agg(F.sum("size").alias("w"))
    rows = sums.groupBy("_src").agg(F.sum("w").alias("w")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; a mixture needs a weight for each")
    sizes = {r["_src"]: int(r["w"] or 0) for r in rows}
    plan = []
    for n, (src, goal) in enumerate(targets(sizes, weights, share, most).items()):
        whole, budget = sizes[src], int(goal + 0.5)
        epochs = budget // whole if whole else 0
        plan.append((src, n, whole, float(goal), epochs, budget - epochs * whole))
    plans = spark.createDataFrame(plan, _PLAN)

    # The distributed prefix sum: words by (source, range), then the range of each source's cut, and
    # the same again within that range.
    inside, ranges, held = None, None, sums.withColumnRenamed("_range", "_to")
    for level in range(LEVELS):
        upto = Window.partitionBy("_src").orderBy("_to").rowsBetween(Window.unboundedPreceding, -1)
        by_range = held.withColumn("_before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
        known = (plans.withColumn("_from", F.lit(0).cast("long")) if ranges is None else ranges.withColumnRenamed("_before", "_from")).select("_n", F.col("_src").alias("_of"), "_rest", "_from")
        ranges = by_range.join(F.broadcast(known), F.col("_src").eqNullSafe(F.col("_of"))).select(
            "_n", F.col("_of").alias("_src"), "_to", (F.col("_from") + F.col("_before")).alias("_before"), "_rest", "w"
        ).where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("w")))
        # At most one row for each source: a literal table, so that what follows doesn't compute it again.
        found = ranges.select("_n", "_src", "_to", "_before", "_rest").collect()
        ranges = spark.createDataFrame([tuple(r) for r in found], _RANGE)
        at = narrow.withColumn("_to", F.substring("_key", 1, RANGE_DIGITS * (level + 1)))
        here = ranges.select("_n", F.col("_src").alias("_of"), F.col("_to").alias("_there"), "_before", "_rest")
        inside = at.join(F.broadcast(here), F.col("_src").eqNullSafe(F.col("_of")) & (F.col("_to") == F.col("_there"))).select("_n", "_src", "_key", "size", "_before", "_rest")
        if level + 1 < LEVELS:
            held = inside.groupBy("_src", F.substring("_key", 1, RANGE_DIGITS * (level + 2)).alias("_to")).agg(F.sum("size").alias("w"))
    within = Window.partitionBy("_n").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.groupBy("_n", "_key").agg(F.sum("size").alias("w"), F.first("_before").alias("_b"), F.first("_rest").alias("_r"))
        .withColumn("_b", F.col("_b") + F.coalesce(F.sum("w").over(within), F.lit(0)))
        .where((F.col("_b") <= F.col("_r")) & (F.col("_r") < F.col("_b") + F.col("w")))
        .select("_n", F.col("_key").alias("_cut"), (F.col("_r") - F.col("_b")).alias("_part"), F.col("w").alias("_tied"))
    )
    cuts = {r["_n"]: r for r in cut.collect()}  # at most one row per source
    forget(spark, path)
    full = [(*p, cuts[p[1]]["_cut"] if p[1] in cuts else "", int(cuts[p[1]]["_part"]) if p[1] in cuts else 0, int(cuts[p[1]]["_tied"]) if p[1] in cuts else 1) for p in plan]
    ended = spark.createDataFrame(full, StructType([*_PLAN.fields, StructField("_cut", StringType()), StructField("_part", LongType()), StructField("_tied", LongType())]))

    extra = F.when(F.col("_key") < F.col("_cut"), F.col("size")).when(F.col("_key") == F.col("_cut"), F.floor(F.col("size") * F.col("_part") / F.col("_tied"))).otherwise(F.lit(0))
    # _part < _tied and size <= _tied, so the product may pass 2**53 only for texts of over 10**7 words.
    joined = one.join(F.broadcast(ended), one["_src"].eqNullSafe(ended["_src"]))
    return joined.select(
        F.col("_id").alias(id_col), "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + extra).cast("long").alias("taken"),
        one["_src"].alias("source"), *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


# Targets: each source gets least(2 * size, weight * level), where level is the one
# at which they sum to 150%; it is found at the first source that its limit leaves open.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS whole,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT a.source, 2 * any_value(a.whole) / any_value(a.weight) AS lim,
         (1.5 * (SELECT sum(whole) FROM s) - coalesce(sum(2 * b.whole) FILTER (2 * b.whole / b.weight < 2 * a.whole / a.weight), 0))
         / sum(b.weight) FILTER (2 * b.whole / b.weight >= 2 * a.whole / a.weight) AS level
  FROM s a, s b GROUP BY a.source
), l AS (
  SELECT coalesce(arg_min(level, lim), 0) AS level FROM r WHERE level <= lim
), t AS (
  SELECT source, whole, least(2 * whole, weight * level) AS target FROM s, l
), p AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t
), c AS (
  SELECT d.*, CAST(p.whole AS BIGINT) AS source_size, p.target, p.budget,
         CASE WHEN p.whole > 0 THEN p.budget // CAST(p.whole AS BIGINT) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM c
"""
