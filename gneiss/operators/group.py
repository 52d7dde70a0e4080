"""Evidence about groups: modes, majorities, representatives, outliers, spreads."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import number
from .stage import materialize


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row for each key: the first in ``order`` (a natural order of the source)."""
    w = Window.partitionBy(*([keys] if isinstance(keys, (str, Column)) else keys)).orderBy(*([order] if isinstance(order, (str, Column)) else order))
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def arg_max(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The row of largest ``value`` for each key, ties by the smallest ``tie``; null keys are
    dropped. A struct aggregate, so it combines before the exchange."""
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t")))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(best.alias("_r")).select("_r.*")


def unique_mode(df: DataFrame, group: str, value: str, name: str = "mode") -> DataFrame:
    """(group, mode): the most frequent value, null where several are."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(group).agg(F.max("n").alias("n"))
    tied = counts.join(top, [group, "n"]).groupBy(group).agg(F.count("*").alias("k"), F.max(value).alias("v"))
    return tied.select(group, F.when(F.col("k") == 1, F.col("v")).alias(name))


def majority(df: DataFrame, group: str, value: str, order: str | None = None) -> DataFrame:
    """(group, majority, ratio): the most frequent value; ties go to the first seen by
    ``order``, or without it to the smallest value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), *([F.min(order).alias("seen")] if order else []))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "seen" if order else value)
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumns({"r": F.row_number().over(w), "t": total}).where("r = 1").select(group, F.col(value).alias("majority"), F.bround(F.col("n") / F.col("t"), 3).alias("ratio"))


def representative(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, representative, coverage): most frequent value, ties to the smallest; coverage is
    its share of the group's rows, to 3 places."""
    out = majority(df.where(F.col(value).isNotNull()), group, value)
    sizes = df.groupBy(group).agg(F.count("*").alias("members"))
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n")).withColumnRenamed(value, "representative")
    joined = sizes.join(out.withColumnRenamed("majority", "representative").drop("ratio"), group, "left").join(counts, [group, "representative"], "left")
    return joined.select(group, F.coalesce("representative", F.lit("Not supplied")).alias("representative"), F.bround(F.coalesce(F.col("n"), F.lit(0)) / F.col("members"), 3).alias("coverage"))


def quantiles(df: DataFrame, by: list[str], value: str, places=(0.25, 0.75)) -> DataFrame:
    """(by..., n, q): how many values a group has, and its quantiles by linear interpolation, exact; null values don't count. As ``percentile``, but no
    task holds a group's values: they are counted in bands that narrow in two steps, and only the band that a wanted rank lies in is sorted. The bands found are
    written, so that their size is known: where they are few, rows meet them where they are."""
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], (F.col(value) + 0.0).alias("_v")).where("_v IS NOT NULL")
    same = lambda a, b, names: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    # Bands by sign and magnitude, 1,024 to a doubling; then 65,536 of equal width in each that is wanted.
    first = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * (1_200_000 + F.floor(F.least(F.log2(F.abs("_v")) * 1024, F.lit(1_100_000.0)))))
    banded = rows.withColumn("_a", first.cast("long"))
    bands = materialize(banded.groupBy(*keys, "_a").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-bands")
    groups = bands.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    at = lambda f, p: f((F.col("_n") - 1) * p).cast("long")
    ranks = groups.select(*keys, F.explode(F.array_distinct(F.array(*[at(f, p) for p in places for f in (F.floor, F.ceil)]))).alias("_rank"))

    def holding(counted: DataFrame, wanted: DataFrame, inside: list[str], order: str) -> DataFrame:
        """The rows of ``counted`` that hold a wanted rank; ranks are those from the start of what they are inside of."""
        upto = F.sum("_c").over(Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        run = counted.withColumn("_upto", upto).alias("r")
        found = run.join(wanted.alias("w"), same("r", "w", inside) & (F.col("w._rank") < F.col("r._upto")) & (F.col("w._rank") >= F.col("r._upto") - F.col("r._c")))
        return found.select("r.*", (F.col("w._rank") - F.col("r._upto") + F.col("r._c")).alias("_rank"), *[F.col(f"w.{c}") for c in wanted.columns if c == "_whole"])

    wide = materialize(holding(bands, ranks.withColumn("_whole", F.col("_rank")), keys, "_a"), "quantile-wide")
    held = banded.alias("b").join(wide.select(*keys, "_a", "_lo", "_hi").distinct().alias("h"), same("b", "h", [*keys, "_a"])).select("b.*", "_lo", "_hi")
    fine = held.withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 65536)).otherwise(F.lit(0)).cast("long"))
    slim = fine.groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_c"))
    narrow = materialize(holding(slim, wide.select(*keys, "_a", "_rank", "_whole"), [*keys, "_a"], "_b").select(*keys, "_a", "_b", "_rank", "_whole"), "quantile-narrow")
    values = fine.alias("f").join(narrow.select(*keys, "_a", "_b").distinct().alias("g"), same("f", "g", [*keys, "_a", "_b"])).groupBy(*[F.col(f"f.{c}").alias(c) for c in (*keys, "_a", "_b", "_v")]).agg(F.count("*").alias("_c"))
    exact = holding(values, narrow, [*keys, "_a", "_b"], "_v").groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_whole", "_v"))).alias("_of"))

    def quantile(p: float) -> Column:
        place, lower, upper = (F.col("_n") - 1) * p, at(F.floor, p), at(F.ceil, p)
        a, b = F.try_element_at("_of", lower), F.try_element_at("_of", upper)
        return F.when((lower == upper) | (a == b), a).otherwise((upper - place) * a + (place - lower) * b)

    return groups.alias("g").join(exact.alias("e"), same("g", "e", keys)).select(*[F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)], F.col("_n").alias("n"), F.array(*[quantile(p) for p in places]).alias("q"))


def fences(df: DataFrame, group: str, value: str, factor: float = 1.5) -> DataFrame:
    """(group, n, low, high): interquartile fences by linear interpolation; null fences where
    fewer than 4 values or no spread make them meaningless."""
    v = number(F.col(value))
    stats = quantiles(df.select(group, v.alias("v")), [group], "v")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    usable = (F.col("n") >= 4) & (q3 > q1)
    return stats.select(group, "n", F.when(usable, q1 - factor * (q3 - q1)).alias("low"), F.when(usable, q3 + factor * (q3 - q1)).alias("high"))


def outliers(df: DataFrame, key: str, group: str, value: str, factor: float = 1.5) -> DataFrame:
    """(key, group, value) strictly outside its group's fences. These are written first, so that their size is known: where they are few, rows
    meet them where they are, and a group of many rows is no task's."""
    v = number(F.col(value))
    return df.select(key, group, v.alias(value)).join(materialize(fences(df, group, value, factor), "fences"), group).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).select(key, group, value)


def outlier_lists(df: DataFrame, key: str, group: str, columns: list[str], factor: float = 1.5) -> DataFrame:
    """(key, outlier_columns, not_assessed): by row the columns in which it lies outside its
    group's fences, by group those with fewer than 4 values; both in the order given. One unpivot
    and one aggregate serve all columns."""
    long = df.where(F.col(group).isNotNull()).select(key, group, F.posexplode(F.array(*[number(F.col(c)) for c in columns])).alias("p", "v"))
    stats = materialize(quantiles(long, [group, "p"], "v"), "quartiles")
    n = F.coalesce(F.col("n"), F.lit(0))
    spread = F.col("q")[1] - F.col("q")[0]
    low, high = F.col("q")[0] - factor * spread, F.col("q")[1] + factor * spread
    out = (n >= 4) & (spread > 0) & ((F.col("v") < low) | (F.col("v") > high))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("p") + 1)
    marked = long.join(stats, [group, "p"], "left").select(key, "p", F.when(out, name).alias("o"), F.when(n < 4, name).alias("x"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("p", F.col(c).alias("c"))))), lambda s: s["c"])
    return marked.groupBy(key).agg(listed("o").alias("outlier_columns"), listed("x").alias("not_assessed"))


def joined_values(value: Column, empty: str = "Not supplied") -> Column:
    """Aggregate: sorted distinct non-empty values, "; " between."""
    v = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(v)), "; "), F.lit("")), F.lit(empty))


def first_values(df: DataFrame, group: str, value: str, order: str, limit: int = 6, empty: str = "Not assessed") -> DataFrame:
    """(group, values): distinct values in the order first seen, at most ``limit`` shown."""
    seen = df.where(F.nullif(F.trim(value), F.lit("")).isNotNull()).groupBy(group, F.trim(value).alias("v")).agg(F.min(order).alias("o"))
    listed = seen.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda s: s["v"]).alias("vs"))
    text = F.concat(F.array_join(F.slice("vs", 1, limit), "; "), F.when(F.size("vs") > limit, F.lit("; additional values present")).otherwise(F.lit("")))
    return df.select(group).distinct().join(listed, group, "left").select(group, F.coalesce(text, F.lit(empty)).alias("values"))


def min_max_scaled(value: Column, over: Window) -> Column:
    """(v - min) / (max - min) in the window; null counts as the smallest, no spread as 0."""
    v = number(value)
    low, high = F.min(v).over(over), F.max(v).over(over)
    return F.when(high > low, (F.coalesce(v, low) - low) / (high - low)).otherwise(F.lit(0.0))


def z_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and divided by their population deviation (0 counts as 1e-8)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1e-8).otherwise(F.col(f"_s_{c}")) for c in columns})
    return out.select(*df.columns)


def centroid_outside(df: DataFrame, key: str, group: str, vector: str, dims: int) -> DataFrame:
    """(key, group, distance, outside): distance to the group's mean vector, outside beyond 2 * sqrt(dims)."""
    long = df.select(key, group, F.posexplode(vector).alias("p", "v"))
    means = long.groupBy(group, "p").agg(F.avg("v").alias("m"))
    d = long.join(means, [group, "p"]).groupBy(key, group).agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("distance"))
    return d.select(key, group, "distance", (F.col("distance") > 2 * dims**0.5).alias("outside"))


def frequency(df: DataFrame, value: str, limit: int = 12, empty: str = "Not available") -> DataFrame:
    """(label, n): the ``limit`` most frequent values of a report, ties by label."""
    label = F.coalesce(F.nullif(F.trim(F.col(value).cast("string")), F.lit("")), F.lit(empty))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(limit)


def spans(df: DataFrame, group: str, column: str, name: str = "span") -> DataFrame:
    """(group, name): the difference of the largest and the smallest number of a group; null without a number."""
    v = F.col(column)
    return df.groupBy(group).agg((F.max(v) - F.min(v)).alias(name))


def distinct_counts(df: DataFrame, group: str, columns: list[str], words: tuple[str, ...] = ("",)) -> DataFrame:
    """(group, n_<column> ...): how many different values each column has in a group, case and blanks at the ends apart;
    missing ones, and the ``words`` for it, don't count."""
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    return df.groupBy(group).agg(*[F.count_distinct(F.when(~text(c).isin(*words), text(c))).alias(f"n_{c}") for c in columns])


def majority_profile(df: DataFrame, group: str, items: str, sep: str = ";") -> DataFrame:
    """(group, common_profile): the set of items that most rows of a group have, written in order; null where
    two sets are equally frequent. A row without items has the empty set."""
    one = df.select(group, F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col(items), F.array().cast("array<string>")))), sep).alias("_p"))
    return unique_mode(one, group, "_p", "common_profile")
