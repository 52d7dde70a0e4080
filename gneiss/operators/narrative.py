"""Deterministic texts about clusters, packets for review, and small export helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .group import joined_values


def packets(df: DataFrame, group: str, classes: str, groups: str, summary: str, fields: list[str], order: str, version: str = "1") -> DataFrame:
    """(group, member_count, classes, groups, uncertainty, cache_key): aggregates only, no member's own
    data; the key is a digest of all evidence fields of all members in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), text(c)) for c in fields])
    hashed = df.select(group, classes, groups, summary, F.struct(F.col(order).alias("o"), F.sha2(row, 256).alias("h")).alias("m"))
    return hashed.groupBy(group).agg(
        F.count("*").alias("member_count"), joined_values(F.col(classes), "").alias("classes"), joined_values(F.col(groups), "").alias("groups"), joined_values(F.col(summary), "").alias("uncertainty"),
        F.sha2(F.concat_ws("|", F.lit(version), F.first(F.col(group).cast("string")), F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["h"]), "|")), 256).alias("cache_key"),
    )


def latest_by_key(cache: DataFrame, key: str, payload: str, at: str) -> DataFrame:
    return cache.groupBy(key).agg(F.max_by(payload, at).alias(payload))


def member_text(rationale: Column, parameters: Column, boundary: Column) -> Column:
    """What is said of a member without any model."""
    or_ = lambda v, d: F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit(d))
    return F.concat(
        F.lit("Cluster membership rationale:\n"), or_(rationale, "Deterministic membership evidence is unavailable."),
        F.lit("\n\nSupporting parameters:\n"), or_(parameters, "Not supplied."),
        F.lit("\n\nBoundary and limitations:\n"), or_(boundary, "SME review is required before analogue selection, read-across, or endpoint-specific assessment."),
    )


def class_reason(existing: Column, cluster: Column, gate: Column, compatibility: Column) -> Column:
    """The existing reason, else gate and compatibility, else what is missing."""
    real = lambda v, *w: F.when(~F.lower(F.trim(v)).isin("", *w), F.trim(v))
    have, c, g, p = real(existing, "nan", "none", "not available"), real(cluster, "not assessable"), real(gate), real(compatibility)
    return (
        F.when(have.isNotNull(), have)
        .when(c.isNull(), F.lit("Not assessable: no valid standardized structure is available for structural clustering."))
        .when(g.isNotNull() & p.isNotNull(), F.concat(g, F.lit(". "), p))
        .otherwise(F.coalesce(g, F.lit("Cluster assignment requires SME review.")))
    )


def retained_alerts(alerts: Column, has_metal: Column) -> Column:
    """Alerts without the heavy-metal one, unless there is such a metal."""
    return F.filter(alerts, lambda a: (F.lower(F.trim(a)) != "heavy_metal") | has_metal)


def fast_fail(name: Column) -> Column:
    """Whether a name can be given up without a look-up."""
    from .tables import FAST_FAIL

    out = F.lit(False)
    for w in FAST_FAIL:
        out = out | F.lower(F.coalesce(name, F.lit(""))).contains(w)
    return out


def letters(position: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, up to three letters."""
    p = position.cast("int")
    one = lambda v: F.chr(F.lit(65) + F.pmod(v, F.lit(26)))
    second, third = F.floor(p / 26).cast("int") - 1, F.floor((F.floor(p / 26) - 1) / 26).cast("int") - 1
    return F.concat(F.when(third >= 0, one(third)).otherwise(F.lit("")), F.when(second >= 0, one(second)).otherwise(F.lit("")), one(p))


def flatten_metadata(value, prefix: str = "") -> list[tuple[str, object]]:
    """(path, value) of nested metadata; an empty list is one blank row."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flatten_metadata(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flatten_metadata(v, f"{prefix}[{i}]")]
    return [(prefix, "" if value is None or value == [] else value)]


def decision_counts(df: DataFrame, group: str, decision: str) -> DataFrame:
    return df.groupBy(group).agg(*[F.count_if(F.col(decision).contains(x)).alias(x.lower()) for x in ("PASS", "WARNING", "FAIL")])


def row_coverage(columns: list[str]) -> Column:
    """Share of columns that have a value, to 3 places."""
    return F.bround(sum((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int") for c in columns) / F.lit(float(len(columns))), 3)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A mirror of some columns under other names, in the order given."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def guide(spark, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "place int, topic string, text string")
