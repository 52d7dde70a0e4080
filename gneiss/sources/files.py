"""Readers and writers. All readers take a schema or read text columns; none infers types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, required: list[str] | None = None, sep: str = ",", **options) -> DataFrame:
    """A CSV with a header, all text; a byte-order mark before the first name is taken off."""
    df = spark.read.options(header=True, sep=sep, encoding="UTF-8", multiLine=True, quote='"', escape='"', **options).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if missing := sorted(set(required or ()) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def tsv(spark: SparkSession, path: str, key: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, count of those without) of a tab-separated table."""
    df = csv(spark, path, required, sep="\t")
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    return df.where(~blank), df.where(blank).agg(F.count("*").alias("skipped"))


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def lookup(rows: DataFrame, reference: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the first reference entry (by ``order``) of their key. The reference is reduced by an
    aggregate before the join."""
    cols = [c for c in reference.columns if c != key]
    first = reference.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return rows.join(first, key, "left").select(*rows.columns, *[F.col(f"_r.{c}").alias(c if c not in rows.columns else f"ref_{c}") for c in cols])


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A set of named tables, each a folder of Parquet, with their order in a small table."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(sheets.values())).sparkSession
    spark.createDataFrame(list(enumerate(sheets, 1)), "place int, sheet string").write.mode("overwrite").parquet(f"{path}/_order")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True).csv(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
