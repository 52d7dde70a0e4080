"""The corpus pipeline: five stages from raw documents to a weighted mix.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs``, whatever other
columns there are and whatever their names.

Defined cases: a null or empty text, and one without a letter, has no language and goes in the first stage; null ids are documents
like others, told apart by their texts; of repeated rows one stays; ties of the smallest id go to the smallest key; very long texts are
taken whole by every stage; an empty table, or one without a labelled row, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import decontam, langid, mixing, neardup, secrets
from gneiss.llm.shared import forget, fresh, materialize, scratch, table

#: Documents below this pooled probability have no language that was learned.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the model is learned from the labelled ones among them."""
    (name,) = fresh(docs, "_lang")
    out = langid.predict(docs, langid.fit(docs), keep=docs.columns, out=name)
    sure = (F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)
    return out.where(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: one of the smallest id. Rows that share an id,
    or have none, are told apart by their texts."""
    return neardup.one_of_each(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item has contaminated."""
    (name,) = fresh(docs, "_hits")
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=True, out=name)
    return out.where(~decontam.contaminated(F.col(name))).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    (name,) = fresh(docs, "_secrets")
    found = secrets.scan(docs, out=name)
    clean = secrets.redact(F.col("text"), F.col(f"{name}.spans"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(f"{name}.spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with its text; documents of which it takes nothing go."""
    return mixing.mix(docs, keep=["lang", "text"]).where("taken > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]

#: The first stage's network can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables written on the way only the last stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, keep = getattr(docs, "_gneiss_path", None), []
        with scratch(spark, keep):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs._gneiss_path)
        if before:
            forget(spark, before)
    return docs
