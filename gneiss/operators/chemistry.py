"""What follows from a chemistry toolkit's findings, and the interface by which one is plugged in.

A toolkit is a ``Backend``: it looks at structures, in batches, and returns plain columns (whether a
structure is valid, which patterns occur, its scaffold). It is made once in each worker and sees
each distinct structure once. Everything that is decided from those columns is here, in built-in
functions, and needs no toolkit.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """Finds what a toolkit can tell of structures: a frame of ``schema``, a row for each of them."""

    schema: str

    def describe(self, structures: pd.Series) -> pd.DataFrame: ...


def described(df: DataFrame, structure: str, make: Callable[[], Backend], schema: str) -> DataFrame:
    """``df`` with the backend's struct ``found``, computed once for each distinct structure. Rows without
    a structure, and structures that the backend leaves out, have null."""

    def run(batches):
        backend = make()
        for pdf in batches:
            out = backend.describe(pdf["s"])
            yield pd.DataFrame({"s": pdf["s"].to_numpy(), **{c: out[c].to_numpy() for c in out.columns}})

    known = df.select(F.trim(F.col(structure)).alias("s")).where("s <> ''").distinct()
    found = known.mapInPandas(run, f"s string, {schema}")
    names = [c for c in found.columns if c != "s"]
    packed = found.select(F.col("s").alias("_structure"), F.struct(*names).alias("found"))
    return df.join(packed, F.trim(F.col(structure)) == F.col("_structure"), "left").drop("_structure")


def alert_labels(valid: Column, alerts: Column) -> Column:
    """struct(first, all): the first alert of a structure in the order of its catalogue, and all of
    them sorted, each once; ``None`` without any, ``N/A`` for both of an invalid structure."""
    some = F.size(alerts) > 0
    return F.struct(
        F.when(~valid, F.lit("N/A")).when(some, F.get(alerts, F.lit(0))).otherwise(F.lit("None")).alias("first"),
        F.when(~valid, F.lit("N/A")).when(some, F.array_join(F.array_sort(F.array_distinct(alerts)), "; ")).otherwise(F.lit("None")).alias("all"),
    )


def ionisation_label(permanent: Column, acidic: Column, basic: Column) -> Column:
    """A permanent charge goes before all; acidic and basic groups together are amphoteric."""
    return (
        F.when(permanent, F.lit("Permanently charged"))
        .when(acidic & basic, F.lit("Amphoteric"))
        .when(acidic, F.lit("Likely acidic"))
        .when(basic, F.lit("Likely basic"))
        .otherwise(F.lit("Neutral"))
    )


def scaffold_label(valid: Column, scaffold: Column, single: bool = False) -> Column:
    """Of a batch: the scaffold, ``No_Scaffold`` for an empty one, ``Error`` where it failed (null) and
    ``Invalid`` without a structure. Of a single row, whatever is missing is not available."""
    if single:
        return F.coalesce(F.when(valid, F.nullif(scaffold, F.lit(""))), F.lit("Not available"))
    return F.when(~valid, F.lit("Invalid")).when(scaffold.isNull(), F.lit("Error")).when(scaffold == "", F.lit("No_Scaffold")).otherwise(scaffold)


def parent_moiety(valid: Column, scaffold: Column, aromatic: Column) -> Column:
    """The scaffold's name; a chain where there is none and no atom is aromatic."""
    bare = F.coalesce(scaffold, F.lit("")) == ""
    return (
        F.when(~valid, F.lit("Unknown"))
        .when(bare & ~aromatic, F.lit("Aliphatic Chain"))
        .when(bare, F.lit("Unknown Scaffold"))
        .when(scaffold == "c1ccccc1", F.lit("Benzene"))
        .otherwise(scaffold)
    )


# Functional groups in order of precedence, and the class of each, by whether there is an
# aromatic ring.
CLASS_OF_GROUP = (
    ("Carboxylic Acid", "Aromatic Acid", "Aliphatic Acid"),
    ("Ester", "Aromatic Ester", "Aliphatic Ester"),
    ("Alcohol", "Aromatic Alcohol", "Aliphatic Alcohol"),
    ("Amine", "Aromatic Amine", "Aliphatic Amine"),
    ("Siloxane", "Siloxane Compound", "Siloxane Compound"),
    ("Phenol", "Phenolic Compound", "Phenolic Compound"),
    (None, "Aromatic Compound (Miscellaneous)", "Aliphatic Compound (Miscellaneous)"),
)


def chemical_class(groups: Column) -> Column:
    """The class of the first group that a compound has."""
    aromatic = F.array_contains(groups, "Aromatic Ring")
    out = None
    for group, ring, chain in reversed(CLASS_OF_GROUP):
        label = F.when(aromatic, F.lit(ring)).otherwise(F.lit(chain))
        out = label if group is None else F.when(F.array_contains(groups, group), label).otherwise(out)
    return out


def confidence(identity: Column, structure: Column, parent: Column, groups: Column) -> Column:
    """How far a row's assessment can be trusted."""
    missing = F.coalesce(structure, F.lit("")) == ""
    sure = (identity == "Exact Match") & ~missing & (parent != "Unknown") & (F.size(groups) > 0)
    return F.when(F.coalesce(sure, F.lit(False)), F.lit("High")).when((identity == "Unresolved") | missing, F.lit("Low")).otherwise(F.lit("Medium"))
