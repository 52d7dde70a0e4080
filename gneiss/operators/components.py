"""Connected components of a link table.

Alternating stars: each round hangs every id on the smallest neighbour seen, by aggregates and joins only, until nothing
changes; the number of rounds grows with the logarithm of the longest chain. Each round's table is written into the
shared folder, and the one before it is deleted. Edges point from the larger to the smaller id, and an id's neighbours shrink
to one within a few rounds, so a label that many share isn't met again and again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import forget, fresh_path, materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp) for all ids of the links (a, b): comp is the smallest id reachable."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path = fresh_path(spark, name)
    edges, old = materialize(edges, name, path), path
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours hang on the smallest of the neighbourhood.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: an id and its smaller neighbours hang on the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        path = fresh_path(spark, name)
        now = materialize(small, name, path)
        sums = [d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for d in (edges, now)]
        forget(spark, old)
        edges, old = now, path
        if tuple(sums[0]) == tuple(sums[1]):
            break
    tree = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    out = tree.unionByName(tree.select(F.col("comp").alias("id"), "comp").distinct())
    out._gneiss_path = path
    return out


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for all ``nodes`` (id): the smallest id that links (i, j) reach."""
    comps = components(links.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return nodes.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("component"))
