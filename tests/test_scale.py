"""Work that grows with the input only: what is exchanged, sorted or held on the way."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import cluster, group, pairs
from gneiss.sources import layouts

from .test_whole import silhouettes as silhouettes_of


@pytest.mark.parametrize("most", [1000, 2])
def test_pairs_of_a_signature_are_spread(spark, monkeypatch, most):
    """A block of one signature: its pairs were all one task's, behind an exchange of half of them by block and signature."""
    monkeypatch.setattr(pairs, "SHARE", 16)
    monkeypatch.setattr(pairs, "SIGNATURES", most)
    rows = [(k, "b" if k < 150 else None if k < 155 else "c", "x" if k < 150 else None if k % 3 == 0 else f"w{k % 5}", float(k)) for k in range(180)]
    df = spark.createDataFrame(rows, "k long, b string, w string, v double")
    got = pairs.signature_pairs(df, "k", "b", ("w",), {"d": lambda x: F.when(x("w")[0].eqNullSafe(x("w")[1]), 0.0).otherwise(1.0)}, ("v",))
    out = got.withColumn("p", F.spark_partition_id()).collect()
    want = {(a[1], a[0], b[0], 0.0 if a[2] == b[2] else 1.0, a[3], b[3]) for a in rows for b in rows if a[0] > b[0] and a[1] == b[1] and a[1]}
    assert len(out) == len(want) and {(r.block, r.i, r.j, r.d, r.v_i, r.v_j) for r in out} == want
    assert len({r.p for r in out if r.block == "b"}) > 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan) if "_s#" in m or "_t#" in m} == set()


def test_sums_of_kinds_equal_those_of_pairs(spark):
    """Rows that agree in all columns of a layer were met one by one."""
    rows = [(k, "b" if k % 3 else "c", ("x", "y", None)[k % 3 if k < 30 else 0], k % 2) for k in range(60)] + [(60, None, "x", 1)]
    df = spark.createDataFrame(rows, "k long, b string, w string, z int")
    differ = lambda x: F.when(x("w")[0].eqNullSafe(x("w")[1]), 0.0).otherwise(0.25)
    numbers = lambda x: F.abs(x("z")[0] - x("z")[1]) / 3
    want = {}
    for a in rows:
        for b in rows:
            if a[0] > b[0] and a[1] == b[1] and a[1]:
                total, n = want.get(a[1], (0, 0))
                want[a[1]] = (total + round(1e6 * ((a[2] != b[2]) * 0.25 + abs(a[3] - b[3]) / 3)), n + 1)
    plain = pairs.kind_sums(df, "k", "b", ("w", "z"), lambda x: differ(x) + numbers(x))
    termed = pairs.kind_sums(df, "k", "b", ("w", "z"), lambda x: F.col("t") + numbers(x), {"t": differ}, ("w",))
    assert {r.block: (r.total, r.n) for r in plain.collect()} == {r.block: (r.total, r.n) for r in termed.collect()} == want


def test_quantiles_hold_no_group(spark):
    rng = np.random.default_rng(2)
    made = {"a": rng.normal(size=3000), "b": np.round(rng.normal(size=500), 1), "c": [5.0], "d": 1e9 + rng.random(2000), "e": [-1e308, 1e308, 0.0, -0.0, 5e-324], None: [3.0, 1.0], "h": [k * 5e-324 for k in range(900, 1100)], "i": [float("-inf"), 1.0, 2.0, 3.0, float("inf")], "f": [2.0] * 9}
    df = spark.createDataFrame([(g, float(v)) for g, vs in made.items() for v in vs] + [("g", None), ("c", None)], "g string, v double")
    got = group.quantiles(df, ["g"], "v", (0.25, 0.5, 0.75))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {r.g: (r.n, r.q) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", [0.25, 0.5, 0.75]).alias("q")).collect()}
    assert {r.g: (r.n, r.q) for r in got.collect()} == want
    plan = group.fences(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    rows = df.withColumn("k", F.monotonically_increasing_id())
    assert "Exchange hashpartitioning(g#" not in group.outliers(rows, "k", "g", "v")._jdf.queryExecution().executedPlan().toString()


def test_report_lines_are_not_sorted(spark):
    """Windows sorted all lines of a task; a page's bounds are aggregates of its marked lines."""
    text = ["External Standard Report", "Totals : early", "Sample Name: x", "before 1", "-------|--|", " 1.5 1 a", "==== 1", "-------| again", "2 b,c", None, "Totals : 9", "3 d", "Totals", "-------|", "4 e"]
    rows = [("d", 1, k, x) for k, x in enumerate(text)] + [("d", None, k, x) for k, x in enumerate(text[:9])] + [("e", 1, k, x) for k, x in enumerate(text[1:])] + [(None, 2, None, text[0]), (None, 2, 1, text[2]), (None, 2, 2, "-------| Totals"), (None, 2, 3, "5 f")]
    got = layouts.standard_report(spark.createDataFrame(rows, "doc string, page int, line int, text string"))
    assert sorted((str(r.doc), str(r.page), r.line, r.record["Compound"]) for r in got.collect()) == [("d", "1", 5, "a"), ("d", "1", 8, "b"), ("d", "None", 5, "a"), ("d", "None", 8, "b")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_silhouette_moves_rows_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCKS", 3)
    monkeypatch.setattr(pairs, "TILE", 4)
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "id long, label long, v array<double>")
    silhouettes = pairs.silhouette_of_vectors(df, "id", "label", "v", block=5)
    want = silhouettes_of(np.arange(90), label, x)
    assert all(abs(r.silhouette - want[r.id]) < 1e-9 for r in silhouettes.collect())
    assert "sequence(0, 2" in silhouettes._jdf.queryExecution().analyzed().toString() or "sequence(0, (3 - 1)" in silhouettes._jdf.queryExecution().analyzed().toString() or "[0,1,2]" in silhouettes._jdf.queryExecution().optimizedPlan().toString()


def test_consensus_is_no_cube():
    """The centres of spectral clustering were met in one array of rows x centres x directions, and each merge looked at the whole square."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[40:60] = x[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tracemalloc.start()
    labels = cluster.spectral(np.exp(-(d**2)), 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(labels.tolist())) > 30 and peak < 6 * 300 * 300 * 8
    plain, groups = d.copy(), {i: [i] for i in range(300)}
    np.fill_diagonal(plain, np.inf)
    while len(groups) > 60:
        i, j = sorted(np.unravel_index(np.argmin(plain), plain.shape))
        a, b = len(groups[i]), len(groups[j])
        merged = (a * plain[i] + b * plain[j]) / (a + b)
        plain[i], plain[:, i] = merged, merged
        plain[i, i], plain[j], plain[:, j] = np.inf, np.inf, np.inf
        groups[i] += groups.pop(j)
    got = cluster.linkage(d, False, k=60)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(np.flatnonzero(got == c).tolist()) for c in set(got.tolist()))
