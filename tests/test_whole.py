"""Queries over whole tables against brute force: no pair is left out by a filter on ids or by a block."""

import numpy as np
import pytest

from gneiss.operators import cluster, pairs
from gneiss.plans import catalogue

from .conftest import DATA


@pytest.fixture(scope="module")
def vectors(spark):
    pdf = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    return pdf["vec_id"].to_numpy(), pdf["label"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(float)


def silhouettes(ids, label, x):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    want = {}
    for r, i in enumerate(ids):
        mean = {c: d[r, (label == c) & (ids != i)].mean() for c in set(label.tolist()) if ((label == c) & (ids != i)).any()}
        a, b = mean.pop(label[r], None), min(mean.values(), default=None)
        want[i] = 0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b)
    return want


def test_silhouette_over_all_pairs(spark, vectors):
    got = {r.id: r.silhouette for r in catalogue.QUERIES["silhouette"](spark, f"{DATA}/sf0.001").collect()}
    want = silhouettes(*vectors)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-5 for i in want)


def test_silhouette_in_blocks_with_copies_and_lone_labels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x[20:40] = x[0]
    label = np.array([*rng.integers(0, 3, 59), 9])
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "id long, label long, v array<double>")
    got = {r.id: r.silhouette for r in pairs.silhouette_of_vectors(df, "id", "label", "v", block=7).collect()}
    want = silhouettes(np.arange(60), label, x)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def best(ids, bits, queries, k=10):
    out = set()
    for q in queries:
        s = [(-(len(bits[q] & bits[o]) / len(bits[q] | bits[o]) if bits[q] | bits[o] else 0.0), o) for o in ids if o != q]
        out |= {(q, o, r + 1, round(-v, 6)) for r, (v, o) in enumerate(sorted(s)[:k])}
    return out


def test_library_search_over_all_labels(spark, vectors):
    ids, label, x = vectors
    bits = {i: set(np.flatnonzero(v > 0).tolist()) for i, v in zip(ids.tolist(), x, strict=True)}
    got = {(r.id, r.other, r.rank, r.similarity) for r in catalogue.QUERIES["topk_library"](spark, f"{DATA}/sf0.001").collect()}
    assert got == best(ids.tolist(), bits, [i for i in ids.tolist() if i % 50 == 0])
    of = dict(zip(ids.tolist(), label.tolist(), strict=True))
    assert any(of[i] != of[o] for i, o, *_ in got)


def test_library_search_in_blocks(spark):
    rng = np.random.default_rng(6)
    bits = {i: set(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for i in range(50)}
    df = spark.createDataFrame([(i, sorted(b)) for i, b in bits.items()], "id long, bits array<int>")
    got = {(r.id, r.other, r.rank, round(r.similarity, 6)) for r in pairs.top_of_all(df.where("id < 20"), df, "id", "bits", k=4, block=6).collect()}
    assert got == best(list(bits), bits, range(20), 4)


def test_consensus_takes_whole_labels(spark, vectors):
    ids, label, x = vectors
    got = {r.vec_id: (r.block, r.label) for r in catalogue.QUERIES["consensus_clusters"](spark, f"{DATA}/sf0.001").collect()}
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for c in set(label.tolist()):
        at = np.flatnonzero(label == c)
        want = cluster.consensus(np.sqrt(np.maximum(2 - 2 * x[at] @ x[at].T, 0)) / 2)
        assert [got[i] for i in ids[at]] == [(c, v) for v in want]
