"""The Jaccard join against all pairs, its search against plain intersections."""

import random

import numpy as np
import pytest

from gneiss.llm import neardup, overlap

from .conftest import prose
from .test_corpus_operators import components


def check(df, docs, k, percent):
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in df.collect()) == components(docs, k, percent)


def random_sets(rng, n, share):
    """Sets around a few centres, some of them links of others."""
    out, centres = [], [rng.integers(0, 2**63, int(rng.integers(1, 90)), dtype=np.uint64) for _ in range(4)]
    for _ in range(n):
        c = centres[rng.integers(4)]
        kept = c[rng.random(len(c)) < share]
        out.append(np.unique(np.concatenate((kept, rng.integers(0, 2**63, int(rng.integers(1, 6)), dtype=np.uint64)))))
    return out


@pytest.mark.parametrize("mu", [0.0085, 0.5, 100.0])
def test_search_finds_all_links(monkeypatch, mu):
    """However many lists are set aside, the links and intersections are those of plain sets."""
    monkeypatch.setattr(overlap, "MU", mu)
    rng, links = np.random.default_rng(3), 0
    for percent in (50, 80, 100):
        for share in (0.8, 0.97):
            sets = random_sets(rng, 60, share)
            index = overlap.Inverted(sets)
            for q in sets[:20]:
                both = [len(np.intersect1d(q, s)) for s in sets]
                want = [(k, c) for k, (c, s) in enumerate(zip(both, sets, strict=True)) if 100 * c >= percent * (len(q) + len(s) - c)]
                assert sorted(index.search(q, percent)) == want
                links += len(want)
    assert links > 300


def test_merge_counts_lists():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        for least in range(1, len(lists) + 1):
            counts = [(k, c) for k in range(30) if (c := sum(k in x for x in lists)) >= least]
            assert list(overlap.merged(lists, least)) == counts


def test_filters_lose_no_link():
    """Posted shingles meet, and sizes and bits allow it, wherever two sets link."""
    rng, n = np.random.default_rng(5), 0
    for _ in range(40):
        sets = random_sets(rng, 12, 0.95)
        for x in sets:
            for y in sets:
                c = len(np.intersect1d(x, y))
                if 100 * c >= 80 * (len(x) + len(y) - c):
                    n += 1
                    assert overlap.possible(len(x), overlap.parity(x), len(y), overlap.parity(y), 80)
                    assert c >= overlap.required(len(x), len(y), 80)
                    assert np.intersect1d(x[: overlap.posted(len(x), 80)], y[: overlap.posted(len(y), 80)]).size
    assert n > 500


@pytest.mark.parametrize(("k", "percent", "small"), [(5, 80, 64), (3, 85, 1)])
def test_join_of_families(spark, monkeypatch, k, percent, small):
    """Groups of copies with a few words changed, a chain, texts that share a passage, odd rows; with
    lists of one as small ones, block against block."""
    monkeypatch.setattr(overlap, "SMALL", small)
    monkeypatch.setattr(overlap, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    passage = prose(rng, 30)
    texts = [prose(rng, 40) + " " + passage for _ in range(60)]
    for size, change in ((120, 0.03), (30, 0.01), (12, 0.06)):
        base = prose(rng, 120).split(" ")
        texts += [" ".join(prose(rng, 1) if rng.random() < change else w for w in base) for _ in range(size)]
    w = prose(rng, 100).split(" ")
    for i in range(12):
        w[i * 8] = "c%d" % i
        texts.append(" ".join(w))
    texts += texts[60:64] * 3
    rng.shuffle(texts)
    docs = [*enumerate(texts), (None, texts[0]), (None, None), (7, ""), (7, " \n"), (7, "one"), (None, "ONE"), (9, texts[1] + " x")]
    check(overlap.linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shingle=k, percent=percent), docs, k, percent)


def test_hot_keys_are_spread(spark, monkeypatch):
    """Rows of a hot key meet their keyed row in many tasks, each once."""
    from gneiss.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i % 3 if i < 600 else i, i) for i in range(700)], "k long, id long")
    keyed = rows.groupBy("k").count()
    out = shared.join_spread(rows, keyed, "k", "count", "id").collect()
    assert sorted((r.k, r.id) for r in out) == sorted((r.k, r.id) for r in rows.collect())
    assert all(r["count"] == (200 if r.k < 3 else 1) for r in out)
