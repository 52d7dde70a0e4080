"""Spelling variants against all pairs."""

import collections
import random
import re
import zlib

import pytest

from gneiss.llm import spelling


def apart(x, y):
    """Whether the edit distance is one, by its table."""
    if abs(len(x) - len(y)) > 1:
        return False
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, last = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
    return row[-1] == 1


def brute(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out = {}
    for w, k in words.items():
        near = sorted((-m, x) for x, m in words.items() if apart(w, x))
        form = near[0][1] if near and -near[0][0] >= 10 * k else None
        out[w] = (k, len(near), form, None if form is None else words[form])
    rows = []
    for w, x in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        rows.append((w, *x, root))
    return sorted(rows)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def edits(rng, word):
    """A word one edit away, or the word."""
    i, c = rng.randrange(len(word) + 1), rng.choice("abnéß")
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word])


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    """Words of few letters, so that doubled ones shift; chains of forms; long words; ties."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abné") for _ in range(rng.randint(7, 13))) for _ in range(8)] + ["aaaaaaa", "aaaaaaaa", "abababab", "x" * 60, "Donaudampfschiff", "École×÷ende"]
    words = []
    for w in base:
        words += [w] * 1200
        for _ in range(5):
            v = edits(rng, w)
            words += [v] * rng.choice([1, 2, 5, 100])
            words += [edits(rng, v)] * rng.choice([2, 3, 10])
    rng.shuffle(words)
    docs = [(i, " ".join(words[j : j + 40]) + rng.choice([".", "1", ""])) for i, j in enumerate(range(0, len(words), 40))]
    docs += [(None, " ".join(base)), (None, None), (3, ""), (3, "\n"), docs[0], docs[0]]
    assert got(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_candidates_are_all_near_words():
    """The count filter drops no word that is one edit away, whatever the edit."""
    rng = random.Random(7)
    for _ in range(3000):
        x = "".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))
        y = edits(rng, x)
        x, y = sorted((x, y), key=len)
        if x != y:
            index = spelling.Postings(len(x))
            index.add(x)
            assert index.candidates(y) == [0] and spelling.one_edit(x, y) >= 0


def test_lists_stay_whole_where_the_join_is_broadcast(spark):
    """Words of several files, lists few enough to be broadcast while the query runs: no list is torn apart by the join's reader."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(7, 8))) for _ in range(400)})
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, n long").repartition(6).localCheckpoint()
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        near = [tuple(sorted((r.word, r.near))) for r in spelling.near_words(rows).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(near) == sorted((x, y) for i, x in enumerate(words) for y in words[i + 1 :] if apart(x, y))
