"""Cross-tokenizer alignment against whole texts encoded at once and plain loops."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm import alignment

from ..conftest import DATA
from .conftest import prose


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(alignment.FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B), {i: t for t, i in a.get_vocab().items()}


def spans(lengths):
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def brute(both, docs):
    """The contract's columns for (id, text), by loops over whole texts."""
    a, b, names = both
    of, links, out, shown = alignment.byte_alphabet(), [], [], []
    for _, text in docs:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [bytes(of[c] for c in names[i]) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if text and not b"".join(ba) == (" " + text).encode() == b"".join(bb):
            ia = ib = ba = bb = []
        sa, sb = spans(map(len, ba)), spans(map(len, bb))
        both_end = {e for _, e in sa} & {e for _, e in sb}
        groups, x, y = [], [], []
        ends = sorted(both_end)
        for e in ends:
            lo = ends[ends.index(e) - 1] if ends.index(e) else 0
            x = [i for i, (s, t) in zip(ia, sa, strict=True) if lo <= s and t <= e]
            y = [i for i, (s, t) in zip(ib, sb, strict=True) if lo <= s and t <= e]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        j, mine = 0, []
        for i, (s, t) in zip(ia, sa, strict=True):
            while j and sb[j - 1][1] > s:
                j -= 1
            while j < len(sb) and sb[j][1] <= s:
                j += 1
            while j < len(sb) and sb[j][0] < t:
                mine.append((i, ib[j]))
                j += 1
        links.append(mine)
        shown.append(";".join(groups))
        out.append((len(ia), len(ib), len(groups)))
    count = collections.Counter(p for m in links for p in m)
    most = collections.defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    rows = [
        (i, *n, len(m), sum(count[p] == most[p[1]] for p in m), sum(count[p] for p in m), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for (i, _), n, m, g in zip(docs, out, links, shown, strict=True)
    ]
    return rows, count, most


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


ODD = [None, "", " ", "  two  blanks ", "tab\tand\nline\r\n\nend", "a▁b is written otherwise", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve 漢字 \U0001f600 é", " no break wide \x1c sep", "it's we'll 'tis don 't", "x", " lead", "trail ", "ﬁ ½™", "0123456789 1,000.50", "a" * 3000 + " " + "▁", "\x00 \x01nul"]


def test_alignment_of_odd_rows(spark, both):
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (0, "x"), (0, "x"), (99, prose(rng, 20_000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "block", "n_a", "stripe", "blob", "kind")})
    assert got(alignment.align(df.repartition(3)).documents) == sorted(brute(both, docs)[0], key=str)


def test_alignment_equals_brute_force(spark, both, monkeypatch):
    """On the driver's table: every row, every id pair; small blocks, several rounds of adding up, several salts."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    rows, count, most = brute(both, docs)
    for name, value in (("BLOCK_LINKS", 20_000), ("FAN", 2), ("SALT_BYTES", 500)):
        monkeypatch.setattr(alignment, name, value)
    found = alignment.align(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").repartition(5), keep_groups=True)
    assert got(found.documents) == sorted(rows, key=str)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found.documents.where("n_a > 0").collect())
    pairs = {(r.a, r.b): (r.n, r.best) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}
    monkeypatch.undo()
    assert got(alignment.op12_alignment(spark, f"{DATA}/sf0.001")) == sorted(rows, key=str)


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 70_000, 2**40):
        columns = [rng.integers(0, top, n, endpoint=True) for n in (0, 1, 500)]
        assert all((x == y).all() for x, y in zip(columns, alignment.unpack(alignment.pack(*columns)), strict=True))
