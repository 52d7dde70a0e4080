"""Language-model scoring: interpolated modified Kneser-Ney over word pairs.

The model is of order two. On a corpus whose word pairs are mostly new, each further order
costs about one and a half times the table of this one in shuffle and disk; the figures are in the README.

Counting runs in Spark in three steps, each a map that combines within its task and a reduce
by shard. What is exchanged are blocks, sorted hash arrays of one shard each, not a row for
each pair:

1. words: hash and count, written as sorted hash arrays; a word's number is its place;
2. pairs: (word, next word) as one number, mixed by a reversible function, so that there are no
   collisions, counted and written as sorted arrays of these hashes with their counts. A
   shard holds all pairs of its first words, so their sums are complete there, except for
   first words that are frequent enough to fill a shard: their pairs are spread by the whole pair;
3. by word: the weight that the word, as a context, leaves to the lower order, and the number of
   different words before it.

The arrays lie in the shared folder and workers map them into memory; a query reads the
pages that its sorted keys touch. Where the folder is no local path, a worker copies each
array that it needs to its own disk first, under no name: it goes with the worker. The number of shards follows the number of input partitions.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token. A
text is scored as a whole: sum of log10 p over its tokens, beginning at the start of a text.

Defined cases: a null or empty text is its end token alone; words that were never seen share
one place in the vocabulary; with nothing to learn from every token has probability 1 (V is
0); repeated rows are counted as often as they occur; ties don't arise; a very long text is read whole, as a slice of its
own; an empty table gives an empty
result; a null id is learned from and not held out; other columns are not read.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .neardup import _mix, words_at
from .shared import fresh_path, materialize, scratch, table, trimming
from .warc import _store

SLICE = 4 << 20
PENDING = 5_000_000
LEAST_SHARDS = 64
_U = np.uint64
END = _U(0x5DEECE66D1CE4E5B)
BEGIN = _U(0xFFFFFFFF)
MISSING = np.int64(-1)


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_mix``."""
    x = x ^ (x >> _U(33))
    x = x * _U(pow(0xC4CEB9FE1A85EC53, -1, 2**64))
    x = x ^ (x >> _U(33))
    x = x * _U(pow(0xFF51AFD7ED558CCD, -1, 2**64))
    return x ^ (x >> _U(33))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """In order of the keys: equal ranges of the 64-bit space."""
    return ((keys >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart: the upper planes are almost all zero,
    which the exchange's compression takes out."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    return (counts.astype(np.uint8) if not len(counts) or counts.max() < 256 else counts.astype(np.int64)).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.int64).astype(np.int64)


def combine(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def _distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.sort(k)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


class Tally:
    """Counts of a task, combined as they come; ``blocks`` hands them over by shard."""

    def __init__(self, shards: int, shard_of_keys):
        self.shards, self.where = shards, shard_of_keys
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > PENDING:
            k, c = combine(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k)
        return self.held > PENDING // 2

    def blocks(self) -> pd.DataFrame:
        k, c = combine(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.counts, self.held = [], [], 0
        s = self.where(k)
        order = np.argsort(s, kind="stable")  # keys stay sorted within a shard
        k, c, s = k[order], c[order], s[order]
        cut = np.searchsorted(s, np.arange(self.shards + 1))
        rows = [(i, pack(k[a:b]), _small(c[a:b])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pd.DataFrame(rows, columns=["shard", "k", "c"])


BLOCK_SCHEMA = "shard int, k binary, c binary"


def slices(texts):
    """(hashes of all words, number of words of each text) of runs of texts of bounded size."""
    run, size = [], 0
    for t in texts:
        b = b"" if t is None else bytes(t)
        run.append(b)
        size += len(b)
        if size >= SLICE:
            yield _slice(run)
            run, size = [], 0
    if run:
        yield _slice(run)


def _slice(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, at = words_at(b"\n".join(run).lower())
    starts = np.cumsum([0, *[len(b) + 1 for b in run]])
    return h, np.diff(np.searchsorted(at, starts))


# ---- files of the model ----


def save(folder: str, name: str, array: np.ndarray) -> str:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{root}/{file}", compression=None) as out:
        out.write(np.ascontiguousarray(array).data if len(array) else b"")
    return file


@lru_cache(maxsize=4096)
def mapped(folder: str, file: str, kind: str) -> np.ndarray:
    """An array of the model, mapped into memory."""
    store, root = _store(folder)
    path = f"{root}/{file}"
    if store.type_name != "local":
        local = tempfile.NamedTemporaryFile(prefix="gneiss-lm-", delete=False)
        with store.open_input_stream(path, compression=None) as source, local:
            while piece := source.read(1 << 24):
                local.write(piece)
        path = local.name
    out = np.memmap(path, kind, "r") if store.get_file_info(f"{root}/{file}").size else np.zeros(0, kind)
    if store.type_name != "local":
        os.unlink(path)  # the mapping keeps it until the worker ends; no one else reads it
    return out


class Words:
    """Numbers of words: places in the sorted hash arrays."""

    def __init__(self, meta: dict):
        self.meta, self.base = meta, np.array(meta["base"])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Of sorted distinct hashes; -1 for words never seen."""
        out = np.full(len(h), MISSING)
        cut = np.searchsorted(shard_of(h, self.meta["shards"]), np.arange(self.meta["shards"] + 1))
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a and (file := self.meta["words"][i]):
                keys = mapped(self.meta["folder"], file, "<u8")
                at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == h[a:b], at + self.base[i], MISSING)
        return out

    def gather(self, what: str, kind: str, numbers: np.ndarray) -> np.ndarray:
        """Values of an array by word, for sorted numbers; 0 for those that are no word's."""
        out = np.zeros(len(numbers), kind)
        cut = np.searchsorted(numbers, self.base)
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a and (file := self.meta[what][i]):
                out[a:b] = mapped(self.meta["folder"], file, kind)[numbers[a:b] - self.base[i]]
        return out


def pairs_of(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts: each text's words and its end token."""
    n, at_end = len(ids) + len(sizes), np.cumsum(sizes + 1) - 1
    token = np.empty(n, np.int64)
    inner = np.ones(n, bool)
    inner[at_end] = False
    token[inner], token[at_end] = ids, end
    context = np.empty(n, np.int64)
    context[1:] = token[:-1]
    context[np.concatenate(([0], at_end[:-1] + 1))] = int(BEGIN)
    return context, token


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return _mix((context.astype(np.uint64) << _U(32)) | token.astype(np.uint64))


def pair_shards(keys: np.ndarray, meta: dict) -> np.ndarray:
    context = (_unmix(keys) >> _U(32)).astype(np.int64)
    by = np.where(np.isin(context, meta["hot"]), keys, _mix(context.astype(np.uint64) + _U(17)))
    return shard_of(by, meta["shards"])


def _numbered(words: Words, h: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(h, return_inverse=True)
    return words.numbers(distinct)[back]


# ---- counting ----


def fit(docs: DataFrame, text_col: str = "text", folder: str | None = None) -> dict:
    """Count ``docs`` and write the model; returns its description (files, sums, discounts). The
    model's files stay; the tables of the steps don't."""
    with scratch(docs.sparkSession, []):
        return _fit(docs, text_col, folder)


def _fit(docs: DataFrame, text_col: str, folder: str | None) -> dict:
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "lm")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    shards = max(LEAST_SHARDS, 2 * texts.rdd.getNumPartitions())
    meta = {"folder": folder, "shards": shards, "hot": np.zeros(0, np.int64)}

    def count_words(batches):
        tally, texts_seen = Tally(shards, lambda k: shard_of(k, shards)), 0
        for pdf in batches:
            texts_seen += len(pdf)
            for h, _ in slices(pdf["t"]):
                if tally.add(*_distinct(h)):
                    yield tally.blocks()
        if texts_seen:
            tally.add(np.array([END]), np.array([texts_seen]))
        yield tally.blocks()

    def write_words(key, pdf):
        k, c = combine(*zip(*[(unpack(x), _large(y, len(x) // 8)) for x, y in zip(pdf["k"], pdf["c"], strict=True)], strict=True))
        top = np.argsort(-c)[:64]
        return pd.DataFrame([(int(key[0]), save(folder, "words", k), save(folder, "counts", c.astype("<u8")), len(k), int(c.sum()), top.tolist(), c[top].tolist())], columns=["shard", "words", "counts", "n", "total", "top", "top_counts"])

    found = materialize(
        texts.mapInPandas(trimming(count_words), BLOCK_SCHEMA).groupBy("shard").applyInPandas(write_words, "shard int, words string, counts string, n long, total long, top array<long>, top_counts array<long>"), "lm-words"
    ).collect()  # one row for each shard
    by = {r["shard"]: r for r in found}
    n = [by[i]["n"] if i in by else 0 for i in range(shards)]
    meta |= {k: [by[i][k] if i in by else "" for i in range(shards)] for k in ("words", "counts")}
    meta |= {"base": np.concatenate(([0], np.cumsum(n))).tolist(), "V": sum(n), "N": sum(r["total"] for r in found)}
    if meta["V"] >= int(BEGIN):
        raise ValueError("more than 2**32 - 2 different words")
    meta["end"] = int(Words(meta).numbers(np.array([END]))[0]) if found else 0
    # A word this frequent could fill a quarter of a shard as a context; there are at most 4 * shards of them.
    hot = [i_base + t for i, i_base in enumerate(meta["base"][:-1]) if i in by for t, c in zip(by[i]["top"], by[i]["top_counts"], strict=True) if 4 * shards * c > meta["N"]]
    meta["hot"] = np.array(sorted([*hot, int(BEGIN)]), np.int64)

    def count_pairs(batches):
        words, tally = Words(meta), Tally(shards, lambda k: pair_shards(k, meta))
        for pdf in batches:
            for h, sizes in slices(pdf["t"]):
                if tally.add(*_distinct(pair_keys(*pairs_of(_numbered(words, h), sizes, meta["end"])))):
                    yield tally.blocks()
        yield tally.blocks()

    empty = b""

    def write_pairs(key, pdf):
        k, c = combine(*zip(*[(unpack(x), _large(y, len(x) // 8)) for x, y in zip(pdf["k"], pdf["c"], strict=True)], strict=True))
        low = np.minimum(c, 255).astype(np.uint8)
        over = c >= 255
        files = [save(folder, "pairs", k), save(folder, "pair-counts", low), save(folder, "over", k[over]), save(folder, "over-counts", c[over].astype("<u8"))]
        coc = [int((c == i).sum()) for i in (1, 2, 3, 4)]
        rows = [(-1, int(key[0]), files, len(k), coc, empty, empty, empty, empty)]
        plain = _unmix(k)
        context, token = (plain >> _U(32)).astype(np.int64), (plain & _U(0xFFFFFFFF)).astype(np.int64)
        # By context: how many tokens followed once, twice, more often. By token: contexts.
        who, back = np.unique(context, return_inverse=True)
        ns = [np.bincount(back, m, len(who)).astype(np.int64) for m in (c == 1, c == 2, c >= 3)]
        after, times = _distinct(token.astype(np.uint64))
        edges = np.array([*meta["base"], int(BEGIN) + 1])
        cut_c, cut_t = np.searchsorted(who, edges), np.searchsorted(after, edges.astype(np.uint64))
        for i in range(shards + 1):
            (a, b), (d, e) = cut_c[i : i + 2], cut_t[i : i + 2]
            if b > a or e > d:
                stats = b"".join(x[a:b].astype("<u4").tobytes() for x in ns)
                rows.append((i, int(key[0]), [], 0, [], pack(who[a:b].astype(np.uint64)), stats, pack(after[d:e]), times[d:e].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["part", "shard", "files", "n", "coc", "who", "ns", "after", "times"])

    schema = "part int, shard int, files array<string>, n long, coc array<long>, who binary, ns binary, after binary, times binary"
    pairs = materialize(texts.mapInPandas(trimming(count_pairs), BLOCK_SCHEMA).groupBy("shard").applyInPandas(write_pairs, schema), "lm-pairs")
    found = pairs.where("part = -1").select("shard", "files", "n", "coc").collect()
    by = {r["shard"]: r for r in found}
    meta["pairs"] = [by[i]["files"] if i in by else [] for i in range(shards)]
    meta["n_pairs"] = sum(r["n"] for r in found)
    meta["D"] = discounts([sum(r["coc"][i] for r in found) for i in range(4)])

    def write_by_word(key, pdf):
        i = int(key[0])
        base = meta["base"][i] if i < shards else int(BEGIN)
        size = meta["base"][i + 1] - base if i < shards else 1
        ns, before = np.zeros((3, size)), np.zeros(size, np.int64)
        for who, n3, after, times in zip(pdf["who"], pdf["ns"], pdf["after"], pdf["times"], strict=True):
            at = unpack(who).astype(np.int64) - base
            ns[:, at] += np.frombuffer(n3, "<u4").reshape(3, -1)
            before[unpack(after).astype(np.int64) - base] += np.frombuffer(times, "<u4")
        rest = (np.array(meta["D"])[:, None] * ns).sum(axis=0)
        coc = [int((before == j).sum()) for j in (1, 2, 3, 4)] + [int((before >= 3).sum())]
        return pd.DataFrame([(i, save(folder, "rest", rest.astype("<f8")), save(folder, "before", before.astype("<u4")), coc, float(rest[0]))], columns=["shard", "rest", "before", "coc", "first"])

    found = materialize(pairs.where("part >= 0").groupBy("part").applyInPandas(write_by_word, "shard int, rest string, before string, coc array<long>, first double"), "lm-by-word").collect()
    by = {r["shard"]: r for r in found}
    meta |= {k: [by[i][k] if i in by else "" for i in range(shards)] for k in ("rest", "before")}
    meta["begin_rest"] = by[shards]["first"] if shards in by else 0.0
    words = [r for r in found if r["shard"] < shards]
    coc = [sum(r["coc"][i] for r in words) for i in range(5)]
    meta["D1"] = discounts(coc[:4])
    meta["rest1"] = meta["D1"][0] * coc[0] + meta["D1"][1] * coc[1] + meta["D1"][2] * coc[4]
    meta["texts"] = meta["N"] and _end_count(meta)
    return meta


def _end_count(meta: dict) -> int:
    return int(Words(meta).gather("counts", "<u8", np.array([meta["end"]]))[0])


def discounts(coc: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of n-grams
    with counts 1 to 4; where these are too few to tell, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = coc
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.01), i) for i, d in enumerate(raw, 1)]


# ---- scoring ----


def _pair_counts(meta: dict, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct pair keys; 0 for pairs never seen."""
    out = np.zeros(len(keys), np.int64)
    s = pair_shards(keys, meta)
    order = np.argsort(s, kind="stable")
    cut = np.searchsorted(s[order], np.arange(meta["shards"] + 1))
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a and meta["pairs"][i]:
            rows = order[a:b]
            files = meta["pairs"][i]
            k = mapped(meta["folder"], files[0], "<u8")
            at = np.minimum(np.searchsorted(k, keys[rows]), len(k) - 1)
            found = np.where(k[at] == keys[rows], mapped(meta["folder"], files[1], "u1")[at], 0).astype(np.int64)
            if (many := np.flatnonzero(found == 255)).size:
                o = mapped(meta["folder"], files[2], "<u8")
                found[many] = mapped(meta["folder"], files[3], "<u8")[np.searchsorted(o, keys[rows[many]])]
            out[rows] = found
    return out


def score_slice(meta: dict, words: Words, h: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """n_tokens, n_known, base_score, score of each text of a slice."""
    total, vocab = meta["N"], meta["V"]
    ids = _numbered(words, h) if total else np.full(len(h), MISSING)
    context, token = pairs_of(ids, sizes, meta["end"] if total else MISSING)
    who, back = np.unique(token, return_inverse=True)
    count = words.gather("counts", "<u8", who).astype(np.float64)
    before = words.gather("before", "<u4", who).astype(np.float64)
    d1 = np.array([0.0, *meta["D1"]])
    low = np.full(len(who), 1 / (vocab + 1))
    if total:
        low = np.maximum(before - d1[np.minimum(before, 3).astype(int)], 0) / meta["n_pairs"] + meta["rest1"] / meta["n_pairs"] / (vocab + 1)
    p = low[back]
    known = (context != MISSING) & (context != meta["end"])  # nothing follows the end of a text
    if total and known.any():
        after, at = np.unique(context[known], return_inverse=True)
        seen = words.gather("counts", "<u8", after).astype(np.float64)
        rest = words.gather("rest", "<f8", after)
        seen[after == int(BEGIN)], rest[after == int(BEGIN)] = meta["texts"], meta["begin_rest"]
        real = token[known] != MISSING
        c = np.zeros(len(at), np.int64)
        keys, where = np.unique(pair_keys(context[known][real], token[known][real]), return_inverse=True)
        c[real] = _pair_counts(meta, keys)[where]
        d = np.array([0.0, *meta["D"]])
        p[known] = (np.maximum(c - d[np.minimum(c, 3)], 0) + rest[at] * p[known]) / seen[at]
    first = np.cumsum(sizes + 1) - sizes - 1
    base = np.log10((count + 1) / (total + vocab + 1))[back]
    return pd.DataFrame({
        "n_tokens": sizes + 1, "n_known": np.add.reduceat((count > 0)[back].astype(np.int64), first),
        "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first),
    })


def score(docs: DataFrame, meta: dict, text_col: str = "text", keep=()) -> DataFrame:
    """The columns ``keep`` and a struct ``_lm`` of n_tokens, n_known, train_tokens, base_score and
    score; perplexity is 10 ** (-score / n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(meta)  # names of files and sums
    each = docs.select(F.struct(*[F.col(c) for c in keep]).alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        words = Words(shared.value)
        for pdf in batches:
            if not len(pdf):
                continue
            out = pd.concat([score_slice(shared.value, words, *s) for s in slices(pdf["t"])], ignore_index=True)
            out["train_tokens"] = shared.value["N"]
            yield pd.DataFrame({"k": pdf["k"].reset_index(drop=True), "r": pd.Series(out.to_dict("records"), dtype=object)})

    kept = each.schema["k"].dataType.simpleString()
    out = each.mapInPandas(trimming(run), f"k {kept}, r struct<n_tokens:bigint,n_known:bigint,train_tokens:bigint,base_score:double,score:double>")
    return out.select("k.*", F.col("r").alias("_lm"))


def op6_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 7, 2)
    out = score(docs, fit(docs.where(~held)), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "_lm.n_tokens", "_lm.n_known", "_lm.train_tokens", "_lm.base_score", "_lm.score")
