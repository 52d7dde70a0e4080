"""Alignment of two tokenizers over a corpus, by id-striped dense count matrices.

Each text is encoded by tokenizer A (byte-level) and tokenizer B (pieces); both see a blank in
front. Byte offsets at which tokens of both end cut the tokens into groups; an A and a B token
whose byte ranges overlap are linked. The count of an id pair says how many links of the whole
corpus hold it, and a link is best if its count is the highest of its B id.

* Workers encode documents. Neither tokenizer joins anything across a single blank between two
  characters that aren't blank, so texts are cut there and a worker encodes equal pieces once. A
  text of which a piece doesn't come back byte for byte is encoded whole.
* A block of documents (``BLOCK_LINKS`` links, or one long text) writes its links by stripe: B ids are dealt
  to ``STRIPES`` stripes by their remainder, so that the frequent ones lie apart. A blob holds a stripe's
  pairs in order, each with its documents and how often.
* The pair counts of blocks are added up into a stripe's dense matrix of its B ids by all A ids with
  ``np.add.at``, ``FAN`` blobs to a task and round after round until each stripe has one. Blocks are
  aggregated before they travel, so a pair that a third of all links hold is one number of each block.
* Links and counts of a stripe are partitioned alike; row maxima of its matrix give the best, and its blobs of
  links pass by one after another. Stripes with more links than ``SALT_BYTES`` are salted by block, each salt with the counts.
* What a stripe finds out about a block's documents goes back to the block, where it is added up.

The vocabularies are read on the driver and broadcast; nothing else that is broadcast or dense grows with the corpus.

Defined cases: a text that is null, empty, or doesn't come back byte for byte from A or B has no tokens: zeros and
an empty digest; strings of special tokens are plain text; ties of the highest count are all best; repeated rows count
as often as they occur, and a repeated or null id keeps a row for each; a very long text is a block of its own; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch, table, trimming

FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
STRIPES = 250
BLOCK_LINKS = 3_000_000
MOST_DOCS = 1 << 16
#: Blobs that a task adds up.
FAN = 512
SALT_BYTES = 32 << 20
#: Pieces that a worker remembers.
MOST_PIECES = 300_000

#: A blank between two characters that aren't blank.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


# ---- columns of numbers as bytes ----


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers below 2**64, byte plane by byte plane, compressed."""
    import zstandard

    out = [np.array([len(columns), *(len(c) for c in columns)], "<u8").tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c, "<u8")
        width = 1
        while width < 8 and len(c) and int(c.max()) >> (8 * width):
            width += 1
        out += [bytes([width]), np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    lengths = np.frombuffer(data, "<u8", n, 8).astype(int)
    at, out = 8 * (n + 1), []
    for length in lengths:
        width = data[at]
        c = np.zeros((length, 8), np.uint8)
        c[:, :width] = np.frombuffer(data, np.uint8, length * width, at + 1).reshape(width, length).T
        out.append(c.view("<u8").reshape(-1).astype(np.int64))
        at += 1 + length * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


# ---- two tokenizers ----


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others in
    order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_a.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        of, vocabulary = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode("utf-8") for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [x.ids for x in found], self.b.encode(texts, num_threads=1)

    def exact(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both are the text's bytes, with a blank in front."""
        plain = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
        return np.array([b"".join(map(self.bytes_a.__getitem__, x)) == p == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, p in zip(a, b, plain, strict=True)], bool)


class Aligned(NamedTuple):
    """Tokens, groups and links of some texts, one after another."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    link_a: np.ndarray
    link_b: np.ndarray


def align_tokens(a: list[list[int]], b: list[list[int]], length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Alignment of texts whose tokens have the same bytes in all; each text has some."""
    n_a, n_b = (np.array([len(x) for x in xs], np.int64) for xs in (a, b))
    ids_a, ids_b = (np.fromiter((i for x in xs for i in x), np.int64) for xs in (a, b))
    end_a, end_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    # Between two ends of any kind lie one A and one B token, and no other two are the same.
    ends = np.union1d(end_a, end_b)
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    last = (end_a[at_a] == ends) & (end_b[at_b] == ends)  # of a group
    text_of_a = np.repeat(np.arange(len(a)), n_a)
    # The tokens in the order in which a group's are written: all of A, then all of B.
    up_to_a, up_to_b = at_a[last] + 1, at_b[last] + 1
    group_a, group_b = (np.repeat(np.arange(len(up)), np.diff(up, prepend=0)) for up in (up_to_a, up_to_b))
    place_a = np.arange(len(ids_a)) + np.concatenate(([0], up_to_b))[group_a]
    place_b = np.arange(len(ids_b)) + up_to_a[group_b]
    written = np.empty(len(ids_a) + len(ids_b), object)
    written[place_a] = [f"{i}," for i in ids_a.tolist()]
    written[place_b] = [f"{i}," for i in ids_b.tolist()]
    written[place_a[up_to_a - 1]] = [f"{i}|" for i in ids_a[up_to_a - 1].tolist()]
    written[place_b[up_to_b - 1]] = [f"{i};" for i in ids_b[up_to_b - 1].tolist()]
    words, stop = written.tolist(), np.cumsum(n_a + n_b).tolist()
    groups = ["".join(words[i:j])[:-1] for i, j in zip([0, *stop], stop, strict=False)]
    of = lambda which: np.bincount(text_of_a[which], minlength=len(a)).astype(np.int64)
    return Aligned(n_a, n_b, of(at_a[last]), of(at_a), groups, ids_a[at_a], ids_b[at_b])


class Pieces:
    """Alignments of pieces of text, remembered."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.groups: list[str] = []

    def learn(self, texts: list[str]) -> None:
        a, b = self.both.encode(texts)
        ok = self.both.exact(texts, a, b)
        good = np.flatnonzero(ok).tolist()
        x = align_tokens([a[i] for i in good], [b[i] for i in good], self.both.length_a, self.both.length_b) if good else None
        counts = np.zeros((4, len(texts)), np.int64)
        if x:
            counts[:, ok] = x.n_a, x.n_b, x.n_groups, x.n_links
        of = dict(zip(good, x.groups if x else [], strict=True))
        for i, text in enumerate(texts):
            self.place[text] = len(self.groups)
            self.groups.append(of.get(i, ""))
        if x:
            self.parts.append((counts, x.link_a, x.link_b))
        else:
            self.parts.append((counts, np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(counts, where each piece's links begin, A ids, B ids of links)."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x, axis=-1) for x in zip(*self.parts, strict=True))]
        counts, link_a, link_b = self.parts[0] if self.parts else (np.zeros((4, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return counts, np.cumsum(counts[3]) - counts[3], link_a, link_b

    def of_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The places of each text's pieces; none where it doesn't come back byte for byte."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        new = list({p for x in cut for p in x}.difference(self.place))
        if new:
            self.learn(new)
        places = [np.fromiter(map(self.place.__getitem__, x), np.int64, len(x)) for x in cut]
        has = self.numbers()[0][0] > 0
        odd = [i for i, x in enumerate(places) if not has[x].all()]
        whole = list({texts[i] for i in odd}.difference(self.place))
        if whole:
            self.learn(whole)
        has = self.numbers()[0][0] > 0
        for i in odd:
            x = np.array([self.place[texts[i]]])
            places[i] = x[has[x]]
        return places


_held: dict[str, Pieces] = {}


def _pieces(key: str, files: tuple[bytes, bytes]) -> Pieces:
    """One in a worker process, built at its first use."""
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(Tokenizers(*files))
    return _held[key]


# ---- in Spark ----


class Shape(NamedTuple):
    """Of a stripe's matrix: its rows (B ids of one remainder) and its columns (A ids)."""

    rows: int
    columns: int


_BLOCKS = "kind int, block long, stripe int, place int, id string, n_a long, n_b long, n_groups long, n_links long, sha string, groups string, size long, blob binary"


def _blocks(key: str, files, shape: Shape, keep_groups: bool):
    names = [x.split(" ")[0] for x in _BLOCKS.split(", ")]

    def block(number: int, ids: list, places: list[np.ndarray], known: Pieces) -> pd.DataFrame:
        counts, begin, link_a, link_b = known.numbers()
        rows = []
        for i, (id_, x) in enumerate(zip(ids, places, strict=True)):
            groups = ";".join([known.groups[j] for j in x.tolist()])
            n = counts[:, x].sum(axis=1).tolist()
            rows.append((0, number, None, i, id_, *n, hashlib.sha256(groups.encode()).hexdigest() if len(x) else "", groups if keep_groups else None, 0, None))
        piece = np.concatenate(places)
        n = counts[3][piece]
        doc = np.repeat(np.repeat(np.arange(len(ids)), [len(x) for x in places]), n)
        at = np.arange(n.sum()) + np.repeat(begin[piece] - (np.cumsum(n) - n), n)
        a, b = link_a[at], link_b[at]
        code = ((b % STRIPES) * shape.rows + b // STRIPES) * shape.columns + a
        link, times = np.unique(code * MOST_DOCS + doc, return_counts=True)
        code, doc = link // MOST_DOCS, link % MOST_DOCS
        one = shape.rows * shape.columns
        stops = np.searchsorted(code, np.arange(STRIPES + 1) * one)
        for s in np.flatnonzero(np.diff(stops)).tolist():
            i, j = stops[s], stops[s + 1]
            cells, first, n = np.unique(code[i:j] - s * one, return_index=True, return_counts=True)
            d = np.diff(doc[i:j], prepend=0)
            d[first] = doc[i:j][first]
            links = pack(_steps(cells), n, d, times[i:j])
            rows.append((1, number, s, 0, None, 0, 0, 0, 0, None, None, len(links), links))
            sums = pack(_steps(cells), np.add.reduceat(times[i:j], first))
            rows.append((2, number, s, 0, None, 0, 0, 0, 0, None, None, len(sums), sums))
        return pd.DataFrame(rows, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _pieces(key, files.value)
        number, ids, places, held = TaskContext.get().partitionId() << 32, [], [], 0
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids += list(part["id"])
                places += known.of_texts([t if isinstance(t, str) else None for t in part["text"]])
                counts = known.numbers()[0]
                held += sum(int(counts[3][x].sum()) for x in places[-len(part) :])
                if held >= BLOCK_LINKS or len(ids) + 256 > MOST_DOCS or len(known.place) > MOST_PIECES:
                    yield block(number, ids, places, known)
                    number, ids, places, held = number + 1, [], [], 0
                    if len(known.place) > MOST_PIECES:
                        known.forget()
        if ids:
            yield block(number, ids, places, known)

    return run


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows in the order in which they come, as (key, row)."""
    for pdf in batches:
        yield from zip(zip(*(pdf[k] for k in keys), strict=True), pdf.itertuples(index=False), strict=True)


def _added(shape: Shape):
    """Sums of blobs of (cells, counts) of the same (stripe, salt); rows come sorted by them."""

    def run(batches):
        matrix, now = np.zeros(shape.rows * shape.columns, np.int64), None

        def out():
            cells = np.flatnonzero(matrix)
            blob = pack(_steps(cells), matrix[cells])
            matrix[cells] = 0
            return pd.DataFrame([(now[0], now[1], blob)], columns=["stripe", "salt", "blob"])

        for key, row in _runs(batches, ["stripe", "salt"]):
            if now is not None and key != now:
                yield out()
            now = key
            steps, counts = unpack(row.blob)
            np.add.at(matrix, np.cumsum(steps), counts)
        if now is not None:
            yield out()

    return run


def _scored(shape: Shape):
    """Of each block of a stripe, what its documents get from it: (block, blob of places, best links, sums of
    counts). Rows come sorted by stripe and salt, the counts first."""

    def run(batches):
        matrix = np.zeros((shape.rows, shape.columns), np.int64)
        flat, highest, cells = matrix.reshape(-1), None, np.zeros(0, np.int64)
        for _, row in _runs(batches, ["stripe", "salt"]):
            if row.kind == 0:
                flat[cells] = 0
                steps, counts = unpack(row.blob)
                cells = np.cumsum(steps)
                flat[cells] = counts
                highest = matrix.max(axis=1)
                continue
            steps, n, docs, times = unpack(row.blob)
            cell = np.cumsum(steps)
            first = np.cumsum(n) - n
            total = np.cumsum(docs)  # documents rise by steps within a cell, each cell from 0 on
            docs = total - np.repeat(total[first] - docs[first], n)
            count = np.repeat(flat[cell], n)
            best = np.repeat(flat[cell] == highest[cell // shape.columns], n)
            best_links, sums = np.zeros(docs.max() + 1, np.int64), np.zeros(docs.max() + 1, np.int64)
            np.add.at(best_links, docs, times * best)
            np.add.at(sums, docs, times * count)
            there = np.flatnonzero(sums)
            yield pd.DataFrame([(row.block, pack(_steps(there), best_links[there], sums[there]))], columns=["block", "blob"])

    return run


_RESULT = "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _documents(batches):
    """The documents of a block, then what the stripes found out; rows come sorted by (block, kind)."""
    now, docs, best, sums = None, [], None, None
    columns = [x.split(" ")[0] for x in _RESULT.split(", ")]

    def out():
        rows = [(d.id, d.n_a, d.n_b, d.n_groups, d.n_links, best[d.place], sums[d.place], d.sha, d.groups) for d in docs]
        return pd.DataFrame(rows, columns=columns)

    for key, row in _runs(batches, ["block"]):
        if key != now:
            if docs:
                yield out()
            now, docs, best, sums = key, [], np.zeros(MOST_DOCS, np.int64), np.zeros(MOST_DOCS, np.int64)
        if row.kind == 0:
            docs.append(row)
        else:
            steps, b, s = unpack(row.blob)
            there = np.cumsum(steps)
            np.add.at(best, there, b)
            np.add.at(sums, there, s)
    if docs:
        yield out()


def _cells(shape: Shape):
    def run(batches):
        for pdf in batches:
            for stripe, blob in zip(pdf["stripe"], pdf["blob"], strict=True):
                steps, counts = unpack(blob)
                cell = np.cumsum(steps)
                row = cell // shape.columns
                highest = np.zeros(shape.rows, np.int64)
                np.maximum.at(highest, row, counts)
                yield pd.DataFrame({"a": cell % shape.columns, "b": row * STRIPES + stripe, "n": counts, "best": counts == highest[row]})

    return run


class Alignment(NamedTuple):
    """``documents``: a row for each, id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and
    groups); ``pairs``: (a, b, n, best) of all linked id pairs. Both read tables in the shared folder."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B, keep_groups: bool = False) -> Alignment:
    """Tokens of both tokenizers in each text, their links, and the corpus-wide counts of id pairs."""
    spark = docs.sparkSession
    with open(file_a, "rb") as fa, open(file_b, "rb") as fb:
        files = (fa.read(), fb.read())
    both = Tokenizers(*files)
    shape = Shape(-(-len(both.bytes_b) // STRIPES), len(both.bytes_a))
    key = hashlib.sha256(b"\0".join(files)).hexdigest()
    shared, keep = spark.sparkContext.broadcast(files), []
    with scratch(spark, keep):
        plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        blocks = materialize(plain.mapInPandas(trimming(_blocks(key, shared, shape, keep_groups)), _BLOCKS), "alignment-blocks")
        counts = _stripe_counts(blocks, shape)
        keep += [blocks._gneiss_path, counts._gneiss_path]
    salts = blocks.where("kind = 1").groupBy("stripe").agg(F.ceil(F.sum("size") / SALT_BYTES).cast("int").alias("salts"))
    links = blocks.where("kind = 1").join(F.broadcast(salts), "stripe").select("stripe", F.pmod("block", "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "block", "blob")
    each = counts.join(F.broadcast(salts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "blob")
    scores = links.unionByName(each).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind").mapInPandas(trimming(_scored(shape)), "block long, blob binary")
    own = blocks.where("kind = 0").select("block", "kind", "place", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", F.lit(None).cast("binary").alias("blob"))
    back = own.unionByName(scores.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = back.na.fill(0, ["place", "n_a", "n_b", "n_groups", "n_links"]).repartition("block").sortWithinPartitions("block", "kind").mapInPandas(trimming(_documents), _RESULT)
    out = out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
    return Alignment(out if keep_groups else out.drop("groups"), counts.mapInPandas(_cells(shape), "a long, b long, n long, best boolean"))


def _stripe_counts(blocks: DataFrame, shape: Shape) -> DataFrame:
    """(stripe, blob): the counts of each stripe, added up ``FAN`` blobs to a task until there is one."""
    sums = blocks.where("kind = 2").select("stripe", F.hash("block").alias("salt"), "blob")
    left = blocks.where("kind = 2").groupBy("stripe").count().agg(F.max("count")).first()[0] or 1
    while True:
        left = -(-left // FAN)
        salted = sums.withColumn("salt", F.pmod("salt", F.lit(left)).cast("int"))
        added = salted.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInPandas(trimming(_added(shape)), "stripe int, salt int, blob binary")
        sums = materialize(added, "alignment-counts")
        if left == 1:
            return sums


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).documents
