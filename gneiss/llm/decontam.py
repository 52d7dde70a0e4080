"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, then the runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is 13 consecutive words of an item (all of
them, if it has fewer). The automaton's patterns are, of every item, ``ANCHOR`` words at every
``STRIDE``-th place: each window of 13 holds one of them whole; an item of fewer words is one
pattern. A document is normalised the same way and scanned once, whatever the items have in common: where an anchor
occurs, the document's windows around it are looked up, each once, among the items' distinct windows, which are kept
as sorted hashes and compared word for word; which items hold a window is read only where it occurs.
Hits are word ranges, mapped back to code points of the original text.

Words are written as codes of fixed width over a small alphabet for each place, so that a node
has few children and a match can't begin inside a word. What a worker holds grows with the
benchmark, never with the documents. A benchmark of more than ``MOST_WORDS`` words is refused;
README has what a worker holds at that limit. Up to there the plan is always the same.

Defined cases: null or empty text has no words and no hit; an item without words has no
window; repeated items (same id) count once; a null item id is not reported, though its
words are hit; repeated documents are judged alike, each on its own; ties don't arise, since every
item with a window in the text is named; a very long text is one string of codes, scanned whole; an
empty benchmark leaves every document clean; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, fresh, table, trim

WINDOW = 13
ANCHOR, STRIDE = 5, 9
MOST_WORDS = 2_000_000
#: Bits of a code letter.
BITS = 6
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_FOLD)) if text else []


def spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of the words of ``normal(text)`` in the original text."""
    return [m.span() for m in _WORD.finditer(text.translate(_FOLD))]


def gather(items, most: int = MOST_WORDS) -> list[tuple[str | None, str]]:
    """(id, words joined by blanks) of the items, each once; at most ``most`` words in all."""
    seen, total = {}, 0
    for item_id, text in items:
        words = normal(text)
        key = (None if item_id is None else str(item_id), " ".join(words))
        if words and key not in seen:
            total += len(words)
            if total > most:
                raise ValueError(f"the benchmark has more than {most} words; one automaton can't hold it")
            seen[key] = None
    return list(seen)


def rolled(codes: np.ndarray, factor: int) -> np.ndarray:
    """A hash of each ``WINDOW`` consecutive codes."""
    n = len(codes) - WINDOW + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(WINDOW if n > 0 else 0):
        out = (out + codes[i : i + n].astype(np.uint64) + np.uint64(1)) * np.uint64(factor)
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The distinct windows of the items, by sorted hashes: where one occurrence lies, and the items that hold it."""

    def __init__(self, items: list[np.ndarray]):
        self.codes = np.concatenate(items) if items else np.zeros(0, np.int32)
        begin = np.cumsum([0, *map(len, items)])
        counts = np.array([max(0, len(x) - WINDOW + 1) for x in items], np.int64)
        item = np.repeat(np.arange(len(items)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[item]
        self.factor = 0x9E3779B97F4A7C15
        while True:
            h = rolled(self.codes, self.factor)[place]
            order = np.lexsort((item, h))
            self.hashes, first, self.which = np.unique(h[order], return_index=True, return_inverse=True)
            self.place = place[order][first]
            mine = place[order]
            if all((self.codes[mine + i] == self.codes[self.place[self.which] + i]).all() for i in range(WINDOW)):
                break
            self.factor += 2  # two windows have one hash: take another one
        pairs = np.unique(self.which.astype(np.int64) * max(1, len(items)) + item[order])
        self.which = None
        self.items = (pairs % max(1, len(items))).astype(np.int32)
        self.stops = np.searchsorted(pairs, np.arange(len(self.hashes) + 1) * max(1, len(items)))

    def find(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of a text that begin at ``starts``, those that an item has, and their numbers."""
        if not len(starts) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = rolled(codes, self.factor)[starts]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[at] == h
        for i in range(WINDOW):
            ok &= self.codes[self.place[at] + i] == codes[starts + i]
        return starts[ok], at[ok]


class Automaton:
    """All items' anchors, and the items' distinct windows."""

    def __init__(self, items: list[tuple[str | None, str]]):
        import ahocorasick

        self.number = {w: n for n, w in enumerate(sorted({w for _, text in items for w in text.split(" ")}))}
        self.width = max(1, -(-len(self.number).bit_length() // BITS))
        self.letters = [[chr(0x100 + (place << BITS) + x) for x in range(1 << BITS)] for place in range(self.width)]
        self.ids = [item_id for item_id, _ in items]
        coded = [np.array([self.number[w] for w in text.split(" ")], np.int32) for _, text in items]
        self.trie, short = ahocorasick.Automaton(), {}
        for k, codes in enumerate(coded):
            n = len(codes)
            if n < WINDOW:
                short.setdefault(self.written(codes), (n, []))[1].append(k)
                continue
            for at in range(0, n - ANCHOR + 1, STRIDE):
                self.trie.add_word(self.written(codes[at : at + ANCHOR]), (ANCHOR, None))
        for pattern, (n, who) in short.items():  # an item of ANCHOR words may also be an anchor
            anchor = n == ANCHOR and pattern in self.trie
            self.trie.add_word(pattern, (n, (tuple(who), anchor)))
        self.trie.make_automaton()
        self.windows = Windows(coded)

    def written(self, codes) -> str:
        """Codes as letters; -1, for a word that no item has, as letters that none has."""
        return "".join(["".join([self.letters[place][n >> (BITS * place) & (1 << BITS) - 1] for place in range(self.width)]) if n >= 0 else "\0" * self.width for n in codes])

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) word ranges inside occurrences of windows, and the items."""
        if not words or not self.ids:
            return [], set()
        number = self.number.get
        codes = [number(w, -1) for w in words]
        hits, who, starts, next_ = [], set(), [], 0
        for last, (n, short) in self.trie.iter(self.written(codes)):
            end = (last + 1) // self.width
            if short is not None:
                hits.append((end - n, end))
                who.update(short[0])
                if not short[1]:
                    continue
            # Windows with this anchor begin where none has been looked up yet.
            next_ = max(next_, end - WINDOW)
            stop = min(end - ANCHOR, len(words) - WINDOW) + 1
            starts += range(next_, stop)
            next_ = max(next_, stop)
        if starts:
            found, which = self.windows.find(np.array(codes, np.int32), np.array(starts))
            hits += [(a, a + WINDOW) for a in found.tolist()]
            for w in np.unique(which).tolist():
                who.update(self.windows.items[self.windows.stops[w] : self.windows.stops[w + 1]].tolist())
        merged: list[list[int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], who


_cache: dict[str, Automaton] = {}


def _held(key: str, items) -> Automaton:
    """One automaton in a worker process, built at its first use."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = Automaton(items)
    return _cache[key]


def decontaminate(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", keep_text=False, out="_hits") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items (sorted ids), spans (code
    points of hit runs in the original text), contaminated. With ``keep_text`` instead all
    columns of ``docs``, whatever their names, and the struct ``out``."""
    items = gather((r[0], r[1]) for r in bench.select(item_id, item_text).toLocalIterator())
    key = hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most MOST_WORDS words

    @F.pandas_udf("n_words bigint, n_hit bigint, items array<string>, spans array<struct<s:int,e:int>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = _held(key, shared.value)
        for texts in batches:
            found = []
            for text in texts:
                words = normal(text)
                ranges, who = auto.scan(words)
                at = spans(text) if ranges else []
                found.append((len(words), sum(b - a for a, b in ranges), sorted({auto.ids[k] for k in who} - {None}), [{"s": at[a][0], "e": at[b - 1][1]} for a, b in ranges]))
            yield pd.DataFrame(found, columns=["n_words", "n_hit", "items", "spans"])
        trim()

    if keep_text:
        return docs.withColumn(out, hits(F.col(text_col)))
    (name,) = fresh(docs, "_hits")
    h = F.col(name)
    return docs.select(id_col, hits(F.col(text_col)).alias(name)).select(
        id_col, h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        h["items"].alias("items"), h["spans"].alias("spans"), contaminated(h).alias("contaminated"),
    )


def contaminated(hits):
    """The contamination rule: hit words are at least a twentieth of all."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def op2_decontam(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT DISTINCT item_id, ws, least(13, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)
), dw AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)
), w AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)
"""
