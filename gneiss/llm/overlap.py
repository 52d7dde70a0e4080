"""Jaccard join of word n-grams by T-occurrence search.

A document's set is its distinct shingles of ``shingle`` words; two documents link when
100 * intersection >= ``percent`` * union, so when they have T = percent * (both sizes) / (100 + percent)
shingles in common. Documents with the same set are one class, of which one goes on.

* Order: shingles are ordered by how often they occur, counted in ``BUCKETS`` buckets over all documents, then by
  hash. Any order gives right results; this one puts shingles with long lists last.
* Meeting: documents that link have in common at least one of the first n - ceil(percent * n / 100) + 1 of
  their n shingles, so only these are posted, and only lists of two or more go on.
* Search: a query's lists in an inverted index of its candidates are divided by length. The L longest
  ones are set aside; the short ones are heap-merged, skipping over documents that can't come up T - L times; documents
  that do are looked up in the long lists by binary search (DivideSkip, L = T / (MU * log2(longest) + 1)).
  The count it ends with is the whole intersection, so every link is exact.

Before texts are fetched, sizes must allow T, and so must parity bits: each shingle flips one bit of its document, so
two documents differ in at least as many shingles as bits. Neither test can lose a link.

In each list the smallest id is the query of all others, which is linear in the list; links join
components. What is left are lists whose documents are in different components, one of each distinct set of
members. Where one component has at least half of a large list, the others query that component once. Then lists of up
to ``SMALL`` are compared by their bits, and what is left of larger ones block against block, by tasks with the
texts of two blocks, which write a link only where it joins two components. Nothing is capped, dropped or sampled.

Defined cases: as in ``neardup``: null, empty and blank texts have an empty set and no link; with fewer words than a
shingle the whole sequence is the one shingle; every row is returned, rows that repeat an id or have none are placed by
their own text; ties of size don't matter; a null id is the smallest of all, and null again in the result; very long
texts are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .neardup import NULL_ID, components, row_key, set_name, shingle_set
from .shared import join_spread, materialize, scratch, table, trimming

SMALL = 64
#: Buckets in which shingles are counted for their order, sent in so many slices.
BUCKETS = 1 << 20
SLICES = 64
#: What a step of the heap costs against one of binary search.
MU = 0.0085
#: Documents, and shingles, of an index.
BLOCK = 256
BLOCK_SHINGLES = 1 << 19

_U = np.uint64


def required(x, y, percent: int):
    """Common shingles that sets of ``x`` and ``y`` need to link: numbers or arrays of them."""
    return -(-percent * (x + y) // (100 + percent))


def posted(n: int, percent: int) -> int:
    """How many of a set's first shingles are posted."""
    return n - -(-percent * n // 100) + 1


# ---- parity bits ----


def parity(s: np.ndarray) -> bytes:
    """One bit for each hash, flipped by each shingle: at least as many bits as shingles."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two parities, the wider one folded: at most as many as shingles that only one has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def possible(n: int, bits: bytes, m: int, other: bytes, percent: int) -> bool:
    """Whether two sets, known by their sizes and bits, may link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    return differing(bits, other) <= n + m - 2 * required(n, m, percent)


# ---- the search ----


class Inverted:
    """Inverted lists of some sets: of each shingle, the sets that have it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, first = np.unique(flat[order], return_index=True)
        self.stops = np.append(first, len(flat)).tolist()
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order].tolist()

    def lists(self, query: np.ndarray) -> list[list[int]]:
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query]
        return [self.members[self.stops[i] : self.stops[i + 1]] for i in at.tolist()]

    def search(self, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(set, intersection) of all sets that link with ``query``."""
        n = len(query)
        least = int(required(n, int(self.sizes.min()), percent))
        lists = sorted(self.lists(query), key=len, reverse=True)
        if len(lists) < least:
            return []
        aside = min(least - 1, int(least / (MU * math.log2(len(lists[0])) + 1)))
        long, found = lists[:aside], []
        for k, count in merged(lists[aside:], least - aside):
            need = int(required(n, int(self.sizes[k]), percent))
            for left, postings in zip(range(len(long), 0, -1), long, strict=True):
                if count + left < need:
                    break
                i = bisect_left(postings, k)
                count += i < len(postings) and postings[i] == k
            if count >= need:
                found.append((k, count))
        return found


def merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(element, lists that hold it) of those in at least ``least`` of the sorted lists: a heap of the lists' heads,
    from which lists are moved on by binary search where too few can hold what they show."""
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    places = [0] * len(lists)
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield top, len(taken)
            target = top + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for i in taken:
            places[i] = at = bisect_left(lists[i], target, places[i])
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i))


# ---- tasks ----


def _sets(k: int):
    """Of each row its set's size, name and parity; at the end, the task's shingles by bucket."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            for s in sets:
                np.add.at(counts, (s >> _U(40)).astype(np.int64) & (BUCKETS - 1), 1)
            names = [set_name(s) for s in sets]
            yield pd.DataFrame({
                "doc": pdf["doc"].to_numpy(), "id": pdf["id"].to_numpy(), "n": [len(s) for s in sets],
                "h1": neardup.signed(np.array([a for a, _ in names], np.uint64)), "h2": neardup.signed(np.array([b for _, b in names], np.uint64)),
                "bits": [parity(s) if len(s) else b"" for s in sets], "slice": -1,
            })
        held = counts.reshape(SLICES, -1)
        some = np.flatnonzero(held.any(axis=1))
        yield pd.DataFrame({"doc": 0, "id": 0, "n": 0, "h1": 0, "h2": 0, "bits": [held[i].astype("<i8").tobytes() for i in some], "slice": some})

    return run


def _slices(batches):
    """Sums of the slices, which come sorted."""
    now, total = None, None
    for pdf in batches:
        for s, data in zip(pdf["slice"], pdf["bits"], strict=True):
            if s != now:
                if now is not None:
                    yield pd.DataFrame({"slice": [now], "bits": [total.tobytes()]})
                now, total = s, np.zeros(BUCKETS // SLICES, np.int64)
            total += np.frombuffer(data, "<i8")
    if now is not None:
        yield pd.DataFrame({"slice": [now], "bits": [total.tobytes()]})


def _postings(k: int, percent: int, often):
    """The first shingles of each document in the common order."""

    def run(batches):
        for pdf in batches:
            tokens, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(t, k)
                if len(s):
                    p = posted(len(s), percent)
                    seen = often.value[(s >> _U(40)).astype(np.int64) & (BUCKETS - 1)]
                    tokens.append(s[np.lexsort((s, seen))[:p]])
                    ids.append(np.full(p, i, np.int64))
            yield pd.DataFrame({"node": neardup.signed(np.concatenate(tokens)), "id": np.concatenate(ids)})

    return run


def _may_link(percent: int):
    def run(batches):
        for pdf in batches:
            ok = [possible(n, x, m, y, percent) for n, x, m, y in zip(pdf["na"], pdf["xa"], pdf["nb"], pdf["xb"], strict=True)]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _small_lists(percent: int):
    """Pairs of a list's documents in different components that may link; rows come sorted by list, and at
    most one list's rows wait for the next batch."""

    def pairs(rows):
        for i, (x, comp, n, bits) in enumerate(rows):
            for y, other, m, theirs in rows[:i]:
                if comp != other and possible(n, bits, m, theirs, percent):
                    yield min(x, y), max(x, y)

    def run(batches):
        now, rows = None, []
        for pdf in batches:
            found = []
            for node, *row in zip(pdf["node"], pdf["id"], pdf["comp"], pdf["n"], pdf["bits"], strict=True):
                if node != now:
                    found += pairs(rows)
                    now, rows = node, []
                rows.append(row)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(list(pairs(rows)), columns=["a", "b"], dtype=np.int64)

    return run


def _queries(k: int, percent: int):
    """Links of queries (side 0) with their candidates (side 1); rows come sorted by (a, block, side)."""

    def links(query, rows):
        if rows:
            index = Inverted([shingle_set(t, k) for _, t in rows])
            for i, _ in index.search(shingle_set(query[1], k), percent):
                yield query[0], rows[i][0]

    def run(batches):
        now, query, rows = None, None, []
        for pdf in batches:
            found = []
            for a, block, side, b, text in zip(pdf["a"], pdf["block"], pdf["side"], pdf["b"], pdf["text"], strict=True):
                if (a, block) != now:
                    found += links(query, rows)
                    now, rows = (a, block), []
                if side == 0:
                    query = (a, text)
                else:
                    rows.append((b, text))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(list(links(query, rows)), columns=["a", "b"], dtype=np.int64)

    return run


def _between(k: int, percent: int):
    """Links that join components between two blocks (sides 0 and 1), or within one (one side). Each document outside
    the largest component queries those that aren't yet in its own; of the links found one is
    written for each component that is joined."""

    def run(pdf):
        ids, comp, side, n = (pdf[c].to_numpy() for c in ("id", "comp", "side", "n"))
        bits, texts, sets, links = list(pdf["bits"]), list(pdf["text"]), {}, []
        names, label, counts = np.unique(comp, return_inverse=True, return_counts=True)
        across = side.max() != side.min()

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i], k)
            return sets[i]

        for i in np.flatnonzero(comp != names[counts.argmax()]).tolist():
            open_ = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if across:
                open_ &= side != side[i]
            near = [j for j in np.flatnonzero(open_).tolist() if possible(n[i], bits[i], n[j], bits[j], percent)]
            if near:
                for j, _ in Inverted([of(j) for j in near]).search(of(i), percent):
                    if label[near[j]] != label[i]:
                        links.append((min(ids[i], ids[near[j]]), max(ids[i], ids[near[j]])))
                        label[label == label[near[j]]] = label[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


# ---- in Spark ----


def search(pairs: DataFrame, sets: DataFrame, texts: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """The links among candidate pairs (a, b): each ``a`` is a query of an index of its ``b``, cut into blocks."""
    sized = pairs.join(sets.select(F.col("id").alias("b"), "n"), "b")
    cuts = sized.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocked = materialize(pairs.join(cuts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")), "overlap-pairs")
    needed = materialize(texts(blocked.select(F.col("a").alias("id")).unionByName(blocked.select(F.col("b").alias("id")))), "overlap-texts")
    text = needed.select(F.col("id").alias("b"), "text")
    rows = blocked.withColumn("side", F.lit(1)).unionByName(blocked.select("a", F.col("a").alias("b"), "block").distinct().withColumn("side", F.lit(0)))
    full = rows.join(text, "b").select("a", "block", "side", "b", "text")
    return materialize(full.repartition("a", "block").sortWithinPartitions("a", "block", "side").mapInPandas(trimming(_queries(k, percent)), "a long, b long"), "overlap-links")


def _filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bits allow a link."""
    one = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(one("b"), "b").join(one("a"), "a").where(fits)
    return materialize(both.select("a", "b", "na", "xa", "nb", "xb").mapInPandas(trimming(_may_link(percent)), "a long, b long"), "overlap-candidates")


def _compare(keyed: DataFrame, sets: DataFrame, texts: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """Links that join components, from tasks of two blocks each."""
    keyed = materialize(keyed, "overlap-keyed")
    needed = materialize(texts(keyed.select("id")).join(sets.select("id", "n", "bits"), "id"), "overlap-family-texts")
    return materialize(keyed.join(needed, "id").groupBy("g", "p", "q").applyInPandas(_between(k, percent), "a long, b long"), "overlap-families")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id. The result reads two tables of ids and sets
    in the shared folder; the others are deleted before it returns."""
    keep: list[str] = []
    with scratch(docs.sparkSession, keep):
        rows = _linked(docs, id_col, text_col, shingle, percent, keep)
    back = lambda c: F.nullif(c, F.lit(NULL_ID))
    return rows.select(back(F.col("doc")).alias(id_col), F.col("n").cast("long").alias("n_shingles"), back(F.col("first")).alias("component_id"))


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, keep: list[str], seed: int = 0) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(id_col, text_col, seed).alias("id"), F.col(text_col).alias("text"))
    found = materialize(plain.mapInPandas(trimming(_sets(k)), "doc long, id long, n int, h1 long, h2 long, bits binary, slice int"), "overlap-sets")
    all_sets = found.where("slice < 0").drop("slice")
    state = neardup.keys_of(all_sets)
    if state["mixed"]:  # two sets have one key: take other keys
        return _linked(docs, id_col, text_col, k, percent, keep, seed + 1)

    def texts(ids: DataFrame) -> DataFrame:
        some = neardup.picked(plain, ids)
        return some.dropDuplicates(["id"]) if (state["rows"] or 0) > 1 else some

    classes = neardup.classes_of(all_sets)
    sets = materialize(neardup.representatives(all_sets, classes).select("id", "n", "bits").distinct(), "overlap-representatives")

    often = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in found.where("slice >= 0").select("slice", "bits").repartition("slice").sortWithinPartitions("slice").mapInPandas(_slices, "slice int, bits binary").toLocalIterator():
        often[r["slice"]] = np.frombuffer(r["bits"], "<i8")  # BUCKETS numbers in all
    shared_counts = spark.sparkContext.broadcast(often.reshape(-1))

    posts = neardup.picked(plain, sets).mapInPandas(trimming(_postings(k, percent, shared_counts)), "node long, id long")
    members = materialize(posts, "overlap-postings")
    nodes = members.groupBy("node").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("size")).where("lead <> last").drop("last")
    lists = materialize(join_spread(members, materialize(nodes, "overlap-nodes"), "node", "size", "id").drop("size"), "overlap-lists")

    stars = lists.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = search(_filtered(stars, sets, percent), sets, texts, k, percent)
    comps = components(links)

    open_ = neardup.mixed_nodes(lists.where("id <> lead").select("node", "id"), comps)
    large = open_.where(F.col("size") > SMALL)
    if not large.isEmpty():
        hosted = materialize(neardup.hosts(large), "overlap-hosts")
        guests = hosted.where("comp <> host")
        links, comps = neardup.more(links, comps, _compare(neardup.against_hosts(hosted, sets), sets, texts, k, percent))
        left = open_.where(F.col("size") <= SMALL).select("node", "id").unionByName(large.join(hosted.select("node").distinct(), "node", "left_anti").select("node", "id"))
        open_ = neardup.mixed_nodes(left.unionByName(guests.select("node", "id")), comps)
    small = open_.where(F.col("size") <= SMALL).join(sets, "id").select("node", "id", "comp", "n", "bits")
    pairs = small.repartition("node").sortWithinPartitions("node").mapInPandas(trimming(_small_lists(percent)), "a long, b long")
    links, comps = neardup.more(links, comps, search(materialize(pairs.distinct(), "overlap-candidates"), sets, texts, k, percent))
    large = open_.where(F.col("size") > SMALL)
    if not large.isEmpty():
        keyed = neardup.in_blocks(neardup.mixed_nodes(large.select("node", "id"), comps), sets)
        links, comps = neardup.more(links, comps, _compare(keyed, sets, texts, k, percent))
    return neardup.labelled(all_sets, classes, comps, keep, found._gneiss_path)


def op11_overlap(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), shingle=5, percent=80)


OP11_SQL = neardup.components_sql(5, 80)
