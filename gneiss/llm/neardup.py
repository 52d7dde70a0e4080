"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of ``shingle`` words. Documents with the same set are
one class; only one representative of each class goes on, named by a hash of its id and text
(``row_key``), so that rows which share an id, or have none, stay apart. Each representative
has ``SKETCH`` minwise values of its set.

Chosen paths: in each of ``TREES`` independent trees a document starts at the root and
branches: the node it is in picks, by its own hash, one of the sketch's tokens (and a second
one with the chance that makes 1/threshold branches on average), and each picked value
leads to a child node. Which children a document enters depends on its path and sketch
alone, so ``DEPTH`` levels need no exchange. A pair at the threshold meets in none of the 16
trees with a probability of 1.2e-5 at 85 % and 5.6e-5 at 80 %, averaged over sketches (calculated).

In each node the smallest id is compared with all others (linear in the node's size), and
confirmed links join their components. What is left are nodes whose other documents are in
different components, one of each distinct set of members. Where one component has at least half
of a large node, the rest meet that component once, whichever nodes they share with it. Then
nodes of up to ``SMALL`` are compared exhaustively by their sketches, and what is left of larger
ones block against block, as completely, by tasks with the texts of two blocks (of at most
``BLOCK`` documents and about ``BLOCK_SHINGLES`` shingles), which write a link only where it joins two
components, so never more links than documents. Every candidate is confirmed on the full
sets. Nothing is capped, dropped or sampled, and no size changes which pairs are compared.

Results are components: the smallest id reachable. Exact copies and large groups of
near copies never turn into all their pairs.

Defined cases: null or empty texts, and texts of blanks, have an empty set, no link and are
kept; with fewer words than a shingle, the whole sequence is the one shingle; every row is
returned, rows that repeat an id or have none are placed by their own text, and texts that are not
linked never meet by their ids; a null id is the smallest of all, and is null again in the
result; very long texts are taken whole; ties don't arise, but for different texts with one id in a component,
of which ``one_of_each`` keeps that of the smallest key; an empty table gives an empty result; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .shared import fresh, join_spread, marked, materialize, scratch, table, trimming

SKETCH = 64
TREES = 16
DEPTH = 4
SMALL = 64
#: Documents of a block, and shingles: a task holds two blocks.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
NULL_ID = -(2**63)

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_MUL = _rng.integers(1, 2**63, SKETCH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def least_agree(threshold: float) -> float:
    """The share of agreeing sketch values below which a pair isn't checked: 5.5 deviations
    under the threshold, so that one pair in 50 millions at the threshold is missed."""
    return threshold - 5.5 * float(np.sqrt(threshold * (1 - threshold) / SKETCH))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 1 << 16), _BASE, np.uint64))
    return _powers[:n]


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and byte offsets of the words of ASCII-lower-cased UTF-8: sums of byte
    codes times powers of the place in the word, for all words at once."""
    b = np.frombuffer(data, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    lengths = end - start
    inside = ~blank
    place = np.flatnonzero(inside) - np.repeat(start, lengths)
    value = _BYTE[b[inside]] * _power(int(lengths.max()))[place]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return _mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), start


def word_hashes(data: bytes) -> np.ndarray:
    return words_at(data)[0]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``k`` words."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() is ASCII only
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = _mix(h + w[i : len(w) - n + 1 + i] + _U(i + 1))
    return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """``SKETCH`` 32-bit minwise values; of large sets, a block of shingles at a time."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048, None] * _MUL + _ADD
        np.minimum(out, (x ^ (x >> _U(29))).min(axis=0), out=out)
    return (_mix(out) >> _U(32)).astype(np.uint32)


def branch(nodes: np.ndarray, owners: np.ndarray, sketches: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Node hashes and the rows of ``sketches`` in them, ``levels`` further down."""
    extra = _U(int((1 / threshold - 1) * 2**32))
    for level in range(levels):
        pick = _mix(nodes + _U(level + 1))
        first = (pick % _U(SKETCH)).astype(np.int64)
        again = (pick >> _U(32)) < extra
        second = (first[again] + 1 + ((pick[again] >> _U(8)) % _U(SKETCH - 1)).astype(np.int64)) % SKETCH
        both = np.concatenate((nodes, nodes[again]))
        token = np.concatenate((first, second))
        owners = np.concatenate((owners, owners[again]))
        nodes = _mix(_mix(both * _U(31) + token.astype(np.uint64)) ^ sketches[owners, token].astype(np.uint64))
    return nodes, owners


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set make its 128-bit name."""
    return (int(_mix(s).sum(dtype=np.uint64)), int(_mix(s + _BASE).sum(dtype=np.uint64))) if len(s) else (0, 0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sets(id_col: str, text_col: str, k: int):
    def run(batches):
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf[text_col]]
            some = [len(s) > 0 for s in sets]
            names = [set_name(s) for s in sets]
            yield pd.DataFrame({
                "doc": pdf["doc"].to_numpy(), "id": pdf[id_col].to_numpy(),
                "n": [len(s) for s in sets],
                "h1": signed(np.array([a for a, _ in names], np.uint64)), "h2": signed(np.array([b for _, b in names], np.uint64)),
                "sketch": [sketch(s).tobytes() if ok else b"" for s, ok in zip(sets, some, strict=True)],
            })

    return run


def _paths(threshold: float):
    def run(batches):
        roots = _mix(np.arange(1, TREES + 1, dtype=np.uint64) * _BASE)
        for pdf in batches:
            if len(pdf):
                sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint32).reshape(-1, SKETCH)
                owners = np.repeat(np.arange(len(pdf)), TREES)
                nodes, owners = branch(np.tile(roots, len(pdf)), owners, sk, DEPTH, threshold)
                yield pd.DataFrame({"node": signed(nodes), "id": pdf["id"].to_numpy()[owners]})

    return run


def _small_nodes(threshold: float):
    """Pairs of documents of a node in different components whose sketches agree; rows come
    sorted by node, and at most one node's rows wait for the next batch."""
    least = least_agree(threshold)

    def pairs(ids, comp, sk):
        agree = (sk[:, None, :] == sk[None, :, :]).mean(axis=2)
        i, j = np.nonzero(np.triu((agree >= least) & (comp[:, None] != comp[None, :]), 1))
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def run(batches):
        wait = None
        for pdf in batches:
            if not len(pdf):
                continue
            sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint32).reshape(-1, SKETCH)
            now = [pdf["node"].to_numpy(), pdf["id"].to_numpy(), pdf["comp"].to_numpy(), sk]
            if wait is not None:
                now = [np.concatenate(x) for x in zip(wait, now, strict=True)]
            cut = np.flatnonzero(np.diff(now[0])) + 1
            starts = np.concatenate(([0], cut))
            found = [pairs(*(x[a:b] for x in now[1:])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            wait = [x[starts[-1] :] for x in now]
            if found:
                yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})
        if wait is not None:
            a, b = pairs(*wait[1:])
            yield pd.DataFrame({"a": a, "b": b})

    return run


def _family(threshold: float, k: int, percent: int):
    """Links that join components between two blocks (sides 0 and 1), or within one (one side). Each
    document outside the largest component is compared with all that are not yet in its
    own and whose sketches agree; their intersections are counted together. Of the links
    found one is written for each component that is joined."""
    least = least_agree(threshold)

    def run(pdf):
        ids, comp, side = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), pdf["side"].to_numpy()
        sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint32).reshape(-1, SKETCH)
        names, label, counts = np.unique(comp, return_inverse=True, return_counts=True)
        texts, sets, links = list(pdf["text"]), {}, []
        across = side.max() != side.min()

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i], k)
            return sets[i]

        for i in np.flatnonzero(comp != names[counts.argmax()]):
            open_ = label != label[i]
            if across:
                open_ &= side != side[i]
            near = np.flatnonzero(open_)
            near = near[(sk[near] == sk[i]).mean(axis=1) >= least]
            if not len(near):
                continue
            x = of(i)
            others = [of(j) for j in near]
            sizes = np.array([len(y) for y in others])
            flat = np.concatenate(others)
            at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
            common = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for j in near[100 * common >= percent * (len(x) + sizes - common)]:
                if label[j] != label[i]:
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _agree(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches agree well enough to be worth the exact check."""
    near = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    far = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    both, least = pairs.join(near, "b").join(far, "a"), least_agree(threshold)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["sa"]), np.uint32).reshape(-1, SKETCH)
                y = np.frombuffer(b"".join(pdf["sb"]), np.uint32).reshape(-1, SKETCH)
                yield pdf.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(trimming(run), "a long, b long")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose ids may be among ``ids``, without moving any other. The joins that follow are
    exact."""
    return marked(docs, ids, F.col("id"), "_maybe").where("_maybe").select("id", "text")


def without(docs: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``ids`` (id). Only rows that the bit filter
    can't clear go through the join."""
    maybe, name = fresh(docs, "_maybe", "_key")
    seen = marked(docs, ids, key, maybe)
    rest = seen.where(F.col(maybe)).withColumn(name, key).join(ids.select(F.col("id").alias(name)), name, "left_anti")
    return seen.where(~F.col(maybe)).select(*docs.columns).unionByName(rest.select(*docs.columns))


def once(docs: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """``docs`` with one row only for each ``key`` in ``ids`` (id)."""
    maybe, name = fresh(docs, "_maybe", "_key")
    some = marked(docs, ids, key, maybe).where(F.col(maybe)).withColumn(name, key).join(ids.select(F.col("id").alias(name)), name, "left_semi").dropDuplicates([name])
    return without(docs, ids, key).unionByName(some.select(*docs.columns))


def _confirm(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets. Texts are what
    moves: they are smaller than their sets. A hot side is a plain equi-join of two
    exchanges, which adaptive execution splits."""
    needed = materialize(texts(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))), "neardup-texts")
    both = pairs.join(needed.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(needed.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        last, x = None, None  # rows come sorted by a: its set is kept from row to row
        for pdf in batches:
            ok = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if last != (a, ta):
                    last, x = (a, ta), shingle_set(ta, k)
                y = shingle_set(tb, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[ok, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(trimming(run), "a long, b long")


def row_key(id_col: str, text_col: str, seed: int) -> Column:
    """The name of a row by its id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.col(text_col), F.lit(seed))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept. The result reads two tables of
    ids and sets in the shared folder; the others are deleted before it returns."""
    rows, _ = placed(docs, id_col, text_col, shingle, percent)
    back = lambda c: F.nullif(c, F.lit(NULL_ID))
    return rows.select(back(F.col("doc")).alias(id_col), F.col("n").cast("long").alias("n_shingles"), back(F.col("first")).alias("component_id"), (F.col("doc") == F.col("first")).alias("kept"))


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: one of its smallest id. Rows are told apart by their
    own texts, so those that share an id, or have none, go only if their texts are linked.
    Rows with an empty set all stay."""
    rows, seed = placed(docs, id_col, text_col, shingle, percent)
    key = row_key(id_col, text_col, seed)
    named = rows.where("n > 0").select("id", "comp", (F.col("doc") == F.col("first")).alias("kept"))
    by_key = materialize(named.groupBy("id").agg(F.min("comp").alias("comp"), F.max("kept").alias("kept"), F.count("*").alias("rows")), "neardup-kept")
    gone, kept = by_key.where("NOT kept").select("id"), by_key.where("kept")
    # Different texts of one component with the same smallest id: the smallest key stays.
    several = kept.groupBy("comp").agg(F.min("id").alias("stays"), F.count("*").alias("keys")).where("keys > 1")
    if not several.isEmpty():
        gone = gone.unionByName(kept.join(several, "comp").where("id <> stays").select("id"))
    out = without(docs, gone, key)
    repeated = kept.where("rows > 1").select("id")
    return out if repeated.isEmpty() else once(out, repeated, key)


def placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, int]:
    """One row per row of ``docs``: doc (its id, null as NULL_ID), id (its key), n, comp (a key that
    names its component) and first (the component's smallest doc); and the seed of the keys."""
    keep: list[str] = []
    with scratch(docs.sparkSession, keep):
        return _placed(docs, id_col, text_col, shingle, percent, keep)


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, keep: list[str], seed: int = 0) -> tuple[DataFrame, int]:
    threshold = percent / 100
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(id_col, text_col, seed).alias("id"), F.col(text_col).alias("text"))
    all_sets = materialize(plain.mapInPandas(trimming(_sets("id", "text", shingle)), "doc long, id long, n int, h1 long, h2 long, sketch binary"), "neardup-sets")
    keys = keys_of(all_sets)
    if keys["mixed"]:  # two sets have one key: take other keys
        return _placed(docs, id_col, text_col, shingle, percent, keep, seed + 1)

    def texts(ids: DataFrame) -> DataFrame:
        found = picked(plain, ids)
        return found.dropDuplicates(["id"]) if (keys["rows"] or 0) > 1 else found

    classes = classes_of(all_sets)
    sketches = materialize(representatives(all_sets, classes).select("id", "sketch", "n").distinct(), "neardup-sketches")

    members = materialize(sketches.mapInPandas(trimming(_paths(threshold)), "node long, id long"), "neardup-paths")
    nodes = members.groupBy("node").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("size")).where("lead <> last").drop("last")
    shared = materialize(join_spread(members, materialize(nodes, "neardup-nodes"), "node", "size", "id").drop("size"), "neardup-shared")

    stars = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = _check(stars, sketches, texts, shingle, percent)
    comps = components(links)

    # A node's lead has met all others. Left are nodes whose others are in different components.
    open_ = mixed_nodes(shared.where("id <> lead").select("node", "id"), comps)
    large = open_.where(F.col("size") > SMALL)
    if not large.isEmpty():
        # Where one component has at least half of a large node, those outside meet that
        # component, once, whichever nodes they share with it; they stay to meet one another.
        hosted = materialize(hosts(large), "neardup-hosts")
        guests = hosted.where("comp <> host")
        links, comps = more(links, comps, _compare(against_hosts(hosted, sketches), sketches, texts, threshold, shingle, percent))
        left = open_.where(F.col("size") <= SMALL).select("node", "id").unionByName(large.join(hosted.select("node").distinct(), "node", "left_anti").select("node", "id"))
        open_ = mixed_nodes(left.unionByName(guests.select("node", "id")), comps)
    small = open_.where(F.col("size") <= SMALL).join(sketches, "id").select("node", "id", "comp", "sketch")
    pairs = small.repartition("node").sortWithinPartitions("node").mapInPandas(trimming(_small_nodes(threshold)), "a long, b long")
    links, comps = more(links, comps, _check(pairs.distinct(), None, texts, shingle, percent))
    large = open_.where(F.col("size") > SMALL)
    if not large.isEmpty():
        # No component rules these: block against block.
        keyed = in_blocks(mixed_nodes(large.select("node", "id"), comps), sketches)
        links, comps = more(links, comps, _compare(keyed, sketches, texts, threshold, shingle, percent))

    return labelled(all_sets, classes, comps, keep, all_sets._gneiss_path), seed


def keys_of(all_sets: DataFrame):
    """How many rows a key has at most, and whether two different sets have one key."""
    mixed = (F.min("n") != F.max("n")) | (F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))
    each = all_sets.where("n > 0").groupBy("id").agg(F.count("*").alias("rows"), mixed.alias("mixed"))
    return each.agg(F.max("rows").alias("rows"), F.bool_or("mixed").alias("mixed")).first()


def classes_of(all_sets: DataFrame) -> DataFrame:
    """(h1, h2, n, rep, doc, copies) of the rows with the same set: its representative and its smallest document."""
    return all_sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min("doc").alias("doc"), F.count("*").alias("copies"))


def representatives(all_sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the classes' representatives."""
    return all_sets.where("n > 0").join(classes.select("h1", "h2", "n", F.col("rep").alias("id")), ["id", "h1", "h2", "n"], "left_semi")


def labelled(all_sets: DataFrame, classes: DataFrame, comps: DataFrame, keep: list[str], path: str) -> DataFrame:
    """(doc, id, n, comp, first) of each row of ``all_sets``, which ``path`` holds, by its class's component."""
    # Classes with over a thousandth of all rows, a thousand at most, are looked up in a
    # broadcast; the join of the others has no hot key.
    rows = all_sets.select("doc", "id", "n", "h1", "h2")
    total = rows.count()
    linked = classes.withColumnRenamed("rep", "id").join(comps, "id").select("id", "comp", "doc")
    first = linked.groupBy("comp").agg(F.min("doc").alias("first"))
    heads = materialize(comps.join(first, "comp").select(F.col("id").alias("rep"), "comp", "first"), "neardup-heads")
    keep += [path, heads._gneiss_path]
    named = classes.join(heads, "rep", "left").select("h1", "h2", "n", "copies", F.coalesce("comp", "rep").alias("comp"), F.coalesce("first", "doc").alias("first"))
    hot = named.where(F.col("copies") * 1000 > total).select("h1", "h2", "n", F.struct("comp", "first").alias("hot"))
    looked = rows.join(F.broadcast(hot), ["h1", "h2", "n"], "left")
    others = looked.where("hot IS NULL").drop("hot").join(named.where(F.col("copies") * 1000 <= total).drop("copies"), ["h1", "h2", "n"], "left")
    out = looked.where("hot IS NOT NULL").select("doc", "id", "n", "h1", "h2", "hot.comp", "hot.first").unionByName(others.select("doc", "id", "n", "h1", "h2", "comp", "first"))
    return out.select("doc", "id", "n", F.coalesce("comp", "id").alias("comp"), F.coalesce("first", "doc").alias("first"))


def mixed_nodes(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, id, comp, size) of the nodes with more than one component; of nodes with the same
    members, one. A member set's name is its size and two sums of hashes without carry."""
    named = members.join(comps, "id", "left").select("node", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = named.groupBy("node").agg(
        F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
        F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2"),
    ).where("c0 <> c1")
    once_each = materialize(mixed.groupBy("size", "s1", "s2").agg(F.min("node").alias("node")).select("node", "size"), "neardup-nodes")
    return materialize(join_spread(named, once_each, "node", "size", "id"), "neardup-mixed")


def hosts(large: DataFrame) -> DataFrame:
    """(node, id, comp, host) of the nodes of which one component, the host, has at least half."""
    counts = large.groupBy("node", "size", "comp").agg(F.count("*").alias("n"))
    host = counts.where(F.col("n") * 2 >= F.col("size")).groupBy("node").agg(F.min("comp").alias("host"), F.max("size").alias("held"))
    return join_spread(large, host, "node", "held", "id").select("node", "id", "comp", "host")


def _blocks_of(count: Column, words: Column) -> Column:
    """Into how many blocks so many documents with so many shingles are cut."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(words / BLOCK_SHINGLES)).cast("int")


def against_hosts(hosted: DataFrame, sketches: DataFrame) -> DataFrame:
    """(g, p, q, side, id, comp): each block of a host's documents with each block of its guests."""
    each = hosted.select("host", "id", "comp").distinct().join(sketches.select("id", "n"), "id").withColumn("side", F.when(F.col("comp") == F.col("host"), 0).otherwise(1))
    mine, theirs = F.col("side") == 0, F.col("side") == 1
    sizes = each.groupBy("host").agg(_blocks_of(F.count_if(mine), F.sum(F.when(mine, F.col("n")))).alias("n0"), _blocks_of(F.count_if(theirs), F.sum(F.when(theirs, F.col("n")))).alias("n1"), F.count("*").alias("held"))
    one = join_spread(each, sizes, "host", "held", "id").withColumn("own", F.pmod(F.xxhash64("id"), F.when(mine, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    out = one.select("host", "side", "id", "comp", "own", F.explode(F.sequence(F.lit(0), F.when(mine, F.col("n1")).otherwise(F.col("n0")) - 1)).alias("other"))
    return out.select(F.col("host").alias("g"), F.when(mine, F.col("own")).otherwise(F.col("other")).alias("p"), F.when(mine, F.col("other")).otherwise(F.col("own")).alias("q"), "side", "id", "comp")


def in_blocks(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(g, p, q, side, id, comp): each two blocks of a node."""
    each = members.join(sketches.select("id", "n"), "id")
    sizes = each.groupBy("node").agg(_blocks_of(F.count("*"), F.sum("n")).alias("nb"), F.count("*").alias("held"))
    one = join_spread(each, sizes, "node", "held", "id").withColumn("i", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    # Block i meets every block j >= i as side 0 and every block j <= i as side 1; itself, as one side.
    out = one.select("node", "id", "comp", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    return out.select(F.col("node").alias("g"), F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "id", "comp")


def _compare(keyed: DataFrame, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: float, k: int, percent: int) -> DataFrame:
    """Links that join components, from tasks of two blocks each. Sketch and text are put together once
    for each document, before its copies for the tasks are made."""
    keyed = materialize(keyed, "neardup-keyed")
    needed = materialize(texts(keyed.select("id")).join(sketches.select("id", "sketch"), "id"), "neardup-family-texts")
    full = keyed.join(needed, "id")
    return materialize(full.groupBy("g", "p", "q").applyInPandas(_family(threshold, k, percent), "a long, b long"), "neardup-families")


def more(links: DataFrame, comps: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with the links that were found."""
    if found.isEmpty():
        return links, comps
    links = links.unionByName(found)
    return links, components(links)


def _check(pairs: DataFrame, sketches: DataFrame | None, texts: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """Confirmed links among candidate pairs; with ``sketches``, of those that agree."""
    good = pairs if sketches is None else _agree(pairs, sketches, percent / 100)
    good = materialize(good, "neardup-good")
    return materialize(_confirm(good, texts, k, percent).distinct(), "neardup-links")


def op9_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def components_sql(shingle: int, percent: int) -> str:
    """The rows' sets and components in SQL: all pairs that have a shingle in common are counted, and links are followed
    to their closure."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT r, ws, least({shingle}, len(ws)) AS n FROM d WHERE len(ws) > 0))
), z AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), c AS (
  SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), l AS (
  SELECT x, y FROM c JOIN z p ON p.r = x JOIN z q ON q.r = y WHERE 100 * common >= {percent} * (p.n + q.n - common)
), reach AS (
  SELECT r, r AS t FROM d UNION SELECT reach.r, l.y FROM reach JOIN l ON l.x = reach.t
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN z USING (r) JOIN (SELECT reach.r, CASE WHEN count(*) > count(o.doc_id) THEN NULL ELSE min(o.doc_id) END AS component_id FROM reach JOIN d o ON o.r = reach.t GROUP BY reach.r) m ON m.r = d.r
"""


OP9_SQL = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({components_sql(3, 85)})"
