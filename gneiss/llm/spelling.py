"""Spelling variants by a positional q-gram index with a count filter.

Words are counted over all documents by Spark. Two words are near if one inserted, deleted or
replaced code point makes one of the other. They are found in three steps.

Lists: a word of ``l`` code points is cut into segments of at most ``SEGMENT``, at places that
depend on ``l`` alone. One edit leaves all segments but one as they are, at places that differ by
at most one, so two near words have a list (length, segment left out, the rest) in common:
equally long ones as themselves, and of others the longer one enters the lists of words that are
shorter by one. A list's words differ in at most ``SEGMENT`` + 1 code points, so its size has a
bound that doesn't depend on the table, whatever the words.

Index: within a list the words' grams of ``Q`` code points are posted under (place, gram). For each
word the postings of its own grams are heap-merged, from the same place and, of a word that is longer by one, from
the place before; a word is a candidate if it comes up at least as often as one edit must leave grams
in common (the longer length - ``Q`` + 1 - ``Q``).

Each candidate is verified, and written by the first list only that can hold the pair.

Defined cases: null and empty texts have no words; a null id is the empty string in front of
the colon; repeated rows count as often as they occur; ties of the form go to the smallest
word in code-point order; very long texts and words are taken whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, scratch, table, trimming

Q = 2
SEGMENT = 3
#: Words are counted from this many code points up, and this many occurrences.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One occurrence in so many loses a code point.
LOSES = 31
#: A form has at least so many times the word's occurrences.
FORM = 10
#: Rounds after which every chain of forms has been followed: each step is ``FORM`` times as frequent,
#: so a chain has fewer than 19 steps, and each round doubles what has been followed.
ROUNDS = 5


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_LENGTH) -> DataFrame:
    """(word) for each run of letters whose result has at least ``least`` code points."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    low = each.select("doc", ascii_lower(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    cut = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.expr("substring(run, int(h % length(run)) + 2)"))
    return low.select(F.when(F.col("h") % LOSES == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``times`` times."""
    return occurrences(docs, id_col, text_col, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _lists(word: Column) -> Column:
    """The lists that a word enters: struct(key, l, place, longer)."""

    def entries(longer: int) -> Column:
        l = F.length(word) - longer  # noqa: E741  the length of the words whose lists these are
        parts = F.ceil(l / SEGMENT).cast("int")

        def entry(j: Column) -> Column:
            # Segments of equal lengths, as far as possible: the j-th begins at j * l / parts.
            a, b = F.floor(j * l / parts).cast("int"), F.floor((j + 1) * l / parts).cast("int")
            rest = F.concat(F.substring(word, F.lit(1), a), F.substring(word, b + 1 + longer, F.length(word)))
            return F.struct(F.xxhash64(l, j, rest).alias("key"), a.alias("place"), F.lit(bool(longer)).alias("longer"))

        return F.transform(F.sequence(F.lit(0), parts - 1), entry)

    return F.concat(entries(0), entries(1))


def one_edit(x: str, y: str, place: int = 0) -> int:
    """The place at which one edit turns ``x`` into ``y``, which is another word and not the shorter one; -1 if none does.
    Both are alike up to ``place``."""
    p, n = place, len(x)
    while p < n and x[p] == y[p]:
        p += 1
    return p if x[p + (len(y) == n) :] == y[p + 1 :] else -1


class Postings:
    """Words of one length under their positional grams."""

    def __init__(self, length: int) -> None:
        self.words: list[str] = []
        self.at: list[dict[str, list[int]]] = [{} for _ in range(length - Q + 1)]

    def add(self, word: str) -> None:
        k = len(self.words)
        self.words.append(word)
        for p, lists in enumerate(self.at):
            lists.setdefault(word[p : p + Q], []).append(k)

    def candidates(self, word: str) -> list[int]:
        """Indexed words, as long as ``word`` or shorter by one, with as many of its grams as one edit leaves."""
        bound, lists = len(word) - Q + 1 - Q, []
        for p, held in enumerate(self.at):
            if (found := held.get(word[p : p + Q])) is not None:
                lists.append(found)
        if len(word) > len(self.at) + Q - 1:  # behind an inserted code point grams stand one place further
            for p, held in enumerate(self.at, 1):
                if (found := held.get(word[p : p + Q])) is not None:
                    lists.append(found)
        if len(lists) < bound:
            return []
        out, last, times = [], -1, 0
        for k in heapq.merge(*lists):
            times = times + 1 if k == last else 1
            last = k
            if times == bound:
                out.append(k)
        return out


def near_in_list(words: list[str], n: list[int], own: int, place: int) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, word, n) of the near words of one list: the first ``own`` are of its length, the others longer by one; all are alike
    up to ``place``, where the segment begins that was left out."""
    index = Postings(len(words[0]))
    for i, word in enumerate(words):
        if i:
            for k in index.candidates(word):
                other = index.words[k]
                at = one_edit(other, word, place)
                if at < 0:
                    continue
                if i >= own and place:
                    # A pair may be in several lists, as where a letter is doubled: the first one writes it.
                    while at and other[at - 1] == word[at]:
                        at -= 1
                    if place >= at:
                        continue
                yield word, n[i], other, n[k]
        if i < own:
            index.add(word)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key, a list's own words first; at most one list's rows wait for the next batch."""

    def of(pdf: pd.DataFrame, stops: np.ndarray) -> pd.DataFrame:
        out: list[tuple] = []
        words, n, places = pdf["word"].tolist(), pdf["n"].tolist(), pdf["place"].tolist()
        owned = np.concatenate(([0], np.cumsum(~pdf["longer"].to_numpy(bool))))
        first = 0
        for stop in stops.tolist():
            own = int(owned[stop] - owned[first])
            if own and stop - first > 1:
                out += near_in_list(words[first:stop], n[first:stop], own, places[first])
            first = stop
        return pd.DataFrame(out, columns=["word", "n", "near", "near_n"])

    wait = None
    for pdf in batches:
        pdf = pdf if wait is None else pd.concat([wait, pdf], ignore_index=True)
        key = pdf["key"].to_numpy()
        stops = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(stops):
            yield of(pdf.iloc[: stops[-1]], stops)
            pdf = pdf.iloc[stops[-1] :]
        wait = pdf
    if wait is not None:
        yield of(wait, np.array([len(wait)]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each two near words of ``words`` (word, n) once."""
    rows = words.select("word", "n", F.explode(_lists(F.col("word"))).alias("e")).select(F.col("e.key").alias("key"), "word", "n", F.col("e.longer").alias("longer"), F.col("e.place").alias("place"))
    # Lists without two words, or without a word of their own length, hold no pair.
    useful = rows.groupBy("key").agg(F.count("*").alias("all"), F.count_if(~F.col("longer")).alias("own")).where("all > 1 AND own > 0").select("key")
    kept = rows.join(useful, "key", "left_semi")
    # By an expression of its own: an exchange by the join's key is left out, and the join may be made a broadcast while it runs, which
    # reads its rows by mapper and would tear lists apart.
    return kept.repartition(F.hash("key")).sortWithinPartitions("key", "longer").mapInPandas(trimming(_pairs), "word string, n long, near string, near_n long")


def forms(words: DataFrame, near: DataFrame, times: int = FORM) -> DataFrame:
    """(word, n, n_near, form, form_n) of all ``words``."""
    both = near.unionByName(near.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = (-F.col("best.less")) >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """``found`` (word, form, ...) with root: the last word that forms lead to. Each round follows twice as
    many steps, and the last one finds nothing to follow."""
    steps = materialize(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    for _ in range(ROUNDS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(further, "root", "left_semi").isEmpty():
            break
        steps = materialize(steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-steps")
    out = found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
    out._gneiss_path = steps._gneiss_path
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, n, n_near, form, form_n, root. The result reads two tables of words in
    the shared folder; the others are deleted before it returns."""
    keep: list[str] = []
    with scratch(docs.sparkSession, keep):
        words = materialize(counted(docs, id_col, text_col), "spelling-words")
        found = materialize(forms(words, near_words(words)), "spelling-forms")
        out = roots(found)
        keep += [found._gneiss_path, out._gneiss_path]
    return out.select("word", "n", "n_near", "form", "form_n", "root")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The check sum is built bit by bit from its polynomial; near words are found by deleted places, not by grams.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), each AS (
  SELECT d, run, count(*) AS times, hex(encode(d || ':' || run)) AS x FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)]),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM each, crc
), words AS (
  SELECT word, sum(times) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
), best AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words o ON o.word = other
), formed AS (
  SELECT w.word, CAST(n AS BIGINT) AS n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CAST(CASE WHEN other_n >= 10 * n THEN other_n END AS BIGINT) AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1
), follow AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT f.word, g.form, steps + 1 FROM follow f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM follow GROUP BY word) USING (word)
"""
