"""Small helpers that the operators share: bit filters, spread joins, words; tables written on the way are those of
``operators.stage``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage import forget, fresh, fresh_path, materialize, scratch, shared_dir  # noqa: F401  operators take them from here

#: Bits of the filter by which rows are picked for a join: two megabytes of bits.
FILTER_BITS = 1 << 24


def _bit(key: Column) -> tuple[Column, Column]:
    """Word and place of a key in the bit filter."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return F.floor(bit / 64), (bit % 64).cast("int")


def bit_filter(keys: DataFrame, key: str = "id") -> DataFrame:
    """(word, bits) of a filter over the hashes of ``key``: at most FILTER_BITS / 64 rows,
    whatever the number of keys, so it can be broadcast."""
    word, place = _bit(F.col(key))
    return keys.select(word.alias("word"), place.alias("place")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))


def marked(df: DataFrame, keys: DataFrame, key: Column, out: str, name: str = "id") -> DataFrame:
    """``df`` with the boolean ``out``: whether the row's ``key`` may be among ``keys``. No row is moved for
    it; a filter too full to help costs only what a join of all rows would. The filter always has a word that no
    key has, so that the plan is the same where there are no keys."""
    word, place, bits = fresh(df, "_word", "_place", "_bits")
    at, inside = _bit(key)
    none = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"))
    held = bit_filter(keys, name).unionByName(none).withColumnsRenamed({"word": word, "bits": bits})
    joined = df.withColumns({word: at, place: inside}).join(F.broadcast(held), word, "left")
    found = F.coalesce(F.expr(f"shiftright({bits}, {place}) & 1L") == 1, F.lit(False))
    return joined.withColumn(out, found).drop(word, place, bits)


#: A key with more rows than this is spread over ``SALTS`` tasks.
HOT_ROWS, SALTS = 1024, 64


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, size: str, by: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each ``key`` and says in ``size`` how many rows that
    key has. Rows of hot keys are dealt by the hash of ``by``, each share with its copy of the keyed row.
    Which keys those are is looked up in a bit filter of bounded size; a key it takes for a hot one is only copied."""
    hot = keyed.where(F.col(size) > HOT_ROWS).select(F.col(key).alias("id"))
    (mark,) = fresh(rows, "_hot")
    left, right = marked(rows, hot, F.col(key), mark), marked(keyed, hot, F.col(key), mark)
    plain = left.where(~F.col(mark)).drop(mark).join(right.where(~F.col(mark)).drop(mark), key)
    salt = F.when(F.col(mark), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.where(mark).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop(mark)
    spread = left.where(mark).withColumn("_salt", salt).drop(mark).join(copies, [key, "_salt"]).drop("_salt")
    return plain.unionByName(spread)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: it becomes a lambda variable,
    so that the optimizer can't copy its expression to each place of use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: ASCII lower case only; ``lower`` would also change other alphabets.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: The separators of ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def count_words(text: Column) -> Column:
    """``size(words(text))`` without building the words: every blank becomes a
    space, and each word but the first begins after one."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))
    return F.when(plain == "", F.lit(0)).otherwise(
        F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def trim() -> None:
    """Give memory that a worker no longer uses back to the system: workers are kept between tasks
    and stages, and what they hold is missing from the executor."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give is not None:
        give(0)


def trimming(run):
    """A function of batches that trims at its end."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped
