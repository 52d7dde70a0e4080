"""Tables of reports from placed words: rows and columns by where words stand, and two further table layouts.

A document parser yields words (doc, page, x0, y0, x1, y1, text), and rules, the drawn lines of bordered tables (doc, page, x0, y0,
x1, y1); ``words`` runs one over binary files. Rows, columns and tables are found by windows over a page's words, so that work is spread
by page; nothing is gathered beyond a row's cells.

Defined cases: words without text are left out; words that overlap in height stand in one line, in order of x, then of their text;
a page without rules has no bordered table; pages and tables are numbered in reading order; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def words(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], glob: str = "*") -> DataFrame:
    """The words of binary files. ``parse`` reads one file into a frame of (page, x0, y0, x1, y1, text); a file that it
    can't read (``ValueError``) has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    yield parse(bytes(content)).assign(doc=doc)[["doc", "page", "x0", "y0", "x1", "y1", "text"]]
                except ValueError:
                    continue

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, WORDS)


# ---- lines and cells ----


def _steps(start: Column, end: Column, gap: float, by: list[str], order: list[str]) -> Column:
    """Whether something begins further than ``gap`` behind all before it."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(start > F.max(end).over(before) + gap, F.lit(False)).cast("int")


def _numbered(df: DataFrame, name: str, start: Column, end: Column, gap: float, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number of its run: a new one begins where a gap is."""
    stepped = df.withColumn("_step", _steps(start, end, gap, by, order))
    return stepped.withColumn(name, F.sum("_step").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_step")


def lined(placed: DataFrame, overlap: float = 0.5) -> DataFrame:
    """``placed`` with the number of its line on the page. Words stand in one line if less than ``overlap`` of the height of one is
    below all before it."""
    w = placed.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    bottom = F.col("y1") - overlap * (F.col("y1") - F.col("y0"))
    return _numbered(w.withColumns({"_bottom": bottom}), "line", F.col("y0"), F.col("_bottom"), 0.0, ["doc", "page"], ["y0", "x0", "x1", "text"]).drop("_bottom")


def lines(placed: DataFrame) -> DataFrame:
    """(doc, page, line, text): the text of each line, words in order, a blank between."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda s: s["text"]), " ")
    return lined(placed).groupBy("doc", "page", "line").agg(said.alias("text"))


def _cells(df: DataFrame, by: list[str]) -> DataFrame:
    """(…by, row_no, cells): the words of each row and column, in reading order; an empty text where there are none."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "x1", "text"))), lambda s: s["text"]), " ")
    each = df.groupBy(*by, "row_no", "column").agg(said.alias("cell"))
    width = each.groupBy(*by).agg((F.max("column") + 1).alias("width"))
    rows = each.groupBy(*by, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("at"))
    full = rows.join(width, by)
    return full.select(*by, "row_no", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("at", c), F.lit(""))).alias("cells"))


def open_tables(placed: DataFrame, between_columns: float = 6.0, between_tables: float = 24.0) -> DataFrame:
    """(doc, page, table, row_no, cells) of tables without rules: a table ends where a space of ``between_tables`` is left between
    two lines; its columns are the runs of x that no word of the table bridges by less than ``between_columns``."""
    w = _numbered(lined(placed), "table", F.col("y0"), F.col("y1"), between_tables, ["doc", "page"], ["y0", "x0", "x1", "text"])
    c = _numbered(w, "column", F.col("x0"), F.col("x1"), between_columns, ["doc", "page", "table"], ["x0", "x1", "y0", "text"])
    first = c.groupBy("doc", "page", "table").agg(F.min("line").alias("_first"))
    return _cells(c.join(first, ["doc", "page", "table"]).withColumn("row_no", F.col("line") - F.col("_first")), ["doc", "page", "table"])


def ruled_tables(placed: DataFrame, rules: DataFrame, flat: float = 1.0) -> DataFrame:
    """(doc, page, table, row_no, cells) of bordered tables: rules that touch one another in height make one table; a word's row and column are
    the numbers of rules of either direction before its middle. Words outside of all tables are left out."""
    r = rules.select("doc", "page", "x0", "y0", "x1", "y1")
    t = _numbered(r, "table", F.col("y0"), F.col("y1"), flat, ["doc", "page"], ["y0", "y1", "x0"])
    upright = (F.col("x1") - F.col("x0")) <= flat
    places = t.groupBy("doc", "page", "table").agg(
        F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("top"), F.max("y1").alias("bottom"),
        F.array_sort(F.collect_set(F.when(upright, F.round("x0", 1)))).alias("xs"), F.array_sort(F.collect_set(F.when(~upright, F.round("y0", 1)))).alias("ys"),
    )
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = lined(placed).join(places, ["doc", "page"]).where((x >= F.col("left")) & (x <= F.col("right")) & (y >= F.col("top")) & (y <= F.col("bottom")))
    number = lambda places_, at: F.greatest(F.size(F.filter(places_, lambda p: p <= at)) - 1, F.lit(0))
    return _cells(inside.withColumns({"row_no": number(F.col("ys"), y), "column": number(F.col("xs"), x)}), ["doc", "page", "table"])


# ---- layouts ----

# Columns of a report of external standards; a line of dashes goes before its rows, and what ends or interrupts them.
STANDARD = ("Retention Time (min)", "Signal", "Type", "Area", "Amt/Area", "Amount (ug/M^3)", "Compound", "CASRN")
DASHES, TOTALS, EQUALS = "-------|", "Totals", "===="
# Columns of a table of concentrations over time, by place, and how many rows stand before its first one.
OVER_TIME = {"CASRN": 0, "Compound": 1, "Initial Operation (ug/m3)": 3, "24 hr (ug/m3)": 4, "72 hr (ug/m3)": 5, "168 hr (ug/m3)": 6}
OVER_TIME_HEAD, OVER_TIME_MARK, PEAK_MARK = 5, "CONCENTRATIONS OF", "PEAK_NUM"


def standard_report(text_lines: DataFrame) -> DataFrame:
    """(doc, page, line, record) of reports of external standards from lines (doc, page, line, text): rows between the line of dashes and
    the totals; the last word holds compound and number."""
    t = F.coalesce("text", F.lit(""))
    line = F.coalesce(F.col("line").cast("long"), F.lit(-(1 << 63)))  # null is before all
    same = lambda a, b: F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & F.col(f"{a}.page").eqNullSafe(F.col(f"{b}.page"))
    # Only lines with a mark are grouped; a page's two bounds then meet its lines, which are neither sorted nor held.
    marks = text_lines.where(t.contains("Sample Name:") | t.contains("External Standard Report") | t.contains(DASHES) | t.contains(TOTALS)).select("doc", "page", line.alias("_line"), t.alias("_t"))
    has = lambda x: F.max(F.col("_t").contains(x))
    begun = marks.groupBy("doc", "page").agg(has("Sample Name:").alias("_s"), has("External Standard Report").alias("_r"), F.min(F.when(F.col("_t").contains(DASHES), F.col("_line"))).alias("_from")).where("_s AND _r AND _from IS NOT NULL").drop("_s", "_r")
    late = marks.where(F.col("_t").contains(TOTALS)).alias("m").join(begun.hint("shuffle_hash").alias("b"), same("m", "b")).where("_line >= _from")
    totals = late.groupBy("m.doc", "m.page").agg(F.min("_line").alias("_to"))
    bounds = begun.alias("b").join(totals.hint("shuffle_hash").alias("e"), same("b", "e"), "left").select("b.doc", "b.page", "_from", "_to")
    placed = text_lines.alias("l").join(bounds.hint("shuffle_hash").alias("b"), same("l", "b")).select("l.doc", "l.page", "l.line", "l.text", "_from", "_to").withColumn("_line", line)
    rows = placed.where((F.col("_line") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_line") < F.col("_to"))) & ~t.contains(DASHES) & ~t.contains(EQUALS) & (F.trim(t) != ""))
    p = F.split(F.trim(t), r"\s+")
    n = F.size(p)
    last = F.get(p, n - 1)
    parts = F.when(last.contains('","'), F.split(last, '","')).when(last.contains(","), F.split(last, ","))
    bare = lambda c: F.regexp_replace(c, '"', "")
    word = lambda i, least: F.when(n >= least, F.get(p, F.lit(i))).otherwise(F.lit("-"))
    values = (F.get(p, F.lit(0)), F.get(p, F.lit(1)), word(2, 6), word(3, 6), word(4, 6), word(5, 7), F.coalesce(bare(F.get(parts, F.lit(0))), last), F.coalesce(bare(F.get(parts, F.lit(1))), F.lit("N/A")))
    return rows.where(n >= 2).select("doc", "page", "line", F.create_map(*[x for name, v in zip(STANDARD, values, strict=True) for x in (F.lit(name), v)]).alias("record"))


def _trimmed(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " ")))


def _head(cells: DataFrame) -> DataFrame:
    """(doc, page, table, head, heading): the first row's cells, and the text of the first row."""
    first = cells.groupBy("doc", "page", "table").agg(F.min_by("cells", "row_no").alias("head"))
    return first.withColumn("heading", F.upper(F.array_join(F.transform("head", lambda c: F.coalesce(c, F.lit(""))), " ")))


def peak_rows(cells: DataFrame) -> DataFrame:
    """(doc, page, table, row_no, record) of tables of peaks: eight columns or more, named by the first row."""
    c = cells.join(_head(cells), ["doc", "page", "table"]).where((F.size("head") >= 8) & F.upper(F.get("head", F.lit(0))).contains(PEAK_MARK))
    w = Window.partitionBy("doc", "page", "table").orderBy("row_no")
    rows = c.withColumn("_k", F.row_number().over(w)).where("_k > 1")
    names = F.transform(_trimmed(F.col("head")), lambda h, i: F.concat(i.cast("string"), F.lit("\0"), h))
    # Names that repeat keep their place in front, so that no value is lost.
    plain = F.transform(names, lambda h, i: F.when(F.size(F.filter(names, lambda o: F.substring_index(o, "\0", -1) == F.substring_index(h, "\0", -1))) > 1, F.concat(F.substring_index(h, "\0", -1), F.lit("."), i.cast("string"))).otherwise(F.substring_index(h, "\0", -1)))
    return rows.select("doc", "page", "table", "row_no", F.map_from_arrays(plain, _trimmed(F.slice("cells", 1, F.size("head")))).alias("record"))


def over_time_rows(cells: DataFrame) -> DataFrame:
    """(doc, page, table, row_no, record) of tables of concentrations over time: rows after the head, marks of footnotes taken off."""
    c = cells.join(_head(cells), ["doc", "page", "table"]).where(F.col("heading").contains(OVER_TIME_MARK))
    w = Window.partitionBy("doc", "page", "table").orderBy("row_no")
    rows = c.withColumns({"_k": F.row_number().over(w), "cells": _trimmed(F.col("cells"))}).where((F.col("_k") > OVER_TIME_HEAD) & F.exists("cells", lambda x: x != ""))
    at = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    value = lambda name, i: F.trim(F.regexp_replace(at(i), "[†‡]", "")) if name == "Compound" else at(i)
    return rows.select("doc", "page", "table", "row_no", F.create_map(*[x for name, i in OVER_TIME.items() for x in (F.lit(name), value(name, i))]).alias("record"))


# Words of the head of a table of replicates; what a caption calls the two kinds with their own columns.
HEAD_WORDS = ("RT", "RETENTION", "PROPOSED", "ELEMENT", "FORMULA", "CONFIDENCE", "MASS PER", "REPLICATE", "µG", "REP1", "REP 1", "(MIN)", "DEVICE", "QUANTITATION", "METHOD BLANK", "MEASURED", "CORRECTED", "CONCENTRATION", "NG/ML")
METAL_CAPTIONS, HEADSPACE_CAPTIONS = ("ICPMS", "ICP-MS"), ("HS-GCMS", "HS-GC")
FOOTNOTES = ("calibration", "retention times are from")
IDENTIFIED = ("RT (min)", "Proposed Identification", "Formula", "Confidence Level", "CAS")
HEAD_ROWS = 8


def formula(text: Column) -> Column:
    """Letters and numbers of a formula that were read apart, put together in turn: ``C H O 2 6`` is C2H6O."""
    said = F.split(F.trim(text), r"\s+")
    letters, numbers = F.filter(said, lambda w: w.rlike(r"^\p{L}+$")), F.filter(said, lambda w: w.rlike(r"^\d+$"))
    apart = (F.size(letters) > 0) & (F.size(numbers) > 0) & (F.size(letters) + F.size(numbers) == F.size(said))
    return F.when(apart, F.array_join(F.transform(letters, lambda x, i: F.concat(x, F.coalesce(F.get(numbers, i), F.lit("")))), "")).otherwise(F.trim(text))


def _has_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for x in terms:
        out |= text.contains(x)
    return out


def replicate_rows(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, table, row_no, record) of tables of replicates; ``captions`` (doc, page, table, caption) tells metals and headspace
    tables from others. The first data row is the first of the first eight that is neither title nor head and has two values; footnotes
    and heads that repeat are left out. Empty cells don't count as columns."""
    by = ["doc", "page", "table"]
    w = Window.partitionBy(*by).orderBy("row_no")
    c = cells.withColumns({"cells": _trimmed(F.col("cells")), "_k": F.row_number().over(w)})
    line = F.upper(F.array_join("cells", " "))
    number = F.exists("cells", lambda x: x.rlike(r"^\d*\.?\d*$") & x.rlike(r"\d"))
    values = F.filter("cells", lambda x: (x != "") & (F.upper(x) != "NONE"))
    title = F.trim(line).rlike(r"^TABLE\s+\d") | (_has_any(line, ("SUMMARY OF", "RESULTS")) & ~number)
    starts = (F.col("_k") <= HEAD_ROWS) & ~title & ~_has_any(line, HEAD_WORDS) & (F.size(values) >= 2)
    first = c.withColumn("_first", F.coalesce(F.min(F.when(starts, F.col("_k"))).over(Window.partitionBy(*by)), F.lit(1)))
    zero, low = F.coalesce(F.get("cells", F.lit(0)), F.lit("")), F.lower(F.array_join("cells", " "))
    note = (zero.rlike(r"^[¹²³⁴⁵\d]") & (F.length(zero) > 20)) | zero.startswith("X:") | zero.startswith("*") | _has_any(low, FOOTNOTES)
    head = _has_any(F.lower(zero), ("rt", "min", "element")) | F.lower(F.coalesce(F.get("cells", F.lit(2)), F.lit(""))).contains("proposed")
    rows = first.where((F.col("_k") >= F.col("_first")) & ~note & ~head & (F.size(F.filter("cells", lambda x: x != "")) >= 2))
    told = rows.join(captions.select(*by, F.upper("caption").alias("_caption")), by, "left").withColumn("_caption", F.coalesce("_caption", F.lit("")))
    metal, headspace = _has_any(F.col("_caption"), METAL_CAPTIONS), _has_any(F.col("_caption"), HEADSPACE_CAPTIONS)

    at = lambda i: F.coalesce(F.get(values, F.lit(i)), F.lit(""))
    rest = F.slice(values, 6, 1 << 20)
    numeric = F.filter(rest, lambda v: v.rlike(r"^[\d.<>NDBQL\s,]+$"))
    # The texts at the end, behind the last value without a letter.
    backwards = F.reverse(rest)
    first_text = F.array_position(F.transform(backwards, lambda v: v.rlike("[a-zA-Z]")), True)
    from_text = F.when(first_text > 0, F.slice(backwards, first_text.cast("int"), F.size(backwards))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(from_text, lambda v: v.rlike("[a-zA-Z]")), False).cast("int")
    texts = F.when(stop > 0, F.slice(from_text, 1, stop - 1)).otherwise(from_text)  # the last one first
    identity = F.map_from_arrays(F.array(*[F.lit(x) for x in IDENTIFIED]), F.array(at(0), at(1), formula(at(2)), F.regexp_replace(at(3), r"\s+", ""), at(4)))
    replicates = F.map_from_arrays(F.transform(numeric, lambda v, i: F.concat(F.lit("Rep"), (i + 1).cast("string"), F.lit(" (ug/device)"))), numeric)
    standard = F.create_map(F.lit("Quantitated by"), F.when(F.size(texts) >= 2, F.get(texts, F.lit(1))).otherwise(F.lit("")), F.lit("Quantitation Standard"), F.when(F.size(texts) >= 1, F.get(texts, F.lit(0))).otherwise(F.lit("")))
    others = F.filter(F.slice("cells", 2, 1 << 20), lambda x: x != "")
    metals = F.map_concat(F.create_map(F.lit("Element"), zero), F.map_from_arrays(F.transform(others, lambda v, i: F.concat(F.lit("Value_"), (i + 1).cast("string"))), others))
    made = F.when(metal, F.when(zero != "", metals)).when(F.size(values) < 3, F.lit(None)).when(headspace, F.map_concat(identity, F.create_map(F.lit("Detection"), F.array_join(rest, ", ")))).otherwise(F.map_concat(identity, replicates, standard))
    return told.withColumn("record", made).where("record IS NOT NULL").select(*by, "row_no", "record")
