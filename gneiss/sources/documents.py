"""From pages of reports to records: who wrote them, and rows of their tables.

Pages come as (doc, page, text), table cells as (doc, table, row_no, cells): what a document
parser yields. Everything after that is expressions and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names looked for on the first page, in order; the last also on the first five pages.
AGENCIES = ("eurofins", "namsa", "wuxi", "ul")
LATE_AGENCY = "jordi"
STUDY_TYPES = ("exhaustive", "exaggerated", "simulated")
WITH_STUDY_TYPE = ("Namsa", "Wuxi")


def _first(low: Column, names) -> Column:
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(low.contains(n), F.lit(n.capitalize())).otherwise(out)
    return out


def origins(pages: DataFrame) -> DataFrame:
    """(doc, agency, study_type) of documents; a study type is told only of some agencies."""
    low = F.lower(F.coalesce("text", F.lit("")))
    per = pages.where("page <= 5").groupBy("doc").agg(
        F.max(F.when(F.col("page") == 1, _first(low, (*AGENCIES, LATE_AGENCY)))).alias("a"), F.max(low.contains(LATE_AGENCY)).alias("late"),
        F.min_by(_first(low, STUDY_TYPES), F.when((F.col("page") <= 2) & _first(low, STUDY_TYPES).isNotNull(), F.col("page"))).alias("s"),
    )
    agency = F.coalesce("a", F.when(F.col("late"), F.lit(LATE_AGENCY.capitalize())), F.lit("Unknown"))
    return per.select("doc", agency.alias("agency"), F.when(agency.isin(*WITH_STUDY_TYPE), F.coalesce("s", F.lit("Unknown"))).otherwise(F.lit("Unknown")).alias("study_type"))


# Column names of a bordered report table by its number of columns, words of its header
# rows, and openings of a row that names the sample configuration of those after it.
BORDERED = {
    6: ("Retention Time (min)", "Compound / Identification", "Est Conc (ug/mL)", "Est Conc (ug/cm2)", "Est Conc (ug/device)", "Confidence (%)"),
    5: ("Retention Time (min)", "Compound / Identification", "Est Conc (ug/mL)", "Est Conc (ug/cm2)", "Est Conc (ug/g)"),
    4: ("Element", "Est Conc (ug/mL)", "Est Conc (ug/cm2)", "Est Conc (ug/device)"),
}
HEADER_WORDS = ("RETENTION", "TENTATIVE IDENTIFICATION", "ELEMENT EST. CONC")
BANNER_WORDS = ("SU ", "MPU ", "Configuration")
# Places of the columns of a report table with merged cells, those that are carried down, and
# for columns that move the places tried in order.
MERGED = ("ID Category", "CASRN", "Compound", "Formula", "Molecular Weight")
MOVED = {"Retention Time (min)": (5, 6, 7), "Concentration (ug/device)": (8, 7)}
SURROGATE = 9


def _clean(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " ")))


def _order(cells: DataFrame) -> Window:
    return Window.partitionBy("doc", "table").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)


def bordered_rows(cells: DataFrame, layouts: dict[int, tuple[str, ...]] = BORDERED) -> DataFrame:
    """(doc, table, row_no, configuration, record) of bordered tables: columns by their number, header
    rows left out, the configuration carried down from its row."""
    c = cells.withColumn("cells", _clean(F.col("cells")))
    line = F.upper(F.array_join("cells", " "))
    head = F.lit(False)
    for w in HEADER_WORDS:
        head = head | line.contains(w)
    banner = F.lit(False)
    for w in BANNER_WORDS:
        banner = banner | F.get("cells", F.lit(0)).contains(w)
    alone = F.size(F.filter("cells", lambda x: x != "")) == 1
    is_banner = alone & (F.get("cells", F.lit(0)) != "") & banner & ~head
    filled = c.withColumn("configuration", F.coalesce(F.last(F.when(is_banner, F.get("cells", F.lit(0))), True).over(_order(cells)), F.lit("Unknown")))
    kept = filled.where(~head & ~is_banner & F.exists("cells", lambda x: x != ""))
    names = F.transform("cells", lambda x, i: F.concat(F.lit("Col_"), i.cast("string")))
    for n, cols in layouts.items():
        names = F.when(F.size("cells") == n, F.array(*[F.lit(x) for x in cols])).otherwise(names)
    return kept.select("doc", "table", "row_no", "configuration", F.map_from_arrays(names, F.col("cells")).alias("record"))


def merged_rows(cells: DataFrame) -> DataFrame:
    """(doc, table, row_no, record) of tables with merged cells: identifying columns and the surrogate are
    carried down; narrow tables are element and first amount."""
    c = cells.withColumn("cells", _clean(F.col("cells"))).where(F.exists("cells", lambda x: x != ""))
    w = _order(cells)
    cell = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    down = lambda i: F.coalesce(F.last(cell(i), True).over(w), F.lit(""))
    tries = lambda places, ok: F.coalesce(*[F.when(ok(cell(i)), cell(i)) for i in places], F.lit(""))
    amount = F.coalesce(F.get(F.filter(F.slice("cells", 2, 100), lambda x: x.rlike(r"[\d.]+")), F.lit(0)), F.lit(""))
    wide = [x for i, n in enumerate(MERGED) for x in (F.lit(n), down(i))]
    wide += [F.lit("Retention Time (min)"), tries(MOVED["Retention Time (min)"], lambda v: ~v.rlike("^[a-zA-Z]")), F.lit("Concentration (ug/device)"), tries(MOVED["Concentration (ug/device)"], lambda v: v.isNotNull()), F.lit("Surrogate Used"), down(SURROGATE)]
    narrow = F.create_map(F.lit("Element"), down(0), F.lit("Est Conc (ug/device)"), amount)
    made = c.select("doc", "table", "row_no", F.when(F.size("cells") < 6, narrow).otherwise(F.create_map(*wide)).alias("record"))
    element = F.try_element_at("record", F.lit("Element"))
    return made.where(element.isNull() | ((element != "") & (F.try_element_at("record", F.lit("Est Conc (ug/device)")) != "")))
