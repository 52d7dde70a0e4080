"""Queries over reports: pages composed from the tables, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import layouts
from .catalogue import query, t

ROWS = 40


def _page(spark, d):
    """Customers placed on pages of one nation, forty to a page: (doc, page, k, cells) with the row's texts."""
    k = F.col("c_custkey")
    cells = F.array(k.cast("string"), F.col("c_name"), F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" sample"))), F.format_string("%.2f", F.col("c_acctbal").cast("double")))
    return t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("doc"), (k / ROWS).cast("int").alias("page"), (k % ROWS).cast("int").alias("k"), cells.alias("cells"))


def _placed(pages, height: float, left=(20.0, 90.0, 260.0, 420.0)):
    """Each word of the cells at its column's place, in lines of ``height``; words of a line don't stand at quite the same height."""
    x = F.element_at(F.array(*[F.lit(v) for v in left]), F.col("c") + 1)
    each = pages.select("doc", "page", "k", F.posexplode("cells").alias("c", "cell")).where("cell <> ''")
    w = each.select("doc", "page", "k", "c", F.posexplode(F.split("cell", " ")).alias("i", "text"))
    x0, y0 = x + F.col("i") * 45.0, F.col("k") * height + F.col("c") * 0.4
    return w.select("doc", "page", x0.alias("x0"), y0.alias("y0"), (x0 + 40.0).alias("x1"), (y0 + 8.0).alias("y1"), "text")


@query(f"""WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc, c_custkey // {ROWS} AS page, c_custkey % {ROWS} AS k, c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(c_mktsegment) || ' sample' END AS segment, printf('%.2f', CAST(c_acctbal AS DOUBLE)) AS amount FROM customer),
b AS (SELECT *, CASE WHEN lag(k) OVER w IS NULL OR k - lag(k) OVER w > 2 THEN 1 ELSE 0 END AS step FROM p WINDOW w AS (PARTITION BY doc, page ORDER BY k)),
n AS (SELECT *, sum(step) OVER (PARTITION BY doc, page ORDER BY k) - 1 AS "table" FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, page, "table" ORDER BY k) - 1 AS row_no, bool_or(segment <> '') OVER (PARTITION BY doc, page, "table") AS has FROM n)
SELECT doc, page, CAST("table" AS INTEGER) AS "table", CAST(row_no AS INTEGER) AS row_no, CASE WHEN has THEN concat_ws('|', c_custkey, c_name, segment, amount) ELSE concat_ws('|', c_custkey, c_name, amount) END AS cells FROM r""")
def tables_of_words(spark, d):
    """Tables without rules: rows of a page that stand apart make tables of their own."""
    out = layouts.open_tables(_placed(_page(spark, d), 14.0), between_tables=24.0)
    return out.select("doc", "page", "table", "row_no", F.array_join("cells", "|").alias("cells"))


@query(f"""WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc, c_custkey // {ROWS} AS page, c_custkey % {ROWS} AS k, concat_ws('|', c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(c_mktsegment) || ' sample' END, printf('%.2f', CAST(c_acctbal AS DOUBLE))) AS cells FROM customer)
SELECT doc, page, 0 AS "table", CAST(k AS INTEGER) AS row_no, cells FROM p""")
def ruled_tables_of_words(spark, d):
    """Bordered tables: every page has a frame, rules between columns, and one below each row's place."""
    pages = _page(spark, d)
    one = pages.select("doc", "page").distinct()
    across = one.select("doc", "page", F.explode(F.sequence(F.lit(0), F.lit(ROWS))).alias("k")).select("doc", "page", F.lit(10.0).alias("x0"), (F.col("k") * 14.0 - 2.0).alias("y0"), F.lit(520.0).alias("x1"), (F.col("k") * 14.0 - 2.0).alias("y1"))
    down = one.select("doc", "page", F.explode(F.array(*[F.lit(v) for v in (10.0, 80.0, 250.0, 410.0, 520.0)])).alias("x0"), F.lit(-2.0).alias("y0"), F.lit(ROWS * 14.0 - 2.0).alias("y1")).withColumn("x1", F.col("x0"))
    out = layouts.ruled_tables(_placed(pages, 14.0), across.unionByName(down))
    return out.select("doc", "page", "table", "row_no", F.array_join("cells", "|").alias("cells"))


@query("""SELECT CAST(user_id AS VARCHAR) AS doc, CAST(event_id % 100 AS INTEGER) AS page, CAST(event_id AS INTEGER) AS line, event_id || '.5' AS rt, CASE WHEN event_id % 3 = 0 THEN 'Z' ELSE '-' END AS type, event_type AS compound, CASE WHEN event_id % 2 = 0 THEN 'c' || event_id ELSE 'N/A' END AS casrn
FROM events WHERE event_id % 11 > 0""")
def standard_report_rows(spark, d):
    """Lines of reports of external standards."""
    k = F.col("event_id")
    last = F.when(k % 2 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('","c'), k.cast("string"), F.lit('"'))).otherwise(F.col("event_type"))
    middle = F.when(k % 3 == 0, F.lit(" Z 10 0.5 7 ")).otherwise(F.lit(" "))
    row = F.when(k % 11 == 0, F.lit("===== ====")).otherwise(F.concat(F.lit("  "), k.cast("string"), F.lit(".5 1"), middle, last))
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("doc"), (k % 100).cast("int").alias("page"), k.cast("int").alias("line"), row.alias("text"))
    pages = e.select("doc", "page").distinct()
    frame = [(-4, "External Standard Report"), (-3, "Sample Name: x"), (-2, "before 1 2 3"), (-1, "-------|--|------|"), (1 << 30, "Totals : 4 5"), ((1 << 30) + 1, "after 1 2 3 4 5 6")]
    around = pages.select("doc", "page", F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.lit(x).alias("text")) for n, x in frame])).alias("f")).select("doc", "page", "f.*")
    r = layouts.standard_report(e.unionByName(around))
    at = lambda c: F.try_element_at("record", F.lit(c))
    return r.select("doc", "page", "line", at("Retention Time (min)").alias("rt"), at("Type").alias("type"), at("Compound").alias("compound"), at("CASRN").alias("casrn"))


@query("""SELECT CAST(p_size AS VARCHAR) AS doc, CAST(p_partkey AS INTEGER) AS row_no, CASE p_size % 3 WHEN 0 THEN 'Element' WHEN 1 THEN 'Detection' ELSE 'Rep' END AS kind, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS named,
CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'C2H6O' END AS formula, CASE p_size % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '1.5, ND, by, standard' ELSE 'ND' END AS value, CASE WHEN p_size % 3 = 2 THEN 'standard' END AS standard FROM part""")
def replicate_tables(spark, d):
    """Tables of replicates with titles, heads and footnotes, of the three kinds that their captions tell."""
    kind = F.col("p_size") % 3
    body = F.when(kind == 0, F.array(F.col("p_brand"), F.lit(""), F.lit("0.5"), F.lit("0.7"))).otherwise(F.array(F.concat(F.col("p_partkey").cast("string"), F.lit(".2")), F.col("p_type"), F.lit(""), F.lit("C H O\n2 6"), F.lit("Hi gh"), F.lit("64-17-5"), F.lit("1.5"), F.lit("ND"), F.lit("by"), F.lit("standard")))
    p = t(spark, d, "part").select(F.col("p_size").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("table"), F.col("p_partkey").cast("int").alias("row_no"), body.alias("cells"), kind.alias("kind"))
    tables = p.select("doc", "page", "table", "kind").distinct()
    frame = [(-3, ["Table 17", "", "", ""]), (-2, ["RT (min)", "Proposed Identification", "Formula", "CAS"]), (1 << 30, ["X: note", "a", "b"]), ((1 << 30) + 1, ["RT", "Proposed", "", ""]), ((1 << 30) + 2, ["see", "calibration range", "x"])]
    around = tables.select("doc", "page", "table", F.explode(F.array(*[F.struct(F.lit(n).alias("row_no"), F.array(*[F.lit(x) for x in xs]).alias("cells")) for n, xs in frame])).alias("f")).select("doc", "page", "table", "f.*")
    captions = tables.select("doc", "page", "table", F.when(F.col("kind") == 0, F.lit("Table 1: icp-ms of metals")).when(F.col("kind") == 1, F.lit("Table 2: HS-GCMS")).otherwise(F.lit("Table 3: LCMS")).alias("caption"))
    r = layouts.replicate_rows(p.drop("kind").unionByName(around), captions)
    at = lambda c: F.try_element_at("record", F.lit(c))
    sort = F.when(at("Element").isNotNull(), F.lit("Element")).when(at("Detection").isNotNull(), F.lit("Detection")).otherwise(F.lit("Rep"))
    return r.select(
        "doc", "row_no", sort.alias("kind"), F.coalesce(at("Element"), at("Proposed Identification")).alias("named"), at("Formula").alias("formula"),
        F.coalesce(at("Value_1"), at("Detection"), at("Rep2 (ug/device)")).alias("value"), at("Quantitation Standard").alias("standard"),
    )


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS doc, CAST(c_custkey AS INTEGER) AS row_no, c_name AS peak, c_mktsegment AS h7, NULL AS later FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS INTEGER), c_name, c_mktsegment, '4' FROM customer WHERE c_nationkey % 2 = 1""")
def peak_and_time_tables(spark, d):
    """Tables of peaks, named by their first row, and of concentrations over time."""
    peaks = F.col("c_nationkey") % 2 == 0
    body = F.when(peaks, F.array(F.col("c_name"), *[F.lit(str(i)) for i in range(1, 7)], F.col("c_mktsegment"))).otherwise(F.array(F.concat(F.lit(" "), F.col("c_name")), F.concat(F.col("c_mktsegment"), F.lit(" †")), F.lit("2"), F.lit("3"), F.lit("4\n")))
    c = t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("table"), F.col("c_custkey").cast("int").alias("row_no"), body.alias("cells"), peaks.alias("peaks"))
    names = c.select("doc", "page", "table", "peaks").distinct()
    head = F.when(F.col("peaks") & (F.col("n") == 0), F.array(F.lit("Peak_Num"), *[F.lit(f"h{i}") for i in range(1, 8)])).when(~F.col("peaks"), F.array(F.lit("Concentrations of"), F.lit("all"), F.lit("compounds")))
    heads = names.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("doc", "page", "table", (F.col("n") - 5).alias("row_no"), head.alias("cells")).where("cells IS NOT NULL")
    cells = c.drop("peaks").unionByName(heads)
    at = lambda n: F.try_element_at("record", F.lit(n))
    one = layouts.peak_rows(cells).select("doc", "row_no", at("Peak_Num").alias("peak"), at("h7").alias("h7"), F.lit(None).cast("string").alias("later"))
    two = layouts.over_time_rows(cells).select("doc", "row_no", at("CASRN").alias("peak"), at("Compound").alias("h7"), at("24 hr (ug/m3)").alias("later"))
    return one.unionByName(two)
