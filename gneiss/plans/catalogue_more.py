"""Further queries: narrative, export helpers, documents' tables, small SMILES reader, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.smiles import smiles_summary
from ..operators import group, narrative, pairs, rules, tables
from ..sources import connectors, documents, files
from . import catalogue_layouts, catalogue_structures, catalogue_summary, catalogue_views  # noqa: F401  they register their queries
from .catalogue import query, t


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'kept' WHEN c_custkey % 5 = 0 THEN 'Not assessable: no valid standardized structure is available for structural clustering.' WHEN c_custkey % 3 = 0 THEN c_mktsegment || '. ok' ELSE c_mktsegment END AS reason FROM customer")
def class_reason(spark, d):
    k = F.col("c_custkey")
    r = narrative.class_reason(F.when(k % 4 == 0, F.lit("kept")).otherwise(F.lit("None")), F.when(k % 5 == 0, F.lit("Not assessable")).otherwise(F.lit("Cluster_001")), F.col("c_mktsegment"), F.when(k % 3 == 0, F.lit("ok")))
    return t(spark, d, "customer").select("c_custkey", r.alias("reason"))


@query("""WITH m AS (SELECT c_nationkey, c_custkey, c_mktsegment, sha256('c_name=' || c_name || chr(31) || 'c_acctbal=' || CAST(c_acctbal AS VARCHAR)) AS h FROM customer)
SELECT c_nationkey, count(*) AS member_count, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS classes FROM m GROUP BY c_nationkey""")
def narrative_packets(spark, d):
    return narrative.packets(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_mktsegment", "c_mktsegment", ["c_name", "c_acctbal"], "c_custkey").select("c_nationkey", "member_count", "classes")  # the key: narrative_cache_key


@query("SELECT c_nationkey, sha256('1|' || c_nationkey || '|' || string_agg(sha256('c_name=' || c_name || chr(31) || 'c_custkey=' || c_custkey), '|' ORDER BY c_custkey)) AS cache_key FROM customer GROUP BY c_nationkey")
def narrative_cache_key(spark, d):
    return narrative.packets(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_mktsegment", "c_mktsegment", ["c_name", "c_custkey"], "c_custkey").select("c_nationkey", "cache_key")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def cache_latest_payload(spark, d):
    e = t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return narrative.latest_by_key(e, "user_id", "event_id", "at")


@query("SELECT p_partkey, CASE WHEN (p_size - 1) < 26 THEN chr(CAST(64 + p_size AS INTEGER)) ELSE chr(CAST(64 + (p_size - 1) // 26 AS INTEGER)) || chr(CAST(65 + (p_size - 1) % 26 AS INTEGER)) END AS letter FROM part")
def letter_suffix(spark, d):
    return t(spark, d, "part").select("p_partkey", narrative.letters(F.col("p_size") - 1).alias("letter"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ',heavy_metal' ELSE p_type END AS alerts FROM part")
def retained_alerts(spark, d):
    a = narrative.retained_alerts(F.array(F.col("p_type"), F.lit("heavy_metal")), F.col("p_size") % 2 == 0)
    return t(spark, d, "part").select("p_partkey", F.array_join(a, ",").alias("alerts"))


@query("SELECT c_nationkey, count(*) FILTER (c_acctbal >= 5000) AS pass, count(*) FILTER (c_acctbal >= 0 AND c_acctbal < 5000) AS warning, count(*) FILTER (c_acctbal < 0) AS fail FROM customer GROUP BY c_nationkey")
def decision_counts(spark, d):
    b = F.col("c_acctbal")
    c = t(spark, d, "customer").withColumn("decision", F.when(b >= 5000, F.lit("PASS")).when(b >= 0, F.lit("WARNING")).otherwise(F.lit("FAIL")))
    return narrative.decision_counts(c, "c_nationkey", "decision")


@query("SELECT doc_id, round_even(((CASE WHEN trim(lang) <> '' THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) + 1) / 3.0::DOUBLE, 3) AS coverage FROM documents")
def row_coverage(spark, d):
    x = t(spark, d, "documents").withColumn("maybe", F.when(F.col("doc_id") % 3 != 0, F.lit("x")))
    return x.select("doc_id", narrative.row_coverage(["lang", "maybe", "source"]).alias("coverage"))


@query("SELECT c_nationkey, max(c_custkey % 5) - min(c_custkey % 5) AS span, count(DISTINCT CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) END) AS n_segment, count(DISTINCT c_custkey % 7) AS n_k FROM customer GROUP BY c_nationkey")
def spans_and_distinct(spark, d):
    k = F.col("c_custkey")
    segment = F.when(k % 3 == 0, F.lit(" None ")).when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    c = t(spark, d, "customer").select("c_nationkey", (k % 5).alias("v"), segment.alias("segment"), (k % 7).alias("k"))
    return group.spans(c, "c_nationkey", "v").join(group.distinct_counts(c, "c_nationkey", ["segment", "k"], ("", "none")), "c_nationkey")


@query("""WITH p AS (SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'a;b' WHEN 1 THEN '' ELSE 'b' END AS p FROM customer), n AS (SELECT c_nationkey, p, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT c_nationkey, max(n) AS top FROM n GROUP BY c_nationkey) SELECT n.c_nationkey, CASE WHEN count(*) = 1 THEN min(p) END AS common_profile FROM n JOIN m ON m.c_nationkey = n.c_nationkey AND n = top GROUP BY n.c_nationkey""")
def majority_profile(spark, d):
    k = F.col("c_custkey") % 3
    items = F.when(k == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).when(k == 2, F.array(F.lit("b")))
    return group.majority_profile(t(spark, d, "customer").select("c_nationkey", items.alias("items")), "c_nationkey", "items")


@query("""WITH s AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM part), z AS (SELECT p_partkey AS id, p_brand, (p_retailprice - m1) / s1 AS a, (p_size - m2) / s2 AS b FROM part, s),
e AS (SELECT x.p_brand AS block, x.id AS i, y.id AS j, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d FROM z x JOIN z y ON x.p_brand = y.p_brand AND x.id > y.id) SELECT block, i, j, round(d / (SELECT max(d) FROM e), 6) AS distance FROM e""")
def scaled_distance(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    z = group.z_scaled(p, ["a", "b"])
    x = lambda n: F.col(f"{n}_i") - F.col(f"{n}_j")
    apart = lambda q: q.withColumn("d", F.sqrt(x("a") * x("a") + x("b") * x("b")))
    top = apart(pairs.block_pairs(pairs.outermost(z, "p_brand", "a", "b"), "key", "block", ("a", "b"))).agg(F.max("d")).first()[0]
    e = apart(pairs.block_pairs(z, "p_partkey", "p_brand", ("a", "b")))
    return e.select("block", "i", "j", rounded(F.col("d") / F.lit(top).cast("double"), 6).alias("distance"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Not applicable' WHEN c_custkey % 4 = 1 THEN 'Not assessable' WHEN c_custkey % 10 = c_custkey % 7 THEN 'Consistent' ELSE 'Review required' END AS consistency FROM customer")
def chain_consistency(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.lit("hexane (n=3)")).when(k % 4 == 1, F.lit("Siloxane")).otherwise(F.concat(F.lit("Cyclosiloxane ( n = 00"), (k % 10).cast("string"), F.lit(")")))
    return t(spark, d, "customer").select("c_custkey", rules.chain_consistency(name, (k % 7).cast("int")).alias("consistency"))


@query("SELECT doc_id, contains(lower(text), 'poly(') OR contains(lower(text), 'unknown') OR contains(lower(text), 'related') OR contains(lower(text), 'dimer') OR contains(lower(text), 'trimer') OR contains(lower(text), 'copolymer') OR contains(lower(text), 'degradant') OR contains(lower(text), 'adduct') OR contains(lower(text), 'unidentified') AS fails FROM documents")
def fast_fail(spark, d):
    return t(spark, d, "documents").select("doc_id", narrative.fast_fail(F.col("text")).alias("fails"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'nothing_supplied' END, CASE WHEN c_custkey % 6 = 1 THEN 'bad_cas' END, CASE WHEN c_custkey % 6 = 2 THEN 'bad_formula' END) AS errors FROM customer")
def input_validation(spark, d):
    k = F.col("c_custkey") % 6
    e = tables.input_errors(F.when(k == 1, F.lit("50-0-0")).when(k == 3, F.lit("50-00-0")), F.when(k == 2, F.lit("h2o")).when(k == 4, F.lit("C6H12")), F.when(k == 5, F.lit("name")))
    return t(spark, d, "customer").select("c_custkey", F.array_join(e, ",").alias("errors"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Exact Match' ELSE 'Given' END AS status FROM customer")
def identity_merge(spark, d):
    k = F.col("c_custkey")
    given = t(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"), F.lit("Given").alias("status"))
    look = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("L"), k.cast("string")).alias("name"), F.when(k % 2 == 0, F.lit("Exact Match")).otherwise(F.lit("Unresolved")).alias("status"))
    return tables.merge_identity(given, look, "c_custkey", ["name"], "status")


@query("SELECT p_partkey, CASE WHEN trim(n) <> '' AND length(trim(n)) <= 180 AND NOT regexp_matches(n, '(?i)\\brelated\\s+compound\\b|\\bpoly[a-z]*\\b|\\bmixture\\b|\\bcompound\\s*\\d+\\b') THEN true ELSE false END AS eligible FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' related compound' WHEN 1 THEN ' polymer' WHEN 2 THEN ' mixture' WHEN 3 THEN ' compound 7' ELSE '' END AS n FROM part)")
def name_eligibility(spark, d):
    k = F.col("p_partkey")
    n = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (" related compound", " polymer", " mixture", " compound 7", "")]), (k % 5 + 1).cast("int")))
    return t(spark, d, "part").select("p_partkey", tables.name_eligible(n).alias("eligible"))


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def reference_lookup(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("o"), "n_name")
    return files.lookup(t(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "o").select("c_custkey", "c_nationkey", "n_name")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kingdom, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a; b' END AS substituents FROM events")
def taxonomy_json(spark, d):
    hit = F.to_json(F.struct(F.struct(F.col("event_type").alias("name")).alias("kingdom"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("substituents")))
    x = connectors.taxonomy_fields(F.when(F.col("event_id") % 3 == 0, F.lit('{"substituents": ["x"]}')).otherwise(hit))
    return t(spark, d, "events").select("event_id", x["kingdom"].alias("kingdom"), x["substituents"].alias("substituents"))


@query("SELECT user_id AS doc, event_id AS row_no, coalesce(last_value(CASE WHEN event_id % 3 = 1 THEN event_type || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS category FROM events")
def merged_table_rows(spark, d):
    no = F.col("event_id")
    cells = F.array(F.when(no % 3 == 1, F.concat("event_type", no.cast("string"))).otherwise(F.lit("")), *[F.lit("x")] * 6)
    c = t(spark, d, "events").select(F.col("user_id").alias("doc"), F.lit(1).alias("table"), no.alias("row_no"), cells.alias("cells"))
    return documents.merged_rows(c).select("doc", "row_no", F.try_element_at("record", F.lit("ID Category")).alias("category"))


@query("SELECT p_partkey, 2 + p_size % 4 AS heavy_atoms, 1 AS si_atoms, CAST(p_size % 2 AS INTEGER) AS formal_charge FROM part")
def smiles_counts(spark, d):
    s = F.concat(F.repeat(F.lit("C"), F.col("p_size") % 4), F.when(F.col("p_size") % 2 == 1, F.lit("[NH4+]")).otherwise(F.lit("N")), F.lit(".[Si]"))
    x = smiles_summary(s)
    out = t(spark, d, "part").select("p_partkey", x.alias("x"))
    return out.select("p_partkey", "x.heavy_atoms", "x.si_atoms", "x.formal_charge")
