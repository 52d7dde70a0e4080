"""Further queries: labels from a toolkit's findings, export views, corpus reports, the full matrix of a cluster's evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chemistry, evidence, ledger, tables, views
from .catalogue import query, t


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


# ---- labels ----


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'Permanently charged' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'Amphoteric' WHEN p_size % 2 = 0 THEN 'Likely acidic' WHEN p_size % 3 = 0 THEN 'Likely basic' ELSE 'Neutral' END AS ionisation,
CASE WHEN p_size % 4 = 0 THEN 'Invalid' WHEN p_size % 5 = 0 THEN 'Error' WHEN p_size % 6 = 0 THEN 'No_Scaffold' ELSE p_type END AS scaffold,
CASE WHEN p_size % 4 = 0 THEN 'Unknown' WHEN p_size % 5 = 0 OR p_size % 6 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'Unknown Scaffold' ELSE 'Aliphatic Chain' END ELSE p_type END AS parent FROM part""")
def structure_labels(spark, d):
    s = F.col("p_size")
    valid = s % 4 != 0
    core = F.when(s % 5 == 0, F.lit(None).cast("string")).when(s % 6 == 0, F.lit("")).otherwise(F.col("p_type"))
    return t(spark, d, "part").select(
        "p_partkey", chemistry.ionisation_label(s % 7 == 0, s % 2 == 0, s % 3 == 0).alias("ionisation"), chemistry.scaffold_label(valid, core).alias("scaffold"), chemistry.parent_moiety(valid, core, s % 2 == 0).alias("parent"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'N/A' WHEN p_size % 2 = 0 THEN p_type ELSE 'None' END AS first_alert, CASE WHEN p_size % 9 = 0 THEN 'N/A' WHEN p_size % 2 = 0 THEN array_to_string(list_sort(list_distinct([p_type, 'Alert', p_brand])), '; ') ELSE 'None' END AS alerts,
CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN 'Aromatic Ester' ELSE 'Aliphatic Ester' END WHEN 1 THEN 'Siloxane Compound' WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 'Aromatic Acid' ELSE 'Aliphatic Acid' END ELSE CASE WHEN p_size % 3 = 0 THEN 'Aromatic Compound (Miscellaneous)' ELSE 'Aliphatic Compound (Miscellaneous)' END END AS class,
CASE WHEN p_size % 5 = 0 AND p_size % 6 > 0 AND p_size % 4 < 3 THEN 'High' WHEN p_size % 5 = 0 AND p_size % 6 > 0 AND p_size % 3 = 0 THEN 'High' WHEN p_size % 5 = 1 OR p_size % 6 = 0 THEN 'Low' ELSE 'Medium' END AS confidence FROM part""")
def alert_and_class_labels(spark, d):
    s = F.col("p_size")
    alerts = F.when(s % 2 == 0, F.array(F.col("p_type"), F.lit("Alert"), F.col("p_brand"), F.col("p_type"))).otherwise(F.array().cast("array<string>"))
    groups = F.array_compact(F.array(F.when(s % 3 == 0, F.lit("Aromatic Ring")), F.when(s % 4 == 0, F.lit("Amine")), F.when(s % 4 == 0, F.lit("Ester")), F.when(s % 4 == 1, F.lit("Siloxane")), F.when(s % 4 == 2, F.lit("Carboxylic Acid"))))
    label = chemistry.alert_labels(s % 9 != 0, alerts)
    sure = chemistry.confidence(F.when(s % 5 == 0, F.lit("Exact Match")).when(s % 5 == 1, F.lit("Unresolved")).otherwise(F.lit("Partial")), F.when(s % 6 != 0, F.lit("CC")), F.lit("x"), groups)
    return t(spark, d, "part").select("p_partkey", label["first"].alias("first_alert"), label["all"].alias("alerts"), chemistry.chemical_class(groups).alias("class"), sure.alias("confidence"))


# ---- views ----


@query("SELECT c_custkey, c_custkey % 6 IN (1, 3) OR c_custkey % 5 = 0 AS review, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS shown, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS src_pos FROM customer")
def review_flags_and_positions(spark, d):
    k = F.col("c_custkey")
    flag = _pick(k, "no", " Yes ", "0", "REVIEW", "", "x")
    c = t(spark, d, "customer").select("c_custkey", views.truthy(flag, F.when(k % 5 == 0, F.lit("odd")).otherwise(_pick(k, "None", "nan"))).alias("review"), F.when(k % 4 != 0, F.col("c_name")).alias("shown"))
    return views.with_position(views.blank_nulls(c), "c_custkey").withColumn("src_pos", F.col("src_pos").cast("long"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Exact reference match' WHEN n_regionkey = 3 THEN 'Not mapped' ELSE 'Mapped' END AS mapping_status, 'R-' || n_regionkey AS local_rule_id, r_name AS local_class,
CASE WHEN n_nationkey % 4 = 0 THEN 'K ' || n_name WHEN n_regionkey = 3 THEN '' ELSE 'Organic ' || r_name END AS kingdom, CASE WHEN n_nationkey % 4 = 0 THEN 'T' || n_nationkey END AS record_id, CASE WHEN n_regionkey = 3 THEN 'No approved local ontology mapping for this structural rule' ELSE 'approved' END AS mapping_evidence
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ontology_mapping(spark, d):
    r = t(spark, d, "region")
    rows = t(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat(F.lit("R-"), F.col("n_regionkey").cast("string")).alias("rule"), F.col("r_name").alias("label"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("key"))
    none = F.lit("").alias
    maps = r.where("r_regionkey <> 3").select(F.concat(F.lit("R-"), F.col("r_regionkey").cast("string")).alias("rule_id"), F.col("r_name").alias("local_class"), F.lit(None).cast("string").alias("mapping_status"), F.concat(F.lit("Organic "), F.col("r_name")).alias("kingdom"), none("superclass"), none("class"), none("subclass"), none("direct_parent"), F.lit("approved").alias("mapping_evidence"))
    own = views.ontology_compatibility(rows, "rule", "label", maps, "1.0.0")
    reference = t(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("Exact reference match").alias("mapping_status"), F.concat(F.lit("K "), F.col("n_name")).alias("kingdom"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("record_id"))
    x = views.reference_enrichment(own, reference, "key")
    return x.select("n_nationkey", *[F.col(f"ontology.{c}").alias(c) for c in ("mapping_status", "local_rule_id", "local_class", "kingdom", "record_id", "mapping_evidence")])


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Unclassified' ELSE p_type END AS "Corrected Chemical Class", p_size % 2 = 0 AS "Manual Review Flag", p_type || '; ' || p_brand AS "Detected Feature Profile", p_brand AS "Primary Functional Group",
'Parent Class: ' || p_type || ' | Functional Group: ' || p_brand AS "Taxonomy Hierarchy", p_type || ' → ' || p_brand AS "Taxonomy Path Steps", 'Mapped' AS "Ontology Mapping Status", CASE WHEN p_size % 5 = 0 THEN 'Mapped' ELSE 'Not matched' END AS "Local Taxonomy Match Status", '' AS "Local Taxonomy URL", 42 + 1 AS columns FROM part""")
def classification_flatten(spark, d):
    s = F.col("p_size")
    ontology = F.struct(F.lit("Mapped").alias("mapping_status"), F.when(s % 5 == 0, F.lit("local")).otherwise(F.lit("else")).alias("source"))
    record = F.struct(
        F.when(s % 3 != 0, F.col("p_type")).alias("corrected_chemical_class"), (s % 2 == 0).alias("manual_review_flag"), F.array("p_type", "p_brand").alias("detected_feature_profile"), F.array("p_type", "p_brand").alias("taxonomy_path_steps"),
        F.create_map(F.lit("Parent Class"), F.col("p_type"), F.lit("Functional Group"), F.col("p_brand")).alias("taxonomy_hierarchy"), ontology.alias("ontology"),
    )
    flat = views.flatten_classification(t(spark, d, "part").select("p_partkey", record.alias("r")), "r", "local", ["p_partkey"])
    shown = ("Corrected Chemical Class", "Manual Review Flag", "Detected Feature Profile", "Primary Functional Group", "Taxonomy Hierarchy", "Taxonomy Path Steps", "Ontology Mapping Status", "Local Taxonomy Match Status", "Local Taxonomy URL")
    return flat.select("p_partkey", *shown, F.lit(len(flat.columns)).alias("columns"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Not available' ELSE CAST(p_size / 100.0::DOUBLE AS VARCHAR) END AS nearest_neighbour, CASE WHEN p_size % 3 = 0 THEN 'Not available' ELSE p_type END AS representative, 'Not assessable' AS domain_status FROM part")
def single_preview(spark, d):
    s = F.col("p_size")
    x = views.single_preview(F.when(s % 4 != 0, s.cast("double")), F.when(s % 3 == 0, F.lit("")).otherwise(F.col("p_type")))
    return t(spark, d, "part").select("p_partkey", x["nearest_neighbour"].alias("nearest_neighbour"), x["representative"].alias("representative"), x["domain_status"].alias("domain_status"))


def _corpus(spark, d):
    k = F.col("doc_id")
    route = tables.curation_route(F.lit("name"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False), F.when(k % 2 == 0, F.lit("50-00-0")))
    return t(spark, d, "documents").select(
        k.alias("source_row"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.lit("").alias("casrn"), "source", F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("K")).alias("supplied_key"), F.when(k % 6 == 0, F.concat(F.lit("D"), k.cast("string"))).alias("computed_key"),
        F.lit("C").alias("structure"), F.when(k % 7 == 0, F.lit("Needs structure")).otherwise(F.lit("Structured")).alias("structure_status"), F.lit("r").alias("structure_reason"), route.alias("route"),
        F.coalesce("lang", F.lit("none")).alias("class"), _pick(k, "STC-1", "STC-UNK-001", "STC-2").alias("rule_id"), (k % 5 == 0).alias("manual_review"), F.lit("Mapped").alias("mapping_status"), F.array("source", F.lit("f")).alias("features"),
    )


@query("""SELECT 'curation' AS report, doc_id AS source_row, CASE WHEN doc_id % 2 = 0 THEN 'CASRN supplied — verify scope' ELSE 'Name-only evidence' END AS said FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'derived', doc_id, 'D' || doc_id FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT 'rule_review', doc_id, concat_ws('; ', source, 'f') FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 = 1
UNION ALL SELECT 'baseline', doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'Not needed' WHEN doc_id % 6 = 0 THEN 'Derived locally' ELSE 'Unavailable' END FROM documents""")
def corpus_queues(spark, d):
    r = views.corpus_reports(_corpus(spark, d))
    shown = {"curation": F.col("tier"), "derived": F.col("derived_key"), "rule_review": F.col("features"), "baseline": F.col("derived_status")}
    return tables.union_all(*[r[name].select(F.lit(name).alias("report"), "source_row", c.alias("said")) for name, c in shown.items()])


@query("""WITH c AS (SELECT coalesce(lang, 'none') AS class, count(*) AS n FROM documents GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS row_count, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS manual_review_rows, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS missing_key_rows,
(SELECT count(*) FROM documents WHERE doc_id % 6 = 0) AS derived_key_rows, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 = 1) AS rule_review_rows, (SELECT string_agg(class || '=' || n, ',' ORDER BY class) FROM c) AS classes""")
def corpus_summary(spark, d):
    s = views.corpus_reports(_corpus(spark, d))["summary"]
    said = F.array_join(F.transform(F.array_sort(F.map_entries("class")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("row_count", "manual_review_rows", "missing_key_rows", "derived_key_rows", "rule_review_rows", said.alias("classes"))


@query("SELECT count(*) FILTER (p_partkey % 4 = 0 OR p_partkey % 10 = 0) AS changed_rows, count(*) FILTER (p_partkey % 4 = 0) * 2 + count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 10 = 0) AS changed_fields FROM part")
def change_counts(spark, d):
    k = F.col("p_partkey")
    p = t(spark, d, "part").select("p_partkey", "p_size", "p_type")
    old = p.where(k % 4 != 0).select("p_partkey", F.when(k % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), "p_type", F.lit(1).alias("o"))
    return views.change_counts(tables.differences(p, old, "p_partkey", ["p_size", "p_type"], "o"), "p_partkey")


@query("SELECT 'missing:CAS' AS error UNION ALL SELECT 'retired:o_comment' UNION ALL SELECT 'unresolved_pass' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def release_gate(spark, d):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("pass")).otherwise(F.lit("fail"))
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.lit("Unresolved name")).otherwise(F.lit("Resolved")).alias("status"), urgent.alias("decision"), F.lit(1).alias("o_comment"))
    found = tables.release_errors(o, ["o_orderkey", "CAS"], ["o_comment", "gone"], "status", "decision")
    return spark.createDataFrame([(e,) for e in found], "error string")


# ---- ledger and matrix ----


@query("""SELECT CAST(event_id AS VARCHAR) AS source_record, CASE WHEN event_id % 4 = 0 THEN 'Duplicate' WHEN event_id % 4 IN (1, 2) THEN 'Error' ELSE 'Imported' END AS status,
CASE event_id % 4 WHEN 1 THEN 'changed_without_supersession' WHEN 2 THEN 'superseded_missing' ELSE '' END AS errors FROM events""")
def ledger_supersede(spark, d):
    k = F.col("event_id")
    rec = lambda result, sup: t(spark, d, "events").select(
        "event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("identity_key"), F.lit("CASRN").alias("compound_mapping_method"), F.lit("Genotoxicity").alias("endpoint"), result.alias("result"), F.lit("In vivo").alias("study_type"),
        F.lit("Rat").alias("species"), F.lit("Oral").alias("route"), F.lit("src").alias("source"), k.cast("string").alias("source_record"), F.lit("http://x.example").alias("source_url"), F.lit("Not assignable").alias("reliability"), F.lit("Retrieved").alias("evidence_status"), sup.alias("supersedes_evidence_id"),
    )
    old = ledger.validate(rec(F.lit("Positive"), F.lit("")), ledger.VOCABULARIES)
    ids = old.select("event_id", "evidence_id")
    new = rec(F.when(k % 4 == 0, F.lit("Positive")).otherwise(F.lit("Negative")), F.lit("")).join(ids, "event_id")
    new = new.withColumn("supersedes_evidence_id", F.when(k % 4 == 2, F.lit("EV-NONE")).when(k % 4 == 3, F.col("evidence_id")).otherwise(F.lit(""))).drop("evidence_id")
    batch = ledger.validate(new, ledger.VOCABULARIES)
    out, _ = ledger.ingest(old, batch, "query", "2024-01-01T00:00:00Z")
    return out.join(batch.select("evidence_id", "source_record"), "evidence_id").select("source_record", "status", F.array_join("errors", ",").alias("errors"))


M_SQL = """f AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS c, 'Grouping' AS d, 'Deterministic cluster' AS k, 'Members=' || count(*) || '; Cluster_Status=' || string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) || '; Decision=Not supplied' AS x, 'Cluster ID; Cluster_Status; Decision' AS s, false AS u FROM customer WHERE c_nationkey <> 5 GROUP BY 1
  UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'Physicochemical', 'Calculated property ranges', 'MW=' || printf('%.2f', min(c_acctbal)) || '-' || printf('%.2f', max(c_acctbal)), 'MW; LogP; TPSA; HBD; HBA; Rotatable_Bonds; Formal_Charge; Ring_Count; Aromatic_Ring_Count; Fraction_CSP3', false FROM customer WHERE c_nationkey <> 5 GROUP BY 1
  UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'Domain', 'Domain status', string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'Inside' ELSE 'Borderline' END, '; ' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'Inside' ELSE 'Borderline' END), 'Domain_Status', true FROM customer WHERE c_nationkey <> 5 GROUP BY 1
  UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'Uncertainty', 'Identity (High)', 'why ' || n_name || ' Required action: act', 'fields', true FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey <> 5
  UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), 'Biological', 'Retrieved endpoint evidence', 'Endpoint=e; Result=r; Source=s; Record=' || s_suppkey || '; Review=Not reviewed', 'Endpoint Evidence Ledger', true FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey <> 5),
m AS (SELECT c AS "Cluster_ID", 'E-' || upper(left(sha256(c || '|' || d || '|' || k || '|' || x), 12)) AS "Evidence_ID", CASE WHEN u THEN 'U-' || upper(left(sha256(c || '|' || d || '|' || x), 12)) ELSE '' END AS "Uncertainty_ID", d AS "Evidence_Domain", k AS "Evidence_Type", left(x, 500) AS "Evidence_Text", s AS "Source_Fields", '1.0.0' AS "Matrix_Version" FROM f)"""


def _matrix(spark, d):
    k = F.col("c_custkey")
    name = F.when(F.col("c_nationkey") == 5, F.lit("Unclustered")).otherwise(F.col("c_nationkey").cast("string"))
    rows = t(spark, d, "customer").select(name.alias("Cluster ID"), F.col("c_mktsegment").alias("Cluster_Status"), F.col("c_acctbal").alias("MW"), F.when(k % 2 == 0, F.lit("Inside")).otherwise(F.lit(" Borderline")).alias("Domain_Status"), k.cast("string").alias("CASRN"))
    register = t(spark, d, "nation").select(F.lit("Cluster").alias("Scope"), F.col("n_nationkey").cast("string").alias("Scope_ID"), F.lit("Identity").alias("Category"), F.lit("High").alias("Level"), F.concat(F.lit("why "), F.col("n_name")).alias("Reason"), F.lit("act").alias("Required_Action"), F.lit("fields").alias("Evidence_Fields"))
    found = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("identity_key"), F.lit("e").alias("endpoint"), F.lit("r").alias("result"), F.lit("s").alias("source"), F.col("s_suppkey").cast("string").alias("source_record"), F.lit("Not reviewed").alias("reviewer_status"))
    return evidence.cluster_matrix(rows, register, found)


@query(f"WITH {M_SQL} SELECT * FROM m")
def cluster_evidence_matrix(spark, d):
    return _matrix(spark, d)


@query(f"""WITH {M_SQL} SELECT "Cluster_ID" AS cluster_id, sha256('[' || string_agg('{{"Cluster_ID":"' || "Cluster_ID" || '","Evidence_Domain":"' || "Evidence_Domain" || '","Evidence_ID":"' || "Evidence_ID" || '","Evidence_Text":"' || "Evidence_Text" || '","Evidence_Type":"' || "Evidence_Type" || '","Matrix_Version":"1.0.0","Source_Fields":"' || "Source_Fields" || '","Uncertainty_ID":"' || "Uncertainty_ID" || '"}}', ',' ORDER BY "Evidence_Domain", "Evidence_Type", "Evidence_ID") || ']') AS matrix_hash FROM m GROUP BY 1""")
def cluster_matrix_hash(spark, d):
    return evidence.cluster_matrix_hash(_matrix(spark, d))
