"""Further queries: the record of each cluster, the dashboard, membership in words, captions, the check of a partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, group, kinds, summary
from .catalogue import B_SQL, P_SQL, emb, query, t

_SEEN = {
    "Compatibility Group": ("'Group ' || label", 1), "Compatibility Gate": ("CASE WHEN vec_id % 2 = 0 THEN 'nan' ELSE 'Gate ' || vec_id % 3 END", 1), "Cluster Status": ("CAST(NULL AS VARCHAR)", 1),
    "Member Chemical Classes": ("'Class ' || vec_id % 9", 6), "Primary Functional Group Profile": ("CASE WHEN vec_id % 5 > 0 THEN 'F' || vec_id % 5 ELSE ' ' END", 6),
    "Scaffold Profile": ("CASE WHEN vec_id % 4 > 0 THEN 'S' || vec_id % 4 ELSE 'Not available' END", 6),
}
_ONCE = ("Scaffold Profile",)


def _seen_sql() -> str:
    out = []
    for i, (name, (v, limit)) in enumerate(_SEEN.items()):
        rows = "u" if name in _ONCE else "d"
        out.append(f"""t{i} AS (SELECT label, string_agg(v, '; ' ORDER BY r) FILTER (r <= {limit}) || CASE WHEN max(r) > {limit} THEN '; additional values present' ELSE '' END AS x FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY o) AS r FROM (SELECT label, {v} AS v, min(vec_id) AS o FROM {rows} WHERE lower(trim({v})) NOT IN ('', 'nan', 'none', 'not available', 'not assessable') GROUP BY ALL)) GROUP BY label)""")
    return ", ".join(out)


_SUMMARY_SQL = f"""WITH {B_SQL}, d AS (SELECT *, CAST(bits AS VARCHAR) AS s FROM e), u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label, s ORDER BY vec_id) = 1),
n AS (SELECT id, round_even(max(s), 3) AS near FROM b GROUP BY id), st AS (SELECT block, round_even(min(s), 3) AS lo, round_even(median(s), 3) AS mid FROM p GROUP BY block),
m AS (SELECT block, id FROM (SELECT block, id, round_even(avg(s), 9) AS mean FROM (SELECT b.block, b.id, b.s FROM b JOIN u x ON x.vec_id = b.id JOIN u y ON y.vec_id = b.other UNION ALL SELECT label, vec_id, 1.0::DOUBLE FROM u) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY block ORDER BY mean DESC, id DESC) = 1),
g AS (SELECT label, count(*) AS n, count(DISTINCT s) AS k FROM d GROUP BY label), nr AS (SELECT label, printf('%.3f', min(near)) || ' to ' || printf('%.3f', max(near)) AS near FROM u JOIN n ON id = vec_id GROUP BY label), {_seen_sql()}
SELECT coalesce(t0.x, 'Not assessed') AS "Compatibility Group", 'Cluster_' || g.label AS "Cluster ID", coalesce(t1.x, 'Not assessed') AS "Compatibility Gate", 'Not assessed' AS "Cluster Status", n AS "Source Row Count", k AS "Unique Structure Count", n - k AS "Duplicate or Alias Row Count",
CASE WHEN m.id % 3 = 0 THEN 'Unnamed compound' ELSE 'V' || m.id END AS "Representative Compound", (SELECT array_to_string(bits, ',') FROM e WHERE vec_id = m.id) AS "Representative Standardized SMILES", coalesce(t3.x, 'Not assessed') AS "Member Chemical Classes", coalesce(t4.x, 'Not assessed') AS "Primary Functional Group Profile",
coalesce(CAST(lo AS VARCHAR), 'Not assessable') AS "Minimum Pairwise Tanimoto", coalesce(CAST(mid AS VARCHAR), 'Not assessable') AS "Median Pairwise Tanimoto", coalesce(near, 'Not assessable') AS "Nearest Neighbour Tanimoto Range", coalesce(t5.x, 'Not assessed') AS "Scaffold Profile", 'Not assessed' AS "Ionisation Profile", 'Not assessed' AS "Structural Alert Profile",
'Not assessed' AS "Property Compatibility", 'Not assessed' AS "Property Compatibility Reason", 'Not assessed' AS "Identity Structure Consistency", 'Not assessed' AS "Compatibility Gate Reason", 'Not assessed' AS "Membership Rationale",
CASE WHEN k = 1 THEN 'Not assessable: one unique structure' WHEN mid >= 0.60 THEN 'Structurally coherent under primary threshold; sensitivity review pending' ELSE 'Borderline: SME review required before use' END AS "Stability Assessment",
'Pending' AS "SME Review Status", 'Pending' AS "SME Decision", '' AS "SME Review Comments", 'Structural grouping only. SME review is required before analogue selection, read-across, or endpoint-specific assessment.' AS "Assessment Boundary"
FROM g LEFT JOIN st ON st.block = g.label LEFT JOIN m ON m.block = g.label LEFT JOIN nr ON nr.label = g.label {' '.join(f'LEFT JOIN t{i} ON t{i}.label = g.label' for i in range(len(_SEEN)))}"""


@query(_SUMMARY_SQL)
def cluster_summary(spark, d):
    e = emb(spark, d)
    rows = e.withColumn("structure", F.array_join("bits", ","))
    k = F.col("vec_id")
    shown = rows.join(kinds.stats(e, "vec_id", "label", "bits").withColumnRenamed("block", "label"), "label", "left").join(kinds.nearest(e, "vec_id", "label", "bits").withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "vec_id", "label", "structure", F.concat(F.lit("Cluster_"), F.col("label").cast("string")).alias("Cluster ID"), F.when(k % 3 != 0, F.concat(F.lit("V"), k.cast("string"))).alias("Compound Name"),
        F.expr(_SEEN["Compatibility Group"][0]).alias("Compatibility Group"), F.expr(_SEEN["Compatibility Gate"][0]).alias("Compatibility Gate"), F.expr(_SEEN["Member Chemical Classes"][0]).alias("Corrected Chemical Class"),
        F.expr(_SEEN["Primary Functional Group Profile"][0]).alias("Primary Functional Group"), F.expr(_SEEN["Scaffold Profile"][0]).alias("Scaffold"),
        F.col("min_similarity").alias("Cluster_Min_Pairwise_Tanimoto"), F.col("median_similarity").alias("Cluster_Median_Pairwise_Tanimoto"), F.col("nearest_similarity").alias("Nearest_Neighbour_Tanimoto"),
    )
    unique = rows.groupBy("label", "structure").agg(F.min("vec_id").alias("vec_id"), F.min_by("bits", "vec_id").alias("bits"))
    best = kinds.medoid(unique, "vec_id", "label", "bits")
    medoids = best.select(F.concat(F.lit("Cluster_"), F.col("block").cast("string")).alias("cluster"), F.col("medoid").alias("pos"))
    return summary.cluster_summary(shown, medoids, "vec_id", "structure")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'None' ELSE c_name END AS s, c_custkey % 4 > 0 AS ok FROM customer),
m AS (SELECT (SELECT count(*) FROM orders) AS a, count(*) AS b, count(DISTINCT k % 100) FILTER (k % 100 > 0) AS cas, count(DISTINCT s) FILTER (ok) AS st, count(*) FILTER (ok) AS y, count(*) FILTER (NOT ok) AS x, count(DISTINCT k % 7) FILTER (ok) AS g,
count(DISTINCT k % 60) FILTER (ok AND k % 60 > 0) AS cl, count(*) FILTER (ok AND k % 60 > 0) AS cd, count(DISTINCT k % 60) FILTER (ok AND k % 60 > 0 AND k % 60 % 5 = 1) AS one, count(*) FILTER (k % 6 = 0 OR k % 10 = 0) AS r, count(*) FILTER (k % 3 = 1) AS al FROM c)
SELECT place, metric, value FROM (SELECT unnest([{'place': 1, 'metric': 'Raw extracted source rows', 'value': a}, {'place': 2, 'metric': 'Final deduplicated chemical records', 'value': b}, {'place': 3, 'metric': 'Unique reported CASRNs', 'value': cas}, {'place': 4, 'metric': 'Unique resolved standardised structures', 'value': st},
{'place': 5, 'metric': 'Structure-resolved records', 'value': y}, {'place': 6, 'metric': 'Unresolved / non-structural records', 'value': x}, {'place': 7, 'metric': 'Grouping-eligible records', 'value': y}, {'place': 8, 'metric': 'Compatibility groups', 'value': g}, {'place': 9, 'metric': 'Structural clusters', 'value': cl},
{'place': 10, 'metric': 'Clustered records', 'value': cd}, {'place': 11, 'metric': 'Singleton clusters', 'value': one}, {'place': 12, 'metric': 'SME review required', 'value': r}, {'place': 13, 'metric': 'Records with structural alerts', 'value': al}], recursive := true) FROM m)""")
def dashboard_metrics(spark, d):
    k = F.col("c_custkey")
    raw = t(spark, d, "orders").agg(F.count("*").alias("raw"))
    c = t(spark, d, "customer").crossJoin(F.broadcast(raw))  # one row
    text = lambda v: v.cast("string")
    return summary.dashboard(
        c, F.max("raw"), k % 4 != 0, F.when(k % 4 == 0, F.lit("None")).otherwise(F.col("c_name")), F.when(k % 100 != 0, text(k % 100)), text(k % 7), F.when(k % 60 == 0, F.lit(" Not assessable ")).otherwise(text(k % 60)),
        F.when(k % 60 % 5 == 1, 1).otherwise(2), F.when(k % 6 == 0, F.lit("Yes")).otherwise(F.lit("no")), F.when(k % 10 == 0, F.lit("odd")), F.element_at(F.array(F.lit("Not assessed"), F.lit("Epoxide"), F.lit("none")), (k % 3 + 1).cast("int")),
    )


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments, printf('%.2f', min(c_acctbal)) || '-' || printf('%.2f', max(c_acctbal)) AS balance FROM customer GROUP BY c_nationkey")
def distinct_values_and_range(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(group.joined_values(F.col("c_mktsegment")).alias("segments"), summary.range_text(F.col("c_acctbal")).alias("balance"))


_WORDS_SQL = """CASE WHEN ok THEN 'Assigned to Cluster_' || label || ' by Compatibility-gated Morgan/ECFP4 Tanimoto Butina clustering with complete-linkage refinement. Cluster size: ' || label % 4 || '. Nearest in-cluster member(s): ' || nm || '. Representative scaffold match: ' || CASE WHEN vec_id % 4 > 0 THEN 'yes' ELSE 'no' END || '; shared-scaffold coverage: Not supplied. Domain status: Inside; ionisation: Not supplied; toxicophore profile: Not supplied; property-outlier flags: None.'
ELSE 'No cluster-membership rationale is available because a valid standardized structure and an assessable cluster assignment are required.' END"""


@query(f"""WITH {B_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, CAST(other AS VARCHAR)) AS k FROM b),
x AS (SELECT id AS vec_id, string_agg('v"' || other || ' (Tanimoto ' || printf('%.3f', round_even(s, 3)) || ')', '; ' ORDER BY k) AS nm, printf('%.3f', round_even(max(s), 3)) AS near FROM r WHERE k <= 3 GROUP BY id),
w AS (SELECT e.vec_id, label, coalesce(nm, 'No in-cluster structural neighbour (singleton cluster)') AS nm, coalesce(near, 'Not available') AS near, label % 3 > 0 AND e.vec_id % 7 > 0 AS ok FROM e LEFT JOIN x USING (vec_id))
SELECT vec_id, CASE WHEN ok THEN 'Calculated deterministic evidence' ELSE 'Not assessable' END AS status, {_WORDS_SQL} AS rationale,
CASE WHEN ok THEN '{{"classification": "Not supplied", "cluster_id": "Cluster_' || label || '", "cluster_size": "' || label % 4 || '", "consensus_method": "Compatibility-gated Morgan/ECFP4 Tanimoto Butina clustering with complete-linkage refinement", "domain_status": "Inside", "ionisation_consistency": "Not supplied", "membership_parameters": "Morgan radius=2; fpSize=1024; Tanimoto >= 0.60; complete-linkage refinement", "nearest_member_tanimoto": "' || near || '", "nearest_members": "' || replace(nm, '"', chr(92) || '"') || '", "property_outlier_flags": "None", "representative_scaffold": "' || CASE WHEN vec_id % 4 = 0 THEN 'T' ELSE 'S' END || '", "representative_scaffold_match": "' || CASE WHEN vec_id % 4 > 0 THEN 'yes' ELSE 'no' END || '", "scaffold_coverage": "Not supplied", "toxicophore_consistency": "Not supplied"}}' ELSE '' END AS parameters,
CASE WHEN ok THEN near ELSE 'Not supplied' END AS packet_nearest FROM w""")
def membership_words(spark, d):
    e = emb(spark, d).withColumn("name", F.concat(F.lit('v"'), F.col("vec_id").cast("string")))
    near = evidence.neighbour_text(e, "vec_id", "label", "bits", "name")
    k = F.col("vec_id")
    rows = near.select(
        "*", F.concat(F.when(F.col("label") % 3 == 0, F.lit("Loose_")).otherwise(F.lit("Cluster_")), F.col("label").cast("string")).alias("Cluster ID"), (F.col("label") % 4).alias("Cluster Size"),
        F.lit("S").alias("Scaffold"), F.when(k % 4 == 0, F.lit("T")).otherwise(F.lit("S")).alias("Cluster_Representative_Scaffold"), F.lit("Inside").alias("Domain_Status"), F.lit("None").alias("Property_Outlier_Flags"),
    )
    made = summary.membership(rows, k % 7 != 0)
    packet = summary.reasoning_packet(made)
    return made.select("vec_id", F.col("Cluster_Reasoning_Status").alias("status"), F.col("Cluster_Membership_Rationale").alias("rationale"), F.col("Cluster_Membership_Parameters").alias("parameters"), packet["Cluster_Nearest_Tanimoto"].alias("packet_nearest"))


@query(f"WITH {P_SQL} SELECT block AS cluster, arg_min('similarity ' || printf('%.3f', round_even(s, 3)), i * 1000000 + j) AS reason FROM p WHERE s < 0.25 GROUP BY block")
def partition_check(spark, d):
    p = kinds.first_below(emb(spark, d), "vec_id", "label", "bits", 0.25)  # of the failing pairs only the first counts
    s = F.col("similarity")
    return summary.failing_pairs(p, F.when(s < 0.25, F.concat(F.lit("similarity "), F.format_string("%.3f", F.bround(s, 3)))))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Eurofins' WHEN 1 THEN 'Namsa' WHEN 2 THEN 'Wuxi' WHEN 3 THEN 'Jordi' WHEN 4 THEN 'Ul' ELSE 'Unknown' END AS agency,
'Table ' || o_orderkey || ': ' || CASE o_custkey % 4 WHEN 0 THEN 'GC-MS ' WHEN 1 THEN 'LC/MS ' WHEN 2 THEN 'Headspace ' ELSE '' END || CASE WHEN o_custkey % 3 > 0 THEN 'Results ' ELSE 'Concentrations ' END || CASE WHEN o_custkey % 5 = 0 THEN 'Summary' WHEN o_custkey % 5 = 1 THEN 'suitability' WHEN o_custkey % 5 = 2 THEN 'in Water' ELSE '' END AS caption FROM orders),
f AS (SELECT *, contains(caption, 'Results') AS r, contains(caption, 'GC-MS') AS gc, contains(caption, 'LC/MS') AS lc, contains(caption, 'Headspace') AS hs, contains(caption, 'Summary') AS su, contains(caption, 'suitability') AS fit, contains(caption, 'Water') AS w FROM c),
v AS (SELECT o_orderkey, CASE agency WHEN 'Unknown' THEN 'Valid E&L Analytical Table' WHEN 'Ul' THEN CASE WHEN contains(caption, 'Concentrations') THEN 'Valid E&L Analytical Results Table (Substance Concentrations)' ELSE 'Method or parameters configuration table (no ''CONCENTRATIONS'')' END
WHEN 'Eurofins' THEN CASE WHEN fit THEN 'Excluded (suitability, limits, conditions, or summary table)' WHEN NOT r THEN 'Reference or method configuration table (no ''Results'')' WHEN NOT lc THEN 'Missing valid analytical method' WHEN NOT w THEN 'Missing valid extraction solvent' ELSE 'Valid E&L Analytical Results Table' END
WHEN 'Jordi' THEN CASE WHEN fit THEN 'Excluded (reference or setup table)' WHEN NOT (gc OR lc) THEN 'No recognized analytical method in caption' WHEN NOT r THEN 'Caption does not describe an analytical results table' ELSE 'Valid E&L Analytical Results Table' END
ELSE CASE WHEN fit OR su THEN 'Excluded (parameters, suitability, observations, or summary table)' WHEN NOT (gc OR lc OR hs) THEN 'No recognized analytical method in caption' WHEN NOT r THEN 'Caption does not describe an analytical results table' ELSE 'Valid E&L Analytical Results Table' END END AS reason FROM f)
SELECT o_orderkey, reason LIKE 'Valid %' AS is_valid, reason FROM v""")
def caption_validity(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    agency = F.element_at(F.array(*[F.lit(x) for x in ("Eurofins", "Namsa", "Wuxi", "Jordi", "Ul", "Unknown")]), (k % 6 + 1).cast("int"))
    caption = F.concat(
        F.lit("Table "), k.cast("string"), F.lit(": "), F.when(c % 4 == 0, F.lit("GC-MS ")).when(c % 4 == 1, F.lit("LC/MS ")).when(c % 4 == 2, F.lit("Headspace ")).otherwise(F.lit("")),
        F.when(c % 3 != 0, F.lit("Results ")).otherwise(F.lit("Concentrations ")), F.when(c % 5 == 0, F.lit("Summary")).when(c % 5 == 1, F.lit("suitability")).when(c % 5 == 2, F.lit("in Water")).otherwise(F.lit("")),
    )
    v = summary.caption_validity(agency, caption)
    return t(spark, d, "orders").select("o_orderkey", v["is_valid"].alias("is_valid"), v["reason"].alias("reason"))
