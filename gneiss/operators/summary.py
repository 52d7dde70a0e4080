"""What reviewers read of a whole run: a record for each cluster, the dashboard, a row's membership
in words, the validity of captions, and the check of a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import number
from ..functions.text import present
from .evidence import review_boundary, stability
from .views import truthy

#: What counts as no value in reports.
NO_VALUE = ("", "nan", "none", "not available", "not assessable")

# ---- a record for each cluster ----

# Columns of a cluster's record, in order.
SUMMARY = (
    "Compatibility Group", "Cluster ID", "Compatibility Gate", "Cluster Status", "Source Row Count", "Unique Structure Count", "Duplicate or Alias Row Count",
    "Representative Compound", "Representative Standardized SMILES", "Member Chemical Classes", "Primary Functional Group Profile",
    "Minimum Pairwise Tanimoto", "Median Pairwise Tanimoto", "Nearest Neighbour Tanimoto Range", "Scaffold Profile", "Ionisation Profile", "Structural Alert Profile",
    "Property Compatibility", "Property Compatibility Reason", "Identity Structure Consistency", "Compatibility Gate Reason", "Membership Rationale",
    "Stability Assessment", "SME Review Status", "SME Decision", "SME Review Comments", "Assessment Boundary",
)
# Columns of the record that list distinct values; the column of the rows that they list, how
# many are shown, and whether only the first row of each structure counts.
LISTS = {
    "Compatibility Group": ("Compatibility Group", 1, False),
    "Compatibility Gate": ("Compatibility Gate", 1, False),
    "Cluster Status": ("Cluster_Status", 1, False),
    "Member Chemical Classes": ("Corrected Chemical Class", 6, False),
    "Primary Functional Group Profile": ("Primary Functional Group", 6, False),
    "Scaffold Profile": ("Scaffold", 6, True),
    "Ionisation Profile": ("Ionisation_Indicator", 6, True),
    "Structural Alert Profile": ("All_Structural_Alerts", 6, True),
    "Property Compatibility": ("Cluster Property Compatibility", 1, False),
    "Property Compatibility Reason": ("Cluster Property Compatibility Reason", 1, False),
    "Identity Structure Consistency": ("Identity Structure Consistency", 6, False),
    "Compatibility Gate Reason": ("Compatibility Gate Reason", 1, False),
    "Membership Rationale": ("Cluster_Membership_Rationale", 1, False),
}
BOUNDARY = "Structural grouping only. SME review is required before analogue selection, read-across, or endpoint-specific assessment."
MORE = "; additional values present"


def range_text(value: Column, places: int = 2, between: str = "-") -> Column:
    """Aggregate: the smallest and the largest number as text; null without any."""
    v = number(value)
    return F.when(F.count(v) > 0, F.concat(F.format_string(f"%.{places}f", F.min(v)), F.lit(between), F.format_string(f"%.{places}f", F.max(v))))


def assessable(cluster: Column) -> Column:
    return F.coalesce(cluster.startswith("Cluster_"), F.lit(False))


def cluster_summary(df: DataFrame, medoids: DataFrame, pos: str = "src_pos", structure: str = "Standardized SMILES", name: str = "Compound Name", cluster: str = "Cluster ID") -> DataFrame:
    """The columns ``SUMMARY`` for each assessable cluster of ``df``, whose rows have distinct ``pos``. ``medoids``
    (cluster, pos) names the representative; a cluster without one is represented by its first row. Columns that
    ``df`` lacks are not assessed. Values are counted once for each cluster and column before the few that are
    shown meet in a row, so a large cluster is never gathered."""
    col = lambda c: F.col(f"`{c}`")
    if "Compatibility Group" not in df.columns and "Cluster Family" in df.columns:  # an older name
        df = df.withColumnRenamed("Cluster Family", "Compatibility Group")
    rows = df.where(assessable(col(cluster))).withColumn("_cluster", col(cluster))
    firsts = rows.groupBy("_cluster", col(structure).alias("_s")).agg(F.min(pos).alias("_pos")).select("_cluster", "_pos", F.lit(True).alias("_first"))
    rows = rows.withColumn("_pos", F.col(pos)).join(firsts, ["_cluster", "_pos"], "left").withColumn("_first", F.col("_first").isNotNull())

    shown = {out: x for out, x in LISTS.items() if x[0] in df.columns}
    value = lambda c, once: F.when(F.col("_first") | F.lit(not once), present(col(c).cast("string"), NO_VALUE))
    items = F.array(*[F.struct(F.lit(out).alias("out"), F.lit(limit).alias("limit"), value(c, once).alias("v")) for out, (c, limit, once) in shown.items()]) if shown else F.array().cast("array<struct<out:string,limit:int,v:string>>")
    seen = rows.select("_cluster", "_pos", F.explode(items).alias("x")).where("x.v IS NOT NULL").groupBy("_cluster", "x.out", "x.limit", "x.v").agg(F.min("_pos").alias("o"))
    ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("_cluster", "out").orderBy("o"))).where("r <= 7")
    texts = ranked.groupBy("_cluster", "out", "limit").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("vs")).withColumn(
        "text", F.concat(F.array_join(F.slice("vs", 1, F.col("limit")), "; "), F.when(F.size("vs") > F.col("limit"), F.lit(MORE)).otherwise(F.lit("")))
    )
    wide = texts.groupBy("_cluster").agg(*[F.max(F.when(F.col("out") == out, F.col("text"))).alias(f"_t{i}") for i, out in enumerate(LISTS)])

    def first_number(c: str) -> Column:
        v = number(col(c)) if c in df.columns else F.lit(None).cast("double")
        return F.min_by(v, F.when(v.isNotNull(), F.col("_pos")))

    near = F.when(F.col("_first"), col("Nearest_Neighbour_Tanimoto")) if "Nearest_Neighbour_Tanimoto" in df.columns else F.lit(None).cast("double")
    sums = rows.groupBy("_cluster").agg(
        F.count("*").alias("_n"), F.count_if("_first").alias("_u"), F.min("_pos").alias("_lead"), first_number("Cluster_Min_Pairwise_Tanimoto").alias("_min"),
        first_number("Cluster_Median_Pairwise_Tanimoto").alias("_median"), range_text(near, 3, " to ").alias("_near"),
    )
    led = sums.join(medoids.select(F.col("cluster").alias("_cluster"), F.col("pos").alias("_medoid")), "_cluster", "left").withColumn("_pos", F.coalesce("_medoid", "_lead"))
    full = led.join(rows.select("_cluster", "_pos", col(name).alias("_name"), col(structure).alias("_structure")), ["_cluster", "_pos"]).join(wide, "_cluster", "left")
    or_ = lambda v, d: F.coalesce(v, F.lit(d))
    made = {
        "Cluster ID": F.col("_cluster"), "Source Row Count": F.col("_n"), "Unique Structure Count": F.col("_u"), "Duplicate or Alias Row Count": F.col("_n") - F.col("_u"),
        "Representative Compound": or_(present(F.col("_name"), NO_VALUE), "Unnamed compound"), "Representative Standardized SMILES": or_(present(F.col("_structure"), NO_VALUE), "Not assessable"),
        "Minimum Pairwise Tanimoto": or_(F.bround("_min", 3).cast("string"), "Not assessable"), "Median Pairwise Tanimoto": or_(F.bround("_median", 3).cast("string"), "Not assessable"),
        "Nearest Neighbour Tanimoto Range": or_(F.col("_near"), "Not assessable"), "Stability Assessment": stability(F.col("_u"), F.col("_median")),
        "SME Review Status": F.lit("Pending"), "SME Decision": F.lit("Pending"), "SME Review Comments": F.lit(""), "Assessment Boundary": F.lit(BOUNDARY),
        **{out: or_(F.col(f"_t{i}"), "Not assessed") for i, out in enumerate(LISTS)},
    }
    return full.select(*[made[c].alias(c) for c in SUMMARY])


# ---- dashboard ----


def dashboard(df: DataFrame, raw_rows: Column, usable: Column, structure: Column, casrn: Column, group: Column, cluster: Column, size: Column, review: Column, reason: Column, alerts: Column) -> DataFrame:
    """(place, metric, value): thirteen counts of a run, from one aggregate. ``raw_rows`` is an aggregate."""
    some = lambda v: present(v.cast("string"), NO_VALUE)
    clustered = usable & some(cluster).isNotNull()
    in_cluster = F.when(clustered, some(cluster))
    alert = some(alerts).isNotNull() & (F.lower(F.trim(alerts)) != "not assessed")
    metrics = (
        ("Raw extracted source rows", raw_rows),
        ("Final deduplicated chemical records", F.count("*")),
        ("Unique reported CASRNs", F.countDistinct(some(casrn))),
        ("Unique resolved standardised structures", F.countDistinct(F.when(usable, some(structure)))),
        ("Structure-resolved records", F.count_if(usable)),
        ("Unresolved / non-structural records", F.count_if(~usable)),
        ("Grouping-eligible records", F.count_if(usable)),
        ("Compatibility groups", F.countDistinct(F.when(usable, some(group)))),
        ("Structural clusters", F.countDistinct(in_cluster)),
        ("Clustered records", F.count_if(clustered)),
        ("Singleton clusters", F.countDistinct(F.when(size == 1, in_cluster))),
        ("SME review required", F.count_if(truthy(review, reason))),
        ("Records with structural alerts", F.count_if(alert)),
    )
    one = df.agg(*[v.cast("long").alias(f"_{i}") for i, (_, v) in enumerate(metrics)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(m).alias("metric"), F.col(f"_{i}").alias("value")) for i, (m, _) in enumerate(metrics)])))


# ---- membership in words ----

METHOD = "Compatibility-gated Morgan/ECFP4 Tanimoto Butina clustering with complete-linkage refinement"
PARAMETERS = "Morgan radius=2; fpSize=1024; Tanimoto >= 0.60; complete-linkage refinement"
NO_RATIONALE = "No cluster-membership rationale is available because a valid standardized structure and an assessable cluster assignment are required."
# The fields that a packet about a row may carry, in order.
PACKET = (
    "Compound Name", "CASRN", "InChIKey", "Standardized SMILES", "Corrected Chemical Class", "Primary Functional Group", "Taxonomy Path", "Cluster ID", "Cluster Size", "Cluster_Status",
    "Cluster_Reasoning_Status", "Cluster_Membership_Rationale", "Cluster_Membership_Parameters", "Cluster_Nearest_Members", "Cluster_Nearest_Tanimoto", "Cluster_Consensus_Method",
    "Domain_Status", "Domain_Reasons", "Ionisation_Consistency", "Toxicophore_Consistency", "Property_Outlier_Flags", "Uncertainty_Summary", "SME_Review_Boundary",
)


def _told(df: DataFrame, name: str, default: str = "Not supplied") -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit("")), F.lit(default)) if name in df.columns else F.lit(default)


def membership(df: DataFrame, valid: Column, nearest_members: str = "nearest_members", nearest: str = "nearest_similarity", version: str = "1.0.0") -> DataFrame:
    """``df`` with a row's reasoning status, method, parameters as JSON with sorted names, rationale and review boundary.
    ``nearest_members`` and ``nearest`` are those of ``neighbour_text``. Rows without a valid structure or an
    assessable cluster are not assessable."""
    say = lambda c, d="Not supplied": _told(df, c, d)
    method, scaffold, representative = say("Cluster_Consensus_Method", METHOD), say("Scaffold"), say("Cluster_Representative_Scaffold")
    match = F.when((scaffold != "Not supplied") & (scaffold == representative), F.lit("yes")).otherwise(F.lit("no"))
    facts = {
        "cluster_id": F.col("`Cluster ID`"), "cluster_size": say("Cluster Size"), "consensus_method": method, "membership_parameters": say("Cluster_Membership_Parameters", PARAMETERS),
        "nearest_members": F.col(nearest_members), "nearest_member_tanimoto": F.col(nearest), "representative_scaffold": representative, "representative_scaffold_match": match,
        "scaffold_coverage": say("Cluster_Scaffold_Coverage"), "domain_status": say("Domain_Status"), "ionisation_consistency": say("Ionisation_Consistency"),
        "toxicophore_consistency": say("Toxicophore_Consistency"), "property_outlier_flags": say("Property_Outlier_Flags"), "classification": say("Corrected Chemical Class"),
    }
    ok = F.coalesce(valid & assessable(F.col("`Cluster ID`")), F.lit(False))
    # ``, `` and ``: `` between, as the packet's readers expect; values are escaped one by one.
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    listed = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), quoted(facts[k])) for k in sorted(facts)]), F.lit("}"))
    f = facts
    said = F.concat(
        F.lit("Assigned to "), f["cluster_id"], F.lit(" by "), method, F.lit(". Cluster size: "), f["cluster_size"], F.lit(". Nearest in-cluster member(s): "), f["nearest_members"],
        F.lit(". Representative scaffold match: "), match, F.lit("; shared-scaffold coverage: "), f["scaffold_coverage"], F.lit(". Domain status: "), f["domain_status"],
        F.lit("; ionisation: "), f["ionisation_consistency"], F.lit("; toxicophore profile: "), f["toxicophore_consistency"], F.lit("; property-outlier flags: "), f["property_outlier_flags"], F.lit("."),
    )
    boundary = review_boundary(say("Domain_Status", "Not assessable"), say("Cluster_Status", ""), say("Property_Outlier_Flags", "None"), say("Ionisation_Consistency", "Consistent"), say("Toxicophore_Consistency", "Consistent"), say("Identity Status", "Resolved"))
    only = lambda v: F.when(ok, v).otherwise(F.lit(""))
    made = {
        "Cluster_Reasoning_Status": F.when(ok, F.lit("Calculated deterministic evidence")).otherwise(F.lit("Not assessable")), "Cluster_Nearest_Members": only(f["nearest_members"]),
        "Cluster_Nearest_Tanimoto": only(f["nearest_member_tanimoto"]), "Cluster_Consensus_Method": only(method), "Cluster_Membership_Parameters": only(listed),
        "Cluster_Membership_Rationale": F.when(ok, said).otherwise(F.lit(NO_RATIONALE)), "SME_Review_Boundary": boundary, "Cluster_Reasoning_Rule_Version": F.lit(version),
    }
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def reasoning_packet(df: DataFrame) -> Column:
    """The struct of the fields ``PACKET``, and no others, as text."""
    return F.struct(*[_told(df, c).alias(c) for c in PACKET])


# ---- the check of a partition ----


def failing_pairs(pairs: DataFrame, reason: Column) -> DataFrame:
    """(cluster, reason) of the clusters with a pair that must not be together: the reason of the first one in order of
    its later member, then of its earlier. ``pairs`` is (block, i, j, ...) with i > j; ``reason`` is null where a pair is fine."""
    bad = pairs.select("block", "i", "j", reason.alias("reason")).where("reason IS NOT NULL")
    return bad.groupBy(F.col("block").alias("cluster")).agg(F.min_by("reason", F.struct("i", "j")).alias("reason"))


# ---- captions ----

# Patterns, for each agency, of a caption's methods, of its exclusions and of the solvents that it must name.
METHODS = {
    "Eurofins": r"(?i)GC/MS|LC/MS|LC/UV|ICP/MS",
    "Namsa": r"(?i)GC.?MS|LC.?MS|LC.?UV|ICP.?MS|QTOF|Headspace|Direct Inject",
    "Wuxi": r"(?i)GC.?MS|LC.?MS|LC.?UV|ICP.?MS|QTOF|Headspace|Direct Inject",
    "Jordi": r"(?i)QTOF|GC.?MS|LC.?MS|ICP.?MS|HS.?GC|ICPMS|GCMS|LCMS",
}
EXCLUDED = {
    "Eurofins": r"(?i)suitability|limits|conditions|internal\s+standard|extraction\s+summary|summary\s+of\s+extraction",
    "Namsa": r"(?i)Parameters|Suitability|Observations?|\bSummary\b|DBT Selection|AET|Extraction Param",
    "Wuxi": r"(?i)Parameters|Suitability|Observations?|\bSummary\b|DBT Selection|AET|Extraction Param",
    "Jordi": r"(?i)Parameters|Suitability|Observations?|DBT Selection|AET|Extraction Param|Identification of Test|List of Acronyms|Study Design|Device Characteristics|Gravimetric|Spike Study|Molecular Weight|Weight Percent|Standard and Solvent|Scope of ISO|PDMS Quantitation",
}
SOLVENTS = r"(?i)Water|Ethanol|Isopropyl\s+alcohol"
RESULTS = {"Eurofins": r"(?i)Results", "Namsa": r"(?i)\bResults\b", "Wuxi": r"(?i)\bResults\b", "Jordi": r"(?i)\bResults\b"}
# What is said of each agency's excluded captions.
EXCLUSION = {
    "Eurofins": "Excluded (suitability, limits, conditions, or summary table)",
    "Namsa": "Excluded (parameters, suitability, observations, or summary table)",
    "Wuxi": "Excluded (parameters, suitability, observations, or summary table)",
    "Jordi": "Excluded (reference or setup table)",
}


def caption_validity(agency: Column, caption: Column) -> Column:
    """struct(is_valid, reason): whether a caption announces a table of results, as its agency words them."""
    out = F.lit("Valid E&L Analytical Table")
    for name in METHODS:
        results, method = caption.rlike(RESULTS[name]), caption.rlike(METHODS[name])
        why = F.when(caption.rlike(EXCLUDED[name]), F.lit(EXCLUSION[name]))
        if name == "Eurofins":
            why = why.when(~results, F.lit("Reference or method configuration table (no 'Results')")).when(~method, F.lit("Missing valid analytical method")).when(~caption.rlike(SOLVENTS), F.lit("Missing valid extraction solvent"))
        else:
            why = why.when(~method, F.lit("No recognized analytical method in caption")).when(~results, F.lit("Caption does not describe an analytical results table"))
        out = F.when(agency == name, why.otherwise(F.lit("Valid E&L Analytical Results Table"))).otherwise(out)
    named = F.when(caption.rlike("(?i)concentration"), F.lit("Valid E&L Analytical Results Table (Substance Concentrations)")).otherwise(F.lit("Method or parameters configuration table (no 'CONCENTRATIONS')"))
    said = F.when(agency == "Ul", named).otherwise(out)
    return F.struct(said.startswith("Valid ").alias("is_valid"), said.alias("reason"))

