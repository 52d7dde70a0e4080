"""Evidence attached to rows and clusters: applicability domain, uncertainty register, evidence
matrix, membership reasoning, cluster summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed, percent
from ..functions.text import canonical, contains_any, digest_id
from .group import outlier_lists, representative, unique_mode
from .kinds import nearest, stats, top_neighbours
from .pairs import both_ways

# ---- applicability domain ----

# Thresholds, terms of identity statuses, and texts of the review flags.
NEAREST_LEAST, COVERAGE_LEAST = 0.60, 0.75
NOT_ASSESSABLE_TERMS = ("unresolved", "tier 3", "fallback required", "no structure")
REVIEW_TERMS = ("surrogate", "partial", "ambiguous", "related compound", "typo corrected")
RESOLVED_TERMS = ("resolved", "exact match")


def _texts(*flags: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in flags]))


def domain_status(df: DataFrame, key: str, group: str, bits: str, scaffold: str, descriptors: list[str], profile: str, ionisation: str, identity: str) -> DataFrame:
    """(key, domain_status, domain_reasons, nearest, min, median, coverage, representative, flags ...) of
    rows with a group. ``profile`` is an array; rows whose ``bits`` are null have no structure."""
    valid = df.where(F.col(bits).isNotNull() & F.col(group).isNotNull())
    spread = stats(valid, key, group, bits).select(F.col("block").alias(group), "min_similarity", "median_similarity")
    near = nearest(valid, key, group, bits).withColumnRenamed("id", key)
    scaf = valid.select(key, group, F.nullif(F.trim(F.col(scaffold)), F.lit("")).alias("s"))
    rep = representative(scaf, group, "s")
    # Coverage is compared before it is rounded.
    exact = scaf.join(rep.select(group, "representative"), group).groupBy(group).agg(F.count("*").alias("members"), (F.count_if(F.col("s") == F.col("representative")) / F.count("*")).alias("exact"))
    prof = valid.select(group, F.array_join(F.array_sort(F.coalesce(profile, F.array().cast("array<string>"))), ";").alias("p"))
    common_p = unique_mode(prof, group, "p", "common_profile")
    ion = valid.select(group, F.coalesce(ionisation, F.lit("Unknown")).alias("x"))
    common_i = unique_mode(ion, group, "x", "common_ionisation")
    odd = outlier_lists(valid, key, group, descriptors)
    w = (
        df.select(key, group, F.col(bits).isNotNull().alias("ok"), F.array_join(F.array_sort(F.coalesce(profile, F.array().cast("array<string>"))), ";").alias("p"), F.coalesce(ionisation, F.lit("Unknown")).alias("x"), F.nullif(F.trim(identity), F.lit("")).alias("who"))
        .join(spread, group, "left").join(rep, group, "left").join(exact, group, "left").join(common_p, group, "left").join(common_i, group, "left")
        .join(near, key, "left").join(odd, key, "left")
    )
    c = F.col
    flags = _texts(
        (c("members") == 1, "Singleton cluster requires analogue review"),
        ((c("members") > 1) & (c("nearest_similarity") < NEAREST_LEAST), "Nearest-neighbour similarity below review threshold"),
        (c("exact") < COVERAGE_LEAST, "Shared-scaffold coverage below review threshold"),
        (F.size("outlier_columns") > 0, F.concat(F.lit("Property outlier: "), F.array_join("outlier_columns", ", "))),
        (c("common_profile").isNull(), "Toxicophore profile has no unique cluster majority"),
        (c("common_profile") != c("p"), "Toxicophore profile differs from cluster majority"),
        (c("common_ionisation").isNull(), "Ionisation indicator has no unique cluster majority"),
        (c("common_ionisation") != c("x"), "Ionisation indicator differs from cluster majority"),
    )
    bad, review = contains_any(c("who"), NOT_ASSESSABLE_TERMS), contains_any(c("who"), REVIEW_TERMS)
    status = (
        F.when(c(group).isNull() | ~c("ok"), "Not assessable").when(bad, "Not assessable").when(review, "Borderline")
        .when((c("members") == 1) | (F.size("flags") > 0), "Borderline").otherwise("Inside")
    )
    first = _texts(
        (F.lit(True), F.concat(F.lit("Representative scaffold "), c("representative"), F.lit("; coverage "), percent(c("exact")))),
        (F.lit(True), F.when(c("nearest_similarity").isNull(), F.lit("Singleton cluster; no pairwise similarity")).otherwise(F.concat(F.lit("Nearest-neighbour Tanimoto "), fixed(c("nearest_similarity"), 3)))),
    )
    who = _texts((bad, F.concat(F.lit("Identity status prevents assessment: "), c("who"))), (~bad & review, F.concat(F.lit("Identity status requires review: "), c("who"))))
    reasons = F.when(c(group).isNull(), F.lit("No cluster assignment")).when(~c("ok"), F.lit("Standardized structure missing or invalid")).otherwise(F.array_join(F.concat(first, c("flags"), who), "; "))
    agree = lambda common, own: F.when(~c("ok"), "Not assessable").when(c(common).isNull(), "No unique cluster majority").when(c(common) == c(own), "Consistent").otherwise("Different from cluster majority")
    listed = F.concat(
        F.when(F.size("outlier_columns") > 0, F.array_join("outlier_columns", "; ")).otherwise(F.lit("None")),
        F.when(F.size("not_assessed") > 0, F.concat(F.lit("; Not assessed (fewer than 4 valid values or unavailable): "), F.array_join("not_assessed", ", "))).otherwise(F.lit("")),
    )
    return w.withColumn("flags", flags).select(
        key, group, status.alias("domain_status"), reasons.alias("domain_reasons"), "nearest_similarity", "min_similarity", "median_similarity",
        c("coverage").alias("scaffold_coverage"), "representative", listed.alias("property_outlier_flags"),
        agree("common_ionisation", "x").alias("ionisation_consistency"), agree("common_profile", "p").alias("toxicophore_consistency"),
    )


# ---- uncertainty register ----

LEVELS = ("Low", "Medium", "High")
# The categories in order, and the action that each outcome asks for.
CATEGORIES = ("Identity", "Structure", "Reactivity", "Property", "Biological", "Exposure", "Domain")
ACTIONS = {
    "identity_missing": "Resolve and document identity status before analogue selection or read-across use.",
    "identity_unresolved": "Resolve identity before analogue selection or read-across use.",
    "identity_review": "Document and verify the surrogate or partial identity before use.",
    "identity_other": "Confirm the identity-resolution status and supporting identifier before use.",
    "structure": "Obtain a valid standardized structure before using structural grouping evidence.",
    "reactivity_flagged": "Review reactive features and local chemical environment before shared assessment.",
    "reactivity_missing": "Obtain a valid standardized structure and re-run structural alert screening.",
    "property": "Review member-level property ranges when sufficient comparable members are available.",
    "outlier": "Review flagged property differences before shared assessment.",
    "biological": "Retrieve and review endpoint-specific biological evidence; do not infer an endpoint conclusion from grouping alone.",
    "exposure": "Confirm route, duration, device/product context, and exposure assumptions for the intended assessment.",
    "exposure_missing": "Request concentration, route, duration, and intended-use exposure context.",
    "domain_missing": "Run or resolve Stage 2 domain evidence before using this grouping for shared assessment.",
    "domain_high": "Do not use direct read-across; resolve the stated domain limitation or assess separately.",
    "domain_medium": "Document member-specific differences and toxicologist rationale before shared assessment.",
    "domain_other": "Confirm the Stage 2 domain status before using this grouping for shared assessment.",
}


def _outcome(level: int, reason: Column | str, action: str = "") -> Column:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(level).alias("level"), r.alias("reason"), F.lit(ACTIONS.get(action, action)).alias("action"))


def uncertainty(identity: Column, structure: Column, alerts: Column, toxicophores: Column, flags: Column, exposure: Column, domain: Column) -> Column:
    """Array of seven struct(category, level, reason, action), in order. ``exposure`` lists the
    exposure fields that have a value; the others are texts."""
    t = lambda v: F.trim(F.coalesce(v, F.lit("")))
    who, made, al, tox, fl, dom = t(identity), t(structure), t(alerts), t(toxicophores), t(flags), t(domain)
    say = lambda head, v, tail="": F.concat(F.lit(head), v, F.lit(tail))
    none = ("", "None", "Not assessable")
    outcomes = (
        F.when(who == "", _outcome(2, "Identity status is not supplied.", "identity_missing"))
        .when(contains_any(who, NOT_ASSESSABLE_TERMS), _outcome(2, say("Identity status is unresolved: ", who), "identity_unresolved"))
        .when(contains_any(who, REVIEW_TERMS), _outcome(1, say("Identity status requires review: ", who), "identity_review"))
        .when(contains_any(who, RESOLVED_TERMS), _outcome(0, say("Identity status is resolved: ", who, ".")))
        .otherwise(_outcome(1, say("Identity status is not a configured resolved status: ", who, "."), "identity_other")),
        F.when(made != "Calculated", _outcome(2, say("Structural evidence status is ", F.coalesce(F.nullif(made, F.lit("")), F.lit("not supplied")), "."), "structure"))
        .otherwise(_outcome(0, "Local structural evidence was calculated from standardized SMILES.")),
        F.when(~al.isin(*none) | ~tox.isin(*none), _outcome(1, F.concat(F.lit("Structural alert/toxicophore review required: alerts="), F.coalesce(F.nullif(al, F.lit("")), F.lit("None")), F.lit("; toxicophores="), F.coalesce(F.nullif(tox, F.lit("")), F.lit("None")), F.lit(".")), "reactivity_flagged"))
        .when(made != "Calculated", _outcome(2, "Reactivity evidence cannot be assessed without a valid structure.", "reactivity_missing"))
        .otherwise(_outcome(0, "No Stage 1 structural alerts or configured toxicophores were identified.")),
        F.when(fl.contains("Not assessed"), _outcome(1, say("Property outlier screening is incomplete: ", fl, "."), "property"))
        .when(~fl.isin("", "None"), _outcome(1, say("Property outlier flag(s): ", fl, "."), "outlier"))
        .otherwise(_outcome(0, "No Stage 2 property outlier flags were reported.")),
        _outcome(2, "No endpoint evidence retrieved in Stage 3.", "biological"),
        F.when(F.size(exposure) > 0, _outcome(1, say("Analytical concentration field(s) supplied: ", F.array_join(exposure, ", "), "; exposure context remains incomplete."), "exposure"))
        .otherwise(_outcome(2, "No configured exposure-context field is supplied.", "exposure_missing")),
        F.when(dom == "", _outcome(2, "Stage 2 domain status is not supplied.", "domain_missing"))
        .when(dom.isin("Not assessable", "Outside"), _outcome(2, say("Stage 2 domain status is ", dom, "."), "domain_high"))
        .when(dom == "Borderline", _outcome(1, say("Stage 2 domain status is ", dom, "."), "domain_medium"))
        .when(dom == "Inside", _outcome(0, say("Stage 2 domain status is ", dom, ".")))
        .otherwise(_outcome(2, say("Stage 2 domain status is unrecognised: ", dom, "."), "domain_other")),
    )
    return F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("category"), o["level"].alias("level"), o["reason"].alias("reason"), o["action"].alias("action")) for i, (c, o) in enumerate(zip(CATEGORIES, outcomes, strict=True))])


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def uncertainty_summary(records: Column) -> Column:
    """``High: a, b | Medium: c`` of a row's records."""
    part = lambda lv: F.transform(F.filter(records, lambda r: r["level"] == lv), lambda r: r["category"])
    text = lambda lv: F.when(F.size(part(lv)) > 0, F.concat(F.lit(f"{LEVELS[lv]}: "), F.array_join(part(lv), ", ")))
    return F.coalesce(F.nullif(F.concat_ws(" | ", text(2), text(1)), F.lit("")), F.lit("Low uncertainty across Stage 3 categories"))


def severity_rollup(records: DataFrame, group: str) -> DataFrame:
    """Per group and category of rows (group, place, category, level, reason, action): the highest
    level, how many members have it, and their distinct reasons and actions. One aggregate: the
    texts are collected by level, at most a distinct text each."""
    by = lambda c: F.collect_set(F.struct("level", F.col(c).alias("t")))
    agg = records.groupBy(group, "place", "category").agg(
        F.max("level").alias("top"), F.count("*").alias("members"),
        *[F.count_if(F.col("level") == lv).alias(f"n{lv}") for lv in range(3)], by("reason").alias("rs"), by("action").alias("acts"),
    )
    at_top = lambda c: F.array_sort(F.transform(F.filter(c, lambda s: (s["level"] == F.col("top")) & (s["t"] != "")), lambda s: s["t"]))
    n = F.element_at(F.array("n0", "n1", "n2"), F.col("top") + 1)
    reason = F.concat(n.cast("string"), F.lit(" of "), F.col("members").cast("string"), F.lit(" member(s) have "), level_name(F.col("top")), F.lit(" "), F.lower("category"), F.lit(" uncertainty. "), F.array_join(at_top("rs"), " | "))
    return agg.select(group, "place", "category", level_name(F.col("top")).alias("level"), n.alias("at_level"), "members", reason.alias("reason"), F.array_join(at_top("acts"), " | ").alias("action"))


# ---- evidence matrix ----


def evidence_rows(facts: DataFrame, group: str, limit: int = 500, version: str = "1.0.0") -> DataFrame:
    """Rows (group, domain, type, text, uncertain) to the matrix: stable ids of the full text,
    shown up to ``limit`` characters; what is empty or not supplied is left out."""
    full = canonical(F.col("text"))
    kept = facts.withColumn("full", full).where((F.col("full") != "") & (F.col("full") != "Not supplied"))
    g = F.col(group).cast("string")
    return kept.select(
        g.alias("cluster_id"), digest_id("E", g, F.col("domain"), F.col("type"), F.col("full")).alias("evidence_id"),
        F.when(F.col("uncertain"), digest_id("U", g, F.col("domain"), F.col("full"))).otherwise(F.lit("")).alias("uncertainty_id"),
        "domain", "type", F.substring("full", 1, limit).alias("text"), F.lit(version).alias("matrix_version"),
    )


def matrix_hash(matrix: DataFrame) -> DataFrame:
    """(cluster_id, matrix_hash): SHA-256 over a cluster's rows in order of their ids."""
    row = F.concat_ws("|", "domain", "type", "evidence_id", "uncertainty_id", "text")
    return matrix.groupBy("cluster_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("matrix_hash"))


def grounding_errors(cited: Column, known: Column, claims: dict[str, Column], rendered: Column, banned: list[str], terms: list[str], most: int = 1800) -> Column:
    """Error codes of a generated text: what it cites must be known and exactly what its claims
    cite, and it must not be long, or claim what is banned."""
    linked = F.array_distinct(F.flatten(F.array(*claims.values())))
    empty = F.lit(False)
    for c in claims.values():
        empty = empty | (F.size(c) == 0)
    return _texts(
        ((F.size(cited) == 0) | (F.size(F.array_except(cited, known)) > 0), "unknown_evidence"),
        (empty, "claim_without_evidence"),
        (F.array_sort(F.array_distinct(cited)) != F.array_sort(linked), "links_differ"),
        (F.length(rendered) > most, "too_long"),
        (rendered.rlike("(?i)" + "|".join(banned)) if banned else F.lit(False), "banned_claim"),
        (contains_any(rendered, terms), "endpoint_term"),
    )


# Columns of a cluster's matrix, in order; the columns whose ranges are shown; id columns.
MATRIX = ("Cluster_ID", "Evidence_ID", "Uncertainty_ID", "Evidence_Domain", "Evidence_Type", "Evidence_Text", "Source_Fields", "Matrix_Version")
RANGES = ("MW", "LogP", "TPSA", "HBD", "HBA", "Rotatable_Bonds", "Formal_Charge", "Ring_Count", "Aromatic_Ring_Count", "Fraction_CSP3")
MEMBER_IDS = ("DTXSID", "EPA_CTX_DTXSID", "InChIKey", "CAS", "CASRN")
LEVELS_OF_TAXONOMY = (("Superclass", "ChemOnt_Superclass"), ("Class", "ChemOnt_Class"), ("Subclass", "ChemOnt_Subclass"), ("Direct Parent", "ChemOnt_Direct_Parent"))
#: Facts that list the distinct values of one column: domain, type, column, whether it is uncertain.
LISTED = (
    ("Structure", "Scaffold", "Scaffold", False),
    ("Structure", "Toxicophore profile", "Toxicophore_Profile", False),
    ("Reactivity", "Structural alerts", "All_Structural_Alerts", False),
    ("Domain", "Domain status", "Domain_Status", True),
    ("Domain", "Domain reasons", "Domain_Reasons", True),
    ("Identity", "Identity status", "Identity Status", True),
    ("Physicochemical", "Member property-outlier flags", "Property_Outlier_Flags", True),
    ("Biological", "Available targets", "ChEMBL_Targets", True),
)


def cluster_matrix(df: DataFrame, register: DataFrame | None = None, ledger: DataFrame | None = None, cluster: str = "Cluster ID", limit: int = 500, version: str = "1.0.0") -> DataFrame:
    """The columns ``MATRIX``: eleven facts of each cluster's rows, the uncertainty register's rows of the cluster
    and the ledger's records of its members. A fact without a value is left out; rows of no cluster are
    ``Unassigned``, and those marked ``Unclustered`` have no facts. One aggregate makes all facts."""
    text = lambda c: F.substring(canonical(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), 1, limit)
    rows = df.withColumn("_c", F.coalesce(F.nullif(text(cluster), F.lit("")), F.lit("Unassigned"))).where("_c <> 'Unclustered'")
    listed = [c for c in dict.fromkeys(["Cluster_Status", "Decision", *[x[2] for x in LISTED], *[c for _, c in LEVELS_OF_TAXONOMY]]) if c in df.columns]
    ranged = [c for c in RANGES if c in df.columns]
    values = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(canonical(F.col(f"`{c}`").cast("string")), F.lit("")))), "; ")
    number = lambda c: F.col(c).try_cast("double")
    sums = rows.groupBy("_c").agg(
        F.count("*").alias("_n"), *[values(c).alias(f"_v_{c}") for c in listed],
        *[F.when(F.count(number(c)) > 0, F.format_string(f"{c}=%.2f-%.2f", F.min(number(c)), F.max(number(c)))).alias(f"_r_{c}") for c in ranged],
    )
    shown = lambda c: F.coalesce(F.nullif(F.col(f"_v_{c}"), F.lit("")), F.lit("Not supplied")) if c in listed else F.lit("Not supplied")
    levels = [F.concat(F.lit(f"{label}="), shown(c)) for label, c in LEVELS_OF_TAXONOMY if c in listed]
    fact = lambda domain, kind, said, fields, uncertain: F.struct(F.lit(domain).alias("domain"), F.lit(kind).alias("type"), said.alias("text"), F.lit(fields).alias("fields"), F.lit(uncertain).alias("uncertain"))
    facts = F.array(
        fact("Grouping", "Deterministic cluster", F.concat(F.lit("Members="), F.col("_n").cast("string"), F.lit("; Cluster_Status="), shown("Cluster_Status"), F.lit("; Decision="), shown("Decision")), "Cluster ID; Cluster_Status; Decision", False),
        fact("Structure", "ChemOnt hierarchy", F.concat_ws("; ", *levels) if levels else F.lit("Not supplied"), "; ".join(c for _, c in LEVELS_OF_TAXONOMY), True),
        fact("Physicochemical", "Calculated property ranges", F.concat_ws("; ", *[F.col(f"_r_{c}") for c in ranged]) if ranged else F.lit(""), "; ".join(RANGES), False),
        *[fact(domain, kind, shown(c), c, uncertain) for domain, kind, c, uncertain in LISTED],
    )
    each = sums.select("_c", F.explode(facts).alias("f")).select("_c", "f.*")
    if register is not None:
        mine = register.where("Scope = 'Cluster'").join(rows.select("_c").distinct(), F.col("Scope_ID").cast("string") == F.col("_c"))
        each = each.unionByName(mine.select(
            "_c", F.lit("Uncertainty").alias("domain"), F.concat(text("Category"), F.lit(" ("), text("Level"), F.lit(")")).alias("type"),
            F.concat(text("Reason"), F.lit(" Required action: "), text("Required_Action")).alias("text"), text("Evidence_Fields").alias("fields"), F.lit(True).alias("uncertain"),
        ))
    ids = [c for c in MEMBER_IDS if c in df.columns]
    if ledger is not None and ids:
        members = rows.select("_c", F.explode(F.array(*[text(c) for c in ids])).alias("_id")).where("_id <> ''").distinct()
        mine = ledger.join(members, F.col("identity_key").cast("string") == F.col("_id"))
        said = [F.lit("Endpoint="), text("endpoint"), F.lit("; Result="), text("result"), F.lit("; Source="), text("source"), F.lit("; Record="), text("source_record"), F.lit("; Review="), text("reviewer_status")]
        each = each.unionByName(mine.select("_c", F.lit("Biological").alias("domain"), F.lit("Retrieved endpoint evidence").alias("type"), F.concat(*said).alias("text"), F.lit("Endpoint Evidence Ledger").alias("fields"), F.lit(True).alias("uncertain")))
    full = each.withColumn("full", canonical(F.col("text"))).where("full <> '' AND full <> 'Not supplied'")
    return full.select(
        F.col("_c").alias("Cluster_ID"), digest_id("E", F.col("_c"), F.col("domain"), F.col("type"), F.col("full")).alias("Evidence_ID"),
        F.when(F.col("uncertain"), digest_id("U", F.col("_c"), F.col("domain"), F.col("full"))).otherwise(F.lit("")).alias("Uncertainty_ID"),
        F.col("domain").alias("Evidence_Domain"), F.col("type").alias("Evidence_Type"), F.substring("full", 1, limit).alias("Evidence_Text"), F.col("fields").alias("Source_Fields"), F.lit(version).alias("Matrix_Version"),
    )


#: The order of a matrix's rows.
MATRIX_ORDER = ("Cluster_ID", "Evidence_Domain", "Evidence_Type", "Evidence_ID")


def cluster_matrix_hash(matrix: DataFrame) -> DataFrame:
    """(cluster_id, matrix_hash): SHA-256 of a cluster's rows, in order, as canonical JSON: names sorted, no
    blanks, letters of all alphabets as they are."""
    order = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(MATRIX_ORDER)], F.to_json(F.struct(*sorted(MATRIX))).alias("json"))
    listed = matrix.groupBy(F.col("Cluster_ID").alias("cluster_id")).agg(F.array_sort(F.collect_list(order)).alias("rows"))
    return listed.select("cluster_id", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]")), 256).alias("matrix_hash"))


# ---- membership reasoning ----


def review_boundary(domain: Column, status: Column, flags: Column, ionisation: Column, toxicophore: Column, identity: Column) -> Column:
    """Why a person must review a row, as one sentence."""
    low = lambda v, d: F.lower(F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit(d)))
    fine = ("consistent", "not assessable", "not supplied")
    fl = low(flags, "None")
    why = _texts(
        (low(domain, "Not assessable") != "inside", F.concat(F.lit("domain status is "), F.coalesce(F.nullif(F.trim(domain), F.lit("")), F.lit("Not assessable")))),
        (low(status, "").contains("unstable"), "cluster stability requires review"),
        (fl.startswith("none; not assessed"), "some cluster property measures are not assessed"),
        (~fl.startswith("none; not assessed") & ~fl.isin("none", "not supplied", "not assessable"), "property-outlier flags are present"),
        (~low(ionisation, "Consistent").isin(*fine), "ionisation differs from the cluster majority"),
        (~low(toxicophore, "Consistent").isin(*fine), "toxicophore profile differs from the cluster majority"),
        (~low(identity, "Resolved").isin("resolved", "exact match"), "identity status requires confirmation"),
    )
    said = F.coalesce(F.nullif(F.array_join(why, "; "), F.lit("")), F.lit("the grouping is a technical similarity result, not an endpoint conclusion"))
    head = "SME review is required before this grouping is used for analogue selection, read-across, or any endpoint-specific assessment because "
    return F.concat(F.lit(head), said, F.lit("."))


def neighbour_text(df: DataFrame, key: str, group: str, bits: str, name: str, k: int = 3) -> DataFrame:
    """(key, nearest_members, nearest_similarity): the ``k`` most similar members of a row's group."""
    top = top_neighbours(df, key, group, bits, k)
    named = top.join(df.select(F.col(key).alias("other"), F.col(name).cast("string").alias("n")), "other")
    text = F.concat(F.col("n"), F.lit(" (Tanimoto "), fixed(F.col("similarity"), 3), F.lit(")"))
    listed = named.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("ts"), F.max("similarity").alias("s"))
    out = df.select(key, group).join(listed, key, "left")
    return out.select(
        key, group,
        F.coalesce(F.array_join(F.transform("ts", lambda t: t["t"]), "; "), F.lit("No in-cluster structural neighbour (singleton cluster)")).alias("nearest_members"),
        F.coalesce(fixed(F.col("s"), 3), F.lit("Not available")).alias("nearest_similarity"),
    )


def stability(unique_count: Column, median: Column, least: float = 0.60) -> Column:
    return (
        F.when(unique_count == 1, F.lit("Not assessable: one unique structure"))
        .when(median >= least, F.lit("Structurally coherent under primary threshold; sensitivity review pending"))
        .otherwise(F.lit("Borderline: SME review required before use"))
    )


def mean_distance(pairs: DataFrame, distance: Column) -> DataFrame:
    """(block, mean_distance) of pair distances, to 6 places."""
    return pairs.groupBy("block").agg(F.bround(F.avg(distance), 6).alias("mean_distance"))


__all__ = ["both_ways", "domain_status", "uncertainty", "severity_rollup", "evidence_rows", "matrix_hash", "cluster_matrix", "cluster_matrix_hash", "grounding_errors", "review_boundary", "neighbour_text", "stability", "mean_distance"]
