"""Views for export and review: blanks, flags, flattened classifications, ontology look-ups, previews,
positions, counts, and the reports over a corpus of classified rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- columns and rows ----


def blank_nulls(df: DataFrame) -> DataFrame:
    """Null texts become empty; columns of other types stay."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def truthy(flag: Column | None, reason: Column | None = None) -> Column:
    """Whether a row asks for a person: a flag that says so, or any reason."""
    low = lambda v: F.lower(F.trim(F.coalesce(v.cast("string"), F.lit(""))))
    said = F.lit(False) if flag is None else low(flag).isin("1", "true", "yes", "y", "review", "required")
    return said if reason is None else said | ~low(reason).isin("", "nan", "none", "not available")


def ordered_unique(*lists: list[str]) -> list[str]:
    """The names of all lists, each at its first place."""
    return list(dict.fromkeys(c for names in lists for c in names))


def with_position(df: DataFrame, order: str, out: str = "src_pos", parts: int = 64) -> DataFrame:
    """``df`` with places 1 to n in the order of a numeric column without ties; nulls are first. Rows are
    dealt into ranges between quantiles, counted, and numbered within their range; no task orders
    all rows, and only a number for each range is put together."""
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)))
    bucket = F.lit(0)
    for i, c in enumerate(cuts, 1):
        bucket = F.when(F.col(order) >= c, F.lit(i)).otherwise(bucket)
    dealt = df.withColumn("_bucket", bucket)
    sums = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``parts`` rows
    offsets = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(order).asc_nulls_first()))
    return dealt.withColumn(out, inside).join(F.broadcast(offsets), "_bucket").withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before")


# ---- counts ----


def frequency_maps(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column a map from its values, as text, to their numbers, in order of the values.
    Values are counted before they meet, so the row grows with the distinct values only."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in columns])).alias("x"))
    counts = long.groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("v", "n")))))
    return counts.agg(*[entry(c).alias(c) for c in columns])


def change_counts(changes: DataFrame, key: str) -> DataFrame:
    """(changed_rows, changed_fields) of a report of differences: distinct keys, and all."""
    return changes.agg(F.countDistinct(key).alias("changed_rows"), F.count("*").alias("changed_fields"))


# ---- ontology ----

ONTOLOGY = ("kingdom", "superclass", "class", "subclass", "direct_parent", "mapping_evidence")


def ontology_compatibility(df: DataFrame, rule: str, label: str, mappings: DataFrame, version: str) -> DataFrame:
    """``df`` with the struct ``ontology``: the approved mapping of a row's rule. ``mappings`` has (rule_id,
    local_class, mapping_status, *ONTOLOGY), a row for each rule. A mapping for another class than the
    row's is an error that ends the query."""
    held = mappings.select(F.col("rule_id").alias("_rule"), F.struct(*[c for c in mappings.columns if c != "rule_id"]).alias("_m"))
    j = df.join(held, F.col(rule) == F.col("_rule"), "left")
    m = F.col("_m")
    wrong = m.isNotNull() & ~m["local_class"].eqNullSafe(F.col(label))
    status = F.when(m.isNull(), F.lit("Not mapped")).when(wrong, F.raise_error(F.concat(F.lit("Ontology mapping class mismatch for "), F.col(rule))).cast("string")).otherwise(F.coalesce(m["mapping_status"], F.lit("Mapped")))
    none = F.lit("No approved local ontology mapping for this structural rule")
    value = lambda c: F.when(m.isNull(), none if c == "mapping_evidence" else F.lit("")).otherwise(F.coalesce(m[c], F.lit("")))
    out = F.struct(status.alias("mapping_status"), F.lit(version).alias("ontology_mapping_version"), F.col(rule).alias("local_rule_id"), F.col(label).alias("local_class"), *[value(c).alias(c) for c in ONTOLOGY])
    return j.withColumn("ontology", out).drop("_rule", "_m")


def reference_enrichment(df: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """``df`` with the fields of an exact reference match laid over its struct ``ontology``; the local rule
    and class stay, and the row's own class is never touched. ``taxonomy`` has a row for each key."""
    fields = [c for c in taxonomy.columns if c != key]
    held = taxonomy.select(F.col(key).alias("_key"), F.struct(*fields).alias("_t"))
    j = df.join(held, F.col(key) == F.col("_key"), "left")
    own = df.schema["ontology"].dataType.names
    kept = [F.col(f"ontology.{c}").alias(c) if c not in fields or c in ("local_rule_id", "local_class") else F.when(F.col("_t").isNull(), F.col(f"ontology.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in own]
    more = [F.col(f"_t.{c}").alias(c) for c in fields if c not in own]
    return j.withColumn("ontology", F.struct(*kept, *more)).drop("_key", "_t")


# ---- flattened classification ----

# Columns of the export in order, the field that each shows, and what an absent one
# becomes. Fields of ``ontology`` are those of the struct of this name.
FLAT = (
    ("Corrected Chemical Class", "corrected_chemical_class", "Unclassified"),
    ("Own Structural Class", "corrected_chemical_class", "Unclassified"),
    ("Final Classification Record", "final_classification_record", ""),
    ("Classification Input Source", "classification_input_source", ""),
    ("Classification Structure SMILES", "classification_structure_smiles", ""),
    ("Classification Standardization Version", "classification_standardization_version", ""),
    ("Classification Stereochemistry Status", "classification_stereochemistry_status", ""),
    ("Classification Status", "classification_status", ""),
    ("Classification Scope", "scope", ""),
    ("Classification Review Recommended", "review_recommended", ""),
    ("Classification Review Recommendation", "recommendation", ""),
    ("Classification Suggested Action", "classification_suggested_action", ""),
    ("Classification Rule ID", "classification_rule_id", ""),
    ("Classification Rule Version", "classification_rule_version", ""),
    ("Manual Review Flag", "manual_review_flag", False),
    ("Manual Review Reason", "manual_review_reason", ""),
    ("Detected Feature Profile", "detected_feature_profile", "; "),
    ("Primary Functional Group", "taxonomy_hierarchy.Functional Group", ""),
    ("Secondary Functional Groups", "secondary_groups", ""),
    ("Secondary Functional Groups Basis", "secondary_basis", ""),
    ("Taxonomy Path", "taxonomy_path", ""),
    ("Taxonomy Path Steps", "taxonomy_path_steps", " → "),
    ("Matched Categories", "matched_categories", " → "),
    ("Direct Parent", "direct_parent", ""),
    ("Taxonomy Dictionary Version", "taxonomy_dictionary_version", ""),
    ("Taxonomy Hierarchy", "taxonomy_hierarchy", " | "),
    ("Topology Profile", "topology_profile", " | "),
    ("Ontology Mapping Status", "ontology.mapping_status", ""),
    ("Ontology Mapping Version", "ontology.ontology_mapping_version", ""),
    ("Ontology Kingdom", "ontology.kingdom", ""),
    ("Ontology Superclass", "ontology.superclass", ""),
    ("Ontology Class", "ontology.class", ""),
    ("Ontology Subclass", "ontology.subclass", ""),
    ("Ontology Direct Parent", "ontology.direct_parent", ""),
    ("Ontology Mapping Evidence", "ontology.mapping_evidence", ""),
    ("Local Taxonomy Match Status", "ontology.mapping_status", "Not matched"),
    ("Local Taxonomy Source", "ontology.source", ""),
    ("Local Taxonomy Record ID", "ontology.record_id", ""),
    ("Local Taxonomy Path", "ontology.taxonomy_path", ""),
    ("Reference Taxonomy Path", "ontology.taxonomy_path", ""),
    ("Local Taxonomy Reference", "ontology.reference", ""),
    ("Local Taxonomy URL", "ontology.url", ""),
)


def flatten_classification(df: DataFrame, record: str, local_source: str, keep: list[str] = ()) -> DataFrame:
    """``keep`` and the columns of ``FLAT`` from the struct ``record``. Lists are joined, maps become
    ``key: value`` pairs, and fields that the struct lacks have their default. Only a match from
    ``local_source`` counts as one of the local taxonomy."""
    top = df.schema[record].dataType
    inner = top["ontology"].dataType.names if "ontology" in top.names else []

    def value(name: str, path: str, default) -> Column:
        head, _, rest = path.partition(".")
        known = head in top.names and (head != "ontology" or rest in inner)
        if not known:
            return F.lit(default if isinstance(default, bool) or rest or default in ("", "Unclassified", "Not matched") else "")
        x = F.col(f"{record}.{head}")
        if isinstance(default, bool):
            return F.coalesce(x.cast("boolean"), F.lit(default))
        if head == "ontology":
            shown = F.coalesce(x[rest].cast("string"), F.lit(""))
            if default == "Not matched":
                here = x["source"] == local_source if "source" in inner else F.lit(False)
                return F.when(F.coalesce(here, F.lit(False)), shown).otherwise(F.lit(default))
            return shown
        if rest:
            return F.coalesce(F.try_element_at(x, F.lit(rest)), F.lit(default))
        kind = top[head].dataType.typeName()
        if kind == "array":
            return F.coalesce(F.array_join(x, default), F.lit(""))
        if kind == "map":
            return F.coalesce(F.array_join(F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), default), F.lit(""))
        return F.coalesce(x.cast("string"), F.lit(default))

    return df.select(*keep, *[value(*row).alias(row[0]) for row in FLAT])


# ---- preview of a single row ----


def single_preview(nearest: Column, scaffold: Column) -> Column:
    """What a single assessment shows where a batch would show its cluster. ``nearest`` is a percentage."""
    shown = F.coalesce(F.bround(nearest / 100, 3).cast("string"), F.lit("Not available"))
    # The texts that stand for what only a batch can tell.
    return F.struct(
        F.lit("Not available in single assessment").alias("cluster_id"), F.lit("Not available in single assessment").alias("cluster_size"),
        F.lit("Single-assessment preview only").alias("cluster_status"), F.lit("Not assessable in single assessment").alias("domain"),
        F.lit("Not assessable in single assessment").alias("decision"), F.lit("Not assessable").alias("domain_status"),
        F.lit("Cluster and domain evidence are computed in the batch workflow; this tab shows only a nearest-analogue preview.").alias("domain_reasons"),
        F.lit("Preview only").alias("domain_rule_version"), shown.alias("nearest_neighbour"),
        F.lit("Not available").alias("min_pairwise"), F.lit("Not available").alias("median_pairwise"), F.lit("Not available").alias("scaffold_coverage"),
        F.coalesce(F.nullif(scaffold, F.lit("")), F.lit("Not available")).alias("representative"),
        F.lit("Not assessable in single assessment").alias("property_outliers"), F.lit("Proxy not assessed").alias("ionisation_consistency"),
        F.lit("Proxy not assessed").alias("toxicophore_consistency"), F.lit("Batch clustering required for uncertainty register").alias("uncertainty"),
    )


# ---- reports over a corpus ----


def derived_key(rows: DataFrame) -> DataFrame:
    """``rows`` (supplied_key, computed_key) with derived_key and derived_status: a key computed from a valid
    structure stands beside a missing one and never replaces a supplied one."""
    have, made = F.coalesce(F.trim("supplied_key"), F.lit("")) != "", F.coalesce(F.col("computed_key"), F.lit("")) != ""
    return rows.withColumns({
        "derived_key": F.when(~have & made, F.col("computed_key")).otherwise(F.lit("")),
        "derived_status": F.when(have, F.lit("Not needed")).when(made, F.lit("Derived locally")).otherwise(F.lit("Unavailable")),
    })


def corpus_reports(rows: DataFrame) -> dict[str, DataFrame]:
    """Of classified rows (source_row, name, casrn, source, supplied_key, computed_key, structure, structure_status,
    structure_reason, route struct, class, rule_id, manual_review, mapping_status, features): the baseline, the queue of
    rows without a structure, the derived keys, the rows that only a broad rule caught, and a summary of one row."""
    base = derived_key(rows)
    whole = F.col("structure_status") == "Structured"
    broad = whole & F.col("rule_id").endswith("-UNK-001")
    counts = base.agg(
        F.count("*").alias("row_count"), F.count_if(~F.col("manual_review")).alias("classified_rows"), F.count_if("manual_review").alias("manual_review_rows"),
        F.count_if(F.coalesce(F.trim("supplied_key"), F.lit("")) == "").alias("missing_key_rows"), F.count_if(F.col("derived_key") != "").alias("derived_key_rows"), F.count_if(broad).alias("rule_review_rows"),
    )
    maps = frequency_maps(base, ["structure_status", "class", "rule_id", "mapping_status"])
    return {
        "baseline": base.drop("route", "features", "computed_key"),
        "curation": base.where(~whole).select("source_row", "name", "casrn", "source", "supplied_key", F.col("structure_status").alias("curation_status"), F.col("structure_reason").alias("reason"), "route.*", F.lit("Review source evidence and obtain an approved structure; do not infer from name text").alias("next_action")),
        "derived": base.where("derived_key <> ''").select("source_row", "name", "casrn", "derived_key", F.lit("Candidate — retain supplied field unchanged until approved").alias("review_status")),
        "rule_review": base.where(broad).select("source_row", "name", "casrn", "structure", "class", "rule_id", F.array_join("features", "; ").alias("features"), F.lit("Broad elemental fallback selected despite a valid structure").alias("review_reason")),
        "summary": counts.crossJoin(F.broadcast(maps)),  # one row each
    }
