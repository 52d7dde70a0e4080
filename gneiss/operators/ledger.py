"""The append-only evidence ledger: validation, ids, ingestion, supersession, lookups.

A batch is validated as a whole against the ledger as it was before it; if one record has an
error, nothing is appended. Identical content is a duplicate and is skipped; changed
content must name the record that it supersedes, which stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Columns of the export, in order; those that the ledger itself adds; those required.
EXPORT = (
    "evidence_id", "identity_key", "compound_mapping_method", "endpoint", "result",
    "study_type", "species", "route", "dose", "dose_unit", "duration", "source",
    "source_record", "source_url", "source_database_version", "reliability",
    "evidence_status", "raw_record_hash", "vocabulary_version", "retrieved_at",
    "imported_at", "imported_by", "reviewer_status", "supersedes_evidence_id", "notes",
)
ADDED = ("evidence_id", "raw_record_hash", "vocabulary_version", "imported_at", "imported_by")
#: What a record says, and its hash covers.
FIELDS = tuple(c for c in EXPORT if c not in ADDED)
REQUIRED = ("identity_key", "compound_mapping_method", "endpoint", "result", "study_type", "species", "route", "source", "source_record", "reliability", "evidence_status")
CONTROLLED = ("compound_mapping_method", "endpoint", "result", "study_type", "species", "route", "reliability", "evidence_status")


def dose_errors(dose: Column, unit: Column) -> Column:
    """Codes for a numeric dose that is negative or without a unit, and for a negative range."""
    plain = dose.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    return F.array_compact(F.array(
        F.when(plain & (dose.try_cast("double") < 0), F.lit("negative_dose")),
        F.when(plain & (F.coalesce(unit, F.lit("")) == ""), F.lit("dose_without_unit")),
        F.when(dose.rlike(r"(^|\s)-\d"), F.lit("negative_range")),
    ))


def validate(records: DataFrame, vocabularies: dict[str, list[str]], version: str = "1.0.0") -> DataFrame:
    """Normalised records with errors, raw_record_hash and evidence_id. A retrieved record without
    a URL becomes incomplete and says so in its notes."""
    t = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in records.columns else F.lit("")
    norm = records.select(*[c for c in records.columns if c not in FIELDS], *[t(c).alias(c) for c in FIELDS])
    norm = norm.withColumn("reviewer_status", F.coalesce(F.nullif("reviewer_status", F.lit("")), F.lit("Not reviewed")))
    errors = [F.when(F.col(c) == "", F.lit(f"missing:{c}")) for c in REQUIRED]
    errors += [F.when((F.col(c) != "") & ~F.col(c).isin(*vocabularies[c]), F.lit(f"vocabulary:{c}")) for c in (*CONTROLLED, "reviewer_status") if c in vocabularies]
    errors.append(F.when((F.col("evidence_status") == "No record retrieved") & (F.col("result") == "Negative"), F.lit("negative_without_record")))
    checked = norm.withColumn("errors", F.concat(F.array_compact(F.array(*errors)), dose_errors(F.col("dose"), F.col("dose_unit"))))
    open_ = (F.col("source_url") == "") & (F.col("evidence_status") == "Retrieved")
    checked = checked.withColumns({
        "notes": F.when(open_, F.trim(F.concat(F.col("notes"), F.lit(" Source URL not supplied; provenance is incomplete.")))).otherwise(F.col("notes")),
        "evidence_status": F.when(open_, F.lit("Incomplete")).otherwise(F.col("evidence_status")),
        "vocabulary_version": F.lit(version),
    })
    # Canonical JSON: names sorted, no blanks, letters of all alphabets as they are.
    hashed = checked.withColumn("raw_record_hash", F.sha2(F.to_json(F.struct(*sorted(FIELDS))), 256))
    return hashed.withColumn("evidence_id", F.concat(F.lit("EV-"), F.upper(F.substring("raw_record_hash", 1, 16))))


def ingest(ledger: DataFrame, batch: DataFrame, imported_by: str, imported_at: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, additions) of a validated batch against the ledger: one outcome per record
    (Imported, Duplicate or its errors); additions are empty if any record has an error."""
    if not imported_by.strip():
        raise ValueError("imported_by is required")
    key = ["identity_key", "source", "source_record"]
    known = ledger.select("raw_record_hash").distinct().withColumn("_known", F.lit(True))
    prior = ledger.select(*key).distinct().withColumn("_prior", F.lit(True))
    old = ledger.select(F.col("evidence_id").alias("supersedes_evidence_id"), F.struct(*key).alias("_old"))
    seen = Window.partitionBy("raw_record_hash")
    j = batch.join(known, "raw_record_hash", "left").join(prior, key, "left").join(old, "supersedes_evidence_id", "left").withColumn("_twice", F.count("*").over(seen) > 1)
    dup = F.coalesce(F.col("_known"), F.lit(False))
    sup = F.col("supersedes_evidence_id") != ""
    more = F.array_compact(F.array(
        F.when(~dup & F.coalesce(F.col("_prior"), F.lit(False)) & ~sup, F.lit("changed_without_supersession")),
        F.when(~dup & sup & F.col("_old").isNull(), F.lit("superseded_missing")),
        F.when(~dup & sup & (F.col("_old") != F.struct(*key)), F.lit("superseded_other_record")),
        F.when(~dup & F.col("_twice"), F.lit("twice_in_batch")),
    ))
    judged = j.withColumn("errors", F.concat("errors", more)).withColumn("status", F.when(F.size("errors") > 0, F.lit("Error")).when(dup, F.lit("Duplicate")).otherwise(F.lit("Imported")))
    bad = judged.agg(F.count_if(F.col("status") == "Error").alias("_bad"))
    new = judged.where("status = 'Imported'").crossJoin(F.broadcast(bad)).where("_bad = 0")  # one row
    additions = new.select(*FIELDS, "vocabulary_version", "raw_record_hash", "evidence_id", F.lit(imported_at).alias("imported_at"), F.lit(imported_by.strip()).alias("imported_by"))
    return judged.select("evidence_id", "raw_record_hash", "status", "errors"), additions


def export(ledger: DataFrame, identity: str | None = None) -> DataFrame:
    """The export's columns in order, of all or one identity; oldest first."""
    rows = ledger if identity is None else ledger.where(F.col("identity_key") == identity)
    return rows.select(*EXPORT).orderBy("imported_at", "evidence_id")


def for_identities(ledger: DataFrame, rows: DataFrame, ids: list[str], group: str | None = None) -> DataFrame:
    """Ledger rows whose identity is in any of the id columns; with ``group``, per group."""
    keep = [group] if group else []
    long = rows.select(*keep, F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in ids])).alias("identity_key")).where("identity_key <> ''").distinct()
    return ledger.join(long, "identity_key", "inner" if group else "left_semi")


def latest(rows: DataFrame, key, order: str, tie: str) -> DataFrame:
    """The latest row of each key, by an aggregate that combines before the exchange."""
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(order, tie))
    return rows.groupBy(F.col(key).alias("_k") if isinstance(key, str) else key.alias("_k")).agg(best.alias("_r")).select("_r.*")


def latest_match(rows: DataFrame, prior: DataFrame, first: str, second: str, value: str, order: str, tie: str) -> DataFrame:
    """``rows`` with the value of the latest prior row of the same ``first``, else of the same
    ``second`` in any case."""
    a = latest(prior.where(F.col(first).isNotNull()), first, order, tie).select(F.col(first), F.col(value).alias("_a"))
    b = latest(prior.where(F.col(second).isNotNull()), F.lower(second), order, tie).select(F.lower(second).alias("_low"), F.col(value).alias("_b"))
    return rows.join(a, first, "left").join(b, F.lower(rows[second]) == F.col("_low"), "left").withColumn("matched", F.coalesce("_a", "_b")).drop("_a", "_b", "_low")


def fresh(cache: DataFrame, key: str, at: str, now: Column, days: int) -> DataFrame:
    """The latest entry of each key that is no older than ``days``."""
    return latest(cache, key, at, key).where(F.col(at) + F.make_dt_interval(F.lit(days)) >= now)


def upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries replace those of the same key."""
    return cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*cache.columns))


# Words that tell the endpoint family of an external hazard record, first match first;
# records of no family stay out of the ledger.
HAZARD_FAMILIES = (
    ("Genotoxicity", "genotox|mutagen|genetic"),
    ("Sensitisation", "sensiti"),
    ("Reproductive/developmental toxicity", "repro|development|fertility|terato"),
    ("Carcinogenicity", "carcin|cancer"),
)
VOCABULARIES = {
    "compound_mapping_method": ["Exact identifier", "Exact structure", "CASRN", "DTXSID", "Surrogate", "Manual mapping"],
    "endpoint": ["Genotoxicity", "Sensitisation", "Systemic toxicity", "Reproductive/developmental toxicity", "Carcinogenicity"],
    "result": ["Positive", "Negative", "Equivocal", "Inconclusive", "Not applicable", "Not reported", "Other"],
    "study_type": ["In vitro", "In vivo", "Human", "In silico", "Read-across", "Other", "Not reported"],
    "species": ["Human", "Mouse", "Rat", "Rabbit", "Guinea pig", "Other", "Not applicable", "Not reported"],
    "route": ["Oral", "Dermal", "Inhalation", "Parenteral", "In vitro", "Other", "Not applicable", "Not reported"],
    "reliability": ["Reliable without restrictions", "Reliable with restrictions", "Not reliable", "Not assignable", "Not reported"],
    "evidence_status": ["Retrieved", "No record retrieved", "Incomplete"],
    "reviewer_status": ["Not reviewed", "Accepted", "Needs review", "Rejected"],
}


def hazard_family(text: Column) -> Column:
    """The endpoint family of a record's text; null for none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(HAZARD_FAMILIES):
        out = F.when(F.lower(text).rlike(words), F.lit(name)).otherwise(out)
    return out


#: Fixed value: what a reviewer is told of a record that was mapped.
MAPPED_NOTE = "Mapped conservatively from EPA CTX raw record; reviewer interpretation required."


def hazard_records(raw: DataFrame, identity: str, text: str, qualifier: str, value: str, unit: str, record: str, study: str, species: str, route: str, source: str, duration: str | None = None, url: str = "", version: str = "", prefix: str = "EPA-CTX-") -> DataFrame:
    """External hazard rows as ledger records: values outside a vocabulary become Other, missing
    ones Not reported; the dose is qualifier and number; a row without a record's id is named by the hash of its
    columns as JSON, their names sorted."""
    clamp = lambda c, v, missing: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(missing)).when(F.col(c).isin(*VOCABULARIES[v]), F.col(c)).otherwise(F.lit("Other"))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(raw.columns)]))
    named = F.coalesce(F.nullif(F.trim(F.col(record).cast("string")), F.lit("")), F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 16)))
    return raw.withColumns({"_e": hazard_family(F.col(text)), "_r": named}).where("_e IS NOT NULL").select(
        F.col(identity).alias("identity_key"), F.lit("DTXSID").alias("compound_mapping_method"), F.col("_e").alias("endpoint"), F.lit("Not reported").alias("result"),
        clamp(study, "study_type", "Other").alias("study_type"), clamp(species, "species", "Not reported").alias("species"), clamp(route, "route", "Not reported").alias("route"),
        F.trim(F.concat_ws(" ", F.nullif(F.col(qualifier), F.lit("")), F.col(value).cast("string"))).alias("dose"), F.coalesce(F.col(unit), F.lit("")).alias("dose_unit"), (F.coalesce(F.col(duration).cast("string"), F.lit("")) if duration else F.lit("")).alias("duration"),
        F.lit(source).alias("source"), F.col("_r").alias("source_record"), F.lit(url).alias("source_url"), F.lit(version).alias("source_database_version"), F.lit("Not assignable").alias("reliability"),
        F.lit("Retrieved").alias("evidence_status"), F.lit("").alias("retrieved_at"), F.lit("Not reviewed").alias("reviewer_status"), F.lit(MAPPED_NOTE).alias("notes"),
    )
