"""The staged workflow: snapshot (A), core (B1A), optional evidence (B1B), export (B2).

A stage reads the table that the stage before it wrote, so a run can be resumed from any
stage by its id alone, and lost executors cost no finished stage. Optional stages only add
columns; ``preserved`` checks that they left the core as it was.

The input is the compound table. What it doesn't bring along of its structures (fingerprint bits, features,
ring systems, counts) is worked out from their texts (``from_structures``); LogP, polar surface and
the catalogues of alerts belong to a toolkit and are taken from columns where there are any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chemistry, cluster, evidence, layers, ledger, rules, structures, tables, views

ALIASES = {
    "a": ("a", "phase_a", "phasea", "snapshot"), "b1a": ("b1", "b1a", "core", "enrich", "enrichment"),
    "b1b": ("b1b", "optional", "finalize"), "b2": ("b2", "export"),
}


@dataclass
class Result:
    """A stage's main table, its side tables, and what the stages of the run did."""

    compounds: DataFrame
    side: dict[str, DataFrame] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)


def stage_name(text: str) -> str:
    """The stage that a name means; any other name means all of them."""
    low = text.strip().lower()
    return next((k for k, names in ALIASES.items() if low in names), "all")


#: Columns that a toolkit may bring along, and their types.
OUTSIDE = {"alerts": "array<string>", "logp": "double", "tpsa": "double", "amide_units": "int", "conc": "double"}


def from_structures(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``df`` with the columns that the stages read and it lacks, each distinct structure worked on once."""
    found, x = structures.profiled(df, smiles), F.col("found")
    top, counts = x["topology"]["rings"], x["descriptors"]
    made = {
        "bits": x["bits"], "features": x["features"], "scaffold": chemistry.scaffold_label(F.coalesce(x["valid"], F.lit(False)), x["scaffold"]), "toxicophores": x["toxicophores"],
        "ionisation": F.when(x["valid"], chemistry.ionisation_label(x["permanent"], x["acidic"], x["basic"])), "topology_class": top["topology_class"], "ring_count": top["ring_count"],
        "aromatic_ring_count": top["aromatic_ring_count"], "formal_charge": counts["formal_charge"], "mw": counts["weight"], "si_atoms": x["si_atoms"], "si_ring_units": x["si_ring_units"],
    }
    made |= {c: F.lit(None).cast(t) for c, t in OUTSIDE.items()}
    return found.withColumns({c: v for c, v in made.items() if c not in df.columns}).drop("found")


def snapshot(df: DataFrame) -> Result:
    """Classification, taxonomy and gate from the features; one projection."""
    if "features" not in df.columns or "bits" not in df.columns:
        df = from_structures(df)
    valid = F.col("bits").isNotNull()
    c = df.withColumn("_c", rules.classify(F.coalesce("features", F.array().cast("array<string>")), valid))
    out = c.withColumns({
        "rule_id": F.col("_c.rule_id"), "chemical_class": F.col("_c.label"), "class_reason": F.col("_c.reason"), "scope": rules.scope(F.col("_c.rule_id")),
        "taxonomy": rules.taxonomy(F.col("_c.label"), F.coalesce("features", F.array().cast("array<string>")), F.col("topology_class"), F.col("aromatic_ring_count"), F.col("ring_count")),
    }).drop("_c")
    gate = rules.compatibility_gate(F.array_join(F.coalesce("alerts", F.array().cast("array<string>")), "; "), F.lit(None).cast("string"), F.col("chemical_class"), F.col("formal_charge"), F.col("smiles"), F.col("ring_count"), F.col("si_atoms"), F.col("si_ring_units"))
    return Result(out.withColumn("gate", gate))


def core(df: DataFrame, cutoff: float = 0.60) -> Result:
    """Clusters, applicability domain, uncertainty."""
    made = df.where(F.col("bits").isNotNull()).withColumn("family", F.col("gate.family"))
    x = layers.sides()
    parts = made.select(F.col("src_pos").alias("k"), F.col("features").alias("f"), "mw", "logp", "tpsa", F.coalesce("amide_units", F.lit(0)).alias("am"))

    def bad(similar: DataFrame) -> DataFrame:
        """Of the similar pairs, those that a gate keeps apart."""
        side = lambda s: parts.select(F.col("k").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("f", "mw", "logp", "tpsa", "am")])
        both = similar.join(side("i"), "i").join(side("j"), "j")
        return both.where(rules.pair_gate(x("am"), x("f"), x("mw"), x("logp"), x("tpsa")).isNotNull()).select("i", "j")

    grouped = cluster.gated_clusters(made, "src_pos", "smiles", "family", "bits", "src_pos", cutoff, bad)
    ids = grouped.select("src_pos", "cluster_id", "family_id", "cluster_size", "unique_count", "duplicate_count")
    full = df.join(ids, "src_pos", "left")
    dom = evidence.domain_status(full, "src_pos", "cluster_id", "bits", "scaffold", ["mw", "logp", "tpsa", "ring_count"], F.col("toxicophores"), F.col("ionisation"), F.col("identity_status")).drop("cluster_id")
    out = full.join(dom, "src_pos", "left")
    rec = evidence.uncertainty(
        F.col("identity_status"), F.when(F.col("bits").isNotNull(), F.lit("Calculated")), F.array_join(F.coalesce("alerts", F.array().cast("array<string>")), "; "),
        F.array_join(F.coalesce("toxicophores", F.array().cast("array<string>")), "; "), F.col("property_outlier_flags"), F.array_compact(F.array(F.when(F.col("conc").isNotNull(), F.lit("conc")))), F.col("domain_status"),
    )
    out = out.withColumns({"uncertainty": rec, "uncertainty_summary": evidence.uncertainty_summary(rec)})
    long = out.select(F.coalesce("cluster_id", F.lit("Unassigned")).alias("cluster_id"), F.explode("uncertainty").alias("r")).select("cluster_id", "r.*")
    return Result(out, {"uncertainty_register": evidence.severity_rollup(long, "cluster_id")})


def matrix_view(df: DataFrame) -> DataFrame:
    """The rows under the names that a cluster's matrix reads."""
    texts = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    names = {
        "Cluster ID": "cluster_id", "Scaffold": "scaffold", "Domain_Status": "domain_status", "Domain_Reasons": "domain_reasons", "Identity Status": "identity_status", "Property_Outlier_Flags": "property_outlier_flags",
        "MW": "mw", "LogP": "logp", "TPSA": "tpsa", "Formal_Charge": "formal_charge", "Ring_Count": "ring_count", "Aromatic_Ring_Count": "aromatic_ring_count", "InChIKey": "inchikey", "CASRN": "casrn",
        "Cluster_Status": "cluster_status", "Decision": "decision", "Toxicophore_Profile": "toxicophores", "All_Structural_Alerts": "alerts",
    }
    lists = {c for c, t in df.dtypes if t == "array<string>"}
    return df.select(*[(texts(F.col(c)) if c in lists else F.col(c)).alias(n) for n, c in names.items() if c in df.columns])


def register_rows(df: DataFrame) -> DataFrame:
    """The uncertainty register of the clusters: scope, category, level, reason, action and fields of each."""
    long = df.where(F.col("cluster_id").isNotNull()).select("cluster_id", F.explode("uncertainty").alias("r")).select("cluster_id", "r.*")
    up = evidence.severity_rollup(long, "cluster_id")
    return up.select(
        F.lit("Cluster").alias("Scope"), F.col("cluster_id").alias("Scope_ID"), F.col("category").alias("Category"), F.col("level").alias("Level"), F.col("reason").alias("Reason"),
        F.col("action").alias("Required_Action"), F.lit("Uncertainty register").alias("Evidence_Fields"), F.col("place").alias("Place"),
    )


def optional(df: DataFrame, records: DataFrame | None = None) -> Result:
    """The whole evidence matrix of the clusters, with the register and, where a ledger is given, its rows of the
    members; its hash; and those rows."""
    clustered = df.where(F.col("cluster_id").isNotNull())
    matrix = evidence.cluster_matrix(matrix_view(clustered), register_rows(df).drop("Place"), records)
    side = {"evidence_matrix": matrix, "matrix_hash": evidence.cluster_matrix_hash(matrix), "register": register_order(register_rows(df))}
    if records is not None:
        side["ledger"] = ledger.for_identities(records, df, ["inchikey", "casrn"])
    return Result(df, side)


def register_order(register: DataFrame) -> DataFrame:
    """Rows of a register as they are written: by category, level (as a word) and reason."""
    return register.orderBy("Category", "Level", "Reason", "Scope_ID").drop("Place")


def export(df: DataFrame, contract: list[str], required: list[str] = ()) -> Result:
    """The contract's columns in the workbook's order; refuses what the release gate rejects."""
    if errors := tables.release_errors(df, list(required), [], "identity_status", "decision"):
        raise ValueError(f"export blocked: {errors}")
    ordered = df.orderBy(*tables.export_order("cluster_id", "family_id", "cluster_size", "name"))
    return Result(tables.apply_contract(ordered, contract))


def preserved(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> bool:
    """Whether a stage left these columns alone, row for row."""
    h = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, *columns).cast("decimal(38,0)")).alias("h")).first()
    return tuple(h(before)) == tuple(h(after))


STAGES = ("a", "b1a", "b1b", "b2")


def _exists(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def _sides(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """The side tables that a stage has written."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/side_{name}_*")
    found = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(here) or []
    return {f.getPath().getName().removeprefix(f"side_{name}_"): spark.read.parquet(f.getPath().toString()) for f in found}


def run(spark: SparkSession, df: DataFrame, path: str, upto: str = "all", contract: list[str] = ()) -> Result:
    """Stages up to ``upto``, each written under ``path`` and read again; stages that are already
    there are not repeated, and their side tables are read with them."""
    steps: dict[str, Callable[[DataFrame], Result]] = {"a": snapshot, "b1a": core, "b1b": optional, "b2": lambda d: export(d, list(contract) or d.columns)}
    out = Result(df)
    for name in STAGES:
        where = f"{path}/{name}"
        status = "kept"
        if not _exists(spark, where):
            made = steps[name](out.compounds)
            for k, s in made.side.items():
                s.write.mode("overwrite").parquet(f"{path}/side_{name}_{k}")
            made.compounds.write.mode("overwrite").parquet(where)
            status = "complete"
        now = spark.read.parquet(where)
        out = Result(now, {**out.side, **_sides(spark, path, name)}, [*out.trace, {"step": name, "status": status, "rows": now.count(), "columns": len(now.columns), "has_cluster_id": "cluster_id" in now.columns}])
        if name == stage_name(upto):
            break
    return out


def resume(spark: SparkSession, path: str) -> Result | None:
    """What the run under ``path`` has reached, without computing anything; None if it has finished no stage."""
    out = None
    for name in STAGES:
        if not _exists(spark, f"{path}/{name}"):
            break
        out = Result(spark.read.parquet(f"{path}/{name}"), {**(out.side if out else {}), **_sides(spark, path, name)}, [*(out.trace if out else []), {"step": name, "status": "kept"}])
    return out


def assess(df: DataFrame) -> DataFrame:
    """Rows taken one by one: their own classification, and a preview where a batch would show its clusters."""
    nearest = F.col("nearest_similarity") * 100 if "nearest_similarity" in df.columns else F.lit(None).cast("double")
    return snapshot(df).compounds.withColumn("preview", views.single_preview(nearest, F.col("scaffold")))


def assess_batch(spark: SparkSession, df: DataFrame, path: str, contract: list[str] = ()) -> Result:
    """All stages of a batch: its rows in the workbook's order, and the side tables."""
    return run(spark, df, path, "all", contract)


def trace_rows(spark: SparkSession, result: Result) -> DataFrame:
    """(place, step, status, rows, columns, has_cluster_id): what each stage did."""
    rows = [(i, x["step"], x["status"], x.get("rows"), x.get("columns"), x.get("has_cluster_id")) for i, x in enumerate(result.trace, 1)]
    return spark.createDataFrame(rows, "place int, step string, status string, rows long, columns int, has_cluster_id boolean")
