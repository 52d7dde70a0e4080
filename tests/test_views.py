"""Views, labels and matrices beyond what the queries show."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.operators import chemistry, evidence, ledger, views


def test_positions_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 1001, f"r{i}") for i in range(1001)], "k long, v string").unionByName(spark.createDataFrame([(None, "none")], "k long, v string"))
    got = [(r.k, r.src_pos) for r in views.with_position(df, "k", parts=8).collect()]
    assert sorted(got, key=lambda x: x[1]) == [(None, 1), *[(i, i + 2) for i in range(1001)]]
    assert views.with_position(df.limit(0), "k").count() == 0


def test_a_mapping_for_another_class_is_an_error(spark):
    rows = spark.createDataFrame([("R-1", "Acid")], "rule string, label string")
    maps = spark.createDataFrame([("R-1", "Ester", None, "", "", "", "", "", "")], "rule_id string, local_class string, mapping_status string, " + ", ".join(f"`{c}` string" for c in views.ONTOLOGY))
    with pytest.raises(Exception, match="mismatch for R-1"):
        views.ontology_compatibility(rows, "rule", "label", maps, "1").collect()


def test_names_keep_their_first_place():
    assert views.ordered_unique(["b", "a"], ["c", "b"], []) == ["b", "a", "c"]
    assert len(views.FLAT) == 42 and len({x[0] for x in views.FLAT}) == 42


class Lengths:
    schema = "valid boolean, scaffold string"

    def describe(self, structures):
        return pd.DataFrame({"valid": structures.str.len() > 1, "scaffold": structures.str.lower()})


def test_a_backend_sees_each_structure_once(spark):
    df = spark.createDataFrame([(1, "CC"), (2, " CC"), (3, "C"), (4, ""), (5, None)], "id int, s string")
    out = {r.id: r for r in chemistry.described(df, "s", Lengths, Lengths.schema).select("id", "found", chemistry.scaffold_label(F.coalesce("found.valid", F.lit(False)), F.col("found.scaffold"), single=True).alias("l")).collect()}
    assert out[1].found == out[2].found and out[1].l == "cc" and out[3].l == "Not available" and out[4].found is None and out[5].l == "Not available"


def test_canonical_hashes(spark):
    """Those of the same rows as sorted JSON without blanks."""
    rec = {c: "" for c in ledger.FIELDS} | {"identity_key": "Ä \"q\"", "compound_mapping_method": "CASRN", "endpoint": "Genotoxicity", "result": "Positive", "study_type": "In vivo", "species": "Rat", "route": "Oral", "source": "s/\\", "source_record": "1", "source_url": "http://x.example", "reliability": "Not assignable", "evidence_status": "Retrieved", "reviewer_status": "Not reviewed"}
    got = ledger.validate(spark.createDataFrame([tuple(rec.values())], ", ".join(f"{c} string" for c in rec)), ledger.VOCABULARIES).first()
    want = hashlib.sha256(json.dumps(rec, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got.raw_record_hash == want and not got.errors and len(ledger.EXPORT) == 25
    rows = spark.createDataFrame([("c1", "a  b", "Inside", 1.5), ("c1", "é", "Inside", 2.0), (None, "x", "Outside", None), ("Unclustered", "y", "Inside", 1.0)], "`Cluster ID` string, Scaffold string, Domain_Status string, MW double")
    m = evidence.cluster_matrix(rows)
    lines = sorted((r.asDict() for r in m.collect()), key=lambda r: [r[c] for c in evidence.MATRIX_ORDER])
    assert {r["Cluster_ID"] for r in lines} == {"c1", "Unassigned"} and [r["Evidence_Text"] for r in lines if r["Evidence_Type"] == "Scaffold"] == ["x", "a b; é"]
    assert [r["Evidence_Text"] for r in lines if r["Cluster_ID"] == "c1" and r["Evidence_Domain"] == "Physicochemical"] == ["MW=1.50-2.00"]
    for r in evidence.cluster_matrix_hash(m).collect():
        mine = [x for x in lines if x["Cluster_ID"] == r.cluster_id]
        assert r.matrix_hash == hashlib.sha256(json.dumps(mine, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
