"""Records of clusters, membership in words, rule files, the local cache and the run's trace."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss.operators import pairs, summary
from gneiss.plans import pipeline, policies
from gneiss.sources import connectors


def test_a_cluster_with_few_columns(spark):
    df = spark.createDataFrame(
        [(3, "Cluster_001", "nan", "CC"), (1, "Cluster_001", " ", None), (2, "Cluster_001", "x", "CC"), (4, "Cluster_002", "y", None), (5, "Loose", "z", "C"), (6, None, "z", "C")],
        "src_pos long, `Cluster ID` string, `Compound Name` string, `Standardized SMILES` string",
    )
    medoids = spark.createDataFrame([("Cluster_001", 2)], "cluster string, pos long")
    got = {r["Cluster ID"]: r.asDict() for r in summary.cluster_summary(df, medoids).collect()}
    assert set(got) == {"Cluster_001", "Cluster_002"} and list(got["Cluster_001"]) == list(summary.SUMMARY) and len(summary.SUMMARY) == 27
    one, two = got["Cluster_001"], got["Cluster_002"]
    assert (one["Source Row Count"], one["Unique Structure Count"], one["Duplicate or Alias Row Count"], one["Representative Compound"]) == (3, 2, 1, "x")
    assert (two["Representative Compound"], two["Representative Standardized SMILES"], two["Stability Assessment"]) == ("y", "Not assessable", "Not assessable: one unique structure")
    assert one["Scaffold Profile"] == "Not assessed" and one["Median Pairwise Tanimoto"] == "Not assessable" and one["Stability Assessment"].startswith("Borderline")
    assert summary.cluster_summary(df.limit(0), medoids).count() == 0


def test_lists_show_six_values_in_the_order_seen(spark):
    rows = [(i, "Cluster_1", f"n{i}", f"s{i % 2}", f"c{(9 - i) % 8}", f"r{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "src_pos long, `Cluster ID` string, `Compound Name` string, `Standardized SMILES` string, `Corrected Chemical Class` string, `Scaffold` string")
    got = summary.cluster_summary(df, spark.createDataFrame([], "cluster string, pos long")).first()
    assert got["Member Chemical Classes"] == "c1; c0; c7; c6; c5; c4; additional values present"
    assert got["Scaffold Profile"] == "r0; r1" and got["Representative Compound"] == "n0"


def test_membership_parameters_are_json(spark):
    odd = 'a "b" \\ {x}\n; é'
    df = spark.createDataFrame([(1, "Cluster_001", odd, "0.500"), (2, "Unclustered", odd, "0.500")], "k int, `Cluster ID` string, nearest_members string, nearest_similarity string")
    one, two = summary.membership(df, F.lit(True)).orderBy("k").collect()
    told = json.loads(one["Cluster_Membership_Parameters"])
    assert list(told) == sorted(told) and told["nearest_members"] == odd and told["cluster_size"] == "Not supplied" and len(told) == 14
    assert one["Cluster_Membership_Rationale"].startswith("Assigned to Cluster_001 by Compatibility-gated")
    assert two["Cluster_Reasoning_Status"] == "Not assessable" and two["Cluster_Membership_Parameters"] == "" and "domain status is Not assessable" in two["SME_Review_Boundary"]
    packet = summary.membership(df, F.lit(None).cast("boolean")).select(summary.reasoning_packet(df).alias("p")).first()["p"].asDict()
    assert list(packet) == list(summary.PACKET) and packet["CASRN"] == "Not supplied"


def test_the_first_failing_pair_is_told(spark):
    p = spark.createDataFrame([("a", 3, 1, None), ("a", 3, 2, "late"), ("a", 2, 1, "first"), ("b", 2, 1, None)], "block string, i int, j int, why string")
    assert [tuple(r) for r in summary.failing_pairs(p, F.col("why")).collect()] == [("a", "first")]


def test_signatures_of_several_blocks(spark):
    rows = [(i, "b" + str(i % 3), None if i % 5 == 0 else f"w{i % 4}", [f"x{i % 2}"], i * 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, block string, w string, xs array<string>, v double")
    differ = lambda x: (~x("w")[0].eqNullSafe(x("w")[1])).cast("int") + F.size(F.array_union(*x("xs")))
    got = {(r.block, r.i, r.j, r.t, r.v_i, r.v_j) for r in pairs.signature_pairs(df, "id", "block", ("w", "xs"), {"t": differ}, ("v",)).collect()}
    want = {(a[1], a[0], b[0], int(a[2] != b[2]) + len({*a[3], *b[3]}), a[4], b[4]) for a in rows for b in rows if a[1] == b[1] and a[0] > b[0]}
    assert got == want


def test_rule_files_that_lack_something(tmp_path):
    whole = dict.fromkeys(policies.TAXONOMY_SERVICE, "x") | {"allowed_identifier_columns": ["InChIKey"]}
    assert policies.taxonomy_service(whole).version == "x"
    with pytest.raises(ValueError, match="only InChIKey"):
        policies.taxonomy_service(whole | {"allowed_identifier_columns": ["InChIKey", "CASRN"]})
    for check in (policies.vocabularies, policies.hazard_service, policies.narrative, policies.taxonomy_service):
        with pytest.raises(ValueError, match="missing"):
            check({})
    assert policies.ontology(f"{tmp_path}/none.json").version == "unavailable"
    (tmp_path / "o.json").write_text('{"mappings": []}')
    with pytest.raises(ValueError, match="object"):
        policies.ontology(f"{tmp_path}/o.json")


def test_local_records(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cache_version": "1", "records": {"abc": {"kingdom": {"name": "K"}, "class": "C"}}}, indent=1))
    (got,) = connectors.local_records(spark, f"file://{tmp_path}/c.json").select("key", "cache_version", connectors.taxonomy_fields(F.col("payload")).alias("t")).collect()
    assert got["key"] == "ABC" and got["cache_version"] == "1" and got["t"]["kingdom"] == "K" and got["t"]["class"] == "C"
    assert connectors.local_records(spark, f"file://{tmp_path}/none.json").count() == 0
