"""Documents' tables, connectors, policies, narrative helpers, the SMILES reader."""

import pytest
from pyspark.sql import functions as F

from gneiss.functions import smiles
from gneiss.operators import narrative
from gneiss.plans import policies
from gneiss.sources import connectors, documents


@pytest.mark.parametrize(("text", "heavy", "charge", "rings", "si", "units"), [
    ("CCO", 3, 0, 0, 0, 0), ("c1ccccc1", 6, 0, 1, 0, 0), ("C[N+](C)(C)C.[Cl-]", 6, 0, 0, 0, 0), ("C[Si]1(C)O[Si](C)(C)O[Si](C)(C)O[Si](C)(C)O1", 16, 0, 1, 4, 4),
    ("[O-]C(=O)c1ccccc1", 9, -1, 1, 0, 0), ("C1CC2CCC1CC2", 8, 0, 2, 0, 0), ("C%12CCCCC%12", 6, 0, 1, 0, 0), ("[Fe+2]", 1, 2, 0, 0, 0), ("ClCBr", 3, 0, 0, 0, 0),
])
def test_smiles(text, heavy, charge, rings, si, units):
    s = smiles.summary(text)
    assert (s["heavy_atoms"], s["formal_charge"], s["ring_count"], s["si_atoms"], s["si_ring_units"]) == (heavy, charge, rings, si, units)


@pytest.mark.parametrize("text", [None, "", "C1CC", "C(", "C)", "nope", "1C", "C[Xx"])
def test_no_smiles(text):
    assert smiles.summary(text) is None


def test_smiles_column(spark):
    df = spark.createDataFrame([("CC",), (None,), ("C(",)], "s string").select(smiles.smiles_summary(F.col("s")).alias("x")).select("x.*")
    assert [r.heavy_atoms for r in df.collect()] == [2, None, None]


def test_origins(spark):
    pages = spark.createDataFrame([(1, 1, "Report by WuXi"), (1, 2, "An exaggerated study"), (2, 1, "x"), (2, 4, "support@jordilabs.com"), (3, 1, None), (4, 1, "Eurofins exhaustive")], "doc int, page int, text string")
    assert {r.doc: (r.agency, r.study_type) for r in documents.origins(pages).collect()} == {1: ("Wuxi", "Exaggerated"), 2: ("Jordi", "Unknown"), 3: ("Unknown", "Unknown"), 4: ("Eurofins", "Unknown")}


def test_bordered_rows(spark):
    cells = [["Retention Time", "x", "y", "z"], ["SU 1", "", "", ""], ["Al", "1", "2", "3"], ["", "", "", ""], ["a", "b"]]
    df = spark.createDataFrame([(1, 1, i, c) for i, c in enumerate(cells)], "doc int, table int, row_no int, cells array<string>")
    out = documents.bordered_rows(df).orderBy("row_no").collect()
    assert [(r.row_no, r.configuration) for r in out] == [(2, "SU 1"), (4, "SU 1")]
    assert out[0].record["Element"] == "Al" and out[1].record == {"Col_0": "a", "Col_1": "b"}


def test_merged_rows(spark):
    rows = [["Cat", "50-00-0", "Name", "CH2O", "30", "1.5", "", "", "7", "S"], ["", "", "Other", "", "", "x", "2.5", "9", "", ""], ["Al", "none", "0.3"], ["", "", ""]]
    df = spark.createDataFrame([(1, 1 if len(c) > 5 else 2, i, c) for i, c in enumerate(rows)], "doc int, table int, row_no int, cells array<string>")
    out = {r.row_no: r.record for r in documents.merged_rows(df).collect()}
    assert out[1]["ID Category"] == "Cat" and out[1]["Compound"] == "Other" and out[1]["Retention Time (min)"] == "2.5" and out[1]["Concentration (ug/device)"] == "9" and out[1]["Surrogate Used"] == "S"
    assert out[2] == {"Element": "Al", "Est Conc (ug/device)": "0.3"} and 3 not in out


def test_connector(spark):
    def fetch(k):
        if k == "bad":
            raise OSError("down")
        return None if k == "none" else '{"kingdom": {"name": "K"}, "substituents": [{"name": "b"}, "a"]}'

    rows = spark.createDataFrame([("old",), ("new",), ("bad",), ("none",), (None,)], "key string")
    cache = spark.createDataFrame([("old", "{}", "2024-01-09"), ("new", "{}", "2023-01-01")], "key string, payload string, at string").select("key", "payload", F.to_timestamp("at").alias("retrieved_at"))
    out, new = connectors.enrich(rows, "key", cache, fetch, F.to_timestamp(F.lit("2024-01-10")), 30, interval=0)
    got = {r.key: r.status for r in out.collect()}
    assert got == {"old": "OK", "new": "OK", "bad": "Unavailable: OSError", "none": "Not found", None: None}
    fields = new.select(connectors.taxonomy_fields(F.col("payload")).alias("x")).first().x
    assert fields.kingdom == "K" and fields.substituents == "a; b"
    late = connectors.ask(rows, "key", fetch, interval=0, deadline=-1).collect()
    assert {r.status for r in late} == {"Unavailable: StageDeadlineExceeded"}


def test_policies():
    good = {"mode": "review_only", "rule_version": "1", "distance_components": [{"weight": 0.4}, {"weight": 0.6}]}
    assert policies.distance_policy(good).version == "1"
    for bad in ({**good, "mode": "x"}, {**good, "rule_version": ""}, {**good, "distance_components": [{"weight": 0.4}]}, {**good, "distance_components": [{"weight": -1}, {"weight": 2}]}):
        with pytest.raises(ValueError):
            policies.distance_policy(bad)
    with pytest.raises(ValueError):
        policies.domain_policy({**good, "descriptor_outlier_method": "z"})
    with pytest.raises(ValueError):
        policies.uncertainty_policy({**good, "categories": ["Identity"]})
    off = policies.all_or_none({"a": (policies.distance_policy, good), "b": (policies.class_policy, good)})
    assert off["a"].version == "1" and off["b"] is None


def test_narrative(spark):
    assert narrative.flatten_metadata({"a": {"b": [1, {"c": None}], "d": []}}) == [("a.b[0]", 1), ("a.b[1].c", ""), ("a.d", "")]
    r = spark.range(1).select(narrative.member_text(F.lit(""), F.lit("p"), F.lit(None).cast("string")), narrative.letters(F.lit(0)), narrative.letters(F.lit(25)), narrative.letters(F.lit(26)), narrative.letters(F.lit(702))).first()
    assert r[0].startswith("Cluster membership rationale:\nDeterministic") and tuple(r[1:]) == ("A", "Z", "AA", "AAA")
    df = spark.createDataFrame([("g", 1, "c", "x"), ("g", 2, "c", "y")], "g string, o int, c string, v string")
    a = narrative.packets(df, "g", "c", "c", "c", ["v"], "o").first()
    b = narrative.packets(df.orderBy(F.desc("o")), "g", "c", "c", "c", ["v"], "o").first()
    assert a == b and a.member_count == 2
    assert narrative.renamed(df, {"v": "w", "zz": "q"}).columns == ["w"]
