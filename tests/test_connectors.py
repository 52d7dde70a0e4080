"""Chains of outside sources: order, caches of answers and of their lack, pace and deadline over several tasks."""

import time

import pytest
from pyspark.sql import functions as F

from gneiss.sources import connectors as c

NOW = "2024-06-10 12:00:00"
CACHE = "source string, key string, payload string, retrieved_at timestamp"


def cache_of(spark, *rows):
    df = spark.createDataFrame(rows, "source string, key string, payload string, at string")
    return df.select("source", "key", "payload", F.col("at").cast("timestamp").alias("retrieved_at"))


def first(k):
    if k == "breaks":
        raise OSError("down")
    return None if k in ("b", "none", "later") else f"first {k}"


def second(k):
    return f"second {k}" if k in ("b", "later") else None


def test_sources_in_order(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("none",), ("breaks",), ("held",), ("without",), ("old",), (None,)], "key string")
    cache = cache_of(spark, ("first", "held", "kept", "2024-06-01 00:00:00"), ("first", "held", "older", "2024-05-20 00:00:00"), ("first", "without", None, "2024-06-09 00:00:00"), ("first", "old", "too old", "2024-01-01 00:00:00"), ("second", "without", "from second", "2024-06-09 00:00:00"))
    chain = [c.Source("first", first, 0.0), c.Source("second", second, 0.0)]
    out, new = c.resolve(rows, "key", chain, cache, F.lit(NOW).cast("timestamp"))
    got = sorted((r.key or "", r.status, r.source, r.payload) for r in out.collect())
    assert got == sorted([
        ("", None, None, None), ("a", "OK", "first", "first a"), ("a", "OK", "first", "first a"), ("b", "OK", "second", "second b"), ("none", "Not found", None, None), ("breaks", "Unavailable: OSError", None, None),
        ("held", "OK", "first", "kept"), ("without", "OK", "second", "from second"), ("old", "OK", "first", "first old"),
    ], key=lambda r: r)
    added = {(r.source, r.key): r.payload for r in new.collect()}
    assert added == {("first", "a"): "first a", ("first", "b"): None, ("first", "none"): None, ("first", "old"): "first old", ("second", "b"): "second b", ("second", "none"): None, ("second", "breaks"): None}
    again, more = c.resolve(rows, "key", chain, cache.unionByName(new), F.lit(NOW).cast("timestamp"))
    assert sorted((r.key or "", r.status, r.source, r.payload) for r in again.collect()) == got
    assert more.isEmpty()


def test_pace_and_deadline_over_tasks(spark, tmp_path):
    """Together the tasks ask no more often than allowed, and none asks after the deadline."""
    log = str(tmp_path)

    def fetch(k):
        with open(f"{log}/{k}", "w") as f:
            f.write(str(time.time()))
        return k

    keys = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"))
    out = c.ask(keys, "key", fetch, interval=0.05, deadline=3.0, tasks=4).groupBy("status").count().collect()
    counts = {r.status: r["count"] for r in out}
    asked = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    assert counts["OK"] == len(asked) and counts.get("OK", 0) + counts.get(c.LATE, 0) == 200
    assert len(asked) <= 3.0 / 0.05 + 8 and all(b - a > 0.1 for a, b in zip(asked, asked[8:], strict=False))


def test_bucket():
    now = [0.0]
    pace, at = c.Pace(10.0, 3.0), []
    for _ in range(8):
        pace.wait(lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
        at.append(round(now[0], 6))
    assert at == [0, 0, 0, 0.1, 0.2, 0.3, 0.4, 0.5] and c.Pace(8.0, 4.0).share(4) == c.Pace(2.0, 1.0)


@pytest.mark.parametrize(("payload", "names", "want"), [('{"A": "", "b": " x "}', ("a", "B"), "x"), ('{"B": 1.5}', ("a", "b"), "1.5"), ("{}", ("a",), ""), (None, ("a",), ""), ('{"a": "1", "A": "2"}', ("A",), "1"), ("no json", ("a",), "")])
def test_fields_in_any_case(spark, payload, names, want):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(c.first_field(F.col("p"), *names)).first()[0] == want


def test_answers(spark):
    rows = [('[{"a": 1}, {"a": 2}]', 2), ('{"data": [1, 2, 3]}', 3), ('{"x": 1}', 1), (None, 0), ("text", 0)]
    df = spark.createDataFrame(rows, "p string, n int")
    assert all(r.got == r.n for r in df.select("n", F.size(c.records(F.col("p"), "results", "data")).alias("got")).collect())
    said = spark.createDataFrame([('{"PropertyTable": {"Properties": [{"CID": 7, "Title": "Ethanol", "SMILES": "CCO", "CanonicalSMILES": ""}]}}',), ("{}",)], "p string")
    one, none = said.select(c.identity_fields(F.col("p")).alias("x")).collect()
    assert (one.x.cid, one.x.name, one.x.smiles, one.x.inchi) == ("7", "Ethanol", "CCO", "") and none.x is None
    act = spark.createDataFrame([('{"molecules": [{"molecule_chembl_id": "M1", "max_phase": "4.0"}]}', '{"mechanisms": [{"target_chembl_id": "T2", "action_type": "INHIBITOR"}, {"target_chembl_id": "T1"}, {"target_chembl_id": "T1"}]}'), ('{"molecules": []}', None)], "m string, w string")
    a, b = act.select(c.bioactivity_fields(F.col("m"), F.col("w")).alias("x")).collect()
    assert (a.x.max_phase, a.x.targets) == (4.0, "T1 (Unknown Action), T2 (INHIBITOR)") and (b.x.max_phase, b.x.targets) == (None, "None")
    names = spark.createDataFrame([("ethanol", "Ethanol absolute"), ("x", "Ethanol"), ("", "a")], "a string, f string").select(c.identity_status(F.col("a"), F.col("f")).alias("s")).collect()
    assert [r.s for r in names] == ["Exact Match", "Partial Match", "Partial Match"]
