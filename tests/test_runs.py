"""Stages of runs in state with a time to live, lines of JSON, and the log of progress."""

import json
import time

from pyspark.sql import functions as F

from gneiss.streaming import runs


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "run_id string, at string, stage string, status string, n_rows long")
    df.select("run_id", F.col("at").cast("timestamp").alias("ts"), "stage", "status", "n_rows").coalesce(1).write.mode("append").parquet(f"file://{folder}")


def test_stages_are_kept_and_forgotten(spark, tmp_path):
    """State goes on over batches and restarts; entries that nobody renews expire, others don't."""
    src, out = tmp_path / "in", []

    def step():
        log = runs.ProgressLog(spark, f"file://{tmp_path}/log")
        spark.streams.addListener(log)
        live = spark.readStream.schema(runs.EVENTS).parquet(f"file://{src}")
        took = []
        q = runs.stages(live, ttl_ms=25_000).writeStream.queryName("runs").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: took.extend(b.collect())).start()
        end = time.time() + 60
        while time.time() < end and not took:
            time.sleep(0.2)  # a query with timers runs on without data
        q.stop()
        spark.streams.removeListener(log)
        out.append({r.run_id: r for r in took})

    put(spark, src, [("a", "2024-01-01 00:00:02", "core", "complete", 5), ("a", "2024-01-01 00:00:01", "snapshot", "complete", 7), ("b", "2024-01-01 00:00:00", "snapshot", "kept", None), (None, "2024-01-01 00:00:00", "x", "", 1), ("b", "2024-01-01 00:00:00", None, "", 1)])
    step()
    assert out[0]["a"].stages == ["snapshot", "core"] and out[0]["a"].n_rows == 12 and out[0]["a"].last_stage == "core" and out[0]["b"].statuses == ["kept"] and set(out[0]) == {"a", "b"}
    put(spark, src, [("a", "2024-01-01 00:01:00", "snapshot", "again", 1)])
    step()
    assert out[1]["a"].stages == ["snapshot", "core"] and out[1]["a"].statuses == ["again", "complete"] and set(out[1]) == {"a"}
    time.sleep(26)
    put(spark, src, [("a", "2024-01-01 00:02:00", "export", "complete", 2)])
    step()
    assert out[2]["a"].stages == ["export"] and out[2]["a"].n_rows == 2
    time.sleep(2)
    rows = runs.progress(spark, f"file://{tmp_path}/log").collect()
    assert sum(r.n_in for r in rows) == 7 and {r.kind for r in rows} >= {"started", "progress"} and max(r.n_state for r in rows) > 0


def test_lines_of_json(spark):
    df = spark.createDataFrame([(1, "a\"b\n", 1.5, [1, None], None), (None, None, float("nan"), None, {"k": None})], "n int, `t x` string, d double, l array<int>, m map<string,string>")
    got = [json.loads(r.value) for r in runs.json_lines(df).collect()]
    assert got == [{"n": 1, "t x": "a\"b\n", "d": 1.5, "l": [1, None], "m": ""}, {"n": "", "t x": "", "d": "", "l": "", "m": {"k": None}}]
