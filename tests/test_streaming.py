"""Streams: keyed state and the log of changes, over files in two batches."""

import time

from pyspark.sql import functions as F

from gneiss.streaming import events

from .conftest import DATA


def test_keyed_state_and_sink(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    src = tmp_path / "in"
    for i in range(2):
        table.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(f"file://{src}")
    live = events.latest_state(events.read(spark, f"file://{src}", maxFilesPerTrigger="1"))
    q = events.upsert_log(live, f"file://{tmp_path}/out", str(tmp_path / "c")).start()
    end = time.time() + 90
    while time.time() < end and sum(p["numInputRows"] for p in q.recentProgress) < table.count():
        time.sleep(0.5)  # a query with timeouts runs on without data
    q.stop()
    out = events.current(spark, f"file://{tmp_path}/out", "user_id")
    last = {r.user_id: r for r in out.collect()}
    assert out.count() == len(last)
    want = {r.user_id: (r.n, r.kinds) for r in table.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds")).collect()}
    assert {k: (r.n, len(r.stages)) for k, r in last.items()} == want


def test_sessions_over_a_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    assert events.sessions(table).agg(F.sum("n")).first()[0] == table.count()
    assert events.windows(table, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * table.count()
