"""Event streams: windows with watermarks, sessions, and keyed state with a time to live."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark, path: str, schema: str = EVENTS, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by window and type; the same for a table and for a stream."""
    marked = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count of events by user and session, which ends after ``gap`` without one."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def latest_state(events: DataFrame, key: str = "user_id", ttl_ms: int = 4 * 3600 * 1000) -> DataFrame:
    """Per key, kept in state for ``ttl_ms`` after its last event: number of events, last type, and
    the stages (types) seen, in the order first seen."""

    def step(k, batches, state: GroupState):
        n, last, last_ts, stages = state.get if state.exists else (0, "", pd.Timestamp(0), [])
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            for ts, kind in pdf.sort_values(["ts", "event_id"])[["ts", "event_type"]].itertuples(index=False, name=None):
                n, stages = n + 1, [*stages, *([kind] if kind not in stages else [])]
                if ts >= last_ts:
                    last, last_ts = kind, ts
        state.update((n, last, last_ts, stages))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "last_type": [last], "stages": [stages]})

    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} long, n long, last_type string, stages array<string>", "n long, last string, last_ts timestamp, stages array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def upsert_log(stream: DataFrame, path: str, checkpoint: str):
    """A query that logs each batch of changed rows in ``path`` under its own number, so that a repeated batch
    replaces itself. ``current`` reads the latest row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def current(spark, path: str, key: str) -> DataFrame:
    """Of a log of changes the latest row of each key, by an aggregate that combines before the exchange."""
    log = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
