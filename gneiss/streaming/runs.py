"""Runs as a stream: which stages each has finished, kept in state for a time, and progress of queries as lines of JSON.

``stages`` keeps a map from stage to what it reported for each run, every entry with a time to live of its own, so that a run that nobody
goes on with is forgotten stage by stage, and its state with the last one. ``ProgressLog`` is a listener that writes the
progress of each batch of a query into a folder of a shared store; ``progress`` reads it back.

Defined cases: events of a run in one batch count in order of time, then of stage; an event that repeats a stage renews it, in its old place,
while it is held; null run ids and stages are left out; nulls are written as empty texts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "run_id string, ts timestamp, stage string, status string, n_rows long"
STAGES = "run_id string, stages array<string>, statuses array<string>, n_rows long, last_stage string"
#: Four hours, as long as a run may rest between two stages.
TTL_MS = 4 * 3600 * 1000
_STATE = "stages array<string>, statuses array<string>, n_rows array<long>, until array<long>"


def stages(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of ``EVENTS`` to ``STAGES``: of each run that a batch has events of, the stages that are still held, in the order in
    which they were first reported. A timer at the next entry's end lets go of those that nobody renews."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {s: (a, n, u) for s, a, n, u in zip(*state.get, strict=True) if u > now} if state.exists else {}
        last = None
        if not state.hasTimedOut:
            for stage, status, n in pd.concat(list(batches)).sort_values(["ts", "stage"])[["stage", "status", "n_rows"]].itertuples(index=False, name=None):
                held[stage] = (status or "", 0 if pd.isna(n) else int(n), now + ttl_ms)
                last = stage
        if held:
            state.update(tuple(list(c) for c in zip(*((s, *v) for s, v in held.items()), strict=True)))
            state.setTimeoutDuration(max(1, min(u for *_, u in held.values()) - now))
        elif state.exists:
            state.remove()
        if last is not None:
            yield pd.DataFrame({"run_id": [key[0]], "stages": [list(held)], "statuses": [[v[0] for v in held.values()]], "n_rows": [sum(v[1] for v in held.values())], "last_stage": [last]})

    known = events.where("run_id IS NOT NULL AND stage IS NOT NULL")
    return known.groupBy("run_id").applyInPandasWithState(step, STAGES, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


# ---- lines of JSON ----


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with all of its fields; nulls, and numbers that aren't any, are empty texts."""
    clean = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})  # {"v":...}
        value = F.substring(text, F.lit(6), F.length(text) - 6)
        clean.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), F.when(c.isNull(), F.lit('""')).otherwise(value)))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *clean), F.lit("}")).alias("value"))


class ProgressLog(StreamingQueryListener):
    """Writes a line for each batch of the session's queries into ``folder``: its own file each, so that writers never meet, whole when
    it has its name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder

    def _put(self, row: dict) -> None:
        name = f"{self.folder}/{row['kind']}-{uuid.uuid4().hex}"
        part, whole = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{uuid.uuid4().hex}"), self.jvm.org.apache.hadoop.fs.Path(f"{name}.json")
        fs = whole.getFileSystem(self.conf)
        out = fs.create(part, True)
        out.write(bytearray((json.dumps(row, ensure_ascii=False) + "\n").encode()))
        out.close()
        fs.rename(part, whole)

    def onQueryStarted(self, event) -> None:
        self._put({"kind": "started", "query": str(event.id), "run": str(event.runId), "name": event.name or "", "at": event.timestamp, "batch": -1, "n_in": 0, "n_state": 0, "ms": 0, "error": ""})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put({
            "kind": "progress", "query": str(p.id), "run": str(p.runId), "name": p.name or "", "at": p.timestamp, "batch": p.batchId, "n_in": p.numInputRows,
            "n_state": sum(s.numRowsTotal for s in p.stateOperators), "ms": p.batchDuration, "error": "",
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put({"kind": "ended", "query": str(event.id), "run": str(event.runId), "name": "", "at": "", "batch": -1, "n_in": 0, "n_state": 0, "ms": 0, "error": event.exception or ""})


PROGRESS = "kind string, query string, run string, name string, at string, batch long, n_in long, n_state long, ms long, error string"


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a ``ProgressLog``, of a folder that may still be written to."""
    return spark.read.schema(PROGRESS).json(folder)
