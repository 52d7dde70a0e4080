"""Tables written on the way: where they live, and how they go.

Lineage is cut by writing a table into the folder that ``spark.checkpoint.dir``
names; the cluster shares that folder between the driver and all executors, so
a lost executor loses nothing. Only where the setting is absent (tests, a bare
local session) a temporary folder is chosen.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A URI of the folder that the driver and all executors can read and write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="gneiss-shared-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gneiss/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    for seen in _scratch:
        seen.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[str]):
    """Deletes at its end the tables that were materialized inside, but for those whose paths the
    caller has put into ``keep`` because a lazy result still reads them."""
    _scratch.append(seen := [])
    try:
        yield
    finally:
        _scratch.pop()
        for path in seen:
            if path not in keep:
                forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no lazy result reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
