"""Intermediate tables in the folder that the driver and all executors share.

Iterative plans cut their lineage here.  A written table survives the loss of
an executor, which a local checkpoint does not.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset, a temporary folder, on a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="terrane-")
    return _own[app]


def materialise(df: DataFrame, name: str = "t", release: bool = False, observe: dict[str, Column] | None = None) -> DataFrame:
    """Write `df` to the shared folder and return the table read back.

    `observe`: aggregates to compute while writing, found in the result's `observed`.
    `release` asks the driver to collect its garbage afterwards, so that Spark
    deletes the shuffle files of the finished step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}/{name}"
    seen = Observation() if observe else None
    (df.observe(seen, *[c.alias(k) for k, c in observe.items()]) if seen else df).write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at, out.observed = path, seen.get if seen else {}
    if release:
        del df
        for _ in range(3):  # the last listeners may still hold the finished step
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.4)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p.rsplit("/", 1)[0])
        path.getFileSystem(conf).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `materialise` returned and that nothing still to run reads."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        written = _written.get(t.sparkSession.sparkContext.applicationId, [])
        if path in written:
            written.remove(path)
            _delete(t.sparkSession, [path])


def drop_written(spark: SparkSession) -> int:
    """Delete every table that this application has written here; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
