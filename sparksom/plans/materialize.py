"""Cutting lineage with tables written to the cluster's shared folder.

A written Parquet table is preferred to ``DataFrame.checkpoint``: it is columnar (later
reads prune columns), it carries sizes that Catalyst and AQE can use, and it survives the
loss of any executor. Iterative operators write one table per round and release the
table of the round before.
"""
from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    ``spark.checkpoint.dir`` (or a folder given with ``setCheckpointDir``) is always
    used when there is one. Only a local-mode session without it, as in tests, gets a
    temporary folder; on a cluster a missing setting is an error, since a machine-local
    folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparksom-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table as read back; with ``by`` in
    one part per value of that column, which can be released one by one."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/sparksom/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path).select(df.columns)
    table._sparksom_path = path
    return table


def release(table: DataFrame | None, part: str | None = None) -> None:
    """Deletes a table that :func:`materialize` wrote and no plan needs any more, or its
    ``part`` (``column=value``)."""
    path = getattr(table, "_sparksom_path", None)
    if path and part and path in _written:
        delete(_written[path], f"{path}/{part}")
    elif path and path in _written:
        delete(_written.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, the tables written within: a query's own, once its result is out.

    ``with scope(): df = query(...); df.write.parquet(...)``
    """
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            delete(_written.pop(path), path)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_written.items()):
        try:
            delete(spark, path)
        except Exception:
            pass
    _written.clear()
