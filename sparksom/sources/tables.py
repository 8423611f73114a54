"""Parquet tables of a scale-factor folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import lookup_join, materialize


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, optionally projected; the projection reaches the scan's ReadSchema."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each record of ``classification_map`` once, with ``id`` and the named columns.

    A record may be delivered several times with equal values. Rows without an ``id``
    name no record and are left out. The hash aggregate combines on the map side, so
    an ``id`` delivered very often is one row per map task in the shuffle.
    """
    table = read_table(spark, sf_dir, "classification_map", "id", *columns)
    return table.where("id is not null").dropDuplicates(["id"])


def records_in_place(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """As :func:`records`, without shuffling the named columns; for wide ones, such as vectors.

    Ids alone are counted first. Of an id delivered several times one row counts, that of
    the smallest hash of its place (file and row). Such ids and their places are a small
    table, broadcast up to the bound of :func:`lookup_join`; the scan drops other rows of theirs.
    """
    table = spark.read.parquet(f"{sf_dir}/classification_map.parquet").where("id is not null")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    counts = table.select("id", place.alias("place")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    several = materialize(counts.where("n > 1").select("id", F.col("place").alias("__kept")), "several-deliveries")
    rows = table.select("id", *columns, place.alias("__place"))
    marked = lookup_join(rows, several, ["id"], "left", salt_by="__place")
    return marked.where("__kept is null or __kept = __place").drop("__kept", "__place")
