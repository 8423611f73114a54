"""Monthly index files: lines of ``year month value``, separated by blanks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``index_year, index_month, index_value``; lines that don't have three fields, and
    fields that are no numbers, are null. Any number of files, read in parallel."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.get(fields, F.lit(0)).try_cast("int").alias("index_year"), F.get(fields, F.lit(1)).try_cast("int").alias("index_month"),
        F.get(fields, F.lit(2)).try_cast("double").alias("index_value"))


def write_index(df: DataFrame, path: str, year: str = "index_year", month: str = "index_month", value: str = "index_value") -> None:
    """Writes lines of ``year month value`` (four places), in order of time; rows that lack
    one of them are left out. A series is a few thousand months, so it is one file."""
    whole = df.where(F.col(year).isNotNull() & F.col(month).isNotNull() & F.col(value).isNotNull())
    line = F.format_string(" %4d %4d %9.4f", F.col(year), F.col(month), F.col(value).cast("double"))
    whole.coalesce(1).sortWithinPartitions(year, month).select(line.alias("value")).write.mode("overwrite").text(path)
