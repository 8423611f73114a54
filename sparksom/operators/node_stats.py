"""Per-key statistics when a few keys hold most of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import materialize


def valid_measure(column: str | Column) -> Column:
    """The value where it is finite and not negative, else null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when((value >= 0) & (value < float("inf")), value)


def key_stats(df: DataFrame, keys: list[str], measure: str, time: str) -> DataFrame:
    """Row count, sum and mean of the valid ``measure``, first and last ``time`` per key.

    Every state (count, sum, min, max) is algebraic, so Spark's hash aggregate combines
    it inside each map task (spilling to a sorted run when its table fills) and only one
    compact partial row per key and map task is shuffled: a key with a third of all rows
    sends as many rows to its reducer as any key that appears in every map task.

    Null keys form a group of their own. ``measure`` counts where it is finite and not
    negative; ``n_valid`` says how often. A key without a valid measure has a null sum
    and mean. Further columns of ``df`` are ignored. An empty table gives no rows.
    """
    value = valid_measure(measure)
    return (
        df.select(*keys, value.alias("__v"), F.col(time).alias("__t"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.count("__v").alias("n_valid"),
            F.sum("__v").alias("sum_dist"),
            F.min("__t").alias("first_ts"),
            F.max("__t").alias("last_ts"),
        )
        .withColumn("mean_dist", F.try_divide("sum_dist", "n_valid"))
    )


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with their count.

    The counts, one row per key, are written once; the total is their sum, taken as a
    scalar subquery, so no row is shuffled or counted a second time.
    """
    counts = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records")), "key-counts")
    total = counts.select(F.sum("n_records").alias("total"))
    return counts.where(F.col("n_records") >= F.lit(share) * total.scalar())


def with_nodes(stats: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes, also those without any record, and the positions that are no node.

    ``nodes`` is unique by ``keys``. ``is_node`` is false for positions outside the map
    or with a null coordinate.
    """
    marked = nodes.select(*keys).withColumn("__node", F.lit(True))
    return (
        stats.join(marked, keys, "full_outer")
        .withColumn("is_node", F.coalesce("__node", F.lit(False)))
        .withColumn("n_records", F.coalesce("n_records", F.lit(0).cast("bigint")))
        .withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("bigint")))
        .drop("__node")
    )
