"""Ordered access within sequences, whatever their length.

A window over a whole sequence would sort it in one task. Here the order is cut into
buckets of fixed width: a window spans one bucket at most, and one row per bucket tells
the first event of the next bucket what came before it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans import lookup_join, materialize

BUCKET = 1 << 16


def with_previous(df: DataFrame, sequence: list[str], order: str, columns: list[str], bucket_width: int = BUCKET) -> DataFrame:
    """``df`` with ``prev_<column>`` of the event before, by the integer ``order`` (unique
    within a sequence); null for a sequence's first event and for rows without an order.

    The rows are written once and read by both passes, so the plan behind them runs once."""
    bucket = F.floor(F.col(order).cast("bigint") / F.lit(bucket_width)).cast("bigint")
    rows = materialize(df.withColumn("__b", bucket), "sequences")
    state = F.struct(*[F.col(c).alias(c) for c in columns])
    inside = Window.partitionBy(*sequence, "__b").orderBy(order)
    local = rows.withColumn("__p", F.lag(state).over(inside))
    last = materialize(
        rows.groupBy(*sequence, "__b").agg(F.max_by(state, order).alias("__last"))
        .withColumn("__before", F.lag("__last").over(Window.partitionBy(*sequence).orderBy("__b")))
        .where("__before is not null").select(*sequence, "__b", "__before"), "sequence-buckets")
    joined = lookup_join(local, last, [*sequence, "__b"], "left")
    previous = F.when(F.col(order).isNotNull(), F.coalesce("__p", "__before"))
    return joined.withColumns({f"prev_{c}": previous[c] for c in columns}).drop("__b", "__p", "__before")
