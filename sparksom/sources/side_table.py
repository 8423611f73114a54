"""Columns of a side table appended to the rows of a table, by key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import lookup_join


def append_side_table(df: DataFrame, side: DataFrame, on: list[str], salt_by: str | None = None, suffix: str = "_side") -> DataFrame:
    """All rows of ``df`` with the columns of ``side``'s row of the same key.

    A DataFrame has no positions, so the tables are matched by ``on``. A key that ``side``
    has several times counts with its smallest row (columns in their order, null first); a
    key that it lacks, or a null one, gives nulls. Columns of ``side`` that ``df`` has as well
    get ``suffix``. The side table is broadcast up to the bound of :func:`lookup_join`;
    beyond it, hot keys of ``df`` are spread by ``salt_by``.
    """
    others = [c for c in side.columns if c not in on]
    one = side.groupBy(*on).agg(F.min(F.struct(*others)).alias("__side")).select(
        *on, *[F.col("__side")[c].alias(c + suffix if c in df.columns else c) for c in others])
    return lookup_join(df, one, on, "left", salt_by=salt_by)
