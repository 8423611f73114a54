"""Equi-joins against a key table whose size is checked before it is broadcast."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key table is broadcast up to this many rows (a few narrow columns: some 100 MB at most).
MAX_BROADCAST_ROWS = 1_000_000


def lookup_join(
    left: DataFrame,
    keys: DataFrame,
    on: list[str],
    how: str = "left_semi",
    salt_by: str | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 16,
) -> DataFrame:
    """Joins ``left`` with ``keys`` (unique by ``on``), whatever the skew of ``left``.

    The rows of ``keys`` are counted first, a count without columns (of a Parquet table
    only the footers are read).
    Up to ``max_broadcast_rows`` the table is broadcast and ``left`` is not shuffled at
    all. Beyond, both sides are shuffled; with ``salt_by`` (a column that varies within
    a key, such as the row's id) ``left`` is spread over ``salts`` parts of each key and
    ``keys`` is repeated once per part, so that no key, however hot, makes one long
    task. ``how`` is ``left_semi``, ``left_anti``, ``left`` or ``inner``; null keys match nothing.
    """
    if keys.count() <= max_broadcast_rows:
        return left.join(F.broadcast(keys), on, how)
    if salt_by is None:
        return left.join(keys, on, how)
    salt = "__salt"
    spread = left.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    repeated = keys.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, salt], how).drop(salt)
