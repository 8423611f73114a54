"""The N highest-scoring items of every group, by two-stage salted ranking."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_n_per_group(
    df: DataFrame,
    groups: list[str],
    score: str,
    item: str,
    n: int,
    salts: int = 32,
) -> DataFrame:
    """The ``n`` best items of each group, equal scores settled by the smaller ``item``.

    Each group is hashed by ``item`` into ``salts`` subgroups. Stage one ranks within
    (group, subgroup) and keeps ``n``; stage two ranks the at most ``n * salts``
    survivors of a group by score and identifier. Both stages keep a rank below a
    constant, so Spark also cuts each map task's rows before either shuffle, and a group
    with a third of all rows is sorted in ``salts`` tasks.

    An item delivered several times with equal values counts once: its deliveries fall
    in the same subgroup and share a dense rank there; one of them is kept. Rows with a
    null item, a null or NaN score or a null in a group column are in no ranking.
    Infinite scores rank as such; filter them before if they are not valid. A group with
    fewer than ``n`` items returns all; an empty table gives no rows. Returned columns:
    ``groups``, ``item``, ``score``, ``rank`` (from 1); others are ignored.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be positive")
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    for column in [*groups, item]:
        usable = usable & F.col(column).isNotNull()
    best_first = [F.col("__score").desc(), F.col("__item").asc()]
    keys = [f"__g{i}" for i in range(len(groups))]  # so that no name of the caller's is in the way
    rows = df.where(usable).select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)],
        F.col(item).alias("__item"),
        F.col(score).alias("__score"),
        F.pmod(F.xxhash64(item), F.lit(salts)).cast("int").alias("__salt"),
    )
    within = Window.partitionBy(*keys, "__salt").orderBy(*best_first)
    across = Window.partitionBy(*keys).orderBy(*best_first)
    survivors = rows.withColumn("__r", F.dense_rank().over(within)).where(F.col("__r") <= n)
    ranked = survivors.drop("__r", "__salt").withColumn("rank", F.dense_rank().over(across)).where(F.col("rank") <= n)
    return ranked.dropDuplicates([*keys, "__item"]).select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("__item").alias(item), F.col("__score").alias(score), "rank"
    )
