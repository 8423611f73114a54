"""Runs of near-identical consecutive events, collapsed by pointer doubling.

Shape of the plan. A sequence may be long (one may hold a third of all rows), so no
window ever spans a whole sequence: the order is cut into buckets of fixed width, a
bucket holds at most that many events, and one summary row per bucket carries what the
neighbouring buckets need. Every event that matches its predecessor then points to it,
and self-joins on (sequence, position) replace pointers by pointers' pointers.

Only the last event of a run must learn its start, so after round k the events kept are
the run ends and those at positions divisible by 2^k (the others point to nothing that
is still needed): the joined rows halve from round to round, and all rounds together
cost about as much as two full self-joins. There are log2(longest run) rounds.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import lookup_join, materialize, release

Similar = Callable[[Column, Column], Column]


def identical(before: Column, now: Column) -> Column:
    """Events are one run where their whole states are equal (null equals null)."""
    return before.eqNullSafe(now)


def collapse_runs(
    df: DataFrame,
    sequence: str,
    order: str,
    item: str,
    time: str,
    state: list[str],
    similar: Similar = identical,
    min_records: int = 1,
    bucket_width: int = 1 << 16,
) -> DataFrame:
    """One row per run: ``sequence, first_id, last_id, n_records, first_ts, last_ts, duration_s``.

    ``df`` has each event once. Within ``sequence`` the events follow each other by
    ``order`` (integers, gaps do not matter; of several events with one ``order`` value
    the smaller ``item`` comes first). An event belongs to the run of the event before
    it where ``similar(before, now)`` is true for the structs of their ``state``
    columns; null counts as false. Runs are as long as possible; those of fewer than
    ``min_records`` events are left out.

    ``duration_s`` is the last minus the first time: negative where a clock stepped
    back, null where either time is null. Events with a null ``sequence`` or ``order``
    have no place in any sequence and belong to no run. An empty table gives no rows.
    """
    spark = df.sparkSession
    events = (
        df.where(F.col(sequence).isNotNull() & F.col(order).isNotNull())
        .select(
            F.col(sequence).alias("s"),
            F.col(order).cast("bigint").alias("o"),
            F.col(item).alias("id"),
            F.col(time).alias("t"),
            F.struct(*[F.col(c) for c in state]).alias("st"),
        )
        .withColumn("b", F.floor(F.col("o") / F.lit(bucket_width)).cast("bigint"))
    )
    w = Window.partitionBy("s", "b").orderBy("o", "id")
    is_true = lambda c: F.coalesce(c, F.lit(False))
    local = (
        events.withColumn("rn", F.row_number().over(w).cast("bigint"))
        .withColumn("before", F.lag(F.struct("id", "t", "st")).over(w))
        .withColumn("after", F.lead("st").over(w))
        .withColumn("link", F.when(F.col("before").isNotNull(), is_true(similar(F.col("before.st"), F.col("st")))))
        .withColumn("nlink", F.when(F.col("after").isNotNull(), is_true(similar(F.col("st"), F.col("after")))))
        .withColumn("plink", F.lag("link").over(w))
        .withColumn("edge", F.col("before").isNull() | F.col("after").isNull())
        .select("s", "b", "rn", "id", "t", "link", "nlink", "plink",
                F.col("before.id").alias("pid"), F.col("before.t").alias("pt"),
                F.when(F.col("edge"), F.col("st")).alias("st"), "edge")
    )
    rows = materialize(local, "run-rows")

    # One row per bucket: what its first and last event must know of other buckets.
    along = Window.partitionBy("s").orderBy("b")
    buckets = (
        rows.where("edge").groupBy("s", "b").agg(
            F.max("rn").alias("n"),
            F.min_by("st", "rn").alias("first_st"),
            F.max_by(F.struct("id", "t", "st", "link"), "rn").alias("last"),
        )
        .withColumn("offset", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
        .withColumn("prev", F.lag(F.struct("n", "last")).over(along))
        .withColumn("next_st", F.lead("first_st").over(along))
        .withColumn("b_link", is_true(similar(F.col("prev.last.st"), F.col("first_st"))) & F.col("prev").isNotNull())
        .withColumn("b_nlink", is_true(similar(F.col("last.st"), F.col("next_st"))) & F.col("next_st").isNotNull())
        .withColumn("b_plink", F.when(F.col("prev.n") > 1, F.col("prev.last.link")).otherwise(F.lag("b_link").over(along)))
        .select("s", "b", "offset", "b_link", "b_nlink", "b_plink",
                F.col("prev.last.id").alias("b_pid"), F.col("prev.last.t").alias("b_pt"))
    )
    buckets = materialize(buckets, "run-buckets")

    first = F.col("rn") == 1
    placed = lookup_join(rows, buckets, ["s", "b"], "inner").select(
        "s",
        (F.col("offset") + F.col("rn")).alias("pos"),
        "id", "t",
        F.when(first, F.col("b_link")).otherwise(F.col("link")).alias("link"),
        F.coalesce("nlink", "b_nlink").alias("nlink"),
        is_true(F.when(first, F.col("b_plink")).when(F.col("rn") == 2, F.col("b_link")).otherwise(F.col("plink"))).alias("plink"),
        F.when(first, F.col("b_pid")).otherwise(F.col("pid")).alias("pid"),
        F.when(first, F.col("b_pt")).otherwise(F.col("pt")).alias("pt"),
    )
    # A pointer: where it leads (position, id, time) and whether that is the run's start.
    pointers = placed.where("link").select(
        "s", "pos", "id", "t", (~F.col("nlink")).alias("end"),
        F.struct((F.col("pos") - 1).alias("pos"), F.col("pid").alias("id"), F.col("pt").alias("t"),
                 (~F.col("plink")).alias("start")).alias("p"),
    )
    done = (F.col("end") & F.col("p.start")).alias("done")
    table = materialize(pointers.withColumn("done", done), "run-pointers", by="done")
    if min_records > 1:
        release(rows)
        release(buckets)
    found, stride = [table.where("done")], 1
    while True:
        after = materialize(_double(table.drop("done"), stride).withColumn("done", done), "run-pointers", by="done")
        release(table, "done=false")  # the resolved ends of a round are kept, the rest is not read again
        table = after
        found.append(table.where("done"))
        if not table.where("not done and `end`").limit(1).count():
            break
        stride *= 2
    ends = reduce(DataFrame.unionByName, found)
    runs = ends.select(
        F.col("s").alias(sequence),
        F.col("p.id").alias("first_id"), F.col("id").alias("last_id"),
        (F.col("pos") - F.col("p.pos") + 1).alias("n_records"),
        F.col("p.t").alias("first_ts"), F.col("t").alias("last_ts"),
    )
    if min_records <= 1:
        alone = placed.where("not link and not nlink").select(
            F.col("s").alias(sequence), F.col("id").alias("first_id"), F.col("id").alias("last_id"),
            F.lit(1).cast("bigint").alias("n_records"), F.col("t").alias("first_ts"), F.col("t").alias("last_ts"))
        runs = runs.unionByName(alone)
    elif min_records > 2:
        runs = runs.where(F.col("n_records") >= min_records)
    return runs.withColumn(
        "duration_s", (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    )


def _double(pointers: DataFrame, stride: int) -> DataFrame:
    """One round: pointers whose targets lie at an odd multiple of ``stride`` (or point
    to a start) become their targets' pointers; only unresolved ends and positions
    divisible by ``2 * stride`` go on."""
    kept = pointers.where((F.col("end") & ~F.col("p.start")) | (F.col("pos") % (2 * stride) == 0))
    targets = pointers.where((F.col("pos") % stride == 0) if stride > 1 else F.lit(True)).select(
        F.col("s"), F.col("pos").alias("at"), F.col("p").alias("q"))
    moved = (F.col("at") % (2 * stride) != 0) | F.col("q.start")
    open_ = kept.where(~F.col("p.start")).withColumn("at", F.col("p.pos"))
    joined = open_.join(targets, ["s", "at"], "inner").select(
        "s", "pos", "id", "t", "end", F.when(moved, F.col("q")).otherwise(F.col("p")).alias("p"))
    # Ends that are resolved were reported by the round that resolved them.
    settled = kept.where(F.col("p.start")).withColumn("end", F.lit(False))
    return joined.unionByName(settled)
