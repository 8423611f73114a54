"""Filling containers of fixed capacity: dominance reduction, then best fit.

Only sizes matter for packing, and there are at most ``capacity`` of them. So the driver
sees one row per size (a histogram, bounded by the capacity whatever the data), packs
it with multiplicities, and gets a plan whose length is bounded in the same way: patterns
such as "9,120 containers of one item of 3,000 and one of 1,096 tokens". Executors then
number the items of each size and look their containers up in the plan.

* Reduction (after Martello and Toth): for the largest remaining size j, a set {j, ...}
  of at most three items is fixed for good if it dominates every other feasible set with
  j, that is, if some optimal packing contains it: j alone when nothing fits beside it;
  j and its best partner k when they fill the container, when no two items fit beside j,
  or when at most two do and no pair of them outweighs k; and j, k and the best third
  item when at most two fit and no two larger-than-third items do. A condition that
  holds stays true while items are only removed, so a set is fixed as often as its
  items last. Passes repeat until none changes anything.
* The remainder is packed by best fit in order of decreasing size, each time into the
  open container with the least sufficient space.
"""
from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import lookup_join, materialize

#: Rows that one ranking task is meant to sort.
RANK_ROWS = 1_000_000

Pattern = tuple[int, dict[int, int]]  # so many containers of these sizes (size: times each)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixes dominating sets; returns them and the remaining histogram."""
    left = {s: n for s, n in counts.items() if n}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        sizes = sorted(left)
        for j in reversed(list(sizes)):
            while left.get(j):
                chosen = _dominating(j, left, sizes, capacity)
                if chosen is None:
                    break
                need = Counter(chosen)
                times = min(left[s] // k for s, k in need.items())
                for s, k in need.items():
                    left[s] -= times * k
                    if not left[s]:
                        del left[s]
                        sizes.pop(bisect.bisect_left(sizes, s))
                fixed.append((times, dict(need)))
                changed = True
    return fixed, left


def _dominating(j: int, left: dict[int, int], sizes: list[int], capacity: int) -> list[int] | None:
    room = capacity - j
    own = left[j] == 1  # the item itself is no partner of itself

    def largest(limit: int, used: tuple[int, ...] = ()) -> int | None:
        at = bisect.bisect_right(sizes, limit) - 1
        while at >= 0:
            s = sizes[at]
            if left[s] - (s == j) - used.count(s) > 0:
                return s
            at -= 1
        return None

    def smallest(count: int, above: int = 0) -> int | None:
        """Sum of the smallest partners over ``above``, or None if there aren't so many."""
        total, missing = 0, count
        for at in range(bisect.bisect_right(sizes, above), len(sizes)):
            s = sizes[at]
            take = min(missing, left[s] - (s == j))
            total += take * s
            missing -= take
            if not missing:
                return total
        return None

    best = largest(room)
    if best is None:
        return [j]
    if best == room:
        return [j, best]
    two = smallest(2)
    if two is None or two > room:
        return [j, best]
    three = smallest(3)
    if three is not None and three <= room:
        return None
    # At most two items fit beside j.
    partners = sizes[:bisect.bisect_right(sizes, room)]
    heaviest, high = 0, len(partners) - 1
    for low, s in enumerate(partners):  # largest feasible sum of two, by two pointers
        if own and s == j:
            continue
        while high >= low and (s + partners[high] > room or (own and partners[high] == j)
                               or (high == low and left[s] - (s == j) < 2)):
            high -= 1
        if high < low:
            break
        heaviest = max(heaviest, s + partners[high])
    if best >= heaviest:
        return [j, best]
    third = largest(room - best, (best,))
    if third is not None:
        over = smallest(2, above=third)
        if over is None or over > room:
            return [j, best, third]
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by decreasing size, for all items of a size at once.

    Equal items go into the fullest open container that still takes one, until it takes
    no more, then into the next: so containers of equal space are filled alike, and a
    group of them is one entry here.
    """
    groups: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)  # by space left
    spaces: list[int] = []

    def put(space: int, times: int, pattern: dict[int, int]) -> None:
        if times:
            if not groups[space]:
                bisect.insort(spaces, space)
            groups[space].append((times, pattern))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                times, pattern = groups[space].pop()
                if not groups[space]:
                    spaces.pop(at)
            else:
                space, times, pattern = capacity, -(-n // (capacity // size)), {}
            each = space // size
            full = min(times, n // each)
            put(space - each * size, full, {**pattern, size: each})
            n -= full * each
            rest = times - full
            if rest and n:
                put(space - n * size, 1, {**pattern, size: n})
                n, rest = 0, rest - 1
            put(space, rest, pattern)
    return [(times, pattern) for of in groups.values() for times, pattern in of]


def pack_sizes(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item of the histogram once, none over capacity."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


class Plan:
    """The patterns as intervals: items of a size, by rank, and where they go."""

    def __init__(self, patterns: list[Pattern]):
        rows, ranks, base = [], Counter(), 0
        for times, pattern in patterns:
            for size, each in pattern.items():
                rows.append((size << 48 | ranks[size], base, each))
                ranks[size] += times * each
            base += times
        rows.sort()
        self.containers = base
        self.key, self.base, self.each = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), ())))

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        wanted = size << 48 | rank
        at = np.searchsorted(self.key, wanted, "right") - 1
        return self.base[at] + (wanted - self.key[at]) // self.each[at]


def pack(df: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """Containers of all items: ``item, part, part_size, container_id``.

    Every row of ``df`` is an item of its own. An item above the capacity is split into full parts and a
    rest; no other item is split. Containers are numbered from 0. An item of size 0
    takes no space and is spread over the containers by its hash; a null (or negative)
    size is no item to pack: its row has null part_size and container. Extra columns
    are ignored; an empty table gives no rows. Rows are numbered per size within hash
    buckets (as many as the item count asks for), so a size that a third of all items
    share is ranked in many tasks.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    n = F.col("size")
    items = df.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("size"))
    parts = items.where(n > 0).select(
        "item", F.posexplode(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(capacity)).cast("bigint")),
            lambda p: F.least(F.lit(capacity).cast("bigint"), n - p * F.lit(capacity)))).alias("part", "size"))
    counts = {r["size"]: r["count"] for r in parts.groupBy("size").count().collect()}  # at most `capacity` rows
    plan = Plan(pack_sizes(counts, capacity))
    buckets = max(16, -(-sum(counts.values()) // RANK_ROWS))

    numbered = parts.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        numbered.groupBy("size", "bucket").count()
        .select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0).cast("bigint")).alias("offset")),
        "pack-offsets")
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("item", "part"))
    ranked = lookup_join(numbered.withColumn("rank", rank), offsets, ["size", "bucket"], "inner").select(
        "item", "part", "size", (F.col("offset") + F.col("rank") - 1).alias("rank"))
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "rank"))
            where = shared.value.container(sizes, ranks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("part"), batch.column("size"), pa.array(where)], ["item", "part", "size", "container"])

    kind = df.schema[item].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"item {kind}, part int, size bigint, container bigint")
    spread = F.pmod(F.xxhash64("item"), F.lit(max(1, plan.containers)))
    others = items.where(n.isNull() | (n <= 0)).select(
        "item", F.lit(0).alias("part"), F.when(n == 0, n).alias("size"), F.when(n == 0, spread).alias("container"))
    return placed.unionByName(others).select(
        F.col("item").alias(item), "part", F.col("size").alias("part_size"), F.col("container").alias("container_id"))
