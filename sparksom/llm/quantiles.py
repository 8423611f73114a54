"""Percentiles per group from mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (v, a, b) over distinct stored values:
``a`` is a lower bound on the number of values <= v and ``b`` an upper bound on the
number of values < v. For every rank r some tuple is the answer: where b < r <= a the
stored value *is* the r-th value; between two neighbours i, j the error of the nearer one
is at most half the uncertainty ``b_j - a_i``. The invariant kept everywhere is

    b_j - a_i <= 2 * eps * n        for neighbours i, j,

so every percentile is off by at most ``eps * n`` ranks (plus one half for rounding).

* Building sorts the values of a partition's groups and keeps, of each group, the fewest
  tuples that the permitted uncertainty of the first level allows.
* Merging adds bounds: a value of one summary lies between two stored neighbours of the
  other, whose a and b bound its rank there. Uncertainties add as the counts do, so the
  invariant survives any merge tree, of partitions, days or earlier results.
* Compressing drops tuples while the invariant of the level holds. Levels get wider
  permits (half of eps when building, eps at the end), which leaves room to drop.

Equal values are one tuple with exact bounds, so columns of few distinct values (map
rows and columns) and small groups stay exact. Nothing is random: where the input is split
differently a large group's answer may be another one within the same bound.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows a partition sorts at once; bounds the memory of building.
BUILD_ROWS = 500_000
#: Summaries of one group a task holds before it merges and compresses them.
FAN_IN = 64


class Summary:
    """Sorted distinct values with rank bounds (see the module's docstring)."""

    __slots__ = ("v", "a", "b", "n")

    def __init__(self, v: np.ndarray, a: np.ndarray, b: np.ndarray, n: int):
        self.v, self.a, self.b, self.n = v, a, b, n

    @classmethod
    def of(cls, values: np.ndarray) -> "Summary":
        v, counts = np.unique(np.asarray(values, float), return_counts=True)
        a = np.cumsum(counts)
        return cls(v, a, a - counts, int(a[-1]) if len(a) else 0)

    @classmethod
    def merge(cls, parts: list["Summary"]) -> "Summary":
        parts = [p for p in parts if p.n]
        if len(parts) == 1:
            return parts[0]
        v = np.unique(np.concatenate([p.v for p in parts])) if parts else np.empty(0)
        a, b = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        for p in parts:
            below = np.searchsorted(p.v, v, "right")  # stored values <= v
            a += np.concatenate(([0], p.a))[below]
            at = np.searchsorted(p.v, v, "left")  # first stored value >= v
            b += np.concatenate((p.b, [p.n]))[at]
        return cls(v, a, b, sum(p.n for p in parts))

    def compress(self, eps: float) -> "Summary":
        permit = int(2 * eps * self.n)
        if permit < 1 or len(self.v) < 3:
            return self
        keep = [0]
        last, i = len(self.v) - 1, 0
        b, a = self.b, self.a
        while i < last:
            # The farthest j whose gap from i is permitted; always at least the next one.
            i = min(last, max(i + 1, int(np.searchsorted(b, a[i] + permit, "right")) - 1))
            keep.append(i)
        k = np.array(keep)
        return Summary(self.v[k], self.a[k], self.b[k], self.n)

    def rank_error(self) -> int:
        """The largest rank error that any percentile of this summary can have."""
        if len(self.v) < 2:
            return 0
        gap = int((self.b[1:] - self.a[:-1]).max())
        return max(0, (gap + 1) // 2)

    def quantile(self, q: float) -> float:
        """The value of rank ceil(q n), within :meth:`rank_error` ranks."""
        if not self.n:
            return float("nan")
        r = max(1, int(np.ceil(round(q * self.n, 9))))
        error = np.maximum(np.maximum(self.b + 1 - r, r - self.a), 0)
        return float(self.v[int(np.argmin(error))])


def summarize(df: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """Level-one summaries: one row per task chunk and group, with ``n, v, a, b``.

    Values that are null, NaN or infinite are not summarised (they have no rank); a group
    without any value has no summary. Null keys form a group of their own. Extra columns
    are ignored. The rows of a chunk are at most ``BUILD_ROWS``; nothing is shuffled.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('infinity')")
    key_fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    schema += ", n bigint, v array<double>, a array<bigint>, b array<bigint>"
    level = eps / 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUILD_ROWS:
                yield from _chunk(pa.Table.from_batches(held), keys, level)
                held, size = [], 0
        if held:
            yield from _chunk(pa.Table.from_batches(held), keys, level)

    return rows.mapInArrow(build, schema)


def _chunk(table: pa.Table, keys: list[str], eps: float) -> Iterator[pa.RecordBatch]:
    """All groups of a chunk at once; only groups large enough to drop tuples loop."""
    if not table.num_rows:
        return
    v = table["__v"].to_numpy() + 0.0  # -0.0 counts as 0.0
    codes = []
    for k in keys:
        coded = table[k].combine_chunks().dictionary_encode("encode")
        codes.append(coded.indices.to_numpy(zero_copy_only=False))
    order = np.lexsort([v, *codes])
    v = v[order]
    new_group = np.zeros(len(v), bool)
    new_group[0] = True
    for c in codes:
        c = c[order]
        new_group[1:] |= c[1:] != c[:-1]
    new_value = new_group.copy()
    new_value[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new_group)  # rows
    sizes = np.diff(np.append(starts, len(v)))
    at = np.flatnonzero(new_value)  # first row of each distinct value
    group_of = np.cumsum(new_group)[at] - 1
    b = at - starts[group_of]
    a = np.append(at[1:], len(v)) - starts[group_of]
    v = v[at]
    keep = np.ones(len(v), bool)
    lo = np.searchsorted(group_of, np.arange(len(starts)))
    hi = np.append(lo[1:], len(v))
    for g in np.flatnonzero((2 * eps * sizes >= 1) & (hi - lo > 2)):
        s = slice(lo[g], hi[g])
        kept = Summary(np.arange(hi[g] - lo[g]), a[s], b[s], int(sizes[g])).compress(eps).v
        keep[s] = False
        keep[lo[g] + kept] = True
    v, a, b, group_of = v[keep], a[keep], b[keep], group_of[keep]
    offsets = pa.array(np.searchsorted(group_of, np.arange(len(starts) + 1)).astype(np.int32))
    first = pa.array(order[starts])
    columns = [table[k].take(first).combine_chunks() for k in keys]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, a.astype(np.int64), b.astype(np.int64))]
    out = pa.table([*columns, pa.array(sizes.astype(np.int64)), *lists], names=[*keys, "n", "v", "a", "b"])
    yield from out.to_batches(max_chunksize=20_000)


def merge_summaries(summaries: DataFrame, keys: list[str], eps: float, salts: int = 16) -> DataFrame:
    """Summaries of equal ``keys`` merged into one each, hierarchically.

    ``summaries`` has ``keys, n, v, a, b`` (of :func:`summarize`, of stored days, of an
    earlier merge with the same or a smaller eps); other columns are dropped. Keys may be
    fewer than those the summaries were made with. First each group is merged in
    ``salts`` parts, then the parts: a group present in every partition of a large run
    never has all its summaries in one task. A task merges ``FAN_IN`` summaries of a
    group at a time and compresses, so its memory does not depend on the group.
    """
    base = summaries.select(*keys, "n", "v", "a", "b")
    part = F.pmod(F.xxhash64("n", "v"), F.lit(salts)).cast("int")
    halfway = _merge_level(base.withColumn("__part", part), [*keys, "__part"], eps * 0.75).drop("__part")
    return _merge_level(halfway, keys, eps)


#: Tuples (24 bytes each) of finished summaries that a task holds before it hands them on.
HELD_TUPLES = 100_000


def _merge_level(df: DataFrame, keys: list[str], eps: float) -> DataFrame:
    df = df.select(*keys, "n", "v", "a", "b")
    schema = df.schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_parts, done, tuples = None, [], [], 0

        def close() -> int:
            total = Summary.merge(open_parts)
            done.append((*open_key, total if len(open_parts) == 1 else total.compress(eps)))
            return len(done[-1][-1].v)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            n = batch.column("n").to_pylist()
            lists = [_lists(batch.column(x)) for x in ("v", "a", "b")]
            for i, key in enumerate(zip(*columns)):
                summary = Summary(*(x[0][x[1][i]:x[1][i + 1]] for x in lists), n[i])
                if key != open_key:
                    if open_key is not None:
                        tuples += close()
                    open_key, open_parts = key, []
                elif len(open_parts) >= FAN_IN:
                    open_parts = [Summary.merge(open_parts).compress(eps)]
                open_parts.append(summary)
                if tuples >= HELD_TUPLES:
                    yield _rows(done, keys, schema)
                    done, tuples = [], 0
        if open_key is not None:
            close()
        if done:
            yield _rows(done, keys, schema)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(merge, schema)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _rows(done: list, keys: list[str], schema) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    sums = [d[-1] for d in done]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s.v) for s in sums]))).astype(np.int32))
    flat = lambda name, kind: pa.array(np.concatenate([getattr(s, name) for s in sums]).astype(kind))
    arrays = [pa.array([d[i] for d in done], to_arrow_type(schema[k].dataType)) for i, k in enumerate(keys)]
    arrays.append(pa.array([s.n for s in sums], pa.int64()))
    arrays += [pa.ListArray.from_arrays(offsets, flat(x, t)) for x, t in (("v", float), ("a", np.int64), ("b", np.int64))]
    return pa.RecordBatch.from_arrays(arrays, [*keys, "n", "v", "a", "b"])


def percentiles(summaries: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """One column per named quantile, and ``rank_error``: the bound on its error in ranks.

    Native array expressions: the tuple whose interval is nearest to rank ceil(q n),
    the smallest value on ties. Other columns are kept.
    """
    tuples = F.arrays_zip("v", "a", "b")
    out = summaries.withColumn("__t", tuples)
    for name, q in quantiles.items():
        rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(q), 9)))
        scored = F.transform("__t", lambda t: F.struct(
            F.greatest(t["b"] + 1 - rank, rank - t["a"], F.lit(0)).alias("e"), t["v"].alias("v")))
        out = out.withColumn(name, F.array_min(scored)["v"])
    gaps = F.zip_with(
        F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), F.slice("a", F.lit(1), F.greatest(F.size("a") - 1, F.lit(0))),
        lambda b, a: F.floor((b - a + 1) / 2))
    error = F.greatest(F.coalesce(F.array_max(gaps), F.lit(0)), F.lit(0)).cast("bigint")
    return out.withColumn("rank_error", error).drop("__t", "v", "a", "b")
