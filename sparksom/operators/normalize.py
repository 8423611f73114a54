"""Normalisation of samples, per feature (fitted once, reused for new data) or per sample.

Population standard deviations, linearly interpolated percentiles, and 1 in place of
every zero denominator. Per-feature methods fit with one aggregation whose result is one
row however long the table; applying any method is a projection, nothing is shuffled.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distances import fold, let, norm

FEATURE_METHODS = ("zscore", "fwn", "robust", "01scale")
SAMPLE_METHODS = ("zscore_sample", "robust_sample", "minmax_sample", "l2", "euclidean")
METHODS = ("none", *FEATURE_METHODS, *SAMPLE_METHODS)


def _or_one(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def _sample_quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (at - low)


def per_sample(method: str, a: Column) -> Column:
    """A sample normalised by its own statistics; an empty array stays empty, null null."""
    def scaled(centre: Column, spread: Column) -> Column:
        stats = F.struct(centre.alias("m"), _or_one(spread).alias("s"))
        return let(stats, lambda t: F.transform(a, lambda v: (v - t["m"]) / t["s"]))

    if method in ("l2", "euclidean"):
        return scaled(F.lit(0.0), norm(a))
    if method == "zscore_sample":
        mean = fold(a) / F.size(a)
        return let(mean, lambda m: scaled(m, F.sqrt(fold(F.transform(a, lambda v: (v - m) * (v - m))) / F.size(a))))
    if method == "robust_sample":
        q = _sample_quantile
        return let(F.array_sort(a), lambda o: scaled(q(o, 0.5), q(o, 0.75) - q(o, 0.25)))
    if method == "minmax_sample":
        return scaled(F.array_min(a), F.array_max(a) - F.array_min(a))
    raise ValueError(f"not a per-sample method: {method!r}")


#: Values of one column that one task sorts.
SORTED_ROWS = 20_000


def exact_quantiles(df: DataFrame, cells: list[Column], shares: tuple[float, ...], sorted_rows: int = SORTED_ROWS) -> list[list[float]]:
    """Exact, linearly interpolated quantiles of each column, without sorting the table.

    Every order statistic is enclosed by two approximate percentiles (mergeable sketches of
    bounded size); a second pass counts the values up to and between them, and the
    search goes on between them, some thousandth of the values, until at most ``sorted_rows``
    are left, which one task sorts. Each pass sends one row per map task. Nulls don't
    count; a column without values has NaN.
    """
    sizes = list(df.agg(*[F.count(c) for c in cells]).first())
    places = {(i, q): (n - 1) * q for i, n in enumerate(sizes) if n for q in shares}
    ranks = sorted({(i, int(k) + step) for (i, _), k in places.items() for step in (0, 1) if int(k) + step < sizes[i]})
    # Of each rank: the open interval that has it, how many values lie below it, how many inside.
    found: dict[tuple[int, int], float] = {}
    open_ = {t: (None, None, 0, sizes[t[0]]) for t in ranks}

    def inside(i: int, low: float | None, high: float | None) -> Column:
        cell = cells[i]
        both = [cell > F.lit(low)] * (low is not None) + [cell < F.lit(high)] * (high is not None)
        return F.when(reduce(Column.__and__, both, F.lit(True)), cell)

    def ask(expressions: list[Column]) -> list:
        out = []
        for start in range(0, len(expressions), 200):
            out += list(df.agg(*[e.alias(f"e{j}") for j, e in enumerate(expressions[start:start + 200])]).first())
        return out

    while large := [t for t in open_ if open_[t][3] > sorted_rows]:
        sketches = []
        for i, k in large:
            low, high, below, n = open_[i, k]
            share = [min(1.0, max(0.0, (k - below) / n + d)) for d in (-5e-4, 5e-4)]
            sketches.append(F.percentile_approx(inside(i, low, high), share, 10_000))
        bounds = ask(sketches)
        counts = ask([F.count(F.when(test, 1)) for (i, k), (a, b) in zip(large, bounds) for cell in (inside(i, *open_[i, k][:2]),)
                      for test in (cell < F.lit(a), cell == F.lit(a), (cell > F.lit(a)) & (cell < F.lit(b)), cell == F.lit(b))])
        for j, (t, (a, b)) in enumerate(zip(large, bounds)):
            low, high, below, n = open_[t]
            less, at_a, between, at_b = counts[4 * j: 4 * j + 4]
            at_b, rank = at_b if a != b else 0, t[1] - below
            if less <= rank < less + at_a:
                found[t] = a
            elif less + at_a + between <= rank < less + at_a + between + at_b:
                found[t] = b
            elif less + at_a <= rank < less + at_a + between:
                open_[t] = (a, b, below + less + at_a, between)
            elif rank < less:
                open_[t] = (low, a, below, less)
            else:
                upto = less + at_a + between + at_b
                open_[t] = (b, high, below + upto, n - upto)
            if t in found:
                del open_[t]
    few: dict[tuple, list[int]] = {}
    for (i, k), (low, high, below, _) in open_.items():
        few.setdefault((i, low, high, below), []).append(k)

    def ranked(ks: list[int], below: int):
        return lambda a: F.array(*[F.get(a, F.lit(k - below)) for k in ks])

    ordered = [let(F.array_sort(F.collect_list(inside(i, low, high))), ranked(ks, below)) for (i, low, high, below), ks in few.items()]
    for (i, *_), ks, values in zip(few, few.values(), ask(ordered)):
        found |= {(i, k): v for k, v in zip(ks, values)}

    def quantile(i: int, q: float) -> float:
        if not sizes[i]:
            return float("nan")
        k = int(places[i, q])
        low, high = found[i, k], found.get((i, k + 1), found[i, k])
        return low + (high - low) * (places[i, q] - k)

    return [[quantile(i, q) for q in shares] for i in range(len(cells))]


class Normalizer:
    """``fit`` learns what per-feature methods need; ``apply`` normalises an array column.

    Unknown methods are a ValueError at construction; applying a per-feature method
    before ``fit`` is a KeyError.
    """

    def __init__(self, method: str = "none", params: dict[str, list[float]] | None = None):
        if method not in METHODS:
            raise ValueError(f"unknown normalization {method!r}; available: {', '.join(METHODS)}")
        self.method = method
        self.params = dict(params or {})

    @staticmethod
    def params_of(numbers: dict) -> dict[str, list[float]]:
        """Parameters from named statistics: mean and std, median and iqr, or lo and rng."""
        for centre, scale in (("mean", "std"), ("median", "iqr"), ("lo", "rng")):
            if centre in numbers:
                return {"centre": list(numbers[centre]), "scale": list(numbers[scale])}
        return {}

    def fit(self, df: DataFrame, features: str) -> "Normalizer":
        if self.method not in FEATURE_METHODS:
            return self
        first = df.select(F.size(features)).where(F.col(features).isNotNull()).first()
        if first is None:
            raise ValueError("no samples to fit")
        cells = [F.get(features, F.lit(i)) for i in range(first[0])]
        if self.method == "robust":
            rows = exact_quantiles(df, cells, (0.25, 0.5, 0.75))
            self.params = {"centre": [q[1] for q in rows], "scale": [(q[2] - q[0]) or 1.0 for q in rows]}
        else:
            zscore = self.method in ("zscore", "fwn")
            pair = (F.avg, F.stddev_pop) if zscore else (F.min, F.max)
            row = df.agg(*[f(c).alias(f"f{j}_{i}") for i, c in enumerate(cells) for j, f in enumerate(pair)]).first()
            a, b = list(row[0::2]), list(row[1::2])
            self.params = {"centre": a, "scale": [(v if zscore else v - u) or 1.0 for u, v in zip(a, b)]}
        return self

    def apply(self, a: Column) -> Column:
        if self.method == "none":
            return a
        if self.method in SAMPLE_METHODS:
            return per_sample(self.method, a)
        centre, scale = (F.array(*[F.lit(float(v)) for v in self.params[k]]) for k in ("centre", "scale"))
        return F.zip_with(F.zip_with(a, centre, lambda v, m: v - m), scale, lambda v, s: v / s)

    def apply_numpy(self, x: np.ndarray) -> np.ndarray:
        """The same for a block of samples (rows)."""
        def one(v: np.ndarray) -> np.ndarray:
            return np.where(v == 0, 1.0, v)

        if self.method == "none":
            return x
        if self.method in FEATURE_METHODS:
            return (x - np.array(self.params["centre"])) / np.array(self.params["scale"])
        if self.method in ("l2", "euclidean"):
            return x / one(np.linalg.norm(x, axis=1, keepdims=True))
        if self.method == "zscore_sample":
            return (x - x.mean(1, keepdims=True)) / one(x.std(1, keepdims=True))
        if self.method == "robust_sample":
            q = np.percentile(x, [25, 50, 75], axis=1)[:, :, None]
            return (x - q[1]) / one(q[2] - q[0])
        low = x.min(1, keepdims=True)
        return (x - low) / one(x.max(1, keepdims=True) - low)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Numeric columns as one ``array<double>``."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))
