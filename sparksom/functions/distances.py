"""Distances between signals, and between nodes of the grid.

Each distance is registered twice under one name: as a native Spark expression over two
``array<double>`` columns (it stays in the JVM, nothing is shuffled), and as a NumPy
kernel for a block of samples against a whole codebook, which the Arrow scorer uses. New
distances are added with :func:`register`.

Samples must be finite and as wide as the codebook; a null array gives a null distance.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Expr = Callable[[Column, Column], Column]
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]  # [n, d] x [k, d] -> [n, k]


def fold(array: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(fold(F.transform(a, lambda v: v * v)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row; inside a lambda over an array
    an outer expression would be worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(a: Column) -> Column:
    return let(fold(a) / F.size(a), lambda mean: F.transform(a, lambda v: v - mean))


def _euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(fold(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def _manhattan(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def _chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def _one_minus_cosine(a: Column, b: Column, absolute: bool = False) -> Column:
    dot = fold(F.zip_with(a, b, lambda p, q: p * q))
    scale = norm(a) * norm(b)
    similarity = F.try_divide(F.abs(dot) if absolute else dot, scale)
    return F.when(scale == 0, 1.0).otherwise(F.lit(1.0) - similarity)


def _correlation(a: Column, b: Column) -> Column:
    """One minus the absolute Pearson correlation; 1 where either signal is constant."""
    flat = (F.array_max(a) == F.array_min(a)) | (F.array_max(b) == F.array_min(b))
    return F.when(flat, 1.0).otherwise(_one_minus_cosine(centred(a), centred(b), absolute=True))


def _cross_correlation(a: Column, b: Column) -> Column:
    """One minus the largest absolute correlation over all shifts of the unit signals."""
    n = F.size(b)
    shifts = F.sequence(F.lit(1) - F.size(a), n - 1)

    def at(shift: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(a) - 1)
        inside = F.filter(positions, lambda i: (i + shift >= 0) & (i + shift < n))
        return F.abs(F.aggregate(inside, F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, i + shift)))

    scale = norm(a) * norm(b)
    return F.when(scale == 0, 1.0).otherwise(F.lit(1.0) - F.try_divide(F.array_max(F.transform(shifts, at)), scale))


def dtw(band: int | None = None) -> Expr:
    """Dynamic time warping over squared differences; square root of the cheapest path.

    With ``band`` only cells with |i - j| <= band may be used; where none leads to the
    end the distance is infinite. Nested folds: the outer over the first signal, the inner
    builds the next row of costs. For short signals; the kernel serves long ones.
    """
    inf = float("inf")

    def expr(a: Column, b: Column) -> Column:
        m = F.size(b)
        first = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(inf), m))
        start = F.struct(F.lit(0).alias("i"), first.alias("row"))

        def next_row(state: Column, x: Column) -> Column:
            i, above = state["i"] + 1, state["row"]

            def cell(row: Column, j: Column) -> Column:
                y = F.get(b, j - 1)
                best = F.least(F.get(above, j), F.get(above, j - 1), F.get(row, j - 1))
                cost = (x - y) * (x - y) + best
                if band is not None:
                    cost = F.when(F.abs(i - j) <= band, cost).otherwise(F.lit(inf))
                return F.array_append(row, cost)

            row = F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(inf)), cell)
            return F.struct(i.alias("i"), row.alias("row"))

        return F.sqrt(F.aggregate(a, start, next_row, lambda s: F.element_at(s["row"], -1)))

    return expr


# -- kernels ------------------------------------------------------------------------------


def _differences(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x[:, None, :] - w[None, :, :]


def _k_cosine(x: np.ndarray, w: np.ndarray, absolute: bool = False) -> np.ndarray:
    scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(w, axis=1)[None, :]
    dot = x @ w.T
    dot = np.abs(dot) if absolute else dot
    return np.where(scale == 0, 1.0, 1.0 - dot / np.where(scale == 0, 1.0, scale))


def _k_correlation(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    xc, wc = (m - m.mean(axis=1, keepdims=True) for m in (x, w))
    xc[np.ptp(x, axis=1) == 0], wc[np.ptp(w, axis=1) == 0] = 0.0, 0.0
    return _k_cosine(xc, wc, absolute=True)


def _k_cross_correlation(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    d, e = x.shape[1], w.shape[1]
    scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(w, axis=1)[None, :]
    best = np.zeros((len(x), len(w)))
    for shift in range(1 - d, e):
        lo, hi = max(0, -shift), min(d, e - shift)
        np.maximum(best, np.abs(x[:, lo:hi] @ w[:, lo + shift:hi + shift].T), out=best)
    return np.where(scale == 0, 1.0, 1.0 - best / np.where(scale == 0, 1.0, scale))


def dtw_kernel(band: int | None = None) -> Kernel:
    """All pairs at once: the costs of a cell are one array over samples and nodes."""

    def kernel(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        n, m = x.shape[1], w.shape[1]
        shape = (len(x), len(w))
        unreached = np.full(shape, np.inf)
        above = [np.zeros(shape), *[unreached] * m]
        for i in range(1, n + 1):
            row = [unreached] * (m + 1)
            low, high = (1, m) if band is None else (max(1, i - band), min(m, i + band))
            for j in range(low, high + 1):
                cost = (x[:, i - 1, None] - w[None, :, j - 1]) ** 2
                row[j] = cost + np.minimum(np.minimum(above[j], above[j - 1]), row[j - 1])
            above = row
        return np.sqrt(above[m])

    return kernel


def warped(x: np.ndarray, w: np.ndarray, upto: int | None = None) -> np.ndarray:
    """Squared dtw of pairs, as the kernel has it; both have their components first ([d, ...]) and
    their further dimensions are broadcast. Cells of one diagonal are one array, so few pairs at
    once (some thousand, which stay in the cache) keep NumPy busy.

    With ``upto`` (at most d) the least cost of a path's beginning, as far as that diagonal: a
    path takes a cell of one of two neighbouring diagonals. The beginning of the
    reversed signals is its end, so both together are a lower bound while they don't meet.
    """
    n, m = len(x), len(w)
    last = upto or n + m
    rows, turned = min(n, last), w[::-1]
    shape = np.broadcast_shapes(x.shape[1:], w.shape[1:])
    two, one, new = (np.full((rows + 1, *shape), np.inf, x.dtype) for _ in range(3))  # the diagonals before, by rows
    cost = np.empty((rows, *shape), x.dtype)
    two[0] = 0.0
    for d in range(2, last + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        here = np.subtract(x[lo - 1:hi], turned[m - d + lo:m - d + hi + 1], out=cost[:hi - lo + 1])
        np.multiply(here, here, out=here)
        best = np.minimum(one[lo:hi + 1], one[lo - 1:hi], out=new[lo:hi + 1])
        np.minimum(best, two[lo - 1:hi], out=best)
        np.add(here, best, out=best)
        two[0] = new[lo - 1] = np.inf
        if hi < rows:
            new[hi + 1] = np.inf
        two, one, new = one, new, two
    return one[n] if upto is None else np.minimum(one[1:upto].min(0), two[1:upto - 1].min(0))


@dataclass(frozen=True)
class Distance:
    """A distance as a native expression and as a kernel (samples by nodes)."""

    name: str
    expr: Expr
    kernel: Kernel
    band: int | None = None


_registry: dict[str, Distance] = {}


def register(name: str, expr: Expr, kernel: Kernel) -> None:
    """Adds a distance under a name that estimators and queries can then use."""
    _registry[name] = Distance(name, expr, kernel)


register("euclidean", _euclidean, lambda x, w: np.sqrt((_differences(x, w) ** 2).sum(axis=2)))
register("manhattan", _manhattan, lambda x, w: np.abs(_differences(x, w)).sum(axis=2))
register("chebyshev", _chebyshev, lambda x, w: np.abs(_differences(x, w)).max(axis=2))
register("cosine", _one_minus_cosine, _k_cosine)
register("correlation", _correlation, _k_correlation)
register("dtw", dtw(), dtw_kernel())
register("cross_correlation", _cross_correlation, _k_cross_correlation)


def available() -> list[str]:
    """Names of the registered distances, in the order of their registration."""
    return list(_registry)


def get(name: str, band: int | None = None) -> Distance:
    """The distance of that name; ``band`` only concerns dtw."""
    if name not in _registry:
        raise ValueError(f"unknown distance {name!r}; available: {', '.join(_registry)}")
    if name == "dtw" and band is not None:
        return Distance("dtw", dtw(band), dtw_kernel(band), band)
    return _registry[name]


def scalar(name: str, a, b, band: int | None = None) -> float:
    """Distance of two signals in the driver, for tests and small work."""
    x, w = (np.atleast_2d(np.asarray(v, float)) for v in (a, b))
    return float(get(name, band).kernel(x, w)[0, 0])


def pair_distances(a: np.ndarray, b: np.ndarray, name: str, band: int | None = None) -> np.ndarray:
    """Distance of every row of ``a`` to the same row of ``b``, for dtw and cross_correlation."""
    n, d = a.shape
    if name == "dtw":
        unreached = np.full(n, np.inf)
        above = [np.zeros(n), *[unreached] * b.shape[1]]
        for i in range(1, d + 1):
            row = [unreached] * (b.shape[1] + 1)
            low, high = (1, b.shape[1]) if band is None else (max(1, i - band), min(b.shape[1], i + band))
            for j in range(low, high + 1):
                row[j] = (a[:, i - 1] - b[:, j - 1]) ** 2 + np.minimum(np.minimum(above[j], above[j - 1]), row[j - 1])
            above = row
        return np.sqrt(above[-1])
    if name == "cross_correlation":
        scale = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        best = np.zeros(n)
        for shift in range(1 - d, b.shape[1]):
            lo, hi = max(0, -shift), min(d, b.shape[1] - shift)
            np.maximum(best, np.abs((a[:, lo:hi] * b[:, lo + shift:hi + shift]).sum(1)), out=best)
        return np.where(scale == 0, 1.0, 1.0 - best / np.where(scale == 0, 1.0, scale))
    raise ValueError(f"{name} has a native expression")


def with_pair_distance(df: DataFrame, a: str, b: str, name: str, out: str = "distance", band: int | None = None) -> DataFrame:
    """``df`` with the distance of its array columns ``a`` and ``b`` (complete, equally wide
    within a batch): native where the expression is cheap, one Arrow pass for dtw and
    cross_correlation, whose cost is quadratic in the width."""
    if name not in ("dtw", "cross_correlation"):
        return df.withColumn(out, get(name).expr(F.col(a), F.col(b)))
    names = [*df.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (a, b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair_distances(x, y, name, band))], names)

    return df.mapInArrow(run, schema)


# -- grid ---------------------------------------------------------------------------------


def grid_distance(name: str, dr: Column, dc: Column) -> Column:
    """Distance of two nodes by row and column differences: Chebyshev for maps with the
    Chebyshev signal distance, Euclidean for all others."""
    if name == "chebyshev":
        return F.greatest(F.abs(dr), F.abs(dc)).cast("double")
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def grid_kernel(name: str, rows: np.ndarray, cols: np.ndarray, r: int, c: int) -> np.ndarray:
    dr, dc = np.abs(rows - r), np.abs(cols - c)
    return np.maximum(dr, dc).astype(float) if name == "chebyshev" else np.sqrt(dr ** 2 + dc ** 2)
