"""Map quality: aggregates over scored samples, and the codebook's U-matrix.

Input of the aggregates are scored samples (``nid, dist`` and, where needed, ``nid2, r, c,
r2, c2``). All reductions are algebraic, so map tasks send one row per node; ``by`` names
further keys, such as the map, and gives one result per value.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.distances import _euclidean
from ..plans import materialize


def far_apart() -> Column:
    """1 where the two best nodes are no neighbours (diagonals count as neighbours)."""
    return F.when(F.greatest(F.abs(F.col("r") - F.col("r2")), F.abs(F.col("c") - F.col("c2"))) > 1, 1).otherwise(0)


def _five(x: Column) -> Column:
    """Rounded to five places, half to even (of the scaled double)."""
    return F.rint(x * 1e5) / 1e5


def activation_map(scored: DataFrame, nodes: DataFrame, by: list[str] = []) -> DataFrame:
    """Samples per node, 0 for nodes that no sample chose; ``nodes`` has ``by, nid, r, c``."""
    hits = scored.groupBy(*by, "nid").agg(F.count(F.lit(1)).alias("activations"))
    return nodes.join(hits, [*by, "nid"], "left").withColumn("activations", F.coalesce("activations", F.lit(0).cast("bigint")))


def error_maps(scored: DataFrame, nodes: DataFrame, by: list[str] = []) -> DataFrame:
    """Per node: activations, sum of distances (5 places, half to even), topological misses,
    and the last two per activation (0 for dead nodes)."""
    per = scored.groupBy(*by, "nid").agg(
        F.count(F.lit(1)).alias("activations"), _five(F.sum("dist")).alias("distance_sum"),
        F.sum(far_apart()).cast("bigint").alias("misses"))
    full = nodes.join(per, [*by, "nid"], "left").na.fill({"activations": 0, "distance_sum": 0.0, "misses": 0})
    return full.withColumns({
        "qe": F.coalesce(F.try_divide("distance_sum", "activations"), F.lit(0.0)),
        "te": F.coalesce(F.try_divide(F.col("misses").cast("double"), F.col("activations")), F.lit(0.0))})


def quantization_error(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """Number of samples and activated nodes, mean distance, and the sum of the rounded
    per-node distance sums over the number of samples; where the second-best nodes are
    known, the topological error from the same pass."""
    both = {"r", "c", "r2", "c2"} <= set(scored.columns)
    misses = F.sum(far_apart() if both else F.lit(0)).alias("misses")
    per = scored.groupBy(*by, "nid").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("s"), misses)
    extra = [(F.sum("misses").cast("double") / F.sum("n")).alias("topological_error")] if both else []
    return per.groupBy(*by).agg(
        F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("num_activations"),
        (F.sum("s") / F.sum("n")).alias("mean_distance"), (F.sum(_five(F.col("s"))) / F.sum("n")).alias("quantization_error"), *extra)


def topological_error(scored: DataFrame, by: list[str] = []) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(far_apart()).alias("topological_error"))


def quantization_error_euclidean(samples: DataFrame, features: str, weights: str, by: list[str] = []) -> DataFrame:
    """Mean Euclidean distance to the chosen node's weights, whatever the map's distance."""
    return samples.groupBy(*by).agg(F.avg(_euclidean(F.col(features), F.col(weights))).alias("quantization_error_euclidean"))


def distortion(samples: DataFrame, features: str, codebook: DataFrame, sigma: DataFrame, by: list[str]) -> DataFrame:
    """Mean over samples of the kernel-weighted squared distance to all nodes.

    Per node with hits three statistics suffice: count n, sum S and sum of squares Q of
    its samples, for then the samples' squared distances to a node w add up to
    ``Q - 2 w.S + n |w|^2``. One pass over the samples, one row per node; the rest joins
    nodes with nodes of the same map. ``samples`` has ``by, nid, features``; ``codebook``
    ``by, nid, r, c, w``; ``sigma`` ``by, sigma`` (at least 1 is used).
    """
    dims = codebook.select(F.size("w")).first()
    sums = samples.groupBy(*by, "nid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.aggregate(features, F.lit(0.0), lambda s, v: s + v * v)).alias("q"),
        *[F.sum(F.get(features, F.lit(i))).alias(f"s{i}") for i in range(dims[0] if dims else 0)])
    sums = sums.select(*by, "nid", "n", "q", F.array(*[c for c in sums.columns if c[0] == "s" and c[1:].isdigit()]).alias("s"))
    sums = materialize(sums, "node-sums")
    hit = codebook.select(*by, "nid", F.col("r").alias("br"), F.col("c").alias("bc")).join(sums, [*by, "nid"]).drop("nid")
    g2 = (F.col("r") - F.col("br")) * (F.col("r") - F.col("br")) + (F.col("c") - F.col("bc")) * (F.col("c") - F.col("bc"))
    width = F.greatest(F.col("sigma"), F.lit(1.0))
    dot = F.aggregate(F.zip_with("w", "s", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    w2 = F.aggregate("w", F.lit(0.0), lambda s, v: s + v * v)
    term = F.exp(-g2.cast("double") / (F.lit(2.0) * width * width)) * (F.col("q") - 2 * dot + F.col("n") * w2)
    total = sums.groupBy(*by).agg(F.sum("n").alias("total"))
    paired = hit.join(codebook.select(*by, "r", "c", "w"), by).join(sigma, by)
    return paired.groupBy(*by).agg(F.sum(term).alias("sum")).join(total, by).select(*by, (F.col("sum") / F.col("total")).alias("distortion"))


def u_matrix(codebook: DataFrame, by: list[str] = []) -> DataFrame:
    """``by, ur, uc, value, kind`` of the (2k-1) x (2k-1) U-matrix.

    Cells between two nodes hold their distance; between four, the mean of the two
    diagonals; on a node, the mean of the two to four cells beside it. Neighbours are
    found by equi-joins on shifted grid positions. ``codebook`` has ``by, r, c, w``.
    """
    nodes = codebook.select(*by, "r", "c", "w")

    def neighbours(dr: int, dc: int) -> DataFrame:
        other = nodes.select(*by, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("w").alias("w2"))
        return nodes.join(other, [*by, "r", "c"]).select(*by, "r", "c", _euclidean(F.col("w"), F.col("w2")).alias("d"))

    def cells(df: DataFrame, ur: Column, uc: Column) -> DataFrame:
        return df.select(*by, ur.cast("int").alias("ur"), uc.cast("int").alias("uc"), F.col("d").alias("value"))

    r, c = F.col("r"), F.col("c")
    vertical = cells(neighbours(1, 0), 2 * r + 1, 2 * c)
    horizontal = cells(neighbours(0, 1), 2 * r, 2 * c + 1)
    edges = vertical.unionByName(horizontal)
    diagonal = cells(neighbours(1, 1), 2 * r + 1, 2 * c + 1).unionByName(cells(neighbours(1, -1), 2 * r + 1, 2 * c - 1))
    diagonal = diagonal.groupBy(*by, "ur", "uc").agg(F.avg("value").alias("value"))
    beside = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    on_node = (
        edges.withColumn("s", beside)
        .select(*by, (F.col("ur") + F.col("s.a")).alias("ur"), (F.col("uc") + F.col("s.b")).alias("uc"), "value")
        .where((F.col("ur") % 2 == 0) & (F.col("uc") % 2 == 0))
        .groupBy(*by, "ur", "uc").agg(F.avg("value").alias("value")))
    kinds = (("node", on_node), ("edge", edges), ("diagonal", diagonal))
    out = None
    for kind, df in kinds:
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


# -- evaluation against labels -------------------------------------------------------------


def purity(scored: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    """Share of samples that carry their node's most frequent label."""
    counts = scored.groupBy(*by, "nid", label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by, "nid").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.groupBy(*by).agg((F.sum("top") / F.sum("n")).alias("purity"))


def nmi(scored: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    """Normalised mutual information of node and label (arithmetic mean of the entropies;
    1 where both are constant). From the contingency table: one row per node and label.
    Samples without a label must be left out by the caller."""
    table = materialize(scored.groupBy(*by, "nid", label).agg(F.count(F.lit(1)).cast("double").alias("n")), "contingency")
    rows = table.groupBy(*by, "nid").agg(F.sum("n").alias("a"))
    cols = table.groupBy(*by, label).agg(F.sum("n").alias("b"))
    names = by or ["__one"]
    keyed = lambda df: df if by else df.withColumn("__one", F.lit(1))
    total = keyed(table).groupBy(*names).agg(F.sum("n").alias("t"))

    def entropy(df: DataFrame, x: str, out: str) -> DataFrame:
        share = F.col(x) / F.col("t")
        return keyed(df).join(total, names).groupBy(*names).agg((-F.sum(share * F.ln(share))).alias(out))

    mutual = keyed(table.join(rows, [*by, "nid"]).join(cols, [*by, label])).join(total, names)
    information = mutual.groupBy(*names).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    joined = information.join(entropy(rows, "a", "ha"), names).join(entropy(cols, "b", "hb"), names)
    mean = (F.col("ha") + F.col("hb")) / 2
    return joined.select(*by, F.when(mean <= 1e-15, 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide("mi", mean))).alias("nmi"))


def flat_rank_correlation(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Spearman correlation of two columns per group; null where one is constant.

    Average ranks come from counts per value, so ties and hot groups cost one row per
    value: the rank of a value is the count below it plus half its own plus one half.
    """
    def ranked(x: str, out: str) -> DataFrame:
        counts = pairs.groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
        below = F.sum("n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        return counts.select(*by, x, (below + (F.col("n") + 1) / 2.0).alias(out))

    counts = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = counts.join(ranked(a, "ra"), [*by, a]).join(ranked(b, "rb"), [*by, b])
    sums = both.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ra")).alias("sa"), F.sum(F.col("n") * F.col("rb")).alias("sb"),
        F.sum(F.col("n") * F.col("ra") * F.col("ra")).alias("saa"), F.sum(F.col("n") * F.col("rb") * F.col("rb")).alias("sbb"),
        F.sum(F.col("n") * F.col("ra") * F.col("rb")).alias("sab"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return sums.select(*by, F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))).alias("spearman"))


def numpy_distortion(x: np.ndarray, best: np.ndarray, w: np.ndarray, size: int, sigma: float) -> float:
    """The direct form, for tests."""
    nodes = np.arange(size * size)
    g2 = (nodes[:, None] // size - nodes // size) ** 2 + (nodes[:, None] % size - nodes % size) ** 2
    h = np.exp(-g2 / (2 * max(sigma, 1.0) ** 2))
    d2 = ((x[:, None, :] - w[None]) ** 2).sum(2)
    return float((h[best] * d2).sum() / len(x))
