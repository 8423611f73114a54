"""The data behind every plot, as DataFrames; rendering is left to the caller.

Positions of heat and elevation maps are transposed as plotting expects: ``px`` runs
along rows of nodes and ``py`` along columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def heat_map(activations: DataFrame, by: list[str] = []) -> DataFrame:
    """Transposed activation counts; the same cells serve the elevation map."""
    return activations.select(*by, F.col("c").alias("plot_row"), F.col("r").alias("plot_col"), "activations")


def characteristics(codebook: DataFrame, by: list[str] = []) -> DataFrame:
    """``nid, feature, value``: the weights of every node, one row per feature."""
    return codebook.select(*by, "nid", F.posexplode("w").alias("feature", "value"))


def activation_histogram(activations: DataFrame, by: list[str] = []) -> DataFrame:
    """How many nodes have exactly h hits, for every h from 0 to the most hits. ``by`` not empty."""
    counted = activations.groupBy(*by, F.col("activations").alias("hits")).agg(F.count(F.lit(1)).alias("n_nodes"))
    steps = activations.groupBy(*by).agg(F.max("activations").alias("m")).select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("hits"))
    return steps.join(counted, [*by, "hits"], "left").na.fill({"n_nodes": 0})


def codebook_planes(codebook: DataFrame, by: list[str] = []) -> DataFrame:
    """Every feature's plane, rounded to two places, transposed."""
    return codebook.select(*by, "r", "c", F.posexplode("w").alias("feature", "v")).select(
        *by, "feature", F.col("c").alias("plot_row"), F.col("r").alias("plot_col"), (F.rint(F.col("v") * 100) / 100).alias("value"))


def majority_labels(scored: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    """Most frequent label per node with its count and the node's; the smallest label on
    ties. Samples without a label don't count. U-matrix markers sit at (2r, 2c)."""
    counts = scored.where(F.col(label).isNotNull()).groupBy(*by, "nid", label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by, "nid").agg(F.sum("n").alias("n_labelled"), F.max("n").alias("n_majority"))
    best = counts.join(total, [*by, "nid"]).where("n = n_majority")
    return best.groupBy(*by, "nid", "n_majority", "n_labelled").agg(F.min(label).alias("majority"))


def hit_map(majority: DataFrame, by: list[str] = []) -> DataFrame:
    """Majority labels with the marker's half width: 0.18 + 0.72 sqrt(n / most n of the map)."""
    most = majority.groupBy(*by).agg(F.max("n_labelled").alias("most"))
    joined = majority.join(most, by) if by else majority.join(F.broadcast(most))  # one row
    return joined.withColumn("half_width", F.lit(0.18) + F.lit(0.72) * F.sqrt(F.col("n_labelled") / F.col("most"))).drop("most")


def bar_chart(cells: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """The cells of a grid (``by, nid``) as bars: ``position`` in row-major order and ``value``."""
    return cells.select(*by, F.col("nid").alias("position"), F.col(value).cast("double").alias("value"))


def weight_grid(codebook: DataFrame, majority: DataFrame, by: list[str] = []) -> DataFrame:
    """Weights of every node with its majority label and count (null for dead nodes)."""
    return codebook.join(majority, [*by, "nid"], "left")


def rotated_weights(codebook: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Weights per cell of the quarter-turned grid: plot row k-1-c, plot column r."""
    return codebook.join(sizes, by).select(*by, (F.col("size") - 1 - F.col("c")).alias("plot_row"), F.col("r").alias("plot_col"), "w")


def rotated_u_matrix(cells: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """The U-matrix quarter-turned: plot row 2k-2-uc, plot column ur."""
    return cells.join(sizes, by).select(*by, (2 * F.col("size") - 2 - F.col("uc")).alias("plot_row"), F.col("ur").alias("plot_col"), "value")


def trajectory(path: DataFrame, sequence: list[str], order: str, seed: int = 0, jitter: float = 0.12) -> DataFrame:
    """The path with a jitter that is a function of (seed, sequence, order), so it replays: the
    first seven digits of a digest as a share of 16^7."""
    def shift(salt: int):
        text = F.concat_ws(",", F.lit(seed), F.lit(salt), *[F.col(c).cast("string") for c in (*sequence, order)])
        unit = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") / F.lit(float(16 ** 7))
        return (unit * 2 - 1) * jitter

    return path.select(*sequence, order, "nid", "r", "c", (F.col("c") + shift(1)).alias("jx"), (F.col("r") + shift(2)).alias("jy"))


def dwell_map(dwell: DataFrame, nodes: DataFrame, by: list[str] = []) -> DataFrame:
    """Mean dwell on every node of the grid, 0 where no sample came."""
    return nodes.join(dwell.select(*by, "nid", "mean_dwell"), [*by, "nid"], "left").na.fill({"mean_dwell": 0.0})
