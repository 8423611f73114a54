"""The node grid: ids, recommended size, schedules of training and neighbourhood kernels."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def vesanto_size(n: int) -> int:
    """Recommended side of a square map for ``n`` samples; rounding is half to even."""
    return max(2, round((5 * n ** 0.5) ** 0.5))


def vesanto_size_col(n: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(F.sqrt(5 * F.sqrt(n.cast("double"))), 0).cast("int"))


def grid(spark: SparkSession, size: int) -> DataFrame:
    """``nid, r, c`` of all nodes, row by row."""
    nid = F.col("id").cast("int")
    return spark.range(size * size).select(
        nid.alias("nid"), F.floor(nid / F.lit(size)).cast("int").alias("r"), (nid % size).alias("c"))


def learning_rate(initial: float, t, total: int, mode: str = "linear"):
    """Rate of presentation ``t`` (from 1); numbers, arrays and columns alike. Any mode
    but ``asymptotic`` is linear; the linear rate stays above zero to the end."""
    if mode == "asymptotic":
        return initial / (1.0 + t / (total / 2.0))
    return initial * (1.0 - t / (total + 1))


def radius(initial: float, t, total: int, final: float = 0.0, mode: str = "linear"):
    """Neighbourhood radius of presentation ``t``; ``final`` is what it decays to."""
    if mode == "asymptotic":
        return final + initial / (1.0 + t / (total / 2.0))
    return final + initial * (1.0 - t / total)


def schedule(spark: SparkSession, total: int, rate: float, sigma: float, final: float = 0.0, mode: str = "linear") -> DataFrame:
    """``t, lr, radius`` of all presentations."""
    t = F.col("t")
    return spark.range(1, total + 1).select(F.col("id").alias("t")).select(
        "t", (F.lit(1.0) * learning_rate(rate, t, total, mode)).alias("lr"), (F.lit(1.0) * radius(sigma, t, total, final, mode)).alias("radius"))


def gaussian(distance: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-(distance ** 2) / (2 * sigma ** 2))


def bubble(distance: np.ndarray, sigma: float) -> np.ndarray:
    return (distance <= sigma).astype(float)


def kernel_col(distance: Column, sigma: float, smooth: bool) -> Column:
    """Influence at a grid distance: Gaussian, or 1 within the radius and 0 outside."""
    if smooth:
        return F.exp(-(distance * distance) / F.lit(2.0 * sigma * sigma))
    return F.when(distance <= sigma, 1.0).otherwise(0.0)
