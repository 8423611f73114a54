"""Metrics of the path that a sequence of samples takes over the map.

Input: one row per sample with its ``sequence``, ``order`` and node (``nid, r, c``). Only the
step from one sample to the next matters, so everything follows from the previous
position (see :mod:`.sequences`) by plain aggregation. Sequences never run into each other.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sequences import with_previous


def steps(path: DataFrame, sequence: list[str], order: str) -> DataFrame:
    """``sequence, order, nid, r, c`` with the position before: ``prev_nid, prev_r, prev_c``."""
    return with_previous(path.select(*sequence, order, "nid", "r", "c"), sequence, order, ["nid", "r", "c"])


def _jump() -> Column:
    return F.greatest(F.abs(F.col("r") - F.col("prev_r")), F.abs(F.col("c") - F.col("prev_c")))


def path_metrics(stepped: DataFrame, by: list[str]) -> DataFrame:
    """Per group: stability (share of steps that stay), mean Euclidean step, mean Chebyshev
    step, and coherence (share of steps to a neighbour or staying). A group without any
    step is perfectly stable and coherent (1) and moves by 0."""
    dr, dc = F.col("r") - F.col("prev_r"), F.col("c") - F.col("prev_c")
    step = F.col("prev_nid").isNotNull()
    mean = lambda x, default: F.coalesce(F.avg(F.when(step, x.cast("double"))), F.lit(default))
    return stepped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        mean((F.col("nid") == F.col("prev_nid")).cast("int"), 1.0).alias("stability"),
        mean(F.sqrt((dr * dr + dc * dc).cast("double")), 0.0).alias("mean_path_length"),
        mean(_jump(), 0.0).alias("mean_chebyshev_jump"),
        mean((_jump() <= 1).cast("int"), 1.0).alias("temporal_coherence"))


def transitions(stepped: DataFrame, by: list[str]) -> DataFrame:
    """``by, from_nid, to_nid, cnt, prob``: how often each step happened and its share among
    all steps from that node. Sparse: only steps that happened."""
    counts = stepped.where("prev_nid is not null").groupBy(*by, F.col("prev_nid").alias("from_nid"), F.col("nid").alias("to_nid")).agg(
        F.count(F.lit(1)).alias("cnt"))
    leaving = F.sum("cnt").over(Window.partitionBy(*by, "from_nid"))
    return counts.withColumn("prob", F.col("cnt") / leaving)


def dense_transitions(counted: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """All pairs of nodes of a map, 0 where no step happened; for small maps and plots."""
    pairs = nodes.select(*by, F.col("nid").alias("from_nid")).join(nodes.select(*by, F.col("nid").alias("to_nid")), by)
    return pairs.join(counted, [*by, "from_nid", "to_nid"], "left").na.fill({"cnt": 0, "prob": 0.0})


def most_frequent_transitions(counted: DataFrame, by: list[str], top_k: int = 10) -> DataFrame:
    """The ``top_k`` steps per group with their rank; ties by (from, to)."""
    order = [F.col("cnt").desc(), F.col("from_nid"), F.col("to_nid")]
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= top_k).select(*by, "rank", "from_nid", "to_nid", "cnt")


def dwell_times(stepped: DataFrame, by: list[str]) -> DataFrame:
    """Mean length of stays per node: samples divided by arrivals (a stay's first sample)."""
    arrived = F.col("prev_nid").isNull() | (F.col("prev_nid") != F.col("nid"))
    return stepped.groupBy(*by, "nid").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count(F.when(arrived, 1)).alias("n_stays")
    ).withColumn("mean_dwell", F.col("n_samples") / F.col("n_stays"))


def summaries(stepped: DataFrame, by: list[str], top_k: int = 3) -> DataFrame:
    """One row per group: the path metrics over all its sequences, its number of different
    nodes, and its ``top_k`` steps as text, ``from>to:count`` from the most frequent on."""
    keyed = stepped if by else stepped.withColumn("__all", F.lit(1))
    keys = by or ["__all"]
    unique = keyed.select(*keys, "nid").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    top = most_frequent_transitions(transitions(keyed, keys), keys, top_k)
    step = F.concat_ws("", F.col("from_nid").cast("string"), F.lit(">"), F.col("to_nid").cast("string"), F.lit(":"), F.col("cnt").cast("string"))
    steps = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", step.alias("step")))).alias("steps"))
    steps = steps.select(*keys, F.array_join(F.transform("steps", lambda t: t["step"]), ";").alias("top_steps"))
    joined = path_metrics(keyed, keys).join(unique, keys).join(steps, keys, "left")
    return joined.withColumn("top_steps", F.coalesce("top_steps", F.lit(""))).drop("__all")


def summary(stepped: DataFrame, top_k: int = 3) -> str:
    """The metrics of all sequences together as text, also logged."""
    import logging

    m = summaries(stepped, [], top_k).first()
    steps = [re.sub("(.*)>(.*):(.*)", r"  \1 -> \2 (\3 times)", t) for t in m["top_steps"].split(";") if t]
    text = "\n".join([
        f"samples              : {m['n_samples']}", f"unique nodes         : {m['n_nodes']}", f"stability            : {m['stability']:.4f}",
        f"mean path length     : {m['mean_path_length']:.4f}", f"mean chebyshev jump  : {m['mean_chebyshev_jump']:.4f}",
        f"temporal coherence   : {m['temporal_coherence']:.4f}", "most frequent steps  :", *steps])
    logging.getLogger(__name__).info(text)
    return text
