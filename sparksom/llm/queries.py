"""Queries of the training-data operators."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.node_stats import valid_measure
from ..plans import lookup_join, materialize
from ..sources import read_table, records
from .clusters import SimilarityClusters
from .lookalikes import lookalike_pairs, skeleton_column
from .packing import pack
from .quantiles import merge_summaries, percentiles, summarize
from .runs import collapse_runs
from .tokenizer import encode_column, token_counts
from .top_n import top_n_per_group

NODE = ["map_id", "x", "y"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of all maps' nodes."""
    return read_table(spark, sf_dir, "codebook", "map_id", F.col("r").alias("x"), F.col("c").alias("y"))


#: Permitted rank error of p1, as a share of a group's values.
P1_EPS = 0.0002
P1_QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
P1_KEYS = ["measure", *NODE, "day"]


def _day(ts: str) -> Column:
    """The day of a timestamp in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def _p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all groupings in one pass: `dist` of every node and of every day, `x`
    and `y` of every map. Unused keys of a grouping are null."""
    nodes = _nodes(spark, sf_dir).withColumn("on_node", F.lit(True))
    rows = lookup_join(records(spark, sf_dir, *NODE, "dist", "ts"), nodes, NODE, "left", salt_by="id")
    none = F.lit(None)

    def entry(measure, value, map_id=none, x=none, y=none, day=none):
        return F.struct(F.lit(measure).alias("measure"), map_id.cast("bigint").alias("map_id"), x.cast("int").alias("x"),
                        y.cast("int").alias("y"), day.cast("date").alias("day"), value.cast("double").alias("value"))

    m, x, y, on = F.col("map_id"), F.col("x"), F.col("y"), F.col("on_node")
    dist = valid_measure("dist")
    entries = F.array(
        entry("node_dist", F.when(on, dist), m, x, y), entry("day_dist", dist, day=_day("ts")),
        entry("map_x", F.when(on, x), m), entry("map_y", F.when(on, y), m))
    return rows.select(F.inline(F.filter(entries, lambda e: e["value"].isNotNull())))


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = summarize(_p1_values(spark, sf_dir), P1_KEYS, "value", P1_EPS)
    return percentiles(merge_summaries(summaries, P1_KEYS, P1_EPS), P1_QUANTILES)


def p1_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every percentile's true rank error, counted over all values of its group, is
    within the stated bound, and the bound within eps n + 1."""
    found = materialize(p1_percentiles(spark, sf_dir), "percentiles")
    key = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in P1_KEYS])
    values = lookup_join(_p1_values(spark, sf_dir).select(key.alias("key"), "value"), found.select(key.alias("key"), *P1_QUANTILES), ["key"], "inner")
    counted = values.groupBy("key").agg(
        F.count(F.lit(1)).alias("counted"), *[F.count_if(F.col("value") < F.col(p)).alias(f"less_{p}") for p in P1_QUANTILES],
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"upto_{p}") for p in P1_QUANTILES])
    both = found.withColumn("key", key).join(counted, "key")
    within = F.col("rank_error") <= F.col("n") * F.lit(P1_EPS) + 1
    for p, q in P1_QUANTILES.items():
        rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(q), 9)))
        within &= F.greatest(F.col(f"less_{p}") + 1 - rank, rank - F.col(f"upto_{p}"), F.lit(0)) <= F.col("rank_error")
    return both.select("measure", "map_id", "x", "y", F.unix_date("day").alias("day_number"), "n", (within & (F.col("n") == F.col("counted"))).alias("within"))


def p1_months_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished summaries of separate days combined into those of months."""
    rows = records(spark, sf_dir, "dist", "ts").select(_day("ts").alias("day"), valid_measure("dist").alias("dist"))
    days = merge_summaries(summarize(rows, ["day"], "dist", P1_EPS), ["day"], P1_EPS)
    months = merge_summaries(days.withColumn("month", F.trunc("day", "month")), ["month"], P1_EPS)
    return percentiles(months, P1_QUANTILES)


def _beside(before, now):
    """Both on nodes, at most one row and one column apart."""
    return (
        before["on_node"] & now["on_node"]
        & (F.abs(before["x"] - now["x"]) <= 1) & (F.abs(before["y"] - now["y"]) <= 1)
    )


def _stays(spark: SparkSession, sf_dir: str, min_records: int) -> DataFrame:
    nodes = _nodes(spark, sf_dir).withColumn("on_node", F.lit(True))
    placed = lookup_join(records(spark, sf_dir, "map_id", "seq_id", "ord", "x", "y", "ts"), nodes, NODE, "left", salt_by="id")
    placed = placed.withColumn("on_node", F.coalesce("on_node", F.lit(False)))
    return collapse_runs(placed, "seq_id", "ord", "id", "ts", ["x", "y", "on_node"], _beside, min_records)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stays(spark, sf_dir, 2).select("seq_id", "first_id", "last_id")


def p2_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stays(spark, sf_dir, 2).select("seq_id", "first_id", "last_id", "n_records", F.round("duration_s", 6).alias("duration_s"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five records a position; positions that are no node drop out of the few survivors."""
    rows = read_table(spark, sf_dir, "classification_map", *NODE, "id", "dist")
    best = top_n_per_group(rows.withColumn("dist", valid_measure("dist")), NODE, "dist", "id", 5)
    return lookup_join(best, _nodes(spark, sf_dir), NODE, "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select(*NODE, "id")


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select(*NODE, F.col("rank").cast("int").alias("rank"), "id", "dist")


def _clusters(spark: SparkSession, sf_dir: str) -> SimilarityClusters:
    return SimilarityClusters(read_table(spark, sf_dir, "classification_map", "id", "data"), "id", "data")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).pairs().select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical records of every cluster of at least two."""
    return _clusters(spark, sf_dir).describe().withColumnRenamed("cluster", "cluster_id")


def p5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every record that has company (all others are clusters of their own)."""
    return _clusters(spark, sf_dir).membership().withColumnRenamed("cluster", "cluster_id")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links each cluster has, and how many of them Markov clustering cut."""
    return _clusters(spark, sf_dir).link_counts().withColumnRenamed("cluster", "cluster_id")


#: The public vocabulary's ranks; set SPARKSOM_VOCABULARY where it lies elsewhere.
VOCABULARY = os.environ.get("SPARKSOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CAPACITY = 4096


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read_table(spark, sf_dir, "documents", "doc_id", "text"), "text", VOCABULARY)


def _containers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Containers of all documents, and their sizes (tokenized once, kept as a narrow table)."""
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text")
    sizes = materialize(token_counts(documents, ["doc_id"], "text", VOCABULARY), "token-counts")
    return pack(sizes, "doc_id", "n_tokens", CAPACITY), sizes


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing had to split: those with a second part."""
    return _containers(spark, sf_dir)[0].where("part = 1").select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers are used, and the least number any packing needs."""
    return _containers(spark, sf_dir)[0].where("part_size > 0").agg(
        F.countDistinct("container_id").alias("n_containers"), F.sum("part_size").alias("n_tokens"),
        F.ceil(F.sum("part_size") / F.lit(CAPACITY)).alias("n_least"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike_pairs(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one consistent form."""
    return skeleton_column(read_table(spark, sf_dir, "documents", "doc_id", "text"), "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_percentiles, p1_rank_errors, p1_months_from_days, p2_found, p2_stays, p4_found, p4_ranked,
        p5_found, p5_clusters, p5_membership, p5_links,
        p6_ids, p7_found, p7_containers, p7_fill, p8_found, p8_skeletons)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
