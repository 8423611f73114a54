"""Queries of the general (core) data-pipeline operator: keys that hold most records."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.node_stats import heavy_keys, key_stats, with_nodes
from ..plans import lookup_join
from ..sources import read_table, records

NODE = ["map_id", "x", "y"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "codebook", "map_id", F.col("r").alias("x"), F.col("c").alias("y"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid positions that hold at least one percent of all records."""
    heavy = heavy_keys(records(spark, sf_dir, *NODE), NODE, 0.01)
    return lookup_join(heavy, _nodes(spark, sf_dir), NODE, "left_semi").select(*NODE)


def p3_node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum and mean of valid ``dist``, first and last time (microseconds) per node."""
    stats = key_stats(records(spark, sf_dir, *NODE, "dist", "ts"), NODE, "dist", "ts")
    return with_nodes(stats, _nodes(spark, sf_dir), NODE).select(
        *NODE, "is_node", "n_records", "n_valid",
        F.round("sum_dist", 6).alias("sum_dist"),
        F.try_divide(F.round("sum_dist", 6), "n_valid").alias("mean_dist"),
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


_RECORDS = """SELECT id, any_value(map_id) AS map_id, any_value(x) AS x, any_value(y) AS y,
  any_value(dist) AS dist, any_value(ts) AS ts FROM classification_map WHERE id IS NOT NULL GROUP BY id"""


def queries() -> dict:
    return {"p3_found": p3_found, "p3_node_stats": p3_node_stats}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
            WITH rec AS ({_RECORDS})
            SELECT rec.map_id, rec.x, rec.y FROM rec JOIN codebook c
              ON rec.map_id = c.map_id AND rec.x = c.r AND rec.y = c.c
            GROUP BY rec.map_id, rec.x, rec.y
            HAVING count(*) >= 0.01 * (SELECT count(*) FROM rec)""",
        "p3_node_stats": f"""
            WITH rec AS ({_RECORDS}),
            st AS (SELECT map_id, x, y, count(*) AS n, count(v) AS nv, sum(v) AS s, min(ts) AS t0, max(ts) AS t1
                   FROM (SELECT *, CASE WHEN dist >= 0 AND isfinite(dist) THEN dist END AS v FROM rec)
                   GROUP BY map_id, x, y)
            SELECT coalesce(st.map_id, c.map_id) AS map_id, coalesce(st.x, c.r) AS x, coalesce(st.y, c.c) AS y,
                   c.nid IS NOT NULL AS is_node, coalesce(n, 0)::bigint AS n_records, coalesce(nv, 0)::bigint AS n_valid,
                   round(s, 6) AS sum_dist, round(s, 6) / nullif(nv, 0) AS mean_dist,
                   epoch_us(t0) AS first_us, epoch_us(t1) AS last_us
            FROM st FULL JOIN codebook c ON st.map_id = c.map_id AND st.x = c.r AND st.y = c.c""",
    }
