"""Streams: the recorded samples read as a stream of files and run until all is processed."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bmu import MAX_NODES, bmu_by_map
from ..plans import checkpoint_dir, delete, materialize
from ..sources import read_table
from ..streaming import running_transitions
from . import base


def _stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table's files as a stream; a stream needs a folder, so a single file is named by a filter."""
    name = "classification_map.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}").schema)
    rows = reader.option("pathGlobFilter", name).parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/{name}")
    return rows.select(*columns)


def _all_of(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives for all files that are there, through a Parquet sink."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/sparksom/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    kept = materialize(spark.read.schema(stream.schema).parquet(f"{folder}/out"), name)
    delete(spark, folder)
    return kept


def _by_batches(stream: DataFrame, of_batch: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """``of_batch`` of every micro-batch, as a stream again, for plans that a stream itself can't
    have. Each batch has a folder of its own under ``folder``, which it replaces if it is run again."""
    spark = stream.sparkSession
    schema = of_batch(spark.createDataFrame([], stream.schema)).schema
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def write(batch: DataFrame, number: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{folder}/batches/{number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/batches")


def stream_bmu(spark, sf_dir, max_nodes: int = MAX_NODES):
    """Best nodes of a stream of deliveries, each record once: ids seen are the only state.

    Beyond ``max_nodes`` nodes the samples of a micro-batch meet their map's nodes by a
    shuffle, which counts the samples first; a stream can't, so its batches are scored one by one.
    """
    rows = _stream(spark, sf_dir, "id", "map_id", "data").where(F.col("id").isNotNull() & base.complete("data"))
    book = read_table(spark, sf_dir, "codebook", "map_id", "nid", "w")
    score = lambda some: bmu_by_map(some, "data", book, "map_id", "id", max_nodes=max_nodes, keep=["id", "map_id"])
    folder = None
    if book.count() <= max_nodes:
        scored = score(rows)
    else:
        folder = f"{checkpoint_dir(spark)}/sparksom/stream-batches-{uuid.uuid4().hex}"
        scored = _by_batches(rows, score, folder)
    best = _all_of(scored.dropDuplicates(["id"]), "stream-bmu")
    if folder:
        delete(spark, folder)
    return best.withColumns({c: F.round(c, 6) for c in ("dist", "dist2")})


def stream_transitions(spark, sf_dir):
    """Steps of every recording in a stream of placed records, counted."""
    nodes = read_table(spark, sf_dir, "codebook", "map_id", F.col("r").alias("x"), F.col("c").alias("y"), "nid")
    rows = _stream(spark, sf_dir, "id", "map_id", "seq_id", "ord", "x", "y").where("id is not null and seq_id is not null and ord is not null")
    placed = rows.dropDuplicates(["id"]).join(nodes, ["map_id", "x", "y"])
    steps = _all_of(running_transitions(placed), "stream-steps")
    return steps.groupBy("seq_id", "from_nid", "to_nid").agg(F.count(F.lit(1)).alias("cnt"))


def queries() -> dict:
    return {"stream_bmu": stream_bmu, "stream_transitions": stream_transitions}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_bmu": f"""WITH {base.SQL_SCORED} SELECT id, map_id, nid, nid2, round(dist, 6) AS dist, round(dist2, 6) AS dist2 FROM scored""",
        "stream_transitions": f"""WITH {base.SQL_PLACED}, steps AS (SELECT seq_id, nid, lag(nid) OVER (PARTITION BY seq_id ORDER BY ord) AS pn
              FROM placed WHERE seq_id IS NOT NULL AND ord IS NOT NULL)
            SELECT seq_id, pn AS from_nid, nid AS to_nid, count(*) AS cnt FROM steps WHERE pn IS NOT NULL GROUP BY seq_id, pn, nid""",
    }
