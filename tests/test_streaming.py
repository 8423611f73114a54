import numpy as np

from sparksom.operators.train import SomEstimator
from sparksom.queries.streams import stream_bmu
from sparksom.sources import read_index
from sparksom.streaming import running_transitions, score_stream


def test_stream_scores_like_a_batch(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((40, 3))
    df = spark.createDataFrame([(i, i % 2, i, r.tolist()) for i, r in enumerate(x)], "id long, seq_id long, ord int, features array<double>")
    model = SomEstimator(size=3, period=50, random_seed=1).fit(df)
    source = str(tmp_path / "in")
    df.where("id < 20").coalesce(1).write.parquet(source)
    df.where("id >= 20").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scored = score_stream(stream, model)
    q1 = scored.select("id", "nid").writeStream.format("memory").queryName("scored").start()
    q1.processAllAvailable()
    q1.stop()
    assert {tuple(r) for r in spark.table("scored").collect()} == {tuple(r) for r in model.transform(df).select("id", "nid").collect()}
    q2 = running_transitions(scored).writeStream.format("memory").queryName("steps").outputMode("append").start()
    q2.processAllAvailable()
    q2.stop()
    assert spark.table("steps").count() == 38


def test_index_files(spark, tmp_path):
    (tmp_path / "a.ascii").write_text("  1950    1 -0.60310E-01\n 1950 2  0.5\n\n bad line\n")
    rows = {(r["index_year"], r["index_month"], r["index_value"]) for r in read_index(spark, str(tmp_path / "a.ascii")).collect()}
    assert rows == {(1950, 1, -0.06031), (1950, 2, 0.5), (None, None, None)}


def test_stream_beyond_the_node_bound(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i % 50, i % 2, rng.standard_normal(16).tolist()) for i in range(40)] + [(None, 0, [0.0] * 16), (90, 7, [0.0] * 16), (91, 0, [0.0] * 3)]
    rows += rows[:5]
    source = f"{tmp_path}/classification_map.parquet"
    frame = spark.createDataFrame(rows, "id long, map_id long, data array<double>")
    frame.repartition(3).write.parquet(source)
    book = [(m, n, rng.standard_normal(16).tolist()) for m in range(2) for n in range(9)]
    spark.createDataFrame(book, "map_id long, nid int, w array<double>").write.parquet(f"{tmp_path}/codebook.parquet")
    few, many = (sorted(tuple(r) for r in stream_bmu(spark, str(tmp_path), max_nodes=n).collect()) for n in (100, 5))
    assert len(many) == 40 and many == few
    frame.where("false").write.mode("overwrite").parquet(source)
    assert stream_bmu(spark, str(tmp_path), max_nodes=5).count() == 0
