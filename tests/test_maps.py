"""Quality, sequences, features, views and joins on small inputs, against plain versions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksom.functions import distances
from sparksom.functions.features import FeatureExtractor, sample_entropies, sample_entropy
from sparksom.operators import bmu, quality, temporal, views
from sparksom.operators.bmu import best_two, bmu_arrow, bmu_by_map, bmu_native, top_two
from sparksom.operators.node_stats import heavy_keys, key_stats
from sparksom.operators.sequences import with_previous
from sparksom.operators.normalize import Normalizer
from sparksom.plans import checkpoint_dir, lookup_join, materialize, release, scope
from sparksom.sources import append_side_table, records_in_place


@pytest.fixture(scope="module")
def book(spark):
    w = np.random.default_rng(2).standard_normal((2, 9, 3))
    rows = [(m, i, i // 3, i % 3, w[m, i].tolist()) for m in range(2) for i in range(9)]
    return w, spark.createDataFrame(rows, "map_id long, nid int, r int, c int, w array<double>")


def test_bmu_plans_agree(spark, book):
    w, df = book
    x = np.random.default_rng(3).standard_normal((40, 3))
    x[0] = w[0][4]
    samples = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "id long, map_id long, x array<double>")
    one = df.where("map_id = 0")
    native = {r["id"]: (r["nid"], r["nid2"]) for r in bmu_native(samples, "x", one, "manhattan").collect()}
    arrow = {r["id"]: (r["nid"], r["nid2"]) for r in bmu_arrow(samples, "x", w[0], "manhattan").collect()}
    by_map = {r["id"]: (r["nid"], r["nid2"]) for r in bmu_by_map(samples, "x", df, "map_id", "id", "manhattan").collect()}
    shuffled = {r["id"]: (r["nid"], r["nid2"]) for r in bmu_by_map(samples, "x", df, "map_id", "id", "manhattan", max_nodes=0).collect()}
    assert native == arrow == by_map == shuffled and native[0][0] == 4
    ties = spark.createDataFrame([(i, [1.0]) for i in range(3)], "nid int, w array<double>")
    row = bmu_native(spark.createDataFrame([(1, [0.0])], "id int, x array<double>"), "x", ties).first()
    assert (row["nid"], row["nid2"]) == (0, 1)
    nulls = spark.createDataFrame([(1, None), (2, x[0].tolist())], "id int, x array<double>")
    assert {r["id"]: r["nid"] for r in bmu_arrow(nulls, "x", w[0]).collect()} == {1: None, 2: 4}
    assert bmu_by_map(samples.where("false"), "x", df, "map_id", "id").count() == 0


def test_umatrix(spark, book):
    w, df = book
    cells = {(r["ur"], r["uc"]): r["value"] for r in quality.u_matrix(df.where("map_id = 0"), ["map_id"]).collect()}
    g = w[0].reshape(3, 3, 3)
    d = lambda a, b: np.linalg.norm(g[a] - g[b])
    assert len(cells) == 25
    assert cells[1, 0] == pytest.approx(d((0, 0), (1, 0))) and cells[0, 1] == pytest.approx(d((0, 0), (0, 1)))
    assert cells[1, 1] == pytest.approx((d((0, 0), (1, 1)) + d((0, 1), (1, 0))) / 2)
    assert cells[2, 2] == pytest.approx(np.mean([cells[1, 2], cells[3, 2], cells[2, 1], cells[2, 3]]))


def test_distortion_equals_direct_form(spark, book):
    w, df = book
    x = np.random.default_rng(5).standard_normal((50, 3))
    best = np.argmin(((x[:, None] - w[0]) ** 2).sum(2), axis=1)
    rows = spark.createDataFrame([(0, int(b), r.tolist()) for b, r in zip(best, x)], "map_id long, nid int, x array<double>")
    sigma = spark.createDataFrame([(0, 2.0)], "map_id long, sigma double")
    got = quality.distortion(rows, "x", df, sigma, ["map_id"]).first()["distortion"]
    assert got == pytest.approx(quality.numpy_distortion(x, best, w[0], 3, 2.0))


def test_path_metrics(spark):
    rows = [(1, i, 4, 1, 1) for i in range(8)] + [(2, 0, 0, 0, 0)] + [(3, i, i, 0, i) for i in range(3)]
    path = spark.createDataFrame(rows, "s long, o int, nid int, r int, c int")
    stepped = temporal.steps(path, ["s"], "o")
    m = {r["s"]: r for r in temporal.path_metrics(stepped, ["s"]).collect()}
    assert (m[1]["stability"], m[1]["mean_path_length"], m[2]["stability"], m[2]["temporal_coherence"], m[3]["stability"], m[3]["mean_path_length"]) == (1, 0, 1, 1, 0, 1)
    assert {r["nid"]: r["mean_dwell"] for r in temporal.dwell_times(stepped.where("s = 1"), []).collect()} == {4: 8.0}
    t = temporal.transitions(stepped, [])
    assert t.agg(F.sum("cnt")).first()[0] == 7 + 0 + 2
    assert [r["prob"] for r in t.groupBy("from_nid").agg(F.sum("prob").alias("prob")).collect()] == [pytest.approx(1)] * 3
    assert temporal.most_frequent_transitions(t, [], 1).first()["cnt"] == 7
    assert "stability" in temporal.summary(stepped)
    assert temporal.path_metrics(stepped.where("false"), []).first()["stability"] == 1


def test_previous_across_buckets(spark):
    rows = [(s, o, s * 1000 + o) for s in (1, 2) for o in range(0, 60, 3)] + [(1, None, -1)]
    df = spark.createDataFrame(rows, "s long, o int, v long")
    got = {(r["s"], r["o"]): r["prev_v"] for r in with_previous(df, ["s"], "o", ["v"], bucket_width=7).collect()}
    assert len(got) == 41 and got[1, None] is None
    for s in (1, 2):
        for o in range(0, 60, 3):
            assert got[s, o] == (None if o == 0 else s * 1000 + o - 3)


def test_features():
    t = np.arange(256) / 256
    sine = np.sin(2 * np.pi * 2 * t)
    e = FeatureExtractor(["dominant_frequency", "zero_crossing_rate", "spectral_power", "delta_power", "mean"], fs=256)
    row = dict(zip(e.names, e.matrix(sine[None])[0]))
    assert row["dominant_frequency"] == 2 and row["mean"] == pytest.approx(0, abs=1e-9)
    flat = FeatureExtractor().matrix(np.full((1, 50), 3.0))[0]
    assert np.isfinite(flat).all() and flat[FeatureExtractor().names.index("zero_crossing_rate")] == 0
    assert FeatureExtractor().names == sorted(FeatureExtractor().names) and len(FeatureExtractor().names) == 13
    assert sample_entropy(np.full(20, 1.0)) == 0 and sample_entropy(np.array([1.0, 2.0])) == 0
    x = np.random.default_rng(0).standard_normal(40)

    def plain(x, m, r):
        def count(length):
            return sum(np.abs(x[i:i + length] - x[j:j + length]).max() < r for i in range(len(x) - length) for j in range(i + 1, len(x) - length))
        a, b = count(m + 1), count(m)
        return 0.0 if not b else (float("inf") if not a else -np.log(a / b))

    assert sample_entropy(x) == pytest.approx(plain(x, 2, 0.2 * x.std()))
    for bad, error in ((["nope"], ValueError), (["mfcc"], ImportError)):
        with pytest.raises(error):
            FeatureExtractor(bad)
    with pytest.raises(KeyError):
        FeatureExtractor(["alpha_power"], bands={"delta": (0, 1)})
    welch = FeatureExtractor(["dominant_frequency"], fs=256, psd="welch")
    assert welch.matrix(sine[None])[0, 0] == 2


def test_feature_nulls(spark):
    rows = [(1, [1.0, 2.0, 3.0, 2.0, 1.0]), (2, None), (3, []), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [5.0])]
    df = spark.createDataFrame(rows, "id int, signal array<double>")
    got = {r["id"]: r["mean"] for r in FeatureExtractor(["mean", "line_length"]).extract(df, "signal").collect()}
    assert got == {1: 1.8, 2: None, 3: None, 4: None, 5: None, 6: 5.0}


def test_views(spark):
    scored = spark.createDataFrame([(0, "b"), (0, "a"), (1, "a"), (1, "a"), (1, None), (2, "c")], "nid int, label string")
    got = {r["nid"]: (r["majority"], r["n_majority"], r["n_labelled"]) for r in views.majority_labels(scored, "label").collect()}
    assert got == {0: ("a", 1, 2), 1: ("a", 2, 2), 2: ("c", 1, 1)}
    labelled = scored.where("label is not null")
    assert quality.purity(labelled, "label").first()[0] == pytest.approx(0.8)
    same = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b")], "nid int, label string")
    assert quality.nmi(same, "label").first()[0] == pytest.approx(1)
    path = spark.createDataFrame([(1, 1, 0, 0, 0)], "s long, o int, nid int, r int, c int")
    one, two = (views.trajectory(path, ["s"], "o", seed=3).first() for _ in range(2))
    assert one == two and abs(one["jx"]) <= 0.12


def test_key_stats_and_heavy_keys(spark):
    rows = [(1, 1.0, 5), (1, float("nan"), 3), (1, -1.0, None), (1, float("inf"), 9), (None, 2.0, 1), (2, None, None)] * 2
    df = spark.createDataFrame(rows, "k int, v double, t int").withColumn("t", F.timestamp_seconds("t")).withColumn("n_records", F.lit("clash"))
    got = {r["k"]: (r["n_records"], r["n_valid"], r["sum_dist"], r["mean_dist"]) for r in key_stats(df, ["k"], "v", "t").collect()}
    assert got == {1: (8, 2, 2.0, 1.0), None: (2, 2, 4.0, 2.0), 2: (2, 0, None, None)}
    assert [r["k"] for r in heavy_keys(df, ["k"], 0.5).collect()] == [1]
    assert key_stats(df.where("false"), ["k"], "v", "t").count() == 0 == heavy_keys(df.where("false"), ["k"], 0.5).count()


def test_lookup_join_plans_agree(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(50)], "id long, k long")
    keys = spark.createDataFrame([(0,), (2,)], "k long")
    for how in ("left_semi", "inner"):
        results = [sorted(r["id"] for r in lookup_join(left, keys, ["k"], how, salt_by=s, max_broadcast_rows=n).collect())
                   for s, n in (("id", 100), ("id", 0), (None, 0))]
        assert results[0] == results[1] == results[2] == [i for i in range(50) if i % 7 and i % 3 != 1]


def test_own_distances(spark):
    rng = np.random.default_rng(4)
    names = {1: "manhattan", 2: "cross_correlation", 3: "dtw", 4: None}
    w = {m: rng.normal(size=(9, 6)) for m in names}
    book = spark.createDataFrame([(m, i, v.tolist(), names[m]) for m in names for i, v in enumerate(w[m])], "map_id long, nid int, w array<double>, distance string")
    x = [(i, 1 + i % 5, rng.normal(size=6)) for i in range(60)]  # map 5 has no codebook
    rows = spark.createDataFrame([(i, m, v.tolist(), 1) for i, m, v in x], "id long, map_id long, data array<double>, dist int").drop("dist")
    want = {}
    for i, m, v in x:
        if m in names:
            d = distances.get(names[m] or "chebyshev").kernel(v[None], w[m])[0]
            want[i] = tuple(np.argsort(d, kind="stable")[:2])
    for most in (1_000, 0):
        got = bmu_by_map(rows, "data", book, "map_id", "id", distance="chebyshev", max_nodes=most, keep=["id"])
        assert got.columns == ["id", "nid", "dist", "nid2", "dist2"]
        assert {r["id"]: (r["nid"], r["nid2"]) for r in got.collect()} == want


def test_records_in_place(spark, tmp_path):
    rows = [(i, i % 3, [float(i)] * 2) for i in range(50)] + [(7, 1, [7.0] * 2)] * 40 + [(9, 0, None)] + [(None, 1, [1.0])] * 3
    df = spark.createDataFrame(rows, "id long, map_id long, data array<double>").where("id is null or id != 9 or data is not null")
    df.repartition(3).write.parquet(f"{tmp_path}/classification_map.parquet")
    got = records_in_place(spark, str(tmp_path), "data")
    assert got.columns == ["id", "data"]
    assert sorted((r["id"], tuple(r["data"])) for r in got.collect()) == [(i, (float(i),) * 2) for i in range(50)]
    df.where("false").write.mode("overwrite").parquet(f"{tmp_path}/classification_map.parquet")
    assert records_in_place(spark, str(tmp_path), "data").count() == 0


def test_side_table(spark):
    df = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c"), (4, None, "d")], "id long, k long, name string")
    side = spark.createDataFrame([(10, "y", 2), (10, "x", 9), (10, "x", 9), (None, "z", 1), (12, "w", 0)], "k long, name string, v int")
    want = {1: ("a", "x", 9), 2: ("b", "x", 9), 3: ("c", None, None), 4: ("d", None, None)}
    assert {r["id"]: (r["name"], r["name_side"], r["v"]) for r in append_side_table(df, side, ["k"]).collect()} == want
    assert append_side_table(df, side.where("false"), ["k"]).where("v is null").count() == 4


def test_summary(spark):
    rows = [(1, i, n, n // 3, n % 3) for i, n in enumerate([0, 0, 1, 0, 1, 5])]
    steps = temporal.steps(spark.createDataFrame(rows, "seq_id long, ord int, nid int, r int, c int"), ["seq_id"], "ord")
    text = temporal.summary(steps)
    assert "samples              : 6" in text and "unique nodes         : 3" in text and "  0 -> 1 (2 times)" in text
    row = temporal.summaries(steps, ["seq_id"], 2).first()
    assert row["top_steps"] == "0>1:2;0>0:1" and row["n_nodes"] == 3


def test_sample_entropies_of_many_rows():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 4, 10, 60):
        x = rng.normal(size=(7, n)).round(1)
        x[0] = 2.0
        for m in (1, 2, 3):
            both = []
            for row in x:
                tolerance, counts = 0.2 * row.std() if np.ptp(row) else 0.0, []
                for length in (m, m + 1):
                    starts = n - length
                    counts.append(sum(max(abs(row[i + k] - row[j + k]) for k in range(length)) < tolerance for i in range(starts) for j in range(i + 1, starts)))
                both.append(0.0 if not counts[0] else np.inf if not counts[1] else -np.log(counts[1] / counts[0]))
            assert np.allclose(sample_entropies(x, m), both)


def test_best_two_is_the_kernels():
    """Estimated and then measured: the same nodes and distances to the last bit, with ties,
    repeated nodes, samples on a node, far away and not finite."""
    rng = np.random.default_rng(12)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e4), (1e6, -3.0)):
        w = rng.normal(size=(60, 16)) * scale + shift
        w[17], w[40:45] = w[3], w[30]
        x = np.concatenate([rng.normal(size=(300, 16)) * scale + shift, w, w[:20] + 1e-9, rng.normal(size=(5, 16)) * 1e12, (w[:10] + w[10:20]) / 2])
        x[5, 3], x[6, 0] = np.nan, np.inf
        kernel = distances.get("euclidean")
        with np.errstate(invalid="ignore"):
            want = top_two(kernel.kernel(x, w))
        got = [np.concatenate(parts) for parts in zip(*(best for _, best in best_two(kernel, x, w)))]
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))


def test_best_two_by_dtw_is_the_kernels():
    """Pruned by bounds: the same nodes and distances to the last bit; the kernel, against all
    nodes, is for samples that are not finite or huge only."""
    rng = np.random.default_rng(13)
    dtw = distances.get("dtw")

    def no_kernel(x, w):
        assert not len(x) or (~np.isfinite(x) | (np.abs(x) > 1e14)).any(axis=1).all()
        return dtw.kernel(x, w)

    for scale, shift, dims in ((1.0, 0.0, 16), (1e-3, 1e4, 16), (1e6, -3.0, 16), (1e-30, 0.0, 16), (1.0, 0.0, 33), (3.0, 0.5, 8)):
        w = rng.normal(size=(60, dims)) * scale + shift
        w[17], w[40:45] = w[3], w[30]
        x = np.concatenate([rng.normal(size=(300, dims)) * scale + shift, w, w[:20] + 1e-9, rng.normal(size=(5, dims)) * 1e16, (w[:10] + w[10:20]) / 2])
        x[5, 3], x[6, 0] = np.nan, np.inf
        for points, nodes in ((x, w), (np.round(x[:300] / scale), np.round(w / scale))):
            with np.errstate(invalid="ignore"):
                want = top_two(dtw.kernel(points, nodes))
                found = best_two(distances.Distance("dtw", dtw.expr, no_kernel), points, nodes)
                got = [np.concatenate(parts) for parts in zip(*(best for _, best in found))]
            assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))
    band = distances.get("dtw", 1)
    (_, got), = best_two(band, x[10:20], w)
    assert all(np.array_equal(a, b) for a, b in zip(got, top_two(band.kernel(x[10:20], w))))


def test_salts_by_map(spark, monkeypatch):
    """Maps of many and of few samples, in groups of some ten: each meets its nodes once."""
    rng = np.random.default_rng(15)
    monkeypatch.setattr(bmu, "GROUP_ROWS", 10)
    of = [0] * 47 + [1] * 3 + [2] * 10 + [None] * 2 + [9]
    samples = spark.createDataFrame([(i, m, rng.normal(size=16).tolist()) for i, m in enumerate(of)], "id long, map_id long, x array<double>")
    nodes = spark.createDataFrame([(m, n, rng.normal(size=16).tolist()) for m in range(4) for n in range(11)], "map_id long, nid int, w array<double>")
    one, other = (sorted(tuple(r) for r in bmu_by_map(samples, "x", nodes, "map_id", "id", "dtw", max_nodes=most, keep=["id", "map_id"]).collect()) for most in (100, 0))
    assert len(one) == 60 and one == other


def test_own_normalizations(spark):
    rng = np.random.default_rng(14)
    ways = {1: ("zscore", [1.0] * 5, [2.0, 4.0, 0.5, 1.0, 3.0]), 2: ("robust_sample", None, None), 3: (None, None, None)}
    w = {m: rng.normal(size=(12, 5)) * 3 for m in ways}
    book = spark.createDataFrame([(m, i, v.tolist(), *ways[m]) for m in ways for i, v in enumerate(w[m])],
                                 "map_id long, nid int, w array<double>, normalization string, centre array<double>, scale array<double>")
    x = [(i, 1 + i % 3, rng.normal(size=5) * 3) for i in range(45)]
    rows = spark.createDataFrame([(i, m, v.tolist()) for i, m, v in x], "id long, map_id long, data array<double>")
    want = {}
    for i, m, v in x:
        normalizer = Normalizer(ways[m][0] or "none", {"centre": ways[m][1], "scale": ways[m][2]})
        d = np.linalg.norm(normalizer.apply_numpy(v[None]) - normalizer.apply_numpy(w[m]), axis=1)
        want[i] = tuple(np.argsort(d, kind="stable")[:2])
    for most in (1_000, 0):
        got = bmu_by_map(rows, "data", book, "map_id", "id", max_nodes=most)
        assert {r["id"]: (r["nid"], r["nid2"]) for r in got.collect()} == want


def test_written_tables(spark):
    """Parts are released one by one, and a scope deletes what was written within."""
    import os

    folder = f"{checkpoint_dir(spark)}/sparksom".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    kept = materialize(spark.range(3), "kept")
    with scope():
        table = materialize(spark.range(10).select((F.col("id") % 2 == 0).alias("even"), "id"), "parted", by="even")
        assert table.columns == ["even", "id"] and table.where("even").count() == 5
        release(table, "even=false")
        assert {r["id"] for r in spark.read.parquet(table._sparksom_path).collect()} == {0, 2, 4, 6, 8}
        assert len(set(os.listdir(folder)) - before) == 2
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 3
    release(kept)
    assert set(os.listdir(folder)) == before
