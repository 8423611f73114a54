import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksom.operators import grid
from sparksom.operators.train import (
    SomEstimator, SomModel, TemporalSomEstimator, _Rows, number_rows, reinforce, search_sizes, size_range, temporal_bmu)


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(0).standard_normal((30, 4))
    df = spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    return x, df


def reference_fit(x, k, period, lr, sigma, smooth, mode, seed, weights="random", sequential=False, chebyshev=False):
    """An independent, plain version of online training."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w = rng.random(d * k * k).reshape(k, k, d) if weights == "random" else x[rng.choice(n, size=k * k, replace=True)].reshape(k, k, d).copy()
    rr, cc = np.meshgrid(range(k), range(k), indexing="ij")
    for t in range(1, period + 1):
        p = x[(t - 1) % n] if sequential else x[rng.integers(0, n)]
        diff = np.abs(w - p)
        dist = diff.max(2) if chebyshev else np.sqrt((diff ** 2).sum(2))
        r, c = np.unravel_index(np.argmin(dist), dist.shape)
        eta = lr / (1 + t / (period / 2)) if mode == "asymptotic" else lr * (1 - t / (period + 1))
        final = 1 if smooth else 0
        v = final + (sigma / (1 + t / (period / 2)) if mode == "asymptotic" else sigma * (1 - t / period))
        g = np.maximum(abs(rr - r), abs(cc - c)) if chebyshev else np.sqrt((rr - r) ** 2 + (cc - c) ** 2)
        h = np.exp(-g ** 2 / (2 * v * v)) if smooth else (g <= v).astype(float)
        w += eta * h[:, :, None] * (p - w)
    return w.reshape(k * k, d)


@pytest.mark.parametrize("options", [
    {}, {"use_decay": True, "lr_decay": "asymptotic"}, {"weights": "sample"}, {"presentation": "sequential"}, {"distance": "chebyshev"}])
def test_online_fit_equals_plain_version(data, options):
    x, df = data
    model = SomEstimator(size=4, period=40, initial_lr=0.5, random_seed=9, **options).fit(df)
    want = reference_fit(x, 4, 40, 0.5, 4, options.get("use_decay", False), options.get("lr_decay", "linear"), 9,
                         options.get("weights", "random"), options.get("presentation") == "sequential", options.get("distance") == "chebyshev")
    assert np.allclose(model.weights, want)


def test_schedules_and_sizes():
    assert [grid.vesanto_size(n) for n in (1, 100, 1000)] == [2, 7, 13]
    assert grid.radius(10, 1, 100) == pytest.approx(9.9) and grid.radius(10, 100, 100) == 0
    assert 0 < grid.learning_rate(0.5, 100, 100) < 0.5 / 100
    assert list(size_range(100)) == [5, 6, 7, 8, 9] and list(size_range(100, 6, 8)) == [6, 7, 8]


def test_validation(data, spark):
    for bad in ({"period": 1}, {"initial_lr": 0}, {"initial_lr": 1}, {"size": 1}, {"distance": "x"}, {"normalization": "x"}, {"weights": "x"}, {"algorithm": "x"}):
        with pytest.raises(ValueError):
            SomEstimator(**bad)
    with pytest.raises(AssertionError):
        TemporalSomEstimator(context_weight=2)
    for row in ([1.0, float("nan")], [1.0, float("inf")], [1.0, None], None):
        with pytest.raises(ValueError):
            SomEstimator(size=2).fit(spark.createDataFrame([(1, row)], "id long, features array<double>"))
    with pytest.raises(ValueError):
        SomEstimator(size=2).fit(data[1].where("false"))


def test_reinforce(data):
    x, df = data
    model = SomEstimator(size=4, period=30, random_seed=1).fit(df)
    assert reinforce(model, df) is model
    before = model.weights.copy()
    after = reinforce(model, df, reinforcement=2, extension=2)
    x1, d1 = data[0], SomEstimator(size=4, period=30, random_seed=1, presentation="sequential", use_decay=True, lr_decay="asymptotic").fit(df)
    twice = reinforce(d1, df, reinforcement=2, extension=2, compression=0.25)
    w, rate, sigma, period = d1.weights.copy(), 0.1, 4, 30
    nodes = np.arange(16)
    for _ in range(2):  # a plain version: longer rounds, smaller rates, radius 1 from the second on
        period, rate = period * 2, rate * 0.25
        for t in range(1, period + 1):
            p = x1[(t - 1) % 30]
            best = np.sqrt(((w - p) ** 2).sum(1)).argmin()
            slow = 1 + t / (period / 2)
            away = np.hypot(nodes // 4 - best // 4, nodes % 4 - best % 4)
            w += (rate / slow * np.exp(-away ** 2 / (2 * (1 + sigma / slow) ** 2)))[:, None] * (p - w)
        sigma = 1
    assert np.allclose(twice.weights, w)
    assert after.params["period"] == 120 and not np.allclose(after.weights, before) and np.allclose(model.weights, before)


def test_round_trip(data, spark, tmp_path):
    _, df = data
    for estimator in (SomEstimator(size=3, normalization="robust", distance="dtw", dtw_band=2, random_seed=4),
                      TemporalSomEstimator(size=3, random_seed=4, lr_decay="asymptotic")):
        model = estimator.fit(df)
        path = str(tmp_path / type(estimator).__name__)
        model.save(spark, path)
        loaded = SomModel.load(spark, path)
        assert type(loaded) is type(model) and loaded.params == model.params and np.array_equal(loaded.weights, model.weights)
        assert loaded.normalizer.params == model.normalizer.params


def test_pca_and_batch(data):
    x, df = data
    w = SomEstimator(size=3, period=2, weights="PCA", initial_lr=1e-9, random_seed=0).fit(df).weights
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs((w[8] - w[2]) @ v[0]), 2, atol=1e-6) and np.allclose(w[4], 0, atol=1e-6)
    batch = SomEstimator(size=3, weights="sample", random_seed=0, algorithm="batch").fit(df)
    scores = np.sqrt(((x[:, None] - batch.weights) ** 2).sum(2)).min(1).mean()
    assert scores < np.sqrt(((x - x.mean(0)) ** 2).sum(1)).mean()


def test_temporal(data, spark):
    x, df = data
    plain = SomEstimator(size=4, period=30, random_seed=3, presentation="sequential").fit(df)
    same = TemporalSomEstimator(size=4, period=30, random_seed=3, context_influence=0).fit(df)
    assert np.allclose(plain.weights, same.weights)
    model = TemporalSomEstimator(size=4, period=30, random_seed=3, context_influence=0.4, context_weight=0.6).fit(df)
    seqs = df.withColumn("seq_id", F.col("id") % 2).withColumn("ord", F.col("id"))
    got = {r["id"]: r for r in model.transform(seqs).collect()}
    for s in (0, 1):
        context = None
        for i in range(30):
            if (i * 3) % 2 != s:
                continue
            d = np.sqrt(((model.weights - x[i]) ** 2).sum(1))
            if context is not None:
                d = 0.6 * d + 0.4 * np.sqrt(((model.weights - context) ** 2).sum(1))
            best = int(np.argmin(d))
            context = model.weights[best] if context is None else 0.6 * context + 0.4 * model.weights[best]
            row = got[i * 3]
            assert row["nid"] == best and np.isclose(row["combined"], d[best]) and np.isclose(row["dist"], np.linalg.norm(model.weights[best] - x[i]))
            assert np.isclose(row["dist2"], np.linalg.norm(model.weights[row["nid2"]] - x[i])) and np.isclose(row["combined2"], np.delete(d, best).min())


def test_search_and_row_numbers(data):
    _, df = data
    with pytest.warns(UserWarning):
        models, best = search_sizes(df, 20, 0.5, range(2, 4), 5)
    assert list(models) == [2, 3] and best in models
    assert [r["row"] for r in number_rows(df, "id").orderBy("id").collect()] == list(range(30))


def test_presented_rows_of_equal_ids(spark):
    """Equal ids are ordered by their vectors' hashes; null ids and copies are rows as well."""
    x = [(5, [1.0]), (5, [2.0]), (5, [2.0]), (None, [3.0]), (1, [4.0])]
    rows = _Rows(spark.createDataFrame(x, "id long, x array<double>").repartition(3))
    got = rows.fetch(np.arange(5)).ravel().tolist()
    assert got[:2] == [3.0, 4.0] and sorted(got[2:]) == [1.0, 2.0, 2.0] and rows.fetch(np.array([4, 0, 4])).ravel().tolist() == [got[4], 3.0, got[4]]
    rows.release()


def test_context_errors():
    for bad in ({"context_weight": 1.5}, {"context_influence": -0.1}):
        with pytest.raises(AssertionError):
            TemporalSomEstimator(size=3, **bad)


def test_recurrent_maps_by_key(spark):
    rng = np.random.default_rng(8)
    w = {k: rng.normal(size=(4, 3)) for k in (1, 2)}
    rows = [(i, i % 4, 1 + i % 2, i, rng.normal(size=3).tolist() if i != 9 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, seq_id long, map_id long, ord int, x array<double>")
    params = {"context_weight": 0.5, "context_influence": 0.3, "distance": "manhattan"}
    book = spark.createDataFrame([(k, i, v.tolist()) for k in w for i, v in enumerate(w[k])], "map_id long, nid int, w array<double>").repartition(2)
    for most in (100, 0):
        got = {r["id"]: r for r in temporal_bmu(df, "x", book, params, "seq_id", "ord", [0.1, 0.2, 0.3], "map_id", most).collect()}
        check(got, rows, w)
    stray = temporal_bmu(df, "x", book.where("map_id = 2"), params, "seq_id", "ord", by="map_id").where("map_id = 1")
    assert {r["nid"] for r in stray.collect()} == {None}


def check(got, rows, w):
    for s in range(4):
        context = np.array([0.1, 0.2, 0.3])
        for i, _, m, _, x in (r for r in rows if r[1] == s):
            if x is None:
                assert got[i]["nid"] is None
                continue
            d = 0.7 * np.abs(w[m] - x).sum(1) + 0.3 * np.linalg.norm(w[m] - context, axis=1)
            assert got[i]["nid"] == d.argmin() and np.isclose(got[i]["combined"], d.min())
            context = 0.5 * context + 0.5 * w[m][d.argmin()]


@pytest.mark.parametrize("recurrent", [False, True])
def test_models_of_the_other_layout(spark, tmp_path, recurrent):
    """Weights by row and column, ``map_size`` and ``norm_params``, several entries."""
    w = np.arange(12.0).reshape(2, 2, 3)
    entry = {"map_size": 2, "input_data_dimension": 3, "presentation": "random", "initial_lr": 0.3, "distance": "euclidean", "use_decay": True, "num_data": 9, "period": 40,
             "neighbourhood": 2, "normalization": "robust", "weights": w.tolist(), "norm_params": {"median": [1.0, 2.0, 3.0], "iqr": [2.0, 2.0, 4.0]}}
    if recurrent:
        entry |= {"context_weight": 0.4, "context_influence": 0.2, "dtw_band": None}
    other = {**entry, "weights": (w + 100).tolist()}
    (tmp_path / "m.json").write_text(json.dumps({"model": [entry, other] if recurrent else [other, entry]}))
    model = SomModel.load(spark, str(tmp_path / "m.json"))
    assert type(model).__name__ == ("TemporalSomModel" if recurrent else "SomModel") and np.array_equal(model.weights, w.reshape(4, 3))
    df = spark.createDataFrame([(1, 0, 0, [3.0, 4.0, 15.0])], "id long, seq_id long, ord int, features array<double>")
    assert model.transform(df).first()["nid"] == 0
    after = reinforce(model, df, reinforcement=1)
    model.save(spark, str(tmp_path / "again"))
    assert SomModel.load(spark, str(tmp_path / "again")).params == model.params and after.weights.shape == (4, 3)
