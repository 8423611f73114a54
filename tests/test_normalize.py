import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksom.operators.normalize import FEATURE_METHODS, METHODS, SAMPLE_METHODS, Normalizer, exact_quantiles


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(1).standard_normal((30, 4)) * [1, 5, 0.1, 100]
    x[:, 2] = 7.0  # a constant feature
    x[5] = 7.0  # a constant sample
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("method", METHODS)
def test_native_equals_numpy(data, method):
    x, df = data
    n = Normalizer(method).fit(df, "x")
    got = np.array([r[0] for r in df.orderBy("id").select(n.apply(F.col("x"))).collect()])
    assert np.allclose(got, n.apply_numpy(x)) and np.isfinite(got).all()


def test_formulas(data):
    x, df = data
    z = Normalizer("zscore").fit(df, "x").apply_numpy(x)
    assert np.allclose(z[:, 0], (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()) and np.allclose(z[:, 2], 0)
    q = np.percentile(x[:, 1], [25, 50, 75])
    assert np.allclose(Normalizer("robust").fit(df, "x").apply_numpy(x)[:, 1], (x[:, 1] - q[1]) / (q[2] - q[0]))
    scaled = Normalizer("01scale").fit(df, "x").apply_numpy(x)
    assert scaled[:, 3].min() == 0 and scaled[:, 3].max() == pytest.approx(1)
    assert np.allclose(np.linalg.norm(Normalizer("l2").apply_numpy(x), axis=1), 1)


def test_errors(data):
    _, df = data
    with pytest.raises(ValueError):
        Normalizer("nothing of the kind")
    for method in FEATURE_METHODS:
        with pytest.raises(KeyError):
            Normalizer(method).apply(F.col("x"))
    with pytest.raises(ValueError):
        Normalizer("zscore").fit(df.where("false"), "x")
    assert len(SAMPLE_METHODS) + len(FEATURE_METHODS) + 1 == len(METHODS)


def test_exact_quantiles(spark):
    """Without a sort of the table: few values left to sort, ties, heavy values, nulls."""
    rng = np.random.default_rng(6)
    n = 3000
    columns = [rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.full(n, 2.5), np.where(rng.random(n) < 0.6, 1.0, rng.exponential(1e6, n)), np.full(n, np.nan)]
    rows = [[None if np.isnan(v) or (i == 0 and r % 7 == 0) else float(v) for i, v in enumerate(row)] for r, row in enumerate(zip(*columns))]
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>").repartition(5)
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for most in (20_000, 40, 1):
        got = exact_quantiles(df, [F.get("x", F.lit(i)) for i in range(5)], shares, most)
        for i in range(4):
            assert np.allclose(got[i], np.percentile([r[i] for r in rows if r[i] is not None], [100 * s for s in shares]), rtol=1e-12)
        assert all(np.isnan(v) for v in got[4])
