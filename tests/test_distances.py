import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparksom.functions import distances as D


@pytest.mark.parametrize("name,a,b,expected", [
    ("euclidean", [0, 0], [3, 4], 5), ("manhattan", [1, 2, 3], [4, 6, 8], 12), ("chebyshev", [1, 5, 2], [4, 2, 3], 3),
    ("cosine", [1, 2], [-1, -2], 2), ("cosine", [0, 0], [1, 2], 1), ("correlation", [1, 2, 3], [3, 2, 1], 0),
    ("correlation", [1, 1, 1], [3, 2, 1], 1), ("cross_correlation", [0, 0], [1, 2], 1), ("cross_correlation", [1, 0, 0], [0, 0, 1], 0),
    ("dtw", [2, 2, 2], [2, 2, 2], 0), ("dtw", [0, 0, 1], [0, 1, 1], 0)])
def test_known_values(name, a, b, expected):
    assert D.scalar(name, a, b) == pytest.approx(expected, abs=1e-12)


vectors = st.lists(st.floats(-50, 50), min_size=5, max_size=5)


@settings(max_examples=40, deadline=None)
@given(vectors, vectors)
def test_invariants(a, b):
    for name in D.available():
        d = D.scalar(name, a, b)
        assert d >= -1e-9 and D.scalar(name, b, a) == pytest.approx(d, abs=1e-6)
    assert D.scalar("dtw", a, b, band=1) >= D.scalar("dtw", a, b) - 1e-9
    assert D.scalar("dtw", a, b) <= D.scalar("euclidean", a, b) + 1e-9


def test_native_expressions_equal_kernels(spark):
    x = np.random.default_rng(0).standard_normal((12, 6))
    x[3] = 0
    x[4] = 2.5
    pairs = [(i, j, x[i].tolist(), x[j].tolist()) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(pairs, "i int, j int, a array<double>, b array<double>")
    for name in [*D.available(), "band"]:
        distance = D.get("dtw", 1) if name == "band" else D.get(name)
        got = df.select("i", "j", distance.expr(F.col("a"), F.col("b")).alias("d")).collect()
        want = distance.kernel(x, x)
        assert all(r["d"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9) for r in got), name
    for name in ("dtw", "cross_correlation"):
        got = D.with_pair_distance(df, "a", "b", name).collect()
        assert all(r["distance"] == pytest.approx(D.get(name).kernel(x, x)[r["i"], r["j"]], abs=1e-9) for r in got)


def test_unreachable_band_and_registry(spark):
    assert D.scalar("dtw", [1, 2, 3, 4], [1], band=1) == float("inf")
    with pytest.raises(ValueError):
        D.get("no such distance")
    D.register("zero", lambda a, b: F.lit(0.0), lambda x, w: np.zeros((len(x), len(w))))
    assert D.scalar("zero", [1], [2]) == 0
    del D._registry["zero"]
    assert D.available() == ["euclidean", "manhattan", "chebyshev", "cosine", "correlation", "dtw", "cross_correlation"]
