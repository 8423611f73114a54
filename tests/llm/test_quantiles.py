import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparksom.llm.quantiles import Summary, merge_summaries, percentiles, summarize

Q = {"p50": 0.5, "p90": 0.9, "p999": 0.999}


def rank_gap(values, answer, q):
    s = np.sort(values)
    r = max(1, int(np.ceil(round(q * len(s), 9))))
    return max(0, np.searchsorted(s, answer, "left") + 1 - r, r - np.searchsorted(s, answer, "right"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 20) | st.floats(-1e6, 1e6), min_size=1, max_size=80), min_size=1, max_size=8), st.sampled_from([0.01, 0.05, 0.2]))
def test_any_merge_tree_stays_within_its_bound(parts, eps):
    summaries = [Summary.of(np.array(p, float)).compress(eps / 2) for p in parts]
    while len(summaries) > 1:
        summaries = [Summary.merge(summaries[i:i + 2]).compress(eps) for i in range(0, len(summaries), 2)]
    values = np.concatenate([np.array(p, float) for p in parts])
    assert summaries[0].n == len(values) and summaries[0].rank_error() <= eps * len(values) + 1
    for q in (0.01, 0.5, 0.9, 0.99, 1.0):
        assert rank_gap(values, summaries[0].quantile(q), q) <= summaries[0].rank_error()


def test_large_groups_shrink_and_keep_the_bound(spark):
    x = np.random.default_rng(0).lognormal(size=60_000).round(2)
    df = spark.createDataFrame([(i % 2 == 0, i % 7, float(v)) for i, v in enumerate(x)], "k boolean, day int, v double").repartition(6)
    parts = summarize(df, ["k"], "v", 0.005)
    merged = merge_summaries(parts, ["k"], 0.005)
    assert merged.agg(F.max(F.size("v"))).first()[0] < 600
    for r in percentiles(merged, Q).collect():
        mine = x[::2] if r["k"] else x[1::2]
        assert r["n"] == len(mine) and r["rank_error"] <= 0.005 * len(mine) + 1
        assert all(rank_gap(mine, r[name], q) <= r["rank_error"] for name, q in Q.items())
    days = merge_summaries(summarize(df, ["day"], "v", 0.005), ["day"], 0.005)
    total = percentiles(merge_summaries(days.withColumn("all", F.lit(1)), ["all"], 0.005), Q).first()
    assert total["n"] == len(x) and all(rank_gap(x, total[name], q) <= total["rank_error"] for name, q in Q.items())


def test_nulls_ties_repeats_empty_and_other_columns(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("a", float("inf")), (None, 2.0), ("b", None), ("c", -0.0), ("c", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumns({"n": F.lit("x"), "a": F.lit(1), "b": F.array(F.lit(1))})
    got = {r["k"]: (r["n"], r["p50"], r["p90"], r["rank_error"]) for r in percentiles(merge_summaries(summarize(df, ["k"], "v", 0.01), ["k"], 0.01), Q).collect()}
    assert got == {"a": (3, 1.0, 3.0, 0), None: (1, 2.0, 2.0, 0), "c": (2, 0.0, 0.0, 0)}
    assert percentiles(merge_summaries(summarize(df.where("false"), ["k"], "v", 0.01), ["k"], 0.01), Q).count() == 0
    assert np.isnan(Summary.of(np.array([])).quantile(0.5)) and Summary.merge([]).n == 0
    with pytest.raises(Exception):
        summarize(df, ["missing"], "v", 0.01)
