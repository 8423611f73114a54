"""Runs, top N and per-item edge cases, against plain versions."""
import random

import pytest
from pyspark.sql import functions as F

from sparksom.llm.runs import collapse_runs
from sparksom.llm.top_n import top_n_per_group


def plain_runs(rows, near):
    out = []
    for s in sorted({r[0] for r in rows if r[0] is not None}):
        events = sorted((r for r in rows if r[0] == s and r[1] is not None), key=lambda r: (r[1], r[2]))
        run = []
        for e in events:
            if run and near(run[-1][4], e[4]):
                run.append(e)
            else:
                run and out.append((s, run))
                run = [e]
        run and out.append((s, run))
    return {(s, r[0][2], r[-1][2], len(r)) for s, r in out}


@pytest.mark.parametrize("width", [3, 8, 1 << 16])
def test_runs(spark, width):
    random.seed(width)
    rows = []
    for s in (1, 2, 3):
        value = 0
        for o in range(0, 90):
            if random.random() < 0.2:
                continue
            if random.random() < (0.3 if s == 1 else 0.05):
                value = random.choice([0, 1, 2, 5, None])
            rows.append((s, o, s * 1000 + o, o * 10, value))
    rows += [(None, 1, 1, 1, 1), (1, None, 2, 1, 1)]
    rows += [(4, o, 4000 + o, o, 7) for o in range(200)]  # one long run
    df = spark.createDataFrame(rows, "s long, o int, id long, t int, v int").withColumn("t", F.timestamp_seconds("t"))
    df = df.withColumns({"pos": F.lit("clash"), "link": F.lit(1), "p": F.lit(2)})
    near = lambda a, b: a is not None and b is not None and abs(a - b) <= 1
    runs = collapse_runs(df, "s", "o", "id", "t", ["v"], lambda a, b: F.abs(a["v"] - b["v"]) <= 1, bucket_width=width)
    got = runs.collect()
    assert {(r["s"], r["first_id"], r["last_id"], r["n_records"]) for r in got} == plain_runs(rows, near)
    assert sum(r["n_records"] for r in got) == len(rows) - 2
    assert next(r["duration_s"] for r in got if r["s"] == 4) == 199
    two = collapse_runs(df, "s", "o", "id", "t", ["v"], lambda a, b: F.abs(a["v"] - b["v"]) <= 1, min_records=2, bucket_width=width)
    assert two.count() == sum(r["n_records"] > 1 for r in got)
    same = collapse_runs(df, "s", "o", "id", "t", ["v"], bucket_width=width)
    assert {(r["s"], r["first_id"], r["last_id"], r["n_records"]) for r in same.collect()} == plain_runs(rows, lambda a, b: a == b)


def test_runs_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, 1, 10, 5, 0)], "s long, o int, id long, t int, v int").withColumn("t", F.timestamp_seconds("t"))
    assert collapse_runs(df.where("false"), "s", "o", "id", "t", ["v"]).count() == 0
    assert [tuple(r)[:4] for r in collapse_runs(df, "s", "o", "id", "t", ["v"]).collect()] == [(1, 10, 10, 1)]
    null_time = df.withColumn("t", F.lit(None).cast("timestamp"))
    assert collapse_runs(null_time, "s", "o", "id", "t", ["v"]).first()["duration_s"] is None


def test_top_n(spark):
    random.seed(1)
    rows = [(g, i, float(random.randint(0, 9))) for g in "ab" for i in range(60)] + [("c", 1, 5.0), ("c", 2, None), ("c", 3, float("nan")), (None, 4, 1.0), ("c", None, 9.0)]
    rows += rows[:20]  # delivered again
    df = spark.createDataFrame(rows, "g string, id long, v double").withColumns({"rank": F.lit("x"), "__score": F.lit(1), "__item": F.lit(2)})
    for salts in (1, 5):
        got = sorted((r["g"], r["rank"], r["id"], r["v"]) for r in top_n_per_group(df, ["g"], "v", "id", 3, salts).collect())
        want = []
        for g in "abc":
            best = sorted({(-v, i) for h, i, v in rows if h == g and i is not None and v is not None and v == v})[:3]
            want += [(g, k, i, -v) for k, (v, i) in enumerate(best, 1)]
        assert got == sorted(want)
    assert top_n_per_group(df.where("false"), ["g"], "v", "id", 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], "v", "id", 0)
