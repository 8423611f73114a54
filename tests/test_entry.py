import subprocess
import sys

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_training_data_operators():
    code = "import sys; sys.modules['sparksom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('p1_') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1] == "False"


@pytest.mark.parametrize("name", ["map_quality", "p3_found", "transitions", "feat_hjorth", "norm_robust", "umatrix"])
def test_queries_against_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
