"""Every query that has SQL gives that SQL's rows, on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

from skeinlog.plans import standins, transcript_standins  # noqa: F401

sys.path.insert(0, os.path.dirname(__file__))
DATA = Path(os.environ.get("SKEINLOG_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(standins.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = standins.QUERIES[name](spark, str(DATA))
    got = duck.execute(standins.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(row[names.index(c)] for c in order) for row in got.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want


def test_entry_survives_without_llm():
    import __spark_entry__

    assert set(standins.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sql_redacts_as_the_engine_does(spark):
    duckdb = pytest.importorskip("duckdb")
    from pyspark.sql import functions as F
    from test_text import MASKED, PLAIN

    from skeinlog.functions.redact import redact

    cases = [*MASKED, *PLAIN, "Token 5", "Bearer a1", "Token abcdef1", "Token abcdefg1", "Basic 1234567", "Basic 12345678.", "Bearer abc.def-ghi/jkl"]
    got = [r["r"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(redact(F.col("c")).alias("r")).collect()]
    want = [duckdb.execute(f"SELECT {standins.sql_redact('c')} FROM (SELECT ? AS c)", [c]).fetchone()[0] for c in cases]
    assert got == want
