"""Every query of the engine against DuckDB on the small tables, and the streaming limiter against the batch fold."""

import math

import duckdb
import pytest

from quern.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(plain, r)) for r in duck.execute(f"select {quoted} from ({ORACLES[name]}) q").fetchall())
    assert got == want


def test_stream_matches_batch(spark, small):
    rows = lambda n: sorted(tuple(r) for r in QUERIES[n](spark, small).select("user_id", "accepted", "calls").collect())
    assert rows("rate_limit_stream") == rows("rate_limit_accept")


def test_rejected_calls_do_not_move_the_clock(spark):
    from quern.operators.limits import accepted_calls

    calls = [(1, t) for t in (15, 0, 4, 11, 21)] + [(2, 5), (3, None), (None, 1), (None, 30)]
    got = accepted_calls(spark.createDataFrame(calls, "user_id long, t long").repartition(3), 10).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 5, 3, 21), (2, 1, 1, 5), (None, 2, 2, 30)]))


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_paragraphs_merge_forward_and_the_tail_joins_the_last_chunk(spark):
    from pyspark.sql import functions as F

    from quern.plans.papers import _starts

    rows = [([90, 300, 85],), ([90],), ([160, 10, 20],), ([100, 100, 200],), ([],)]
    got = spark.createDataFrame(rows, "n array<int>").select(_starts(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == [[1, 4], [1, 2], [1, 4], [1, 3, 4], [1]]
