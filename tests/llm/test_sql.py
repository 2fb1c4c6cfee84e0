"""The SQL of this folder's queries, as the engine's own is tested."""

import math

import duckdb
import pytest

from quern.llm.registry import ORACLES, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def test_op5_spreads_rows_without_ids(spark):
    from quern.llm.mixing import mix

    rows = [(None, f"w{i} and more", "s") for i in range(40)] + [(1, "one word", "s"), (None, None, None), (None, "x y", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    first, again = ([tuple(r) for r in mix(x).collect()] for x in (df, df.repartition(2)))
    assert sorted(first, key=str) == sorted(again, key=str) and len(first) == len(rows)
    taken = {s: (sum(r[4] for r in first if r[5] == s), next(r[3] for r in first if r[5] == s)) for s in ("s", "t", None)}
    assert all(abs(n - round(target)) < 1 for n, target in taken.values())
    assert mix(df.where("source = 's' and doc_id is null")).count() == 40 and mix(df.limit(0)).collect() == []


def test_op7_tiles_have_a_fixed_size_at_most():
    import numpy as np

    from quern.llm import simhash_dedup as s

    assert s.MOST >= s.TILE
    points = np.arange(60).reshape(-1, 1)
    assert len(np.unique(s.boxes(points, np.full(60, s.MOST), s.MOST))) == 60
