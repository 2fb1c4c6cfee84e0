"""Embedding near-dedup against all pairs."""

import duckdb
import numpy as np
import pytest
from brute import classes

from quern.llm import embedding_dedup
from quern.llm.embedding_dedup import cells, close_pairs, cover_tree, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, h1 string, cell int"


def brute(rows):
    """[(id, n_links, component, kept)] by all pairs; ids before nulls."""
    x = [None if r[2] is None or not r[1] or any(c is None or not np.isfinite(c) for c in r[1]) or not any(r[1]) else np.array(r[1], np.float32).astype(float) for r in rows]
    linked = []
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98:
                linked.append((j, i))
    group = classes(range(len(rows)), linked)
    degree = np.bincount([k for e in linked for k in e], minlength=len(rows))
    ids = {}
    for i, c in group.items():
        ids.setdefault(c, []).append(rows[i][0])
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    return [(rows[i][0], int(degree[i]), least[group[i]], rows[i][0] == least[group[i]] if least[group[i]] is not None else group[i] == i) for i in range(len(rows))]


def vectors(n, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = r.normal(size=16) if i % 3 or not rows else np.array(rows[r.integers(len(rows))][1]) * r.uniform(0.5, 2) + r.normal(size=16) * 0.08
        rows.append((i * 7 % 1000, base.astype(np.float32).tolist(), int(r.integers(2))))
    return rows


@pytest.mark.parametrize("block", [4096, 40])
def test_links_match_all_pairs(spark, block):
    rows = vectors(600)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, near_vectors(df, block=block).collect()))
    assert got == sorted(brute(rows))


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]
    rows = [(None, one, 1), (None, one, 1), (2, [2.0, 0.0], 1), (3, one, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, nan, 1), (8, inf, 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (2, one, 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (11, [-0.0, 5.0], 2)]
    got = near_vectors(spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(1)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_traversal_misses_no_pair():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8))
    x[200:] = x[:200] + r.normal(size=(200, 8)) * 0.1
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    tree = cover_tree(x, leaf=10)
    got = {(int(i), int(j)) for p, q in close_pairs(tree, tree, 0.2) for i, j in zip(p, q, strict=True)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(2 - 2 * x @ x.T <= 0.04), strict=True)}
    assert want <= got and len(got) < 5000


def test_visits_miss_no_pair():
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 6))
    x[250:] = x[:250] + r.normal(size=(250, 6)) * 0.1
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    row, cell, home = cells(x, x[:12], 0.2)
    at = {}
    for i, c, h in zip(row.tolist(), cell.tolist(), home.tolist(), strict=True):
        at.setdefault(c, []).append((i, h))
    met = [(min(i, j), max(i, j)) for group in at.values() for i, h in group for j, g in group if i < j and (h or g)]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(2 - 2 * x @ x.T <= 0.04), strict=True) if i < j}
    lives = {i: c for i, c, h in zip(row.tolist(), cell.tolist(), home.tolist(), strict=True) if h}
    assert want <= set(met) and len(row) < 500 * 12
    counted = [p for group in at.values() for i, h in group for j, g in group if i < j and ((h and g) or (h != g)) for p in [(i, j)] if p in want]
    assert len(counted) == len(set(counted)) == len(want) and len(lives) == 500


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    got = sorted(map(tuple, embedding_dedup.op10_embedding_dedup(spark, small).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == sorted(con.execute(f"select vec_id, n_links, component_id, kept from ({embedding_dedup.ORACLE_SQL})").fetchall())
