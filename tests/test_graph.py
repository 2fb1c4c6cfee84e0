"""Hops of any depth against a plain search; the counted bootstrap against one that draws rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from quern.operators.hops import doubled, hops, inner_edges


def reach(edges, root, k):
    near, depth, layer = {}, {root: 0}, [root]
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for d in range(1, k + 1):
        layer = sorted({y for x in layer for y in near.get(x, ())} - set(depth))
        depth |= dict.fromkeys(layer, d)
    return depth


@pytest.mark.parametrize("k", [0, 1, 3, 9])
def test_hops_reach_what_a_search_reaches(spark, k):
    r = random.Random(k)
    edges = [(f"n{r.randint(0, 30)}", f"n{r.randint(0, 30)}") for _ in range(35)] + [("x", "x"), ("hub", "n1")]
    e = spark.createDataFrame(edges, "src string, dst string")
    roots = ["n0", "n5", "x", "alone"]
    got = hops(doubled(e), spark.createDataFrame([(x,) for x in roots], "root string"), k)
    assert sorted(map(tuple, got.collect())) == sorted((x, n, d) for x in roots for n, d in reach(edges, x, k).items())
    inner = sorted((r["root"], r["src"], r["dst"], r["depth"]) for r in inner_edges(got, e).collect())
    want = sorted((x, a, b, max(d[a], d[b])) for x in roots for d in [reach(edges, x, k)] for a, b in edges if a in d and b in d)
    assert inner == want


def test_hubs_are_reached_and_not_passed_if_so_asked(spark):
    edges = [("a", "hub"), ("a", "b"), ("b", "c")] + [("hub", f"h{i}") for i in range(10)]
    both = doubled(spark.createDataFrame(edges, "src string, dst string"))
    roots = spark.createDataFrame([("a",), ("hub",)], "root string")
    got = {(r["root"], r["node"]) for r in hops(both, roots, 3, most=5).collect()}
    assert {n for x, n in got if x == "a"} == {"a", "b", "hub", "c"}
    assert {n for x, n in got if x == "hub"} >= {f"h{i}" for i in range(10)}


def test_intervals_are_those_of_drawn_rows(spark):
    from quern.plans.measures import bootstrap_means

    rng = np.random.default_rng(1)
    groups = {"many": rng.integers(0, 300, 400), "ties": rng.choice([1, 5, 90], 3000), "two": np.array([3, 9])}
    rows = [(g, int(x), int(n)) for g, xs in groups.items() for x, n in zip(*np.unique(xs, return_counts=True))]
    got = {r["g"]: r for r in bootstrap_means(spark.createDataFrame(rows, "g string, x long, n long"), "g").collect()}
    for g in ("many", "ties"):
        means = groups[g][rng.integers(0, len(groups[g]), (4000, len(groups[g])))].mean(axis=1)
        low, high = np.quantile(means, [0.025, 0.975])
        assert abs(got[g]["low"] - low) < 0.05 * (high - low) and abs(got[g]["high"] - high) < 0.05 * (high - low)
    assert got["two"]["low"] == got["two"]["high"] == 6


def test_counts_by_bits_are_those_of_a_search(spark):
    from quern.operators.hops import inner_counts, reach as reach_bits

    r = random.Random(6)
    name = lambda i: f"{'AB'[i % 2]}:{i}"
    edges = [(name(r.randint(0, 700)), name(r.randint(0, 700))) for _ in range(900)] + [("A:0", "A:0"), ("A:0", "A:2"), ("A:0", "A:2"), ("B:1", "B:1")]
    e = spark.createDataFrame(edges, "src string, dst string")
    roots, k = [name(i) for i in range(650)] + ["A:9000"], 3  # more than a block of roots
    nodes, inside = inner_counts(*reach_bits(doubled(e), spark.createDataFrame([(x,) for x in roots], "root string"), k), e, k)
    far = {x: reach(edges, x, k) for x in roots}
    want = {}
    for x in roots:
        for n, d in far[x].items():
            want[x, d, n[0]] = want.get((x, d, n[0]), 0) + 1
    assert {(a["root"], a["depth"], a["kind"]): a["nodes"] for a in nodes.collect()} == want
    counted = {(x, i): sum(far[x].get(a, 99) <= i and far[x].get(b, 99) <= i for a, b in edges) for x in roots for i in range(1, k + 1)}
    assert {(a["root"], a["k"]): a["edges"] for a in inside.collect()} == counted


def test_each_row_has_a_weight_of_its_own(spark, tmp_path):
    from quern.plans.measures import QUERIES

    r = random.Random(8)
    rows = [(i // 3, i % 3, "user" if i % 4 else "assistant", "x" * r.choice([10, 10, 10, 50, 90])) for i in range(60)] + [(90, 0, "user", None), (None, 1, "user", "x" * 30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    cdf = [round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), 12) for k in range(8)]
    for got in QUERIES["eval_bootstrap_ci"](spark, str(tmp_path)).collect():
        own = [(c, t, len(x)) for c, t, role, x in rows if role == got["role"] and x is not None]
        keyed = [(c, t, n) for c, t, n in own if c is not None]
        u = np.array([[int(hashlib.md5(f"{b}:{c}:{t}".encode()).hexdigest()[:8], 16) / 2**32 for c, t, _ in keyed] for b in range(1, 10_001)])
        w, x = np.searchsorted(cdf, u, "right"), np.array([n for *_, n in keyed])
        means = (w * x).sum(axis=1) / w.sum(axis=1)
        assert got["n"] == len(own) and abs(got["mean"] - np.mean([n for *_, n in own])) < 1e-5
        assert np.allclose([got["low"], got["high"]], np.quantile(means, [0.025, 0.975]), atol=1e-5)


def test_tasks_that_count_shared_terms_grow_in_number_with_the_asked_genes(spark, small, monkeypatch):
    from quern.plans import graph

    plan = lambda: graph.QUERIES["kg_shared"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [gene_a" in plan()
    asked = 2  # genes 100 and 200 of this small table, of thirty edges or so each
    monkeypatch.setattr(graph, "_ASKED", 1)
    parts = int(next(x for x in plan().splitlines() if "RepartitionByExpression" in x).rsplit(", ", 1)[1])
    assert parts > 4 * asked


@pytest.mark.parametrize("parts", [1, 20])
def test_counts_by_joints_are_those_of_a_search(spark, monkeypatch, parts):
    from quern.operators import hop_counts

    r = random.Random(parts)
    leaves = [(f"P:{r.randint(0, 300)}", f"S:{r.randint(0, 60)}") for _ in range(700)]
    joints = [(f"S:{r.randint(0, 60)}", f"{'NSR'[r.randint(0, 2)]}:{r.randint(0, 9)}") for _ in range(30)]
    hub = [("P:7", f"S:{i}") for i in range(200)] + [(f"P:{i}", "S:3") for i in range(0, 300, 2)]
    edges = [*leaves, *joints, *hub, *leaves[:20], ("S:1", "S:1"), ("P:900", "P:901"), ("S:4", "P:901"), ("Q:1", "Q:1")]
    e = spark.createDataFrame(edges, "src string, dst string")
    roots, k = [f"P:{i}" for i in range(0, 300, 5)] + ["S:1", "N:2", "P:901", "Q:1", "P:9000"] + [f"P:x{i}" for i in range(600)], 4
    monkeypatch.setattr(hop_counts, "EDGES", len(edges) // parts)
    nodes, inside = hop_counts.hop_counts(e, spark.createDataFrame([(x,) for x in [*roots, "P:5"]], "root string"), k)
    far = {x: reach(edges, x, k) for x in roots}
    want = {}
    for x in roots:
        for n, d in far[x].items():
            want[x, d, n[0]] = want.get((x, d, n[0]), 0) + 1
    assert {(a["root"], a["depth"], a["kind"]): a["nodes"] for a in nodes.collect()} == want
    counted = {(x, i): sum(far[x].get(a, 99) <= i and far[x].get(b, 99) <= i for a, b in edges) for x in roots for i in range(1, k + 1)}
    assert {(a["root"], a["k"]): a["edges"] for a in inside.collect()} == counted


def test_what_is_stored_of_hops_does_not_grow_with_leaves(spark, tmp_path, monkeypatch):
    from quern.operators import hop_counts, hops
    from quern.plans.graph import QUERIES

    n, where = 3000, str(tmp_path)
    spark.range(2 * n).selectExpr(f"id % {n} AS l_partkey", f"(id * 7 + id div {n}) % 6 AS l_suppkey").write.parquet(f"{where}/lineitem.parquet")
    spark.range(n).selectExpr("id * 5 AS p_partkey").union(spark.range(n).selectExpr("id * 500 + 1000000")).write.parquet(f"{where}/part.parquet")
    spark.range(6).selectExpr("id AS s_suppkey", "int(id % 2) AS s_nationkey").write.parquet(f"{where}/supplier.parquet")
    spark.range(2).selectExpr("int(id) AS n_nationkey", "0 AS n_regionkey").write.parquet(f"{where}/nation.parquet")
    spark.range(1).selectExpr("int(id) AS r_regionkey").write.parquet(f"{where}/region.parquet")
    rows = []

    def counted(df, *more, **named):
        out = written(df, *more, **named)
        rows.append((out.count(), out.columns))
        return out

    written = hops.written
    monkeypatch.setattr(hops, "written", counted)
    monkeypatch.setattr(hop_counts, "written", counted)
    got = {(r["root"], r["k"]): r for r in QUERIES["kg_khop_depths"](spark, where).collect()}
    assert got["P:0", 4]["genes"] == n and got["P:1000000", 4]["nodes"] == 1  # all leaves are counted
    of_hops = [x for x, columns in rows if "block" in columns and "root" not in columns]
    assert of_hops and max(of_hops) < 500  # not a row for each leaf and block of roots
