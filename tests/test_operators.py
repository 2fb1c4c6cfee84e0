"""Nearest vectors, the lexical index, quotes and recursive chunks against plain versions."""

import random

import numpy as np
import pytest

from quern.operators.ranking import lexical_index, quoted
from quern.operators.vectors import nearest
from quern.functions.chunking import split_recursively


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_in_several_blocks(spark, metric, monkeypatch):
    from quern.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES", 7)
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for row in nearest(df, df.where("vec_id < 40"), 5, metric=metric).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["id"]))
    y = x.astype(float)
    near = (y / np.sqrt((y * y).sum(1, keepdims=True))) @ (y / np.sqrt((y * y).sum(1, keepdims=True))).T if metric == "cosine" else -np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(near, -np.inf)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: sorted(range(300), key=lambda i: (-round(near[q, i], 6), i))[:5] for q in range(40)}


def test_quotes_are_found_by_their_rarest_term_or_by_reading_all(spark, tmp_path):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "xalpha beta gamma deltax"), (3, "Alpha beta gamma delta"), (4, "the of and"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    phrases = [(1, "alpha beta gamma delta"), (2, "lpha beta gamma"), (3, "the of"), (4, "beta missing gamma"), (5, "amma")]
    df = spark.createDataFrame(phrases, "k long, phrase string")
    for fold in (False, True):
        got = {(r["k"], r["doc_id"]) for r in quoted(lexical_index(spark, str(tmp_path)), docs, df, ["k"], fold).collect()}
        assert got == {(k, i) for k, p in phrases for i, t in rows if t and (p.lower() in t.lower() if fold else p in t)}


def test_recursive_chunks_fit_and_lose_nothing():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["word ", "long" * r.randint(1, 40) + " ", ". ", "\n", "\n\n", "a! ", "b? "]) for _ in range(r.randint(0, 200)))
        for size, overlap in ((100, 0), (60, 20)):
            chunks = split_recursively(text, size, overlap)
            assert all(0 < len(c) <= size for c in chunks)
            squeezed = lambda s: "".join(s.split())
            if overlap == 0:
                assert squeezed("".join(chunks)) == squeezed(text)
            else:
                assert set(squeezed(text)) <= set(squeezed("".join(chunks)))
