"""Exact duplicates against a dictionary of whole texts, also where every fingerprint collides."""

import hashlib

import numpy as np

from quern.llm.exact_copies import BASES, MODULI, _powers, copies, drop_copies


def expected(rows):
    """{(doc_id, sha): set of (keep_id, size)} and how many rows stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str), len(groups)


ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "é" * 50), (6, "é" * 49 + "è"), (7, "é" * 50), (7, "é" * 50), (None, "a b"), (None, "x"), (8, "x" * 1000), (9, "x" * 999 + "y"), (10, "x" * 1000), (11, "\0"), (12, "\0\0")]
SCHEMA = "doc_id long, text string"


def held(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


def test_groups_and_ties(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for piece in (7, 1 << 16):
        got = copies(df, piece=piece)
        want, groups = expected(ROWS)
        assert held(got) == want
        stay = got.where("kept").collect()
        assert len(stay) == groups and all(r["doc_id"] == r["keep_id"] for r in stay)


def test_collisions_are_told_apart_by_their_bytes(spark):
    rows = [(i, f"{w:04d}" * 5) for i, w in enumerate([1, 2, 3, 1, 2, 1, 4, 5, 6, 7])]
    got = copies(spark.createDataFrame(rows, SCHEMA), piece=8, moduli=(1, 1))
    assert held(got) == expected(rows)[0]


def test_hashes_of_pieces_add_up_to_the_hash_of_the_whole(spark):
    text = "0123456789" * 30
    prints = []
    for piece in (16, 1 << 10):
        from pyspark.sql import functions as F

        from quern.llm.exact_copies import fingerprints, pieces

        df = spark.createDataFrame([(5, text)], SCHEMA)
        prints.append(fingerprints(pieces(df, "doc_id", "doc_id", F.col("text"), piece), piece).first()["fp"])
    whole = [sum((c + 1) * pow(b, i, m) for i, c in enumerate(text.encode())) % m for m, b in zip(MODULI, BASES, strict=True)]
    assert set(prints) == {whole[0] << 32 | whole[1]}
    assert [int(p[9]) for p in _powers(10, MODULI, BASES)] == [pow(b, 9, m) for m, b in zip(MODULI, BASES, strict=True)]
    assert all(p.dtype == np.int64 for p in _powers(3, MODULI, BASES))


def test_empty_tables_and_clashing_names(spark):
    assert copies(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a", 5, "p"), (2, "a", 6, "q"), (3, "b", 7, "r")], "doc_id long, text string, row int, `kept.x` string")
    assert sorted(map(tuple, drop_copies(df).collect())) == [(2, "a", 6, "q"), (3, "b", 7, "r")]
    assert drop_copies(df.limit(0)).columns == df.columns
    folded = copies(spark.createDataFrame([(1, "A"), (2, "a")], SCHEMA), normalise=lambda t: __import__("pyspark").sql.functions.lower(t))
    assert {r["group_size"] for r in folded.collect()} == {2}


def test_the_bitmap_spares_others_and_loses_none(spark, monkeypatch):
    from pyspark.sql import functions as F

    import quern.llm.exact_copies as m

    cut = spark.range(20_000).select(F.col("id").alias("row"), F.lit(0).alias("at"), F.lit(b"x").alias("bytes"))
    led = spark.range(0, 20_000, 50).select(F.col("id").alias("row"))
    got = {r["row"] for r in m._likely(cut, led).collect()}
    assert set(range(0, 20_000, 50)) <= got and len(got) < 500
    monkeypatch.setattr(m, "MOST_BITS", 15)  # too small: more pass, none is lost
    assert {r["row"] for r in m._likely(cut, led).collect()} >= set(range(0, 20_000, 50))
