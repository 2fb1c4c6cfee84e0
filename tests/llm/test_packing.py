"""Packing: every piece against the tokenizer on whole texts, and rows of all kinds."""

import zlib

import numpy as np

from quern.llm.packing import op9_packing, pack, vocabulary_path


def check(rows, pieces, size):
    """Each row's ids lie in its pieces once, and sequences are gapless, full, or a power of two."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    wanted = {}
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.setdefault(i, []).append(ids)
    found = {}
    for p in pieces:
        found.setdefault(p["doc_id"], []).append(p)
    assert found.keys() == wanted.keys()
    for i, group in found.items():
        whole = wanted[i]
        assert sum(p["length"] for p in group) == sum(map(len, whole))
        for p in group:
            assert any(p["doc_tokens"] == len(ids) and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in whole)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & (at - 1) == 0


def test_the_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op9_packing(spark, small).collect(), 2048)


def test_rows_of_all_kinds(spark):
    rows = [(1, "some words here"), (1, "some words here"), (None, "no id"), (2, None), (3, ""), (4, "A long text, <|with|> odd marks. " * 3000), (5, "Ünïcode ñ 高粱 " * 10)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int").repartition(3)
    check(rows, pack(df, size=64).collect(), 64)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
