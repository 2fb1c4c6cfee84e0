"""Importance resampling against a plain version, and the table's probing."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from quern.llm.importance import BUCKETS, Interned, occurrences, resample

SCHEMA = "doc_id long, text string"


def features(text, grams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, grams=1, buckets=BUCKETS):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, grams)[1])
    t = Counter(bucket(f) for x in target for f in features(x, grams)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in docs:
        words, fs = features(text, grams)
        weight = sum(gain(bucket(f)) for f in fs) // max(1, len(fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def docs(n):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abéß字Z09"), rng.integers(1, 5)))
    return [(i, "".join(word() + str(rng.choice([" ", "-", "\n", "\0", "_"])) for _ in range(int(rng.integers(0, 60))))) for i in range(n)]


def test_same_rows_as_the_plain_version(spark):
    rows = [*docs(120), (None, "w " * 30), (500, None), (501, ""), (502, "x" * 50_000 + " y" * 4000), (503, "same " * 25), (504, "same " * 25), (504, "same " * 25)]
    target = [t for _, t in docs(9)] + [None]
    df, goal = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    for grams, buckets in ((1, BUCKETS), (3, 50)):
        got = sorted((tuple(r) for r in resample(df, goal, grams=grams, buckets=buckets).collect()), key=str)
        assert got == plain(rows, target, grams, buckets)


def test_equal_scores_take_every_rank_once(spark):
    df = spark.createDataFrame([(7, "a " * 20)] * 200, SCHEMA).repartition(5)
    got = [r["rank"] for r in resample(df, df).collect()]
    assert sorted(r for r in got if r) == list(range(1, 21)) and len(got) == 200


def test_empty_tables_and_further_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resample(none, none).collect() == []
    df = spark.createDataFrame([(1, "a b", 3, "r")], "doc_id long, text string, rank int, `row` string")
    assert resample(df, none).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [r["rank"] for r in resample(df, none).collect()] == [None]


def test_one_hash_for_all_still_tells_words_apart():
    texts = [b"a bb a ccc bb", b"", None, b"a"]
    raw, starts, ends, doc, words = occurrences(texts, 2)
    table = Interned(raw, starts, ends, 1000, hashed=lambda _: 3)
    grams = [raw[a:z] for a, z in zip(starts, ends)]
    assert grams == [b"a", b"bb", b"a", b"ccc", b"bb", b"a", b"a bb", b"bb a", b"a ccc", b"ccc bb"]
    assert words.tolist() == [5, 0, 0, 1] and doc.tolist() == [0] * 5 + [3] + [0] * 4
    of = {s: g for s, g in zip(table.slots.tolist(), grams)}
    assert len(of) == len(set(grams)) and all(of[s] == g for s, g in zip(table.slots.tolist(), grams))
    assert {of[s]: int(table.counts[s]) for s in of} == Counter(grams)
    assert all(table.buckets[s] == zlib.crc32(g) % 1000 for s, g in of.items())
