import random

import numpy as np
import pytest
from brute import classes, lpf, removed, simhash

from quern.llm.simhash_dedup import boxes, near_duplicates, op7_simhash_dedup
from quern.llm.suffix_anchors import sliding_min
from quern.llm.suffix_dedup import longest_previous_factor, op1_suffix_dedup, ordered_repeats, remove_repeats


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def hard_documents():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ñ\n") for _ in range(n))
    shared, tail = text(260), text(199)
    docs = [text(300), shared, text(150) + shared + text(90), text(77) + shared[:230], shared[31:] + text(40), tail + text(50), text(60) + tail, "", None, "x" * 700, "ab" * 300, "short"]
    docs += [docs[0], docs[0] + "!", text(400) + docs[0], "x" * 199, "x" * 200]
    docs += [text(rng.randrange(0, 130)) + shared[:rng.randrange(190, 260)] + text(rng.randrange(0, 130)) for _ in range(40)]
    long = text(5000)
    docs += [long, long[:2500] + text(1) + long[2500:], long[1000:1900] + long[3000:3300]]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("min_len", "limit"), [(200, 256), (64, 256), (200, 2), (64, 1)])
def test_repeats_match_brute_force(spark, min_len, limit):
    docs = hard_documents()
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], "doc_id long, text string, s string, n int, k long, h long").repartition(5)
    got = rows_of(remove_repeats(df, min_len=min_len, keep_first=False, limit=limit))
    want = removed(docs, min_len)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


@pytest.mark.parametrize("limit", [256, 1])
def test_keep_first_leaves_the_earliest_copy(spark, limit):
    docs = [(i, t) for i, t in hard_documents() if t]
    got = rows_of(remove_repeats(spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3), keep_first=True, limit=limit))
    seen, want = set(), {}
    for i, t in docs:
        raw, gone = t.encode(), 0
        mask = bytearray(len(raw))
        for p in range(len(raw) - 199):
            if raw[p : p + 200] in seen:
                mask[p : p + 200] = b"\1" * 200
            seen.add(raw[p : p + 200])
        want[i] = sum(mask)
    assert {i: r["n_removed"] for i, r in got.items()} == want


def test_repeats_on_the_small_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op1_suffix_dedup(spark, small))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == removed(docs, 200)


def test_repeats_with_null_and_shared_ids(spark):
    rng = random.Random(6)
    passage, other = ("".join(rng.choices("abcdef ", k=400)) for _ in range(2))
    rows = [(None, "x" + passage), (2, passage), (3, "y" * 3 + other), (3, other + "z"), (3, None), (None, "alone " * 3), (4, "".join(rng.choices("ghijkl ", k=900)))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep_first=False, keep_text=False).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == [(-1, 18, 0), (-1, 401, 400), (2, 400, 400), (3, 0, 0), (3, 401, 400), (3, 403, 400), (4, 900, 0)]
    first = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True, keep_text=False).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in first) == [(-1, 0), (-1, 400), (2, 0), (3, 0), (3, 0), (3, 400), (4, 0)]


def test_order_decides_in_both_modes():
    rng = random.Random(3)
    for _ in range(40):
        min_len, base = rng.choice([41, 50, 64]), bytes(rng.choices(b"ab", k=300))
        pieces = []
        for row in range(rng.randint(1, 8)):
            n, a = rng.randint(1, 60), rng.randint(0, 150)
            b = bytearray(base[a : a + n + min_len - 1])
            b[rng.randrange(len(b))] = 99
            pieces.append((rng.randrange(3), row, a, n, bytes(b)))
        places = {}
        for i, row, s, n, b in pieces:
            for p in range(n):
                places.setdefault(b[p : p + min_len], []).append((i, row, s + p))
        for keep_first in (False, True):
            want = {p[1:] for x in places.values() if len(x) > 1 for p in sorted(x)[keep_first:]}
            assert {(row, s + i) for row, s, n in ordered_repeats(pieces, min_len, keep_first) for i in range(n)} == want


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = remove_repeats(spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == [(0, 1, 0), (1, 0, 0), (1, 0, 0)]


def test_longest_previous_factor():
    for raw in (b"", b"a", b"aaaaa", b"banana", b"abcabcabx", bytes(random.Random(1).choices(b"ab", k=120))):
        assert longest_previous_factor(np.frombuffer(raw, np.uint8)).tolist() == lpf(raw)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 777).astype(np.uint64)
    for w in (1, 5, 137, 777):
        assert sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]


def check_simhash(df, rows):
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    prints = {i: simhash(t) for i, t in rows}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == prints
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == classes(ids, linked)


def test_simhash_matches_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    base = [rng.choice("alpha Beta gamma delta eps zeta eta".split()) + str(rng.randrange(50)) for _ in range(300)]
    for i in range(60):
        words = list(base)
        words[rng.randrange(300)] = "new"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "ONE"), (20_004, "a b c"), (20_005, "\t\n ")]
    check_simhash(spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, rep int, fp string").repartition(6), rows)


def test_simhash_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_simhash_tiles_of_any_size(spark):
    from quern.llm.shared import components
    from quern.llm.simhash_dedup import links

    rng = random.Random(9)
    fps = {0, 1, 3, (1 << 63), (1 << 64) - 1}
    while len(fps) < 700:
        f = rng.getrandbits(64)
        fps.add(f)
        fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    want = classes(range(len(rows)), [(i, j) for f, i in rows for g, j in rows if i < j and ((f ^ g) & (1 << 64) - 1).bit_count() <= 4])
    for tile in (7, 100, 5000):
        got = {r["id"]: r["component"] for r in components(links(spark.createDataFrame(rows, "fp long, rep long"), tile=tile)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_simhash_of_null_and_shared_ids(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "other words stand here now"), (None, "alone in the world today"), (7, None), (None, ""), (8, "A b c d E")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 5), (5, 5), (5, 5), (None, None), (7, 7), (None, 7), (8, 5)]))


def test_boxes_hold_all_and_stay_small():
    r = np.random.default_rng(2)
    points, weight = r.integers(0, 17, (800, 4)), r.integers(1, 50, 800)
    tile = boxes(points, weight, 300)
    sums = np.bincount(tile, weight)
    assert sums.sum() == weight.sum() and all(w <= 300 or len(np.unique(points[tile == t], axis=0)) == 1 for t, w in enumerate(sums))


def test_op7_columns(spark, small):
    assert op7_simhash_dedup(spark, small).columns == ["doc_id", "fingerprint", "component_id"]
