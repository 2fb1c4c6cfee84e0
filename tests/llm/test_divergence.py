"""The source audit against a plain version; prefixes, tiles and bitmaps."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import divergence as d

SCHEMA = "doc_id long, text string, lang string, source string"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows, least, top):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        ws = terms(text)
        held[lang or ""].update(set(ws))
        counts[lang or "", source or ""].update(ws)
    out = []
    for lang in held:
        keep = sorted(t for t, n in held[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in keep} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in keep}
        p = lambda g: {t: 1 + 10**9 * (g[t] + 2) // (sum(g.values()) + 2 * len(keep)) for t in keep}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        ps, q = {s: p(g) for s, g in groups.items()}, p(whole)
        for s, g in groups.items():
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in keep)) for o in groups if o != s]
            own = [(t, f(ps[s][t], q[t])) for t in keep if g[t] and ps[s][t] > q[t]]
            for part, rows_ in (("pair", pairs), ("term", own)):
                ranked = sorted(rows_, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows(n=150):
    rng = np.random.default_rng(3)
    words = ["a", "abcd", "abcdefgh", "abcdefghi", "Abcdefghijklmnop", "é", "éé", "ééééé", "字字", "x" * 40, "x" * 41, "x" * 300] + ["".join(rng.choice(list("abc"), 6)) for _ in range(40)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(0, 30)))) + str(rng.choice(["", ".", "1 b", "\0c"]))
        out.append((i, text, str(rng.choice(["en", "fr", ""])), f"s{rng.integers(0, 5)}"))
    return out + [(1, None, None, None), (1, "", "xx", "only"), (2, "a a", "yy", "p"), (2, "a a", "yy", "q"), (None, "B b", "en", "s1"), *[(9, "same words here", "en", "hot")] * 12]


@pytest.mark.parametrize("least,first,wide", [(10, 4, 512), (3, 1, 2)])
def test_same_rows_as_the_plain_version(spark, least, first, wide):
    data = rows()
    got = d.divergence(spark.createDataFrame(data, SCHEMA).repartition(5), least=least, first=first, top=4, wide=wide)
    assert sorted(map(tuple, got.collect())) == plain(data, least, 4)


@pytest.mark.parametrize("least,first", [(3, 1), (1, 3), (40, 2)])
def test_prefixes_keep_what_documents_hold(spark, least, first):
    data = rows()
    held = Counter(p for _, text, lang, _ in data for p in {(lang or "", t) for t in terms(text)})
    kept = d.kept_terms(d.bags(spark.createDataFrame(data, SCHEMA)), least, first, bits=1 << 15)
    got = kept.select("lang", F.col("term").cast("string").alias("term")).collect()
    assert sorted(map(tuple, got)) == sorted(p for p, n in held.items() if n >= least)


def test_empty_tables_and_further_columns(spark):
    assert d.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a", "en", "s", 5), (2, "b", "en", "t", 6)], SCHEMA + ", n int")
    assert sorted(map(tuple, d.divergence(df).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_tiles_of_sources():
    """Pairs in one tile, and pairs between two tiles, against all pairs of the terms that both hold."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    zero = rng.integers(1, 50, 4)
    p = {(t, s): int(rng.integers(1, 10**9)) for t in range(10) for s in range(4) if rng.random() < 0.6}
    f = lambda x, y: (x - y) ** 2 // (x + y)
    want, got = Counter(), Counter()
    for (t, a), x in p.items():
        for b in range(a + 1, 4):
            if (t, b) in p:
                y, za, zb = p[t, b], int(zero[a]), int(zero[b])
                want[a, b] += f(x, y) - f(x, zb) - f(za, y) + f(za, zb)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        part = sorted(("en", i, j, bytes([t]), s, x, int(zero[s])) for (t, s), x in p.items() if s // 2 in (i, j))
        batch = pa.record_batch(list(map(pa.array, zip(*part))), list("abcdefg"))
        for out in d._shared_sums(2, 3)(iter([batch])):
            got.update({(a, b): v for _, a, b, v in zip(*(c.to_pylist() for c in out.columns))})
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
