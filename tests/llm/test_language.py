"""Language identification: held-out rows, alphabets of any size, and rows of all kinds."""

import random
from collections import Counter

from quern.llm.language_id import identify, op8_language_id, profiles


def test_held_out_rows_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = [r["lang"] == r["lang_pred"] for r in op8_language_id(spark, d).where("held_out").join(known, "doc_id").collect()]
    assert sum(got) >= 0.98 * len(got) > 200


def test_alphabets_of_1500_letters(spark):
    r = random.Random(1)
    letters = {"a": [chr(0x4E00 + i) for i in range(1500)], "b": [chr(0x6000 + i) for i in range(1500)]}
    rows = [(i, "".join(r.choice(letters["ab"[i % 2]]) for _ in range(60)), "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(df.where("doc_id >= 400"), profiles(df.where("doc_id < 400"))).collect()
    assert all(x["lang_pred"] == "ab"[x["doc_id"] % 2] for x in got)


def test_rows_of_all_kinds(spark):
    rows = [(1, "the words of the text", "en", "x"), (1, "the words of the text", "en", "x"), (2, "der text und die worte", "de", "x"), (3, None, "en", "x"), (4, "", "de", "x"), (5, "123 !?", "en", "x"), (None, "the text of words", None, "x"), (6, "the words " * 50_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string")
    got = sorted((str(r["doc_id"]), r["lang_pred"], 0 <= r["score"] <= 1) for r in identify(df, profiles(df)).collect())
    assert got == [("1", "en", True), ("1", "en", True), ("2", "de", True), ("3", "und", True), ("4", "und", True), ("5", "und", True), ("6", "en", True), ("None", "en", True)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(empty, profiles(empty)).collect() == [] and {r["lang_pred"] for r in identify(df, {}).collect()} == {"und"}


def plain_grams(text):
    """N-grams as tuples of letters, 0 for a break between words."""
    letters = [0]
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
        elif letters[-1]:
            letters.append(0)
    letters += [0] if letters[-1] else []
    one = [(c,) for c in letters if c]
    return one + list(zip(letters, letters[1:])) + [g for g in zip(letters, letters[1:], letters[2:]) if g[1]]


def plain_profile(texts, size):
    n = Counter(g for t in texts for g in plain_grams(t))
    return sorted(n, key=lambda g: (-n[g], len(g), g))[:size]


def test_out_of_place_distances_are_those_of_a_plain_version(spark):
    r = random.Random(5)
    size = 40
    words = {"en": ["the", "of", "and", "a", "in"], "de": ["der", "und", "die", "é", "in"], "xx": ["字字", "字", "a", "of"]}
    rows = [(i, " ".join(r.choice(words[w]) for _ in range(r.randint(1, 12))) + r.choice(["", "!", " 12", "\n\n"]), w) for i, w in enumerate(r.choice(list(words)) for _ in range(120))]
    rows += [(500, "word " * 30_000 + "the", "en"), (501, "a", "en"), (502, "a", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = {w: plain_profile([t for _, t, x in rows if x == w], size) for w in words}
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify(df, profiles(df, size=size), size=size).collect()}
    for i, text, _ in rows:
        own = plain_profile([text], size)
        out = {w: sum(abs(known[w].index(g) - k) if g in known[w] else size for k, g in enumerate(own)) / (size * len(own)) for w in sorted(words)}
        best = min(sorted(out), key=lambda w: out[w])
        nearest = min(v for w, v in out.items() if w != best)
        assert got[i] == (best, round(min(1, max(0, 0.5 + (nearest - out[best]) / (2 * max(nearest, 1e-9)))), 9))
