"""Tables of phrases against plain searches, and their cost as rules grow."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quern.operators.rules import Matcher, Rule, from_table, labels, rule_hits


def plain(rules, text):
    out = {}
    for i, r in enumerate(rules):
        side = r"[A-Za-z0-9]"
        pattern = re.escape(r.phrase)
        pattern = rf"(?<!{side}){pattern}(?!{side})" if r.word else pattern
        m = re.search(pattern, text, re.IGNORECASE if r.fold else 0)
        if m and r.phrase:
            out[i] = m.start()
    return out


def test_places_are_those_of_plain_searches():
    r = random.Random(1)
    piece = lambda n: "".join(r.choice("abAB 1-") for _ in range(n))
    for _ in range(100):
        rules = [Rule(piece(r.randint(0, 4)), "l", r.random() < 0.5, r.random() < 0.5) for _ in range(30)]
        text = piece(r.randint(0, 60))
        assert Matcher(rules).places(text) == plain(rules, text)


def test_longest_phrases_do_not_overlap():
    rules = [Rule("plant", "a", True), Rule("plant cell", "b", True), Rule("cell", "c", True), Rule("lant", "d"), Rule("Plant Cell", "e", True)]
    assert Matcher(rules).longest("Plant cells, the plant cell; a cell") == [(0, 0), (1, 17), (2, 31)]
    assert Matcher(rules).longest(None) == []


def test_rows_keep_their_columns_and_rules_their_order(spark):
    df = spark.createDataFrame([(1, "How many GENES", {"k": 1}), (2, None, None), (3, "", {})], "id long, t string, m map<string,int>")
    rules = [Rule("genes", "second"), Rule("how", "first", True), Rule("GENES", "second", fold=False), Rule("genes ", "none")]
    got = {r["id"]: r for r in rule_hits(df, F.col("t"), rules).withColumn("l", labels()).collect()}
    assert [tuple(h) for h in got[1]["hits"]] == [(0, "second", "genes", 9), (1, "first", "how", 0), (2, "second", "GENES", 9)]
    assert got[1]["l"] == ["second", "first"] and got[1]["m"] == {"k": 1} and got[2]["hits"] == [] == got[3]["hits"]


def test_tables_are_bounded(spark, monkeypatch):
    import quern.operators.rules as m

    df = spark.createDataFrame([(f"p{i}", "l") for i in range(5)], "phrase string, label string")
    assert [r.phrase for r in from_table(df)] == [f"p{i}" for i in range(5)]
    monkeypatch.setattr(m, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        rule_hits(df, F.col("phrase"), m.from_table(df))


def test_time_does_not_go_by_the_number_of_rules():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(50_000)]
    text = " ".join(r.choice("xyz") * 7 for _ in range(50_000))
    took = []
    for n in (50, 50_000):
        matcher = Matcher([Rule(w, "l", True) for w in words[:n]])
        began = time.time()
        assert matcher.places(text) == {}
        took.append(time.time() - began)
    assert took[1] < 5 * took[0] + 0.5
