"""Sections, chunks and their stored index, and near copies in order."""

import random
import re
import time

from pyspark.sql import functions as F

from quern.functions.chunking import by_sentence, kept_sections, merged, natural
from quern.functions.overlap import near_earlier

SKIP = "funding|abbreviations"


def plain_sections(lines):
    out, skipping = [], False
    for i, x in enumerate(lines):
        if re.fullmatch(f"[ \t]*({SKIP})[ \t]*", x, re.IGNORECASE):
            skipping = True
        elif i and re.match("[ \t]*[A-Z]", x) and len(x.strip(" ")) <= 61 and not lines[i - 1].strip(" "):
            skipping = False
        if not skipping:
            out.append(x)
    return out


def test_sections_go_up_to_the_next_heading(spark):
    r = random.Random(1)
    rows = [[r.choice(["", " ", "Funding", "abbreviations ", "Results", "Results of a line that is longer than any heading may be in a paper", "text", "  Methods"]) for _ in range(r.randint(0, 40))] for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in rows], "x array<string>").select(kept_sections(F.col("x"), SKIP).alias("k")).collect()
    assert [g["k"] for g in got] == [plain_sections(x) for x in rows]


def test_a_paper_of_a_hundred_thousand_lines(spark):
    lines = ["Funding", "a grant", "", "Results", "text"] * 20_000
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    began = time.time()
    n = df.select(F.size(kept_sections(F.split("t", "\n", -1), SKIP)).alias("n")).first()["n"]
    assert n == len(plain_sections(lines)) and time.time() - began < 30


def test_merging_and_packing(spark):
    def one(column):
        return spark.range(1).select(column.alias("c")).first()["c"]

    words = lambda *ns: F.array(*(F.lit("x" * n) for n in ns))
    assert [len(c) for c in one(merged(words(90, 300, 85), 200))] == [90 + 2 + 300 + 2 + 85]
    assert [len(c) for c in one(merged(words(90), 200))] == [90]
    assert [len(c) for c in one(merged(words(160, 250, 20), 150))] == [160, 250 + 2 + 20]
    assert one(merged(F.array().cast("array<string>"), 200)) == []
    text = F.lit("One two. Three! Four five six? " + "y" * 30 + ". End")
    assert one(by_sentence(text, 16)) == ["One two. Three!", "Four five six?", "y" * 30 + ".", "End"]
    whole = one(natural(F.lit("\n\n".join(["a" * 79, "b" * 80, "c" * 80, "d" * 81]))))
    assert whole == ["b" * 80 + "\n\n" + "c" * 80 + "\n\n" + "d" * 81]


def test_a_search_reads_its_folders_only(spark):
    from quern.operators.chunk_index import build, search

    docs = spark.createDataFrame([(i, f"Paragraph {i} speaks of gene{i} and of traits, at a length that makes it a paragraph of its own right here.") for i in range(300)] + [(900, None), (901, "short")], "doc_id long, text string")
    index = build(docs, F.col("text"))
    assert {r["scale"]: r["n"] for r in index.chunks.groupBy("scale").agg(F.count("*").alias("n")).collect()} == {s: 300 for s in ("fine", "std", "large", "para")}
    asked = spark.createDataFrame([(1, "para", "gene7"), (1, "para", "traits"), (2, "fine", "gene9"), (3, "para", "nothing")], "q int, scale string, term string")
    found = search(index, asked, "q", 2)
    assert sorted((r["q"], r["doc_id"], r["terms"]) for r in found.collect()) == [(1, 0, 1), (1, 7, 2), (2, 9, 1)]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "dynamicpruning" in scan and "bucket" in scan and "scale" in scan
    assert any("PushedFilters" in line and "In(term" in line for line in plan.splitlines())


def test_postings_of_changed_files_are_made_anew(spark, tmp_path):
    from quern.operators.ranking import lexical_index

    where = str(tmp_path / "documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for word in ("alpha", "beta"):
        spark.createDataFrame([(1, word, "en", "s", 5)], schema).write.mode("overwrite").parquet(where)
        assert [r["term"] for r in lexical_index(spark, str(tmp_path)).terms.collect()] == [word]
        time.sleep(1.1)


def test_near_copies_in_order():
    r = random.Random(2)
    for kept_only in (True, False):
        for _ in range(40):
            bags = [set(r.choices("abcdefghijkl", k=r.randint(0, 8))) for _ in range(30)]
            want, held = [], []
            for b in bags:
                near = any(len(b & h) > 0.7 * min(len(b), len(h)) for h in held)
                want.append(near)
                if not (near and kept_only):
                    held.append(b)
            assert near_earlier(bags, kept_only=kept_only) == want


def test_near_copies_of_a_paper_of_ten_thousand_chunks():
    r = random.Random(4)
    took = []
    for n in (2500, 10_000):
        bags = [{f"w{int(r.paretovariate(0.6)) % 20_000}" for _ in range(30)} for _ in range(n)]
        began = time.time()
        near_earlier(bags)
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1  # four times the chunks
