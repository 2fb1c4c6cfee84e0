"""The threshold of op4 above and below the bound of its sample."""

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quern.llm.toxicity import CUTOFF, WINDOW, fit_logistic, learn, score


def test_weights_are_copies():
    r = np.random.default_rng(1)
    x, n = r.normal(size=(300, 3)), r.integers(1, 6, 300)
    y = (x[:, 0] + r.normal(size=300) > 1).astype(float)
    weighted, copied = fit_logistic(x, y, n.astype(float)), fit_logistic(np.repeat(x, n, axis=0), np.repeat(y, n))
    for a, b in zip(weighted, copied, strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_predictions_agree_above_and_below_the_sample(spark):
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(2200):
        toxic = i % 11 == 0
        text = list(r.choice(words, 40))
        for at in range(r.binomial(4, 0.6) if toxic else r.binomial(2, 0.06)):
            text[at * 9] = "venomous" if r.random() < 0.5 else "hatefully"
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    whole, part = (score(docs, learn(docs, labels, sample=n)).select("doc_id", F.col("score").alias(f"s{n}")) for n in (4000, 200))
    got = [(a >= CUTOFF, b >= CUTOFF, a, b) for _, a, b in whole.join(part, "doc_id").collect()]
    assert sum(a != b for a, b, *_ in got) <= 0.02 * len(got)
    assert abs(np.mean([a for *_, a, b in got]) - np.mean([b for *_, a, b in got])) < 0.03


SCHEMA = "doc_id long, text string"


def plain_score(text, model):
    """Windows of words, each compressed alone with the ordinary dictionary and with both."""
    (toxic, ordinary, level), (mean, spread, w) = model
    words = (text or "").lower().encode("utf-8", "replace").split()
    saved = []
    for at in range(0, len(words), WINDOW):
        window, sizes = b" " + b" ".join(words[at : at + WINDOW]), []
        for content in (ordinary, toxic + ordinary):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window)))
        saved.append(sizes[0] - sizes[1])
    first, second = (sorted(saved, reverse=True) + [0, 0])[:2]
    total = sum(s for s in saved if s > 0)
    x = np.array([min(first, 10), min(second, 10), np.log1p(total), 10 * total / (len(saved) + 5), np.log1p(len(saved))])
    return 1 / (1 + np.exp(-(np.append((x - mean) / spread, 1) @ w)))


def labelled(spark, n=400):
    r = np.random.default_rng(3)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*r.choice(words, 30), *(["venomous"] * 2 if i % 5 == 0 else [])]), int(i % 5 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA + ", toxic int").repartition(3)
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_scores_are_those_of_a_plain_version(spark):
    docs, labels = labelled(spark)
    model = learn(docs, labels)
    more = [(1000, None), (1001, ""), (None, "venomous words"), (1002, "venomous " + "word7 " * 60_000), (1003, "word1 word2"), (1003, "word1 word2"), (1004, "ÄÖ 字 \0 venomous")]
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in score(df, model).collect())
    assert got == sorted((str(r["doc_id"]), round(float(plain_score(r["text"], model)), 9)) for r in df.collect())


def test_learning_meets_ids_and_texts_of_all_kinds(spark):
    docs, labels = labelled(spark, 200)
    docs = docs.unionByName(spark.createDataFrame([(0, None), (500, ""), (501, None), (None, "x"), (7, "y")], SCHEMA)).withColumn("toxic", F.lit(3)).withColumn("check", F.lit("c"))
    both = labels.unionByName(spark.createDataFrame([(1, 1), (5, 0), (None, 1), (500, 1), (501, 0), (9, None), (8, 2)], "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in score(docs.where("doc_id < 200"), learn(docs, both)).collect()}
    toxic, others = ([s for i, s in scores.items() if (i % 5 == 0) == k] for k in (True, False))
    assert all(0 <= s <= 1 for s in scores.values()) and np.mean(toxic) > np.mean(others)


def test_labels_of_one_kind_and_empty_tables(spark):
    docs, labels = labelled(spark, 60)
    for some in (labels.where("toxic = 0"), labels.where("toxic = 1"), labels.limit(0)):
        assert {r["score"] for r in score(docs, learn(docs, some)).collect()} == {0.0}
    model = learn(docs, labels)
    assert score(docs.limit(0), model).collect() == [] and score(docs, learn(docs.limit(0), labels)).count() == 60

