"""Stages of the corpus pipeline against plain versions."""

import random

from brute import SPACE, classes

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(5)


def jaccard_sets(text):
    words = SPACE.findall((text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Places of the rows that stay: of each class of similar texts, the smallest id, ids before nulls."""
    sets = [jaccard_sets(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = {}
    for i, c in classes(range(len(rows)), linked).items():
        groups.setdefault(c, []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = "new" + str(rng.randrange(1000))
    return " ".join(words)


def test_near_dedup_removes_edited_copies_as_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, near = [], 0
    for n in (25, 60, 150, 400, 900):
        for _ in range(12):
            base = rng.choices(vocabulary, k=n)
            rows.append((len(rows), " ".join(base)))
            for edits in (max(1, n // 100), max(1, n // 50), n // 12):
                rows.append((len(rows), edited(rng, base, edits)))
    rng.shuffle(rows)
    want = sorted(rows[i][0] for i in survivors(rows))
    assert len(want) < len(rows) - 60
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()) == want


def test_near_dedup_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == sorted(rows[i][0] for i in survivors(rows))


def test_verification_in_many_blocks(spark, monkeypatch):
    from quern.llm import jaccard_dedup

    rng = random.Random(4)
    base = rng.choices([f"w{i}" for i in range(500)], k=200)
    rows = [(i, edited(rng, base, 2)) for i in range(120)]
    for _ in range(60):  # a chain whose ends are far from its beginning
        rows.append((len(rows), edited(rng, rows[-1][1].split(), 1)))
    monkeypatch.setattr(jaccard_dedup, "GATHERED", 4000)
    got = jaccard_dedup.similar_texts(frame(spark, rows), "doc_id", tile=50).collect()
    sets = [jaccard_sets(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert {r["row"]: r["component"] for r in got} == classes(range(len(rows)), linked)


def test_near_dedup_of_nothing(spark):
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), "").collect() == []


def test_null_and_shared_ids_keep_their_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=60)) for _ in range(9)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (9, texts[4]), (8, texts[4]), (None, texts[5]), (None, texts[5]), (1, texts[6])]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[5]), (1, texts[6])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_mixing_takes_rows_of_null_and_shared_ids_once_an_epoch(spark):
    from quern.llm.mixing import mix

    rows = [(None, "a b c"), (None, "d e f g"), (5, "h i"), (5, "j k l"), (6, "m n o")]
    got = corpus_pipeline.mixing(spark, frame(spark, rows), "").collect()
    budget = int(mix(frame(spark, rows)).collect()[0]["target"] + 0.5)
    assert sum(len(r["text"].split()) for r in got) == budget >= 15
    assert {t for _, t in rows} <= {r["text"] for r in got}
    assert sorted({str(r["doc_id"]) for r in got}) == ["5", "6", "None"]


def run_stages(spark, docs, sf_dir):
    """[(name, rows in, rows out)] with every stage written and read again, as run() does."""
    from quern.llm.shared import written

    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir))
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_each_stage_against_a_plain_version(spark, small):
    """A run on the small table, with odd rows added, stage by stage."""
    import duckdb

    from quern.llm import quality_rules
    from quern.llm.mixing import mix
    from quern.llm.pii import all_spans, learn, masked
    from test_packing import check

    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = docs.where("n_chars > 600").limit(3).collect()
    odd = [(None, some[0]["text"], "en", None, 5), (some[1]["doc_id"], some[2]["text"] + " and more words than before", None, "s", 5), (900_001, None, "en", "s", None), (900_002, "", "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    stages = {n: (a, b) for n, a, b in run_stages(spark, docs, small)}
    assert all(r.asDict().keys() == set(docs.columns) for n, (a, _) in stages.items() for r in a[:1])
    text_of = lambda rows: sorted((str(r["doc_id"]), r["text"]) for r in rows)

    before, after = stages["quality"]
    con = duckdb.connect()
    con.register("documents", docs.select(*docs.columns[:4]).toPandas())
    rejected = sorted((str(i) if i == i and i is not None else "None") for (i,) in con.execute(f"select cast(doc_id as bigint) from ({quality_rules.ORACLE_SQL}) where not kept").fetchall())
    assert sorted([str(r["doc_id"]) for r in after] + rejected) == sorted(str(r["doc_id"]) for r in before)

    before, after = stages["simhash_near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    assert text_of(after) == sorted((str(rows[i][0]), rows[i][1]) for i in survivors(rows))

    before, after = stages["pii"]
    frame_of = spark.createDataFrame(before, docs.schema)
    texts = [r["text"] for r in before]
    spans = all_spans(learn(frame_of), texts)
    want = [masked(t, s) for t, (_, s) in zip(texts, spans, strict=True)]
    assert text_of(after) == sorted((str(r["doc_id"]), t) for r, t in zip(before, want, strict=True)) and any("[" in t for t in want)
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = stages["mixing"]
    goals = {r["source"]: (r["source_size"], round(r["target"])) for r in mix(spark.createDataFrame(before, docs.schema)).collect()}
    taken, known = {}, {(str(r["doc_id"]), r["source"]): [] for r in before}
    for r in before:
        known[str(r["doc_id"]), r["source"]].append(SPACE.findall(r["text"]))
    for r in after:
        words = SPACE.findall(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(words)
        assert any(w[: len(words)] == words for w in known[str(r["doc_id"]), r["source"]])
    assert taken == {s: t for s, (_, t) in goals.items() if t}

    before, after = stages["packing"]
    check([(r["doc_id"], r["text"]) for r in before], after, 2048)


def test_stages_of_nothing_and_of_clashing_names(spark, small):
    schema = COLUMNS + ", __q_words int, row_key int, w int, size_ int, k string, h string"
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == [], name
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(500)], k=60)), "en", "s", 5, 1, 2, 3, 4, "k", "h") for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and {(r["row_key"], r["__q_words"], r["k"]) for r in out.collect()} == {(2, 1, "k")}, name
