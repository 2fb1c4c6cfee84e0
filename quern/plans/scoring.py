"""Evaluation of searches and answers: ranked papers with grades, gains, averages, key points, claims, nuggets and their join."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quern.operators.ranking import top_k
from quern.plans.fusion import _RANKED, reranked
from quern.plans.registry import registry
from quern.plans.retrieval import _CORPUS, _NEAREST, _nearest, _scores
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

#: Three vectors are a paper; a paper's grade for a label is 2 if a vector of even number in it has the label, 1 for an odd one.
_GRADED = f"""{_NEAREST}, gd AS (SELECT label, vec_id // 3 AS paper, max(CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END) AS grade FROM embeddings GROUP BY ALL),
pp AS (SELECT query_id, query_label, vec_id // 3 AS paper, min(rank) AS rank FROM k WHERE rank <= 20 GROUP BY ALL),
pr AS (SELECT query_id, query_label, coalesce(grade, 0) AS grade, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM pp LEFT JOIN gd ON gd.label = pp.query_label AND gd.paper = pp.paper),
pi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, r) AS ideal, count(*) OVER (PARTITION BY query_id) AS n FROM pr),
tr AS (SELECT label AS query_label, count(*) AS relevant FROM gd GROUP BY label),
em AS (SELECT query_id, {', '.join(f"round(least(1, count(*) FILTER (grade > 0 AND r <= {k}) / greatest(1, max(relevant))::DOUBLE), 6) AS recall{k}" for k in (5, 10, 20))},
 {', '.join(f"round(count(*) FILTER (grade > 0 AND r <= {k}) / greatest(1, least({k}, max(n)))::DOUBLE, 6) AS precision{k}" for k in (5, 10))}, round(coalesce(1.0::DOUBLE / min(CASE WHEN grade > 0 THEN r END), 0), 6) AS mrr,
 {', '.join(f"round(CASE WHEN sum(CASE WHEN ideal <= {k} THEN grade / log2(ideal + 1) END) > 0 THEN sum(CASE WHEN r <= {k} THEN grade / log2(r + 1) END) / sum(CASE WHEN ideal <= {k} THEN grade / log2(ideal + 1) END) ELSE 0 END, 6) AS ndcg{k}" for k in (5, 10))},
 CAST(max(n) AS BIGINT) AS retrieved FROM pi JOIN tr USING (query_label) GROUP BY query_id)"""


def _metrics(spark, d):
    v = read(spark, d, "embeddings")
    paper = lambda c: F.floor(F.col(c) / 3)
    grades = v.groupBy(F.col("label").alias("query_label"), paper("vec_id").alias("paper")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, 2).otherwise(1)).alias("grade"))
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    first = _nearest(spark, d, 20).join(asked, "query_id").groupBy("query_id", "query_label", paper("vec_id").alias("paper")).agg(F.min("rank").alias("rank"))
    ranked = first.join(grades, ["query_label", "paper"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    mine = Window.partitionBy("query_id")
    ranked = ranked.withColumn("r", F.row_number().over(mine.orderBy("rank"))).withColumns({"ideal": F.row_number().over(mine.orderBy(F.desc("grade"), "r")), "n": F.count("*").over(mine)})
    ranked = ranked.join(grades.groupBy("query_label").agg(F.count("*").alias("relevant")), "query_label")
    good = lambda k: F.count_if((F.col("grade") > 0) & (F.col("r") <= k))
    gain = lambda at, k: F.coalesce(F.sum(F.when(F.col(at) <= k, F.col("grade") / F.log2(F.col(at) + 1))), F.lit(0.0))
    out = [F.round(F.least(F.lit(1.0), good(k) / F.greatest(F.lit(1), F.max("relevant")).cast("double")), 6).alias(f"recall{k}") for k in (5, 10, 20)]
    out += [F.round(good(k) / F.greatest(F.lit(1), F.least(F.lit(k), F.max("n"))).cast("double"), 6).alias(f"precision{k}") for k in (5, 10)]
    out.append(F.round(F.coalesce(1.0 / F.min(F.when(F.col("grade") > 0, F.col("r"))), F.lit(0.0)), 6).alias("mrr"))
    out += [F.round(F.when(gain("ideal", k) > 0, gain("r", k) / gain("ideal", k)).otherwise(0.0), 6).alias(f"ndcg{k}") for k in (5, 10)]
    return ranked.groupBy("query_id").agg(*out, F.max("n").alias("retrieved"))


@query(f"{_GRADED} SELECT * FROM em")
def eval_ndcg(spark, d):
    """Recall, precision, reciprocal rank and gains of ranked papers; the ideal order is that of the grades found."""
    return _metrics(spark, d)


_MEASURES = ("recall5", "recall10", "recall20", "precision5", "precision10", "mrr", "ndcg5", "ndcg10")


@query(f"{_GRADED} SELECT count(*) AS questions, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _MEASURES)} FROM em")
def eval_macro(spark, d):
    return _metrics(spark, d).agg(F.count("*").alias("questions"), *(F.round(F.avg(m), 6).alias(m) for m in _MEASURES))


#: Scorers with parts left out: weights of the dense, lexical and remaining parts of the final score.
_CONFIGS = (("full", 1.0, 1.0, 1.0), ("dense_only", 1.0, 0.0, 0.0), ("lexical_only", 0.0, 1.0, 0.0), ("no_bonus", 1.0, 1.0, 0.0), ("no_lexical", 1.0, 0.0, 1.0), ("half_lexical", 1.0, 0.5, 1.0), ("half_bonus", 1.0, 1.0, 0.5))
_VARIED = "round(-a * cos - b * 0.25{d} * lex + c * (final - fused), 6)"


@query(f"""{_RANKED}, cf(config, a, b, c) AS (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in _CONFIGS)}),
x AS (SELECT config, item_id, source, {_VARIED.format(d='::DOUBLE')} AS f, row_number() OVER (PARTITION BY config, item_id ORDER BY {_VARIED.format(d='::DOUBLE')}, doc_id) AS r FROM rr, cf)
SELECT config, count(DISTINCT item_id) AS items, round(avg(f), 4) AS mean_top5, count(DISTINCT source) AS sources FROM x WHERE r <= 5 GROUP BY config""")
def eval_ablation(spark, d):
    """The top five of each question under seven scorers, whose weights are real parameters; the few configurations ride on each hit."""
    configs = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in _CONFIGS)))
    x = reranked(spark, d).select("item_id", "doc_id", "source", "cos", "lex", "fused", "final", configs.alias("k")).select("*", "k.*").withColumn("f", F.expr(_VARIED.format(d="D")))
    return top_k(x, ["config", "item_id"], [F.asc("f"), F.asc("doc_id")], 5).groupBy("config").agg(F.count_distinct("item_id").alias("items"), F.round(F.avg("f"), 4).alias("mean_top5"), F.count_distinct("source").alias("sources"))


_TOP = f"WITH {_CORPUS}, tp AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"


def _top(spark, d, k):
    return top_k(_scores(spark, d, k), ["item_id"], [F.desc("score"), F.asc("doc_id")], k).select("item_id", "doc_id")


@query(f"""{_TOP}, kp AS (SELECT item_id, list_filter(string_split(lower(text), '. '), lambda x: length(x) > 20) AS kps FROM benchmark),
cv AS (SELECT item_id, CASE WHEN len(kps) = 0 THEN 0 ELSE len(list_filter(kps, lambda x: contains(lower(documents.text), x))) / len(kps)::DOUBLE END AS share FROM tp JOIN kp USING (item_id) JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT item_id, round(max(share), 6) AS best, round(avg(share), 6) AS mean FROM cv GROUP BY item_id""")
def eval_keypoint_topk(spark, d):
    """The share of a question's key points that each of its first five papers holds: the largest and the mean."""
    kps = read(spark, d, "benchmark").select("item_id", F.filter(F.split(F.lower("text"), r"\. ", -1), lambda x: F.length(x) > 20).alias("kps"))
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    hit = F.size(F.filter("kps", lambda x: F.col("t").contains(x)))
    share = F.when(F.size("kps") == 0, 0.0).otherwise(hit / F.size("kps").cast("double"))
    c = _top(spark, d, 5).join(kps, "item_id").join(docs, "doc_id").select("item_id", share.alias("share"))
    return c.groupBy("item_id").agg(F.round(F.max("share"), 6).alias("best"), F.round(F.avg("share"), 6).alias("mean"))


@query(f"""{_TOP}, tt AS (SELECT item_id, doc_id, source, n_chars FROM tp JOIN documents USING (doc_id) WHERE rank <= 10), rel AS (SELECT item_id, 'src' || (item_id % 20) AS source FROM benchmark WHERE item_id % 4 <> 0 UNION SELECT item_id, 'src' || (item_id * 7 % 20) FROM benchmark WHERE item_id % 4 <> 0)
SELECT item_id, round(max(hits) / max(truth)::DOUBLE, 6) AS recall, round(count(DISTINCT source) / count(*)::DOUBLE, 6) AS diversity, round(avg(n_chars), 4) AS mean_chars
FROM tt LEFT JOIN (SELECT r.item_id, count(*) AS truth, count(*) FILTER (EXISTS (SELECT 1 FROM tt WHERE tt.item_id = r.item_id AND tt.source = r.source)) AS hits FROM rel r GROUP BY r.item_id) USING (item_id) GROUP BY item_id""")
def eval_diversity(spark, d):
    """Recall of the relevant papers (null where none is known), different sources among the hits, and their mean length."""
    hits = _top(spark, d, 10).join(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    named = lambda x: F.concat(F.lit("src"), x.cast("string"))
    b = read(spark, d, "benchmark").where("item_id % 4 <> 0")
    rel = b.select("item_id", F.explode(F.array_distinct(F.array(named(F.col("item_id") % 20), named(F.col("item_id") * 7 % 20)))).alias("source"))
    found = rel.join(hits.select("item_id", "source", F.lit(1).alias("hit")).distinct(), ["item_id", "source"], "left").groupBy("item_id").agg((F.count("hit") / F.count("*").cast("double")).alias("recall"))
    g = hits.groupBy("item_id").agg((F.count_distinct("source") / F.count("*").cast("double")).alias("diversity"), F.avg("n_chars").alias("mean_chars"))
    return g.join(found, "item_id", "left").select("item_id", F.round("recall", 6).alias("recall"), F.round("diversity", 6).alias("diversity"), F.round("mean_chars", 4).alias("mean_chars"))


#: Sentences and words, and how much of a sentence's words another text must hold.
_SENTENCES = lambda x: f"list_filter(string_split({x}, '. '), lambda z: length(z) > 3)"
_WORDS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z]+'))"
_SHARE = "len(list_intersect({a}, {b})) / greatest(1, len({a}))::DOUBLE"
_TALKS = f"""tk AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text END, '. ' ORDER BY turn, text) AS answer, string_agg(CASE WHEN role <> 'assistant' THEN text END, '. ' ORDER BY turn, text) AS context, count(*) FILTER (role <> 'assistant') AS chunks FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
cl AS (SELECT conv_id, list_transform({_SENTENCES("coalesce(answer, '')")}, lambda z: {_SHARE.format(a=_WORDS('z'), b=_WORDS("coalesce(context, '')"))}) AS cs, list_transform({_SENTENCES("coalesce(context, '')")}, lambda z: {_SHARE.format(a=_WORDS('z'), b=_WORDS("coalesce(answer, '')"))}) AS ns, chunks FROM tk)"""


def _talks(spark, d):
    """(conv_id, cs, ns, chunks): how much of each claim (sentence of the answers) the context holds, and of each nugget the answers."""
    c = read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text", (F.col("role") == "assistant").alias("own"))
    said = lambda own: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("own") == own, F.struct("turn", "text")))), lambda r: r["text"]), ". ")
    t = c.groupBy("conv_id").agg(said(True).alias("answer"), said(False).alias("context"), F.count_if(~F.col("own")).alias("chunks"))
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), 0))

    def shares(text: str, other: str) -> Column:
        return F.transform(F.filter(F.split(text, r"\. ", -1), lambda z: F.length(z) > 3), lambda z: F.size(F.array_intersect(words(z), F.col(other))) / F.greatest(F.lit(1), F.size(words(z))).cast("double"))

    t = t.withColumns({"aw": words(F.col("answer")), "cw": words(F.col("context"))})
    return t.select("conv_id", shares("answer", "cw").alias("cs"), shares("context", "aw").alias("ns"), "chunks")


def _share_of(items: str, low: float, high: float) -> Column:
    """The number of items in [low, high)."""
    return F.size(F.filter(items, lambda z: (z >= low) & (z < high)))


_COUNT = lambda items, low, high: f"len(list_filter({items}, lambda z: z >= {low} AND z < {high}))"


@query(f"""WITH {_TALKS} SELECT conv_id, CAST(len(cs) AS BIGINT) AS claims, round(({_COUNT('cs', 0.5, 2)} + 0.5::DOUBLE * {_COUNT('cs', 0.2, 0.5)}) / greatest(1, len(cs)), 6) AS precision, round({_COUNT('cs', 0, 0.2)} / greatest(1, len(cs))::DOUBLE, 6) AS hallucination,
 round({_COUNT('cs', 0.2, 2)} / greatest(1, len(cs))::DOUBLE, 6) AS utilization FROM cl WHERE len(cs) > 0""")
def eval_claim_verdicts(spark, d):
    """Claims that the context supports (half of their words), supports in part, or does not."""
    n = F.greatest(F.lit(1), F.size("cs")).cast("double")
    t = _talks(spark, d).where("size(cs) > 0")
    return t.select("conv_id", F.size("cs").cast("long").alias("claims"), F.round((_share_of("cs", 0.5, 2) + 0.5 * _share_of("cs", 0.2, 0.5)) / n, 6).alias("precision"), F.round(_share_of("cs", 0, 0.2) / n, 6).alias("hallucination"), F.round(_share_of("cs", 0.2, 2) / n, 6).alias("utilization"))


@query(f"""WITH {_TALKS} SELECT conv_id, CAST(len(ns) AS BIGINT) AS nuggets, round(({_COUNT('ns', 0.6, 2)} + 0.5::DOUBLE * {_COUNT('ns', 0.3, 0.6)}) / greatest(1, len(ns)), 6) AS recall, CASE WHEN chunks > 0 THEN round(least(1, len(ns) / (chunks * 3)::DOUBLE), 6) END AS context_precision FROM cl WHERE len(ns) > 0""")
def eval_nuggets(spark, d):
    """Nuggets (sentences of the context) that the answers cover, in whole or part, and how many there are for each chunk."""
    n = F.greatest(F.lit(1), F.size("ns")).cast("double")
    t = _talks(spark, d).where("size(ns) > 0")
    precision = F.when(F.col("chunks") > 0, F.round(F.least(F.lit(1.0), F.size("ns") / (F.col("chunks") * 3).cast("double")), 6))
    return t.select("conv_id", F.size("ns").cast("long").alias("nuggets"), F.round((_share_of("ns", 0.6, 2) + 0.5 * _share_of("ns", 0.3, 0.6)) / n, 6).alias("recall"), precision.alias("context_precision"))


_RECORDS = f"""qx AS (SELECT DISTINCT conv_id FROM conversations), raw AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'timeout' END AS error FROM qx WHERE conv_id % 13 <> 1),
nug AS (SELECT conv_id, len(ns) AS nuggets, chunks FROM cl WHERE len(ns) > 0), clm AS (SELECT conv_id, len(cs) AS claims FROM cl WHERE len(cs) > 0),
vrd AS (SELECT conv_id, ({_COUNT('cs', 0.5, 2)} + 0.5::DOUBLE * {_COUNT('cs', 0.2, 0.5)}) / len(cs) AS precision, {_COUNT('cs', 0, 0.2)} / len(cs)::DOUBLE AS hallucination FROM cl WHERE len(cs) > 0 AND conv_id % 7 <> 2),
cov AS (SELECT conv_id, ({_COUNT('ns', 0.6, 2)} + 0.5::DOUBLE * {_COUNT('ns', 0.3, 0.6)}) / len(ns) AS recall FROM cl WHERE len(ns) > 0 AND conv_id % 5 <> 3), rel AS (SELECT conv_id, conv_id % 6 AS relevance FROM qx)"""


@query(f"""WITH {_TALKS}, {_RECORDS}, j AS (SELECT conv_id, error, coalesce(nuggets, 0) AS nuggets, coalesce(claims, 0) AS claims, chunks, coalesce(precision, 0) AS p, coalesce(hallucination, 0) AS h, coalesce(recall, 0) AS r, relevance, error IS NOT NULL OR (nuggets IS NULL AND claims IS NULL) AS stops
 FROM qx LEFT JOIN raw USING (conv_id) LEFT JOIN nug USING (conv_id) LEFT JOIN clm USING (conv_id) LEFT JOIN vrd USING (conv_id) LEFT JOIN cov USING (conv_id) LEFT JOIN rel USING (conv_id))
SELECT conv_id, error, CASE WHEN error IS NULL THEN nuggets ELSE 0 END AS nuggets, CASE WHEN error IS NULL THEN claims ELSE 0 END AS claims, round(CASE WHEN stops THEN 0 ELSE p END, 6) AS precision, round(CASE WHEN stops THEN 0 ELSE h END, 6) AS hallucination, round(CASE WHEN stops THEN 0 ELSE r END, 6) AS recall,
 round(CASE WHEN stops OR chunks IS NULL OR chunks = 0 THEN 0 ELSE least(1, nuggets / (chunks * 3)::DOUBLE) END, 6) AS context_precision, round(CASE WHEN stops OR p + r = 0 THEN 0 ELSE 2 * p * r / greatest(0.001::DOUBLE, p + r) END, 6) AS f1, round(CASE WHEN stops OR relevance = 0 THEN 0 ELSE relevance / 5.0::DOUBLE END, 6) AS relevance FROM j""")
def eval_join(spark, d):
    """All records of a question side by side: questions with an error, or without claims and nuggets, keep zeros."""
    t = _talks(spark, d)
    asked = read(spark, d, "conversations").select("conv_id").distinct()
    raw = asked.where("conv_id % 13 <> 1").select("conv_id", F.when(F.col("conv_id") % 11 == 0, "timeout").alias("error"))
    some_n, some_c = t.where("size(ns) > 0"), t.where("size(cs) > 0")
    nug = some_n.select("conv_id", F.size("ns").cast("long").alias("nuggets"), "chunks")
    clm = some_c.select("conv_id", F.size("cs").cast("long").alias("claims"))
    vrd = some_c.where("conv_id % 7 <> 2").select("conv_id", ((_share_of("cs", 0.5, 2) + 0.5 * _share_of("cs", 0.2, 0.5)) / F.size("cs")).alias("p"), (_share_of("cs", 0, 0.2) / F.size("cs").cast("double")).alias("h"))
    cov = some_n.where("conv_id % 5 <> 3").select("conv_id", ((_share_of("ns", 0.6, 2) + 0.5 * _share_of("ns", 0.3, 0.6)) / F.size("ns")).alias("r"))
    rel = asked.select("conv_id", (F.col("conv_id") % 6).alias("rv"))
    j = asked
    for part in (raw, nug, clm, vrd, cov, rel):
        j = j.join(part, "conv_id", "left")
    j = j.withColumn("stops", F.col("error").isNotNull() | (F.col("nuggets").isNull() & F.col("claims").isNull()))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    held = lambda name, x, off=None: F.round(F.when(F.col("stops") | (off if off is not None else F.lit(False)), 0.0).otherwise(x), 6).alias(name)
    p, r, n = zero(F.col("p")), zero(F.col("r")), F.coalesce("nuggets", F.lit(0))
    whole = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return j.select(
        "conv_id", "error", whole("nuggets"), whole("claims"), held("precision", p), held("hallucination", zero(F.col("h"))), held("recall", r),
        held("context_precision", F.least(F.lit(1.0), n / (F.col("chunks") * 3).cast("double")), F.col("chunks").isNull() | (F.col("chunks") == 0)),
        held("f1", 2 * p * r / F.greatest(F.lit(0.001), p + r), p + r == 0), held("relevance", F.col("rv") / 5.0, F.col("rv") == 0),
    )


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{\"verdict\": \"' || event_type || '\", \"n\": ' || user_id || '}' || chr(10) || '```' WHEN 1 THEN 'so {\"verdict\": \"' || event_type || '\", \"n\": ' || user_id || '} there' WHEN 2 THEN 'no object at all' ELSE '```' || chr(10) || '{\"verdict\": \"x\"}' || chr(10) || '``` ' END"


@query(rf"""WITH r AS (SELECT event_id, {_REPLY} AS t FROM events), f AS (SELECT event_id, coalesce(nullif(regexp_extract(t, '(?s)```(json)?[ \t\n]*(.*?)[ \t\n]*```', 2), ''), nullif(regexp_extract(t, '(?s)\{{.*\}}', 0), '')) AS j FROM r)
SELECT event_id, json_extract_string(j, '$.verdict') AS verdict, CAST(json_extract_string(j, '$.n') AS BIGINT) AS n FROM f""")
def llm_json_parse(spark, d):
    """The object in a model's reply: a fenced block, or from the first brace to the last; null where there is none."""
    r = read(spark, d, "events").select("event_id", F.expr(_REPLY.replace("chr(10)", "'\\n'")).alias("t"))
    j = F.coalesce(F.nullif(F.regexp_extract("t", r"(?s)```(json)?[ \t\n]*(.*?)[ \t\n]*```", 2), F.lit("")), F.nullif(F.regexp_extract("t", r"(?s)\{.*\}", 0), F.lit("")))
    return r.select("event_id", F.from_json(j, "verdict string, n long").alias("o")).select("event_id", "o.verdict", "o.n")
