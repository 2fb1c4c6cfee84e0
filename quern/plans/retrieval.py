"""Lexical and vector retrieval, fusion, reranking and diversification."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import STOPWORDS, TOKEN
from quern.operators.ranking import bm25, inverse_frequencies, lexical_index, overlaps, sent_whole, top_k
from quern.operators.vectors import nearest
from quern.plans.registry import registry
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}'), lambda t: t NOT IN ({_STOP}))"
_CORPUS = f"""d AS (SELECT doc_id, {TOKENS('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
c AS (SELECT doc_id, len(t) AS size, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
i AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf FROM f, st),
q AS (SELECT DISTINCT item_id, unnest({TOKENS('text')}) AS term FROM benchmark),
s AS (SELECT item_id, c.doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / greatest(1.0, avgdl)))) AS score
      FROM c JOIN q USING (term) JOIN i USING (term), st GROUP BY item_id, c.doc_id)"""


@query(f"WITH {_CORPUS} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_term_stats(spark, d):
    return inverse_frequencies(lexical_index(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def _scores(spark, d, k):
    """Each question's first k documents are among these rows."""
    return bm25(lexical_index(spark, d), read(spark, d, "benchmark"), k=k)


@query(f"WITH {_CORPUS} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_topk(spark, d):
    return top_k(_scores(spark, d, 5), ["item_id"], [F.desc("score"), F.asc("doc_id")], 5).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CORPUS} SELECT item_id, doc_id, round(least(score / 15, 1), 6) AS capped, round(score / max(score) OVER (PARTITION BY item_id), 6) AS relative FROM s")
def bm25_normalized(spark, d):
    """Scores against a fixed bound, and against the question's best one."""
    s = bm25(lexical_index(spark, d), read(spark, d, "benchmark"))
    s = s.join(sent_whole(s.groupBy("item_id").agg(F.max("score").alias("top"))), "item_id")
    return s.select("item_id", "doc_id", F.round(F.least(F.col("score") / 15, F.lit(1.0)), 6).alias("capped"), F.round(F.col("score") / F.col("top"), 6).alias("relative"))


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest({TOKENS('text')}) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
t AS (SELECT DISTINCT doc_id, unnest({TOKENS('text')}) AS term FROM documents),
s AS (SELECT item_id, doc_id, round(count(*) / greatest(max(n), 1)::DOUBLE, 6) AS overlap FROM q JOIN t USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, overlap FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) <= 5""")
def lexical_overlap_topk(spark, d):
    s = overlaps(lexical_index(spark, d), read(spark, d, "benchmark"), k=5).withColumn("overlap", F.round("overlap", 6))
    return top_k(s, ["item_id"], [F.desc("overlap"), F.asc("doc_id")], 5).drop("rank")


_NEAREST = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, round(list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)), 6) AS cos
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM p)"""


def _nearest(spark, d, k, metric="cosine"):
    """Every row whose id is divisible by 100 is a query against all rows."""
    v = read(spark, d, "embeddings")
    return nearest(v, v.where("vec_id % 100 = 0"), k, metric=metric).withColumnsRenamed({"id": "vec_id", "score": "cos"})


@query(f"{_NEAREST} SELECT query_id, vec_id, cos, rank FROM k WHERE rank <= 10")
def knn_cosine_topk(spark, d):
    return _nearest(spark, d, 10).select("query_id", "vec_id", "cos", F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""")
def knn_l2_topk(spark, d):
    return _nearest(spark, d, 10, "l2").select("query_id", "vec_id", (-F.col("cos")).alias("distance"))


@query(f"""{_NEAREST}, a AS (SELECT doc_id FROM documents WHERE lang = 'en'), x AS (SELECT doc_id FROM documents WHERE lang = 'none') SELECT 'en' AS allowed, query_id, vec_id, cos FROM k WHERE rank <= 20 AND (vec_id IN (SELECT doc_id FROM a) OR NOT EXISTS (SELECT 1 FROM a))
UNION ALL SELECT 'none', query_id, vec_id, cos FROM k WHERE rank <= 20 AND (vec_id IN (SELECT doc_id FROM x) OR NOT EXISTS (SELECT 1 FROM x))""")
def knn_allowed_semijoin(spark, d):
    """The allow-list filters after the top rows are taken; an empty list allows all."""
    found, docs = _nearest(spark, d, 20), read(spark, d, "documents")

    def within(lang: str):
        allowed = docs.where(F.col("lang") == lang).select(F.col("doc_id").alias("vec_id"))
        kept = found.join(allowed, "vec_id", "left_semi") if allowed.limit(1).count() else found
        return kept.select(F.lit(lang).alias("allowed"), "query_id", "vec_id", "cos")

    return within("en").unionByName(within("none"))


HYBRID = f"""WITH {_CORPUS}, b AS (SELECT item_id, s.doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, s.doc_id) AS rank FROM s),
h AS (SELECT item_id, b.doc_id, b.rank, documents.source, documents.lang, quality, score, round(-0.25::DOUBLE * least(score / 15, 1) - CASE lang WHEN 'en' THEN 0.12::DOUBLE ELSE 0.06::DOUBLE END
   - CASE WHEN quality IS NULL THEN 0::DOUBLE WHEN quality = 1 THEN 0.07::DOUBLE ELSE -0.05::DOUBLE END, 6) AS final
   FROM b JOIN documents USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) WHERE rank <= 30)"""


def reranked(spark, d):
    """Fused lexical score less bonuses for language (as granularity) and quality; smaller is better."""
    hits = top_k(_scores(spark, d, 30), ["item_id"], [F.desc("score"), F.asc("doc_id")], 30)
    labels = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    h = hits.join(read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").join(labels, "doc_id", "left")
    bonus = F.when(F.col("lang") == "en", 0.12).otherwise(0.06) + F.when(F.col("quality").isNull(), 0.0).when(F.col("quality") == 1, 0.07).otherwise(-0.05)
    return h.withColumn("final", F.round(-0.25 * F.least(F.col("score") / 15, F.lit(1.0)) - bonus, 6))


@query(f"{HYBRID} SELECT item_id, doc_id, final FROM h")
def rerank_additive(spark, d):
    return reranked(spark, d).select("item_id", "doc_id", "final")


@query(f"{HYBRID}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY final, doc_id) AS nth FROM h) SELECT item_id, source, doc_id, final, nth FROM o WHERE nth <= 2")
def diversify_cap(spark, d):
    """At most two hits of a source for each question."""
    return top_k(reranked(spark, d), ["item_id", "source"], [F.asc("final"), F.asc("doc_id")], 2, "nth").select("item_id", "source", "doc_id", "final", F.col("nth").cast("long").alias("nth"))


@query(f"{HYBRID}, g AS (SELECT item_id, source, count(*) AS n, round(avg(least(score / 15, 1)), 6) AS mean FROM h GROUP BY ALL) SELECT item_id, source, n, mean FROM g WHERE mean >= 0.5 OR n >= 3")
def density_gate(spark, d):
    g = reranked(spark, d).groupBy("item_id", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.col("score") / 15, F.lit(1.0))), 6).alias("mean"))
    return g.where("mean >= 0.5 or n >= 3")


_IR = f"""{_NEAREST}, g AS (SELECT *, CAST(label = query_label AS INTEGER) AS rel FROM k WHERE rank <= 10),
t AS (SELECT query_id, sum(CAST(label = query_label AS INTEGER)) AS relevant FROM p GROUP BY query_id)
SELECT query_id, round(sum(CASE WHEN rank <= 5 THEN rel END) / 5.0::DOUBLE, 6) AS p5, round(sum(rel) / greatest(max(relevant), 1)::DOUBLE, 6) AS recall10,
 round(coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr,
 round(sum(rel / log2(rank + 1)), 6) AS dcg FROM g JOIN t USING (query_id) GROUP BY query_id"""


@query(_IR)
def eval_ir_metrics(spark, d):
    """Precision, recall, reciprocal rank and gain, with rows of the query's label as relevant."""
    v = read(spark, d, "embeddings").select("vec_id", "label")
    of = lambda i, name: v.select(F.col("vec_id").alias(i), F.col("label").alias(name))
    g = _nearest(spark, d, 10).join(of("query_id", "query_label"), "query_id").join(of("vec_id", "label"), "vec_id")
    relevant = v.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("relevant"))
    g = g.withColumn("rel", (F.col("label") == F.col("query_label")).cast("int")).join(relevant, "query_label")
    return g.groupBy("query_id").agg(
        F.round(F.sum(F.when(F.col("rank") <= 5, F.col("rel"))) / 5.0, 6).alias("p5"),
        F.round(F.sum("rel") / F.greatest(F.max("relevant"), F.lit(1)).cast("double"), 6).alias("recall10"),
        F.round(F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)), 6).alias("dcg"),
    )
