"""Hybrid search from question to evidence: fused scores, several indexes and searches, reranking, gates, limits, back-fill.

Questions are benchmark items; an item's vector is the one of its number, a paper's chunk is the document of a vector's number,
its granularity and section go by that number, and a source stands for a paper that has several chunks.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.overlap import near_earlier
from quern.functions.text import title, tokens
from quern.operators.chunk_index import chunk_index, search
from quern.operators.ranking import asked_terms, bm25, bm25_of, lexical_index, sent_whole, top_k
from quern.operators.vectors import nearest
from quern.plans.registry import registry
from quern.plans.retrieval import _CORPUS, TOKENS
from quern.plans.routing import CLASSIFIED, INDEXED, KEYWORDED, SIGNALS, classified, index_route, keywords
from quern.plans.texts import CHUNKED, _lines
from quern.sources.scratch import written
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

#: Hits of a dense search, and the weight of the lexical score (fixed values).
_DEEP, _LEXICAL = 120, 0.25

_DENSE = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
dp AS (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)), 6) AS cos FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, doc_id) AS rank FROM dp QUALIFY rank <= 300)"""
_HYBRID_TEXT = f"{KEYWORDED}, hq AS (SELECT DISTINCT item_id, unnest({TOKENS('t')}) AS term FROM (SELECT item_id, benchmark.text || chr(10) || array_to_string(ks, ', ') AS t FROM kw JOIN benchmark USING (item_id)))"
_LEX = """hs AS (SELECT item_id, c.doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / greatest(1.0, avgdl)))) AS score FROM c JOIN hq USING (term) JOIN i USING (term), st GROUP BY item_id, c.doc_id)"""
_FUSED = f"""WITH {CLASSIFIED}, {_HYBRID_TEXT}, {_CORPUS}, {_LEX}, {_DENSE},
fu AS (SELECT item_id, doc_id, source, cos, least(coalesce(round(score, 6), 0) / 15, 1) AS lex, round(-cos - {_LEXICAL}::DOUBLE * least(coalesce(round(score, 6), 0) / 15, 1), 6) AS fused FROM dn JOIN documents USING (doc_id) LEFT JOIN hs USING (item_id, doc_id) WHERE rank <= {_DEEP})"""


def _dense(spark, d, k):
    v, items = read(spark, d, "embeddings"), read(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return nearest(v, v.join(items, "vec_id", "left_semi"), k).withColumnsRenamed({"query_id": "item_id", "id": "doc_id", "score": "cos"})


def fused(spark, d):
    """(item_id, doc_id, source, cos, lex, fused): dense hits with the lexical score of question and keywords; smaller is better."""
    ks = keywords(spark, d).select("item_id", F.array_join("ks", ", ").alias("k"))
    asked = read(spark, d, "benchmark").join(ks, "item_id").select("item_id", F.concat("text", F.lit("\n"), "k").alias("text"))
    dense = written(_dense(spark, d, _DEEP))  # read twice below
    lex = bm25_of(lexical_index(spark, d), asked, dense).withColumn("lex", F.least(F.round("score", 6) / 15, F.lit(1.0))).drop("score")
    hits = dense.join(read(spark, d, "documents").select("doc_id", "source"), "doc_id").join(lex, ["item_id", "doc_id"], "left")
    hits = hits.withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    return hits.select("item_id", "doc_id", "source", "cos", "lex", F.round(-F.col("cos") - _LEXICAL * F.col("lex"), 6).alias("fused"))


@query(f"{_FUSED} SELECT item_id, doc_id, fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused, doc_id) AS rank FROM fu) WHERE rank <= 10")
def hybrid_fusion(spark, d):
    return top_k(fused(spark, d), ["item_id"], [F.asc("fused"), F.asc("doc_id")], 10).select("item_id", "doc_id", "fused", F.col("rank").cast("long").alias("rank"))


#: Bonuses by granularity, for labels that prefer one, and by section (fixed values).
_GRANULARITIES = (("fine", 0.12), ("std", 0.08), ("large", 0.04), ("para", 0.06))
_SECTIONS = (("abstract", 0.12), ("results", 0.08), ("discussion", 0.08), ("introduction", 0.03), ("methods", -0.03), ("references", -0.50), ("", 0.0))
_GRAN = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_GRANULARITIES)) + " END"
_SECT = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_SECTIONS)) + " END"
_GRAN_BONUS = "CASE WHEN label IN ('review', 'mechanism') AND gran = 'para' THEN 0.20D WHEN label IN ('factoid', 'gene_function') AND gran = 'fine' THEN 0.18D " + " ".join(f"WHEN gran = '{n}' THEN {v}D" for n, v in _GRANULARITIES) + " ELSE 0.0D END"
_SECT_BONUS = "CASE " + " ".join(f"WHEN section = '{n}' THEN {v}D" for n, v in _SECTIONS) + " ELSE 0.0D END"
_QUALITY = "CASE WHEN quality IS NULL THEN 0.0D WHEN quality = 1 THEN 0.07D ELSE -0.05D END"
_FINAL = f"round(fused - ({_GRAN_BONUS}) - ({_SECT_BONUS}) - ({_QUALITY}), 6)"
_SQL = lambda x: re.sub(r"([0-9])D\b", r"\1::DOUBLE", x)
_RANKED = f"""{_FUSED}, rr AS (SELECT *, {_SQL(_FINAL)} AS final FROM (SELECT fu.*, label, quality, {_GRAN} AS gran, {_SECT} AS section FROM fu JOIN cl USING (item_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)))"""


def reranked(spark, d):
    """Fused hits less the bonuses for granularity (by label), section and quality."""
    quality = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    h = fused(spark, d).join(sent_whole(classified(spark, d).select("item_id", "label")), "item_id").join(quality, "doc_id", "left")
    return h.withColumns({"gran": F.expr(_GRAN), "section": F.expr(_SECT)}).withColumn("final", F.expr(_FINAL))


@query(f"{_RANKED} SELECT item_id, doc_id, label, gran, section, final FROM rr")
def rerank_full(spark, d):
    return reranked(spark, d).select("item_id", "doc_id", "label", "gran", "section", "final")


#: Evidence by label (fixed values); labels that the density gate looks at.
_LIMITS = {"factoid": 12, "gene_function": 20, "mechanism": 24, "qtl_gwas": 16, "locate": 0, "review": 24, "gene_list": 24, "count": 0, "boundary": 0}
_LIMIT = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LIMITS.items()) + " END"
_GATED = "label IN ('gene_list', 'gene_function', 'factoid', 'qtl_gwas')"
_DENSE_ENOUGH = "CASE WHEN label = 'gene_list' THEN mean >= 0.5 OR n >= 3 ELSE mean >= 0.3 END"
_SELECTED = f"""{_RANKED}, ro AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final, doc_id) AS place FROM rr),
pp AS (SELECT item_id, label, source, round(avg(lex), 6) AS mean, count(*) AS n, min(place) AS first_place FROM ro GROUP BY ALL),
pk AS (SELECT *, {_DENSE_ENOUGH} AS dense, row_number() OVER (PARTITION BY item_id ORDER BY mean DESC, first_place) AS nth FROM pp),
pc AS (SELECT *, count(*) FILTER (dense) OVER (PARTITION BY item_id) AS n_dense FROM pk),
pg AS (SELECT item_id, source FROM pc WHERE NOT ({_GATED}) OR dense OR (n_dense < ({_LIMIT}) // 2 AND nth <= ({_LIMIT}) // 2)),
cp AS (SELECT ro.*, row_number() OVER (PARTITION BY item_id, source ORDER BY place) AS in_source FROM ro JOIN pg USING (item_id, source)),
sl AS (SELECT item_id, label, doc_id, source, final, row_number() OVER (PARTITION BY item_id ORDER BY place) AS spot FROM cp WHERE in_source <= CASE WHEN label IN ('review', 'gene_list') THEN 1 ELSE 2 END QUALIFY spot <= greatest({_LIMIT}, 1))"""


def selected(spark, d):
    """Evidence by label: papers dense enough (topped up to half the limit), few chunks of each, up to the limit.

    The check of the limit follows the append, so that a limit of none leaves one.
    """
    ro = written(reranked(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("final", "doc_id"))))  # read twice below
    p = ro.groupBy("item_id", "label", "source").agg(F.round(F.avg("lex"), 6).alias("mean"), F.count("*").alias("n"), F.min("place").alias("first_place"))
    p = p.withColumns({"dense": F.expr(_DENSE_ENOUGH), "nth": F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("mean"), "first_place"))})
    p = p.withColumn("n_dense", F.count_if("dense").over(Window.partitionBy("item_id")))
    half = f"(({_LIMIT}) DIV 2)"
    p = p.where(F.expr(f"NOT ({_GATED}) OR dense OR (n_dense < {half} AND nth <= {half})")).select("item_id", "source")
    kept = ro.join(p, ["item_id", "source"]).withColumn("in_source", F.row_number().over(Window.partitionBy("item_id", "source").orderBy("place")))
    kept = kept.where(F.col("in_source") <= F.when(F.col("label").isin("review", "gene_list"), 1).otherwise(2))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("place")))
    return kept.where(F.expr(f"place <= greatest({_LIMIT}, 1)")).select("item_id", "label", "doc_id", "source", "final", F.col("place").cast("long").alias("place"))


@query(f"{_SELECTED} SELECT item_id, label, doc_id, final, spot AS place FROM sl")
def evidence_select(spark, d):
    return selected(spark, d).select("item_id", "label", "doc_id", "final", "place")


_META = f"""mt AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT DISTINCT item_id, unnest({TOKENS('text')}) AS term FROM benchmark) JOIN (SELECT DISTINCT doc_id, unnest({TOKENS('split_part(text, chr(10), 1)')}) AS term FROM documents) USING (term) GROUP BY ALL),
mk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS nth FROM mt QUALIFY nth <= 200)"""


def _meta(spark, d, k):
    """(item_id, doc_id, nth): the papers whose titles share the most terms with a question."""
    asked = sent_whole(asked_terms(read(spark, d, "benchmark")), 200_000)
    heads = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(title(F.col("text"))))).alias("term"))
    n = heads.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    return top_k(n, ["item_id"], [F.desc("n"), F.asc("doc_id")], k, "nth").select("item_id", "doc_id", F.col("nth").cast("long").alias("nth"))


@query(f"""{_SELECTED}, {_META}, bf AS (SELECT item_id, doc_id FROM mk WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.item_id = mk.item_id AND sl.doc_id = mk.doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY nth) <= 20)
SELECT item_id, doc_id, final, 'chunk' AS section FROM sl UNION ALL SELECT item_id, doc_id, 0.85::DOUBLE, 'abstract' FROM bf""")
def backfill_rerank(spark, d):
    """Papers by title that gave no selected chunk come back with the fixed score 0.85, the worst there is, after and beyond the limit."""
    sl = written(selected(spark, d).select("item_id", "doc_id", "final", F.lit("chunk").alias("section")))
    missing = _meta(spark, d, 200).join(sl.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    back = top_k(missing, ["item_id"], [F.asc("nth")], 20).select("item_id", "doc_id", F.lit(0.85).alias("final"), F.lit("abstract").alias("section"))
    return sl.unionByName(back)


@query(f"""{_SELECTED}, {_META} SELECT item_id, doc_id, 0.5::DOUBLE AS score, md5(substr(text, 1, 800)) AS abstract_md5 FROM mk JOIN documents USING (doc_id) WHERE nth <= 24 AND item_id NOT IN (SELECT item_id FROM sl WHERE {_LIMIT} > 0)""")
def abstract_fallback(spark, d):
    """Questions that no evidence may be taken for (a limit of none, kept strictly) get the beginnings of the first 24 papers by title."""
    some = selected(spark, d).where(F.expr(f"{_LIMIT} > 0")).select("item_id").distinct()
    m = _meta(spark, d, 24).join(some, "item_id", "left_anti")
    return m.join(read(spark, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 800)).alias("abstract_md5")), "doc_id").select("item_id", "doc_id", F.lit(0.5).alias("score"), "abstract_md5")


@query(f"""WITH {CLASSIFIED}, {_DENSE}, h AS (SELECT item_id, label, source, doc_id, cos FROM dn JOIN documents USING (doc_id) JOIN cl USING (item_id) WHERE rank <= CASE WHEN label IN ('count', 'review', 'gene_list') THEN 300 ELSE 120 END)
SELECT item_id, source, doc_id, cos FROM h QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY cos DESC, doc_id) = 1""")
def metadata_topk(spark, d):
    """The nearest papers of each question, more for labels that list; one row for each paper (source)."""
    label = sent_whole(classified(spark, d).select("item_id", "label"))
    h = _dense(spark, d, 300).join(label, "item_id").where(F.col("rank") <= F.when(F.col("label").isin("count", "review", "gene_list"), 300).otherwise(120))
    h = h.join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return top_k(h, ["item_id", "source"], [F.desc("cos"), F.asc("doc_id")], 1, "nth").select("item_id", "source", "doc_id", "cos")


_ROUTED = f"""{CLASSIFIED}, {INDEXED}, {CHUNKED}, ct AS (SELECT DISTINCT doc_id, scale, chunk, unnest({TOKENS('text')}) AS term FROM chunked), q AS (SELECT DISTINCT item_id, unnest({TOKENS('text')}) AS term FROM benchmark), rt AS (SELECT item_id, label, index_name AS scale, ord FROM cl JOIN ix USING (label)),
h AS (SELECT item_id, scale, doc_id, chunk, count(*) AS terms FROM ct JOIN q USING (term) JOIN rt USING (item_id, scale) GROUP BY ALL),
hk AS (SELECT *, row_number() OVER (PARTITION BY item_id, scale ORDER BY terms DESC, doc_id, chunk) AS rank FROM h)"""


def searched(spark, d, k):
    """(item_id, scale, doc_id, chunk, terms, rank): the stored indexes of a question's label, each searched for the chunks with most of its terms."""
    routed = index_route(spark, d).select("item_id", F.col("index_name").alias("scale"))
    asked = written(asked_terms(read(spark, d, "benchmark")).join(routed, "item_id"))
    return search(chunk_index(spark, d, _lines()), asked, "item_id", k)


@query(f"WITH RECURSIVE {_ROUTED} SELECT item_id, scale, doc_id, chunk, terms FROM hk WHERE rank <= 5")
def multi_granularity_search(spark, d):
    """Up to four scales; a search reads the folders of its scales and of its terms' buckets."""
    return searched(spark, d, 5).drop("rank")


#: The scale that is kept of near copies, by label (fixed values).
_PREFERRED = "CASE WHEN label IN ('review', 'mechanism', 'gene_list') THEN 'para' ELSE 'fine' END"


@query(f"""WITH RECURSIVE {_ROUTED}, o AS (SELECT item_id, doc_id, scale, chunk, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY scale <> {_PREFERRED}, ord, rank) AS nth, list_distinct(regexp_extract_all(lower(substr(text, 1, 200)), '[^ \t\n]+')) AS ws FROM hk JOIN rt USING (item_id, scale) JOIN chunked USING (doc_id, scale, chunk) WHERE rank <= 30),
kp AS (SELECT item_id, doc_id, scale, chunk, nth, [ws] AS held, true AS kept FROM o WHERE nth = 1
 UNION ALL SELECT o.item_id, o.doc_id, o.scale, o.chunk, o.nth, CASE WHEN near THEN held ELSE list_append(held, ws) END, NOT near FROM (SELECT o.*, held, len(list_filter(held, lambda x: len(list_intersect(x, ws)) > 0.7::DOUBLE * least(len(x), len(ws)))) > 0 AS near FROM kp JOIN o ON o.item_id = kp.item_id AND o.doc_id = kp.doc_id AND o.nth = kp.nth + 1) o)
SELECT item_id, doc_id, scale, chunk, nth FROM kp WHERE kept""")
def near_dup_keep_first(spark, d):
    """Hits of a paper without those whose beginning is nearly that of a hit kept before; hits of the label's preferred scale come first.

    A question's hits are at most 30 for each of four scales, so a paper's hits are a small group.
    """
    label = index_route(spark, d).select("item_id", F.col("index_name").alias("scale"), "ord", F.expr(_PREFERRED).alias("first"))
    hits = written(searched(spark, d, 30).join(label, ["item_id", "scale"]))
    texts = chunk_index(spark, d, _lines()).chunks.join(sent_whole(hits.select("doc_id", "scale", "chunk").distinct(), 200_000), ["doc_id", "scale", "chunk"])
    heads = texts.select("doc_id", "scale", "chunk", F.array_distinct(F.regexp_extract_all(F.lower(F.substring("text", 1, 200)), F.lit("[^ \t\n]+"), 0)).alias("ws"))
    order = Window.partitionBy("item_id", "doc_id").orderBy(F.col("scale") != F.col("first"), "ord", "rank")
    o = hits.join(heads, ["doc_id", "scale", "chunk"]).select("item_id", "doc_id", "scale", "chunk", F.row_number().over(order).cast("long").alias("nth"), "ws")

    def keep(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        near = near_earlier([set(w) for w in rows.column("ws").to_pylist()])
        return rows.drop_columns("ws").filter(pa.array([not n for n in near]))

    return o.groupBy("item_id", "doc_id").applyInArrow(keep, "item_id long, doc_id long, scale string, chunk long, nth long")


@query(f"""WITH {SIGNALS}, {KEYWORDED}, {_CORPUS}, br AS (SELECT item_id, 0 AS branch, text FROM benchmark UNION ALL SELECT item_id, nth, topic || ' ' || w FROM (SELECT item_id, unnest(ks[1:4]) AS topic, generate_subscripts(ks[1:4], 1) AS nth FROM kw) JOIN (SELECT item_id, regexp_extract(text, '[A-Za-z]{{3,}}', 0) AS w FROM benchmark) USING (item_id)),
bq AS (SELECT DISTINCT item_id, branch, unnest({TOKENS('text')}) AS term FROM br),
bs AS (SELECT item_id, branch, c.doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / greatest(1.0, avgdl)))), 6) AS score FROM c JOIN bq USING (term) JOIN i USING (term), st GROUP BY item_id, branch, c.doc_id)
SELECT item_id, CAST(branch AS BIGINT) AS branch, doc_id, score FROM bs QUALIFY row_number() OVER (PARTITION BY item_id, branch ORDER BY score DESC, doc_id) <= 5""")
def multi_query_union(spark, d):
    """The question and up to four topics of it, each a search; hits are put together without removing those found twice."""
    b = read(spark, d, "benchmark")
    word = b.select("item_id", F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("w"))
    topics = keywords(spark, d).select("item_id", F.posexplode(F.slice("ks", 1, 4)).alias("i", "topic")).join(word, "item_id")
    br = b.select("item_id", F.lit(0).alias("branch"), "text").union(topics.select("item_id", F.col("i") + 1, F.concat("topic", F.lit(" "), "w")))
    q = F.col("item_id") * 5 + F.col("branch")  # branches are 0 to 4
    s = bm25(lexical_index(spark, d), br.select(q.alias("q"), "text"), "q", 5).select(F.expr("(q - pmod(q, 5)) div 5").alias("item_id"), F.expr("pmod(q, 5)").alias("branch"), "doc_id", "score")
    return top_k(s, ["item_id", "branch"], [F.desc("score"), F.asc("doc_id")], 5).select("item_id", F.col("branch").cast("long").alias("branch"), "doc_id", "score")


@query("""WITH m AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'store-' || vec_id END AS store_id FROM embeddings), s AS (SELECT 'store-' || doc_id AS store_id, doc_id, source FROM documents WHERE doc_id % 3 <> 0)
SELECT vec_id, doc_id, source FROM m JOIN s USING (store_id)""")
def docstore_lookup(spark, d):
    """From an index's numbers to stored ids to documents; what either map lacks is skipped."""
    key = lambda c: F.concat(F.lit("store-"), F.col(c).cast("string"))
    m = read(spark, d, "embeddings").where("vec_id % 5 <> 0").select("vec_id", key("vec_id").alias("store_id"))
    return m.join(read(spark, d, "documents").where("doc_id % 3 <> 0").select(key("doc_id").alias("store_id"), "doc_id", "source"), "store_id").select("vec_id", "doc_id", "source")


_KEYS = "['doc' || doc_id || '.pdf', 'doc' || doc_id, lower(trim(split_part(text, chr(10), 1))), source || '/' || n_chars, substr(lower(text), 1, 60)]"
_ASKED = "['doc' || (doc_id + 500) || '.pdf', source || '/' || n_chars, lower(trim(split_part(text, chr(10), 1)))]"


@query(f"""WITH al AS (SELECT DISTINCT ON (k) k, doc_id FROM (SELECT unnest({_KEYS}) AS k, doc_id FROM documents) WHERE k <> '' ORDER BY k, doc_id DESC),
lk AS (SELECT doc_id, unnest({_ASKED}) AS k, generate_subscripts({_ASKED}, 1) AS ord FROM documents WHERE doc_id % 3 = 0)
SELECT lk.doc_id, arg_min(al.doc_id, ord) AS record FROM lk LEFT JOIN al USING (k) GROUP BY lk.doc_id""")
def citation_map(spark, d):
    """Records found under several keys: of equal keys the later record counts, and of a paper's own keys the first that is known."""
    docs = read(spark, d, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    head, place = F.lower(F.trim(title(F.col("text")))), F.concat("source", F.lit("/"), F.col("n_chars").cast("string"))
    known = docs.select(F.explode(F.array(F.concat(name, F.lit(".pdf")), name, head, place, F.substring(F.lower("text"), 1, 60))).alias("k"), "doc_id").where("k <> ''").groupBy("k").agg(F.max("doc_id").alias("record"))
    other = F.concat(F.lit("doc"), (F.col("doc_id") + 500).cast("string"), F.lit(".pdf"))
    asked = docs.where("doc_id % 3 = 0").select("doc_id", F.posexplode(F.array(other, place, head)).alias("ord", "k"))
    found = asked.join(known, "k", "left").groupBy("doc_id").agg(F.min(F.when(F.col("record").isNotNull(), F.struct("ord", "record")))["record"].alias("record"))
    return found


@query("""WITH f AS (SELECT item_id, 'src' || item_id % 10 AS journal FROM benchmark), h AS (SELECT item_id, doc_id, lower(source) AS source, journal FROM f JOIN documents ON doc_id % 40 = item_id % 40)
SELECT item_id, count(*) FILTER (contains(source, journal)) AS by_part, count(*) FILTER (source = journal) AS by_name FROM h GROUP BY item_id""")
def journal_post_filter(spark, d):
    """Hits of a journal: names that hold the asked one (as answers do), and equal names (as streams do)."""
    f = read(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 10).cast("string")).alias("journal"), (F.col("item_id") % 40).alias("m"))
    h = read(spark, d, "documents").select((F.col("doc_id") % 40).alias("m"), F.lower("source").alias("source")).join(sent_whole(f), "m")
    return h.groupBy("item_id").agg(F.count_if(F.col("source").contains(F.col("journal"))).alias("by_part"), F.count_if(F.col("source") == F.col("journal")).alias("by_name"))
