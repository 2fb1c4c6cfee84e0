"""Answer assembly and its evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators.ranking import lexical_index, quoted
from quern.plans.registry import registry
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

#: Few own phrases for turns of conversations, by priority; plans/routing.py has the nine labels.
ROUTES = (("count", ("how many", "number of")), ("locate", ("where", "find")), ("review", ("overview", "the and")), ("factoid", ("what", "is")))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{p}')''' for p in ps)} THEN '{n}'" for n, ps in ROUTES) + " ELSE 'review' END AS label, "
       + " + ".join(f"CAST({' OR '.join(f'''contains(lower(text), '{p}')''' for p in ps)} AS INTEGER)" for _, ps in ROUTES) + " AS n_labels FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def classify_query(spark, d):
    q = read(spark, d, "conversations").where("role = 'user' and text is not null").withColumn("q", F.lower("text"))
    hit = {n: F.expr(" or ".join(f"contains(q, '{p}')" for p in ps)) for n, ps in ROUTES}
    label = F.lit("review")
    for n in reversed(hit):
        label = F.when(hit[n], n).otherwise(label)
    return q.select("conv_id", "turn", label.alias("label"), sum((h.cast("int") for h in hit.values()), F.lit(0)).alias("n_labels"))


_KEYS = (("ing", "process"), ("tion", "action"), ("able", "ability"), ("er", "agent"))


@query("WITH k(frag, kw, ord) AS (VALUES " + ", ".join(f"('{f}', '{k}', {i})" for i, (f, k) in enumerate(_KEYS)) + ") SELECT item_id, coalesce(string_agg(kw, ', ' ORDER BY ord), '') AS keywords FROM benchmark LEFT JOIN k ON contains(lower(text), frag) GROUP BY item_id")
def expand_keywords(spark, d):
    """Keywords of a dictionary's fragments that a question holds, in the dictionary's order."""
    low = F.lower("text")
    found = F.filter(F.array(*(F.when(low.contains(f), F.lit(k)) for f, k in _KEYS)), lambda x: x.isNotNull())
    return read(spark, d, "benchmark").select("item_id", F.array_join(found, ", ").alias("keywords"))


@query("""SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role) AS number FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL)""")
def source_index(spark, d):
    """Numbers by first appearance."""
    f = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return f.select("conv_id", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "role")).cast("long").alias("number"))


@query("SELECT conv_id, md5(string_agg('[' || turn || '] ' || coalesce(text, ''), chr(10) ORDER BY turn, text)) AS evidence_md5, count(*) AS n FROM conversations GROUP BY conv_id")
def evidence_block(spark, d):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", line.alias("l")))).alias("x"))
    return g.select("conv_id", F.md5(F.array_join(F.transform("x", lambda r: r["l"]), "\n")).alias("evidence_md5"), F.size("x").cast("long").alias("n"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS num, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS pos FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, num, min(pos) AS pos FROM c WHERE length(num) <= 2 GROUP BY ALL)
SELECT doc_id, num, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS renumbered FROM f""")
def citation_renumber(spark, d):
    """Valid references (of one or two digits) renumbered from one by first appearance; others are dropped."""
    c = read(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("pos", "num")).where(F.length("num") <= 2)
    f = c.groupBy("doc_id", "num").agg(F.min("pos").alias("pos"))
    return f.select("doc_id", "num", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long").alias("renumbered"))


@query("""WITH a AS (SELECT conv_id, turn, length(text) AS n, len(string_split(text, '. ')) AS claims FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, CAST(sum(claims) AS BIGINT) AS claims, round(sum(CASE WHEN n > 300 THEN claims WHEN n > 100 THEN 0.5::DOUBLE * claims ELSE 0 END) / greatest(sum(claims), 1), 6) AS precision,
 round(sum(CASE WHEN n <= 100 THEN claims ELSE 0 END) / greatest(sum(claims), 1)::DOUBLE, 6) AS hallucination FROM a GROUP BY conv_id""")
def eval_claims(spark, d):
    """Claims of answers with verdicts by evidence length: full, half and no support."""
    a = read(spark, d, "conversations").where("role = 'assistant' and text is not null").select("conv_id", F.length("text").alias("n"), F.size(F.split("text", r"\. ", -1)).alias("claims"))
    all_ = F.greatest(F.sum("claims"), F.lit(1))
    worth = F.when(F.col("n") > 300, F.col("claims").cast("double")).when(F.col("n") > 100, 0.5 * F.col("claims")).otherwise(0.0)
    return a.groupBy("conv_id").agg(F.sum("claims").alias("claims"), F.round(F.sum(worth) / all_, 6).alias("precision"), F.round(F.sum(F.when(F.col("n") <= 100, F.col("claims")).otherwise(0)) / all_.cast("double"), 6).alias("hallucination"))


@query("""SELECT lang, round(avg(CASE WHEN b = 0 THEN n_chars END), 4) AS small, round(avg(CASE WHEN b = 1 THEN n_chars END), 4) AS medium, round(avg(CASE WHEN b = 2 THEN n_chars END), 4) AS large
FROM (SELECT lang, n_chars, CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 5000 THEN 1 ELSE 2 END AS b FROM documents) GROUP BY lang""")
def eval_pivot(spark, d):
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    p = read(spark, d, "documents").withColumn("size", size).groupBy("lang").pivot("size", ["small", "medium", "large"]).agg(F.avg("n_chars"))
    return p.select("lang", *(F.round(c, 4).alias(c) for c in ("small", "medium", "large")))


@query("""SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS low, max(n_chars) AS high, (list_sort(list(n_chars)))[count(*) // 2 + 1] AS upper_median
FROM documents WHERE n_chars > 0 GROUP BY GROUPING SETS ((lang), (source), ())""")
def eval_report(spark, d):
    """Means and upper medians by language, by source and over all, from counts of each length; no group gathers its rows."""
    counted = read(spark, d, "documents").where("n_chars > 0").groupBy("lang", "source", F.col("n_chars").alias("v")).agg(F.count("*").alias("c"))
    none = F.lit(None).cast("string")
    sets = [(F.col("lang"), none), (none, F.col("source")), (none, none)]
    g = reduce(lambda x, y: x.union(y), [counted.select(F.lit(i).alias("part"), a.alias("lang"), b.alias("source"), "v", "c") for i, (a, b) in enumerate(sets)])
    g = g.groupBy("part", "lang", "source", "v").agg(F.sum("c").alias("c"))
    group = Window.partitionBy("part", "lang", "source")
    r = g.withColumns({"upto": F.sum("c").over(group.orderBy("v")), "n": F.sum("c").over(group)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v")))
    means = F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 4)
    return r.groupBy("part", "lang", "source").agg(F.max("n").alias("n"), means.alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), middle.alias("upper_median")).drop("part")


@query("""WITH k AS (SELECT item_id, unnest(string_split(lower(text), '. ')) AS kp FROM benchmark), h AS (SELECT item_id, kp FROM k WHERE length(kp) > 20)
SELECT item_id, count(*) AS keypoints, count(*) FILTER (EXISTS (SELECT 1 FROM documents WHERE contains(lower(documents.text), kp))) AS covered FROM h GROUP BY item_id""")
def eval_keypoints(spark, d):
    """Key points of benchmark items that some document holds, found by their rarest term."""
    k = read(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), r"\. ", -1)).alias("i", "phrase")).where(F.length("phrase") > 20)
    hit = quoted(lexical_index(spark, d), read(spark, d, "documents"), k, ["item_id", "i"], True).select("item_id", "i").distinct().withColumn("hit", F.lit(1))
    return k.join(hit, ["item_id", "i"], "left").groupBy("item_id").agg(F.count("*").alias("keypoints"), F.count("hit").alias("covered"))
