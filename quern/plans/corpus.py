"""Cleaning, chunking, deduplication, mining and incremental loading of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import noisy, normal, title
from quern.operators.ranking import top_k
from quern.operators.rules import from_table, rule_hits
from quern.plans.registry import registry
from quern.sources.scratch import shared_dir, written
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

_NORMAL = lambda x: rf"(SELECT CASE WHEN lower(z) = 'nan' THEN '' ELSE z END FROM (SELECT trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[　 ]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' ') AS z))"


def _docs(spark, d):
    return read(spark, d, "documents")


@query(f"SELECT doc_id, md5({_NORMAL('text')}) AS norm_md5, length({_NORMAL('text')}) AS n FROM documents")
def norm_text(spark, d):
    n = normal(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_extract(text, '(^|[^0-9])((19|20)[0-9][0-9])([^0-9]|$)', 2) AS year, regexp_extract(text, '10\.[0-9]{4,9}/[A-Za-z0-9._/-]+', 0) AS doi FROM documents")
def doi_year_extract(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_extract("text", "(^|[^0-9])((19|20)[0-9][0-9])([^0-9]|$)", 2).alias("year"), F.regexp_extract("text", r"10\.[0-9]{4,9}/[A-Za-z0-9._/-]+", 0).alias("doi"))


_CHUNKS = """WITH s(scale, size, step) AS (VALUES ('fine', 500, 450), ('std', 1000, 900), ('large', 1500, 1300)),
c AS (SELECT doc_id, source, scale, i, substr(text, CAST(i * step + 1 AS BIGINT), size) AS chunk FROM documents, s, unnest(generate_series(0, greatest(0, (length(text) - 1) // step))) AS u(i) WHERE length(text) > 0)"""


def _chunks(spark, d):
    """Windows of three sizes, each overlapping the next; built row by row, without a shuffle."""
    scales = F.array(*(F.struct(F.lit(n).alias("scale"), F.lit(size).alias("size"), F.lit(step).alias("step")) for n, size, step in (("fine", 500, 450), ("std", 1000, 900), ("large", 1500, 1300))))
    c = _docs(spark, d).where(F.length("text") > 0).select("doc_id", "source", "text", F.explode(scales).alias("s"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.col("s.step")).cast("int")))
    return c.select("doc_id", "source", "text", "s.*", at.alias("i")).select("doc_id", "source", "scale", "i", F.substring("text", F.col("i") * F.col("step") + 1, F.col("size")).alias("chunk"))


@query(f"{_CHUNKS} SELECT doc_id, scale, i, md5(chunk) AS chunk_md5 FROM c")
def fixed_window_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", "scale", F.col("i").cast("long").alias("i"), F.md5("chunk").alias("chunk_md5"))


@query(f"""{_CHUNKS} SELECT source, scale, count(*) AS chunks, count(*) FILTER (length(chunk) < 80 OR length(regexp_replace(chunk, '[^A-Za-z]', '', 'g')) * 4 < length(chunk)
 OR (len(string_split(chunk, chr(10))) > 5 AND length(chunk) < 20 * len(string_split(chunk, chr(10))))) AS noise FROM c GROUP BY ALL""")
def noise_ratio_by_source(spark, d):
    return _chunks(spark, d).groupBy("source", "scale").agg(F.count("*").alias("chunks"), F.count_if(noisy(F.col("chunk"))).alias("noise"))


@query("SELECT md5(text) AS h, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def exact_dedup(spark, d):
    return _docs(spark, d).where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


_TITLE = r"regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, t AS norm_title, count(*) AS n FROM (SELECT doc_id, substr({_TITLE}, 1, 80) AS t FROM documents) WHERE length(t) >= 10 GROUP BY t")
def title_dedup(spark, d):
    t = F.substring(F.regexp_replace(F.lower(title(F.col("text"))), "[^a-z0-9]+", " "), 1, 80)
    return _docs(spark, d).select("doc_id", t.alias("norm_title")).where(F.length("norm_title") >= 10).groupBy("norm_title").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"{_CHUNKS} SELECT source, m.a AS doc_id, m.b AS i, n FROM (SELECT source, min(struct_pack(a := doc_id, b := i)) AS m, count(*) AS n FROM c WHERE scale = 'fine' GROUP BY source, substr(chunk, 1, 120))")
def snippet_dedup(spark, d):
    c = _chunks(spark, d).where("scale = 'fine'")
    return c.groupBy("source", F.substring("chunk", 1, 120).alias("k")).agg(F.min(F.struct("doc_id", F.col("i").cast("long").alias("i"))).alias("m"), F.count("*").alias("n")).select("source", "m.*", "n")


_SYMBOL = "[A-Z][a-z]{2,}[0-9]+|[A-Z]{3,}[0-9]*"


@query(f"SELECT sym, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_SYMBOL}')) AS sym FROM documents) WHERE upper(sym) NOT IN ('THE', 'AND', 'FOR') GROUP BY sym")
def mine_counts(spark, d):
    s = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_SYMBOL), 0)).alias("sym")).where(~F.upper("sym").isin("THE", "AND", "FOR"))
    return s.groupBy("sym").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '{_SYMBOL}')) AS sym FROM documents),
p AS (SELECT doc_id, sym, strpos(text, sym) AS pos, text FROM s)
SELECT sym, doc_id, substr(text, greatest(1, pos - 100), least(pos - 1, 100) + 200) AS context FROM p QUALIFY row_number() OVER (PARTITION BY sym ORDER BY doc_id) <= 3""")
def mine_contexts(spark, d):
    s = _docs(spark, d).select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_SYMBOL), 0))).alias("sym"))
    pos = F.expr("instr(text, sym)")
    # the context is cut before the ranking, so that whole texts do not travel
    c = s.select("doc_id", "sym", F.substring("text", F.greatest(F.lit(1), pos - 100), F.least(pos - 1, F.lit(100)) + 200).alias("context"))
    return top_k(c, ["sym"], [F.asc("doc_id")], 3).select("sym", "doc_id", "context")


@query(f"""WITH s AS (SELECT upper(unnest(regexp_extract_all(text, '{_SYMBOL}'))) AS sym FROM documents),
k AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '{_SYMBOL}'))) AS sym FROM benchmark)
SELECT sym, count(*) AS n FROM s WHERE sym NOT IN (SELECT sym FROM k) GROUP BY sym HAVING count(*) >= 3""")
def mine_novel(spark, d):
    found = lambda t: read(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit(_SYMBOL), 0)).alias("sym")).select(F.upper("sym").alias("sym"))
    return found("documents").groupBy("sym").agg(F.count("*").alias("n")).where("n >= 3").join(found("benchmark").distinct(), "sym", "left_anti")


@query("""WITH o AS (SELECT doc_id, max(quality) AS v FROM labels GROUP BY doc_id), n AS (SELECT doc_id, CAST(n_chars > 1000 AS INTEGER) AS v FROM documents)
SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.v <> n.v THEN 'modified' ELSE 'same' END AS status, count(*) AS n,
 coalesce(bool_or(n.doc_id IS NULL OR o.v <> n.v), false) AS rebuild FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1""")
def manifest_diff(spark, d):
    """An old and a new manifest (labels as they were given, documents as they are): anything changed or gone asks for a rebuild."""
    old = read(spark, d, "labels").groupBy(F.col("doc_id").alias("o")).agg(F.max("quality").alias("ov"))
    new = _docs(spark, d).select(F.col("doc_id").alias("m"), (F.col("n_chars") > 1000).cast("int").alias("nv"))
    both = old.join(new, F.col("o") == F.col("m"), "full")
    status = F.when(F.col("o").isNull(), "added").when(F.col("m").isNull(), "deleted").when(F.col("ov") != F.col("nv"), "modified").otherwise("same")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("m").isNull() | (F.col("ov") != F.col("nv"))), F.lit(False)).alias("rebuild"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    """The last row of each key, as a replacing insert leaves it."""
    e = read(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_stream(spark, d):
    """The same from a stream in several batches, whose work fails for every seventh event at first; failures are tried again until none is left."""
    from quern.streaming.upsert import latest, retry, upserts

    path, rows = shared_dir(spark), read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    rows.repartition(4).write.parquet(f"{path}/in")
    work = lambda r: r.withColumn("ok", (F.col("event_id") % 7 != 0) | (F.col("attempt") > 0))
    run = upserts(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), f"{path}/out", work).trigger(availableNow=True).start()
    run.awaitTermination()
    tried = rows.withColumn("attempt", F.lit(0)).schema
    batch = run.lastProgress["batchId"]
    while (then := retry(spark, f"{path}/out", tried, work, batch)) > batch:
        batch = then
    return latest(spark, f"{path}/out", tried, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def fetch_queue_antijoin(spark, d):
    return _docs(spark, d).join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT source, count(*) AS n, count(l.doc_id) AS matched, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS rate FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def eval_match_rate(spark, d):
    known = read(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    g = _docs(spark, d).join(known, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("matched"))
    return g.withColumn("rate", F.round(F.col("matched") / F.col("n").cast("double"), 6))


#: Names of files that a search gave, and those that are known: types of parts, whole, in part, or with more.
_GIVEN = "lower(CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN substr(p_type, 1, 12) ELSE 'v2 ' || p_type || ' ' || p_size END)"


@query(f"""WITH kn AS (SELECT DISTINCT lower(p_type) AS known FROM part WHERE p_partkey % 2 = 0), gi AS (SELECT DISTINCT {_GIVEN} AS name FROM part), un AS (SELECT name FROM gi WHERE name NOT IN (SELECT known FROM kn)),
n AS (SELECT name, known, row_number() OVER (PARTITION BY name ORDER BY known) AS nth, count(*) OVER (PARTITION BY name) AS near FROM un JOIN kn ON contains(known, name) OR contains(name, known))
SELECT un.name, coalesce(max(near), 0) AS near, coalesce(string_agg(known, '|' ORDER BY known) FILTER (nth <= 3), '') AS nearest FROM un LEFT JOIN n ON n.name = un.name GROUP BY un.name""")
def eval_nearest_names(spark, d):
    """Names without an equal known one, with up to three known ones that hold them or that they hold.

    Names are tables of phrases for each other: one pass over the given names finds the known ones in them, another the other way round.
    """
    p = read(spark, d, "part")
    known = p.where("p_partkey % 2 = 0").select(F.lower("p_type").alias("known")).distinct()
    un = written(p.select(F.expr(_GIVEN).alias("name")).distinct().join(known.withColumnRenamed("known", "name"), "name", "left_anti"))
    as_rules = lambda df, c: from_table(df.select(F.col(c).alias("phrase"), F.col(c).alias("label")))
    held = rule_hits(un, F.col("name"), as_rules(known, "known")).select("name", F.explode("hits.phrase").alias("known"))
    holding = rule_hits(known, F.col("known"), as_rules(un, "name")).select(F.explode("hits.phrase").alias("name"), "known")
    pairs = held.union(holding).distinct()
    first = top_k(pairs, ["name"], [F.asc("known")], 3).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("known")), "|").alias("nearest"))  # three at most
    out = un.join(pairs.groupBy("name").agg(F.count("*").alias("near")), "name", "left").join(first, "name", "left")
    return out.select("name", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("nearest", F.lit("")).alias("nearest"))


@query("SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2")
def longest_by_source(spark, d):
    return top_k(_docs(spark, d).select("doc_id", "source", "lang", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 2).drop("rank")
