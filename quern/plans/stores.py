"""Sources and sinks: files of other formats, column discovery, appended, replaced and resumed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import registry
from quern.sources.scratch import replace_folder, shared_dir
from quern.sources.tables import find_column, first_filled, read, read_csv, read_files, read_json, read_mixed_csv

QUERIES, ORACLES, query = registry()


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def csv_read(spark, d):
    """Parts by way of a CSV in GB18030, which the reader finds out."""
    path = shared_dir(spark)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size").withColumn("wide　name", F.lit("高粱")).write.csv(path, header=True, encoding="GB18030")
    return read_csv(spark, path).drop("wide　name")


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'utf-8-sig' ELSE 'gb18030' END AS encoding, count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS sizes, md5(string_agg(p_name || CASE p_partkey % 3 WHEN 0 THEN '' ELSE '高粱' END, '|' ORDER BY p_partkey)) AS names_md5, 0 AS bad FROM part GROUP BY 1
UNION ALL SELECT 'latin-1', 1, 7, md5('blé'), 2""")
def csv_mixed(spark, d):
    """A folder of CSV files of several encodings and orders of columns, read once each; lines of the wrong length are counted."""
    path, p = shared_dir(spark), read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    p.where("p_partkey % 3 = 0").write.csv(f"{path}/a", header=True)
    p.where("p_partkey % 3 <> 0").select("p_size", F.concat("p_name", F.lit("高粱")).alias("p_name"), "p_partkey").write.csv(f"{path}/b", header=True, encoding="GB18030")
    # one file of one value: a header, a row in a third encoding, and two lines that do not fit
    spark.range(1).select(F.lit("p_partkey,p_name,p_size\n1,blé,7\n2,x\n3,y,8,9").alias("v")).coalesce(1).write.option("quote", "").option("escape", "").option("sep", "\x01").csv(f"{path}/c", encoding="ISO-8859-1")
    rows, bad = read_mixed_csv(spark, path)
    key = F.col("p_partkey").cast("long")
    name = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), "p_name"))), lambda x: x["p_name"]), "|")  # one text of names, as they are compared
    n = rows.groupBy(F.col("_encoding").alias("encoding")).agg(F.count("*").alias("rows"), F.sum(F.col("p_size").cast("long")).alias("sizes"), F.md5(name).alias("names_md5"))
    of = rows.select("_file", "_encoding").distinct().join(bad.groupBy("_file").agg(F.count("*").alias("bad")), "_file").groupBy(F.col("_encoding").alias("encoding")).agg(F.sum("bad").alias("bad"))
    return n.join(of, "encoding", "left").select("encoding", "rows", "sizes", "names_md5", F.coalesce("bad", F.lit(0)).alias("bad"))


@query("SELECT p_partkey, p_name AS title, p_type AS kind, p_retailprice AS file FROM part")
def column_discovery(spark, d):
    """Columns by lists of names that they may go by; the file's column falls back to the last one."""
    p = read(spark, d, "part").withColumnsRenamed({"p_name": "Article Title", "p_type": "Document　Type"})
    found = {"title": find_column(p.columns, ["title", "ArticleTitle"]), "kind": find_column(p.columns, ["Document Type"]), "file": find_column(p.columns, ["file", "names"], last=True)}
    return p.select("p_partkey", *(F.col(f"`{c}`").alias(n) for n, c in found.items()))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority WHEN lower(trim(o_orderstatus)) = 'f' THEN 'F' ELSE coalesce(nullif(o_orderpriority, ''), 'none') END AS label FROM
(SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)""")
def first_filled_column(spark, d):
    """Row by row, the first of three columns that holds text; "nan", blanks and nulls are none."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    o = read(spark, d, "orders").select("o_orderkey", F.when(status == "O", "  ").when(status == "F", " F　").otherwise("NaN").alias("State"), F.when(status == "O", priority).alias("Kind Of"), priority.alias("Last"))
    return o.select("o_orderkey", first_filled(o.columns, ["State", "KindOf", "Last"], "none").alias("label"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_read(spark, d):
    """Nations by way of JSON, one file as an array."""
    path = shared_dir(spark)
    read(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value")).write.text(path)  # nations are 25
    return read_json(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_max FROM events GROUP BY event_type")
def json_props(spark, d):
    e = read(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query("SELECT n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_hashes(spark, d):
    """A folder of files, listed below all levels by a pattern, with the hash of each."""
    path = shared_dir(spark)
    read(spark, d, "nation").select("n_nationkey", "n_name").repartition(1).write.partitionBy("n_nationkey").text(path)
    files = read_files(spark, path, "*.txt")
    return files.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "length", "sha256")


@query("""WITH f AS (SELECT doc_id, md5(text) AS h FROM documents), s AS (SELECT h, min(doc_id) AS doc_id, count(*) AS n FROM f WHERE h IS NOT NULL GROUP BY h)
SELECT doc_id, n - 1 AS skipped FROM s""")
def hash_dedup_in_run(spark, d):
    """Files of one hash are taken once in a run, the first by id."""
    f = read(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).where("h is not null")
    return f.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("skipped")).drop("h")


@query("SELECT vec_id, label, source, text FROM embeddings JOIN documents ON doc_id = vec_id")
def vector_store(spark, d):
    """Vectors with their texts."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    return read(spark, d, "embeddings").select("vec_id", "label").join(texts, "vec_id")


_SCAN = """WITH s(ord, size, step) AS (VALUES (0, 500, 450), (1, 1000, 900), (2, 1500, 1300)),
c AS (SELECT ord, doc_id, i, substr(text, CAST(i * step + 1 AS BIGINT), size) AS chunk FROM documents, s, unnest(generate_series(0, greatest(0, (length(text) - 1) // step))) AS u(i) WHERE length(text) > 0)"""


@query(f"{_SCAN} SELECT ord, doc_id, i, length(chunk) AS n FROM c WHERE length(chunk) > 50 QUALIFY row_number() OVER (PARTITION BY substr(chunk, 1, 200) ORDER BY ord, doc_id, i) = 1")
def docstore_scan(spark, d):
    """Chunks of all stores in their order, each beginning of 200 characters once; the least place wins before the shuffle."""
    scales = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(size).alias("size"), F.lit(step).alias("step")) for o, size, step in ((0, 500, 450), (1, 1000, 900), (2, 1500, 1300))))
    c = read(spark, d, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(scales).alias("s")).select("doc_id", "text", "s.*")
    c = c.select("doc_id", "ord", "text", "size", "step", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.col("step")).cast("int"))).alias("i"))
    c = c.select("ord", "doc_id", F.col("i").cast("long").alias("i"), F.substring("text", F.col("i") * F.col("step") + 1, F.col("size")).alias("chunk")).where("length(chunk) > 50")
    first = c.groupBy(F.substring("chunk", 1, 200).alias("k")).agg(F.min(F.struct("ord", "doc_id", "i", F.length("chunk").cast("long").alias("n"))).alias("m"))
    return first.select("m.*")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def jsonl_append(spark, d):
    """Events appended to JSON lines in two runs, and read again."""
    path, e = shared_dir(spark), read(spark, d, "events").select("event_id", "event_type")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label")
def index_append(spark, d):
    """A vector index by label, made with one half of the vectors and appended with the other."""
    path, v = shared_dir(spark), read(spark, d, "embeddings")
    v.where("vec_id % 2 = 0").write.partitionBy("label").parquet(path)
    v.where("vec_id % 2 <> 0").write.mode("append").partitionBy("label").parquet(path)
    stored = spark.read.schema(v.schema).parquet(path)
    return stored.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 1000")
def index_replace(spark, d):
    """An index is built aside and then takes the place of the old one, which stays as a backup."""
    path, docs = shared_dir(spark), read(spark, d, "documents").select("doc_id", "source", "n_chars")
    docs.write.parquet(path)
    docs.where("n_chars >= 1000").write.parquet(f"{path}.new")
    replace_folder(spark, f"{path}.new", path)
    return spark.read.schema(docs.schema).parquet(path)


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND length(text) > 0 AND conv_id IS NOT NULL) AND conv_id IS NOT NULL")
def resume_pending(spark, d):
    """Questions without a finished answer are asked again."""
    c = read(spark, d, "conversations")
    done = c.where("role = 'assistant' and length(text) > 0").select("conv_id").distinct()
    return c.where("conv_id is not null").select("conv_id").distinct().join(done, "conv_id", "left_anti")


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (role = 'assistant' AND length(text) > 0) > 0 THEN 1 WHEN conv_id % 2 = 0 THEN 2 ELSE 3 END AS run, count(*) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id""")
def resume_appended(spark, d):
    """Answers stored over three runs: each asks only what has no stored answer yet, and appends what it gets (even ones in the second run)."""
    c = read(spark, d, "conversations").where("conv_id is not null")
    asked = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.coalesce(F.bool_or((F.col("role") == "assistant") & (F.length("text") > 0)), F.lit(False)).alias("easy"))
    path, schema = shared_dir(spark), "conv_id long, run int, turns long"
    for run, answered in ((1, F.col("easy")), (2, F.col("conv_id") % 2 == 0), (3, F.lit(True))):
        pending = asked.join(spark.read.schema(schema).parquet(path), "conv_id", "left_anti") if run > 1 else asked
        pending.where(answered).select("conv_id", F.lit(run).alias("run"), "turns").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN coalesce(text, '') || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0),
s AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h IS DISTINCT FROM n.h THEN 'modified' ELSE 'same' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id)
SELECT doc_id, status FROM s WHERE CASE WHEN (SELECT count(*) FROM s WHERE status IN ('modified', 'deleted')) > 0 THEN status <> 'deleted' ELSE status = 'added' END""")
def manifest_rebuild(spark, d):
    """The files to index, by a manifest stored as JSON: all if any has changed or gone, else the new ones."""
    path, docs = shared_dir(spark), read(spark, d, "documents")
    docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h")).write.json(path)
    old = spark.read.schema("doc_id long, h string").json(path).select(F.col("doc_id").alias("o"), F.col("h").alias("oh"))
    new = docs.where("doc_id % 13 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    both = new.join(old, F.col("doc_id") == F.col("o"), "full")
    status = F.when(F.col("o").isNull(), "added").when(F.col("doc_id").isNull(), "deleted").when(~F.col("h").eqNullSafe(F.col("oh")), "modified").otherwise("same")
    s = both.select(F.coalesce("doc_id", "o").alias("doc_id"), status.alias("status"))
    whole = s.agg(F.coalesce(F.bool_or(F.col("status").isin("modified", "deleted")), F.lit(False)).alias("whole"))
    return s.join(F.broadcast(whole)).where(F.when(F.col("whole"), F.col("status") != "deleted").otherwise(F.col("status") == "added")).drop("whole")  # one row


@query("""SELECT 'by_lang' AS sheet, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'by_source', source, count(*) FROM documents GROUP BY source""")
def workbook_sheets(spark, d):
    """A workbook as one folder of CSV for each sheet, read back by its names."""
    path, docs = shared_dir(spark), read(spark, d, "documents")
    for sheet in ("lang", "source"):
        docs.groupBy(sheet).agg(F.count("*").alias("n")).withColumnRenamed(sheet, "name").write.csv(f"{path}/by_{sheet}", header=True)
    back = [spark.read.schema("name string, n long").csv(f"{path}/by_{s}", header=True).select(F.lit(f"by_{s}").alias("sheet"), "name", "n") for s in ("lang", "source")]
    return back[0].unionByName(back[1])


@query("""SELECT 1 + row_number() OVER (ORDER BY source NULLS FIRST) AS line, '| ' || coalesce(source, '-') || ' | ' || count(*) || ' | ' || max(n_chars) || ' |' AS text FROM documents GROUP BY source
UNION ALL SELECT 0, '| source | papers | longest |' UNION ALL SELECT 1, '|---|---|---|'""")
def report_markdown(spark, d):
    """A report's table, a line for each group; only groups are ordered."""
    from pyspark.sql import Window

    g = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("m"))
    row = F.concat(F.lit("| "), F.coalesce("source", F.lit("-")), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("m").cast("string"), F.lit(" |"))
    body = g.select((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) + 1).cast("long").alias("line"), row.alias("text"))
    head = spark.createDataFrame([(0, "| source | papers | longest |"), (1, "|---|---|---|")], "line long, text string")
    return head.unionByName(body)

