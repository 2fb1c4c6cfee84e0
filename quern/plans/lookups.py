"""Structured lookups: counts, profiles, ranges, substring search, statistics, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.limits import accepted_calls
from quern.operators.ranking import top_k
from quern.plans.registry import registry
from quern.sources.scratch import shared_dir
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()


@query("SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_partkey) AS parts FROM part WHERE p_type IS NOT NULL GROUP BY p_brand")
def group_count_distinct(spark, d):
    return read(spark, d, "part").where("p_type is not null").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.count_distinct("p_partkey").alias("parts"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def bridge_count(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("""SELECT coalesce(b.bucket, 'Other') AS bucket, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer
LEFT JOIN (VALUES ('BUILDING', 'goods'), ('MACHINERY', 'goods'), ('FURNITURE', 'home'), ('HOUSEHOLD', 'home')) b(seg, bucket) ON c_mktsegment = seg GROUP BY 1""")
def category_bucket(spark, d):
    b = spark.createDataFrame([("BUILDING", "goods"), ("MACHINERY", "goods"), ("FURNITURE", "home"), ("HOUSEHOLD", "home")], "c_mktsegment string, bucket string")
    c = read(spark, d, "customer").join(F.broadcast(b), "c_mktsegment", "left")
    return c.groupBy(F.coalesce("bucket", F.lit("Other")).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT p_partkey, p_brand, p_type, count(l_suppkey) AS n_suppliers, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey), '.') AS suppliers
FROM part LEFT JOIN s ON p_partkey = l_partkey GROUP BY ALL""")
def entity_profile(spark, d):
    """One row of an entity with its nested list, '.' where there is none."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    p = read(spark, d, "part").join(s, "p_partkey", "left")
    return p.select("p_partkey", "p_brand", "p_type", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_suppliers"), F.coalesce(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), F.lit(".")).alias("suppliers"))


@query("""SELECT s_suppkey, p_partkey, p_size FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p_partkey FROM lineitem) JOIN part USING (p_partkey)
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY p_size, p_partkey) <= 5""")
def term_members_ordered_limit(spark, d):
    b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    return top_k(b.join(read(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), ["s_suppkey"], [F.asc("p_size"), F.asc("p_partkey")], 5).select("s_suppkey", "p_partkey", "p_size")


@query("""WITH r AS (SELECT s_suppkey, 900 + s_suppkey % 50 * 20 AS lo, 900 + s_suppkey % 50 * 20 + 15 AS hi FROM supplier)
SELECT s_suppkey, count(*) AS n, min(p_partkey) AS first_part FROM r JOIN part ON p_retailprice >= lo AND p_retailprice <= hi GROUP BY s_suppkey""")
def region_join_binned(spark, d):
    """Containment as an equi-join on bins of the range's width, then the exact test."""
    width = 20
    r = read(spark, d, "supplier").select("s_suppkey", (900 + F.col("s_suppkey") % 50 * 20).alias("lo"))
    r = r.withColumn("hi", F.col("lo") + 15)
    r = r.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    p = read(spark, d, "part").select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / width).alias("bin"))
    return r.join(p, "bin").where("p_retailprice between lo and hi").groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%steel%'")
def like_search(spark, d):
    return read(spark, d, "part").where(F.col("p_name").ilike("%re%") | F.col("p_type").ilike("%steel%")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, s_suppkey, s_nationkey FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_size <= 5 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) <= 3""")
def locus_by_gene(spark, d):
    b = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    j = read(spark, d, "part").where("p_size <= 5").select("p_partkey").join(b, "p_partkey").join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return top_k(j, ["p_partkey"], [F.asc("s_suppkey")], 3).select("p_partkey", "s_suppkey", "s_nationkey")


#: A trait's unit and a sample's place: events have neither.
_UNIT, _SITE = "CASE WHEN length(event_type) > 5 THEN 'cm' ELSE 'kg' END", "'L' || CAST(user_id % 5 AS STRING)"


@query(f"""SELECT event_type, count(DISTINCT user_id) AS samples, round(avg(value), 3) AS mean, round(min(value), 3) AS low, round(max(value), 3) AS high, min({_UNIT}) AS unit,
 string_agg(DISTINCT {_SITE}, ',' ORDER BY {_SITE}) AS sites, string_agg(DISTINCT CAST(year(ts) AS VARCHAR), ',' ORDER BY CAST(year(ts) AS VARCHAR)) AS years FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def trait_stats(spark, d):
    """Samples, mean, range and unit of a trait (the least where there are several), and where and when it was measured."""
    return trait_figures(read(spark, d, "events"))


def trait_figures(events):
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return events.where("value is not null").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("samples"),
        F.round(F.avg("value"), 3).alias("mean"),
        F.round(F.min("value"), 3).alias("low"),
        F.round(F.max("value"), 3).alias("high"),
        F.min(F.expr(_UNIT)).alias("unit"),
        listed(F.expr(_SITE)).alias("sites"),
        listed(F.year("ts").cast("string")).alias("years"),
    )


@query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def trait_list(spark, d):
    return read(spark, d, "events").select("event_type").distinct().orderBy("event_type")


@query("""WITH b AS (SELECT CASE WHEN o_totalprice < 1000 THEN '0-999' WHEN o_totalprice < 50000 THEN '1000-49999' WHEN o_totalprice < 200000 THEN '50000-199999' ELSE '200000+' END AS bin FROM orders)
SELECT bin, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 3) AS percent FROM b GROUP BY bin""")
def cache_histogram(spark, d):
    o = read(spark, d, "orders")
    v = F.col("o_totalprice")
    g = o.groupBy(F.when(v < 1000, "0-999").when(v < 50000, "1000-49999").when(v < 200000, "50000-199999").otherwise("200000+").alias("bin")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(o.agg(F.count("*").alias("all")))).select("bin", "n", F.round(100.0 * F.col("n") / F.col("all"), 3).alias("percent"))


_GAP = 6 * 3600 * 1_000_000


_LIMITED = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, t, t AS last_t, 1 AS n FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - r.last_t >= {_GAP} THEN e.t ELSE r.last_t END, CASE WHEN e.t - r.last_t >= {_GAP} THEN r.n + 1 ELSE r.n END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)"""


@query(f"{_LIMITED} SELECT user_id, CAST(max(n) AS BIGINT) AS accepted, count(*) AS calls, max(last_t) AS last_accepted FROM r GROUP BY user_id")
def rate_limit_accept(spark, d):
    """Calls at least six hours after the last accepted one."""
    return accepted_calls(read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), _GAP)


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) > 5 AS over_quota FROM events GROUP BY ALL")
def daily_quota(spark, d):
    return read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls")).withColumn("over_quota", F.col("calls") > 5)


@query(f"{_LIMITED} SELECT user_id, CAST(max(n) AS BIGINT) AS accepted, count(*) AS calls FROM r GROUP BY user_id")
def rate_limit_stream(spark, d):
    """The same rule as a stream over the events' files; its state and its rows go to the shared folder, not to the driver."""
    from quern.streaming.rate_limit import limited

    path, schema = shared_dir(spark), read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    run = limited(stream, _GAP).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("user_id long, event_id long, t long, accepted boolean").parquet(f"{path}/rows")
    return rows.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count("*").alias("calls"))


@query("SELECT user_id, min(event_id) AS first_call, count(*) AS calls FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' OR event_type = 'login') GROUP BY user_id")
def key_lookup(spark, d):
    """Calls of registered keys; unknown ones are rejected by the semi-join."""
    e = read(spark, d, "events")
    registered = e.where(F.col("event_type").isin("signup", "login")).select("user_id").distinct()
    return e.join(registered, "user_id", "left_semi").groupBy("user_id").agg(F.min("event_id").alias("first_call"), F.count("*").alias("calls"))


@query("SELECT DISTINCT user_id, md5('key-' || user_id) AS api_key FROM events")
def register_keys(spark, d):
    """A key for each user; by a digest here, so that it can be compared (a service would draw it)."""
    return read(spark, d, "events").select("user_id").distinct().select("user_id", F.md5(F.concat(F.lit("key-"), F.col("user_id").cast("string"))).alias("api_key"))


@query("SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events) AS calls")
def service_stats(spark, d):
    one = [read(spark, d, "documents").agg(F.count("*").alias("papers")), read(spark, d, "embeddings").agg(F.count("*").alias("vectors")), read(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("calls"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))  # one row each
