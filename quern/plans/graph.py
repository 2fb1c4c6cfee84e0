"""The knowledge graph: nodes and edges of the star schema, neighbourhoods, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quern.operators.hop_counts import hop_counts
from quern.operators.ranking import lexical_index, quoted, sent_whole, top_k
from quern.plans.registry import registry
from quern.sources.scratch import written
from quern.sources.tables import read, stamp

QUERIES, ORACLES, query = registry()

_EDGES = """e AS (SELECT DISTINCT 'P:' || l_partkey AS src, 'S:' || l_suppkey AS dst, 'contains' AS relation FROM lineitem
 UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'located' FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'belongs_to' FROM nation)"""
_NODES = """n AS (SELECT 'P:' || p_partkey AS id, 'gene' AS type FROM part UNION ALL SELECT 'S:' || s_suppkey, 'locus' FROM supplier
 UNION ALL SELECT 'N:' || n_nationkey, 'place' FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'zone' FROM region)"""


def _edges(spark, d):
    made = lambda t, a, x, b, y, r: read(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(r).alias("relation"))
    return made("lineitem", "P:", "l_partkey", "S:", "l_suppkey", "contains").distinct().union(made("supplier", "S:", "s_suppkey", "N:", "s_nationkey", "located")).union(made("nation", "N:", "n_nationkey", "R:", "n_regionkey", "belongs_to"))


def _nodes(spark, d):
    made = lambda t, a, x, kind: read(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("id"), F.lit(kind).alias("type"))
    return reduce(lambda x, y: x.union(y), [made("part", "P:", "p_partkey", "gene"), made("supplier", "S:", "s_suppkey", "locus"), made("nation", "N:", "n_nationkey", "place"), made("region", "R:", "r_regionkey", "zone")])


_TABLES = ("lineitem", "supplier", "nation", "part", "region")
_stores: dict[tuple, tuple] = {}


def graph_store(spark, d):
    """(nodes, edges) of the folder as stored tables; built once a session and again when files have changed."""
    key = (spark.sparkContext.applicationId, d, *(stamp(spark, d, t) for t in _TABLES))
    if key not in _stores:
        _stores[key] = written(_nodes(spark, d)), written(_edges(spark, d))
    return _stores[key]


@query(f"WITH {_EDGES}, {_NODES} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def kg_store(spark, d):
    """The graph as it is stored and read again."""
    nodes, edges = graph_store(spark, d)
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row


@query(f"WITH {_NODES} SELECT type, count(*) AS n FROM n GROUP BY type")
def kg_nodes_by_type(spark, d):
    return _nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES}, {_NODES} SELECT relation, count(*) AS n FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY relation")
def kg_edges_by_relation(spark, d):
    """Edges whose two ends are declared."""
    n = _nodes(spark, d)
    e = _edges(spark, d).join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.groupBy("relation").agg(F.count("*").alias("n"))


_HOPS = f"""{_EDGES}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e),
h0 AS (SELECT 'P:' || p_partkey AS root FROM part WHERE p_partkey % 100 = 0),
h1 AS (SELECT DISTINCT root, z AS node FROM h0 JOIN b ON a = root),
h2 AS (SELECT root, z AS node FROM h1 JOIN b ON a = node UNION SELECT root, node FROM h1 UNION SELECT root, root FROM h0)"""


@query(f"""WITH {_HOPS}, i AS (SELECT h.root, count(*) AS edges FROM h2 h JOIN e ON e.src = h.node JOIN h2 g ON g.root = h.root AND g.node = e.dst GROUP BY h.root)
SELECT root, count(*) AS nodes, count(*) FILTER (node LIKE 'P:%') AS genes, count(*) FILTER (node LIKE 'S:%') AS loci, count(*) FILTER (node LIKE 'N:%') AS places, coalesce(max(edges), 0) AS edges FROM h2 LEFT JOIN i USING (root) GROUP BY root""")
def kg_khop(spark, d):
    """Two undirected hops around every hundredth part, and the edges between what they reach."""
    nodes, inside = hop_counts(graph_store(spark, d)[1], _roots(spark, d, 100), 2)
    n = nodes.groupBy("root").agg(F.sum("nodes").alias("nodes"), *_kinds())
    return n.join(inside.where("k = 2"), "root", "left").select("root", "nodes", "genes", "loci", "places", F.coalesce("edges", F.lit(0)).alias("edges"))


def _roots(spark, d, every):
    return read(spark, d, "part").where(F.col("p_partkey") % every == 0).select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("root"))


def _kinds():
    return [F.sum(F.when(F.col("kind") == kind, F.col("nodes")).otherwise(0)).alias(name) for kind, name in (("P", "genes"), ("S", "loci"), ("N", "places"))]


_DEEP = 4


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT 'P:' || p_partkey AS root FROM part WHERE p_partkey % 500 = 0),
w AS (SELECT root, root AS node, 0 AS depth FROM h0 UNION SELECT w.root, b.z, w.depth + 1 FROM w JOIN b ON b.a = w.node WHERE w.depth < {_DEEP}),
s AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY ALL), i AS (SELECT x.root, greatest(x.depth, y.depth) AS depth FROM e JOIN s x ON x.node = e.src JOIN s y ON y.node = e.dst AND y.root = x.root),
k AS (SELECT root, k FROM h0, unnest(generate_series(1, {_DEEP})) AS t(k))
SELECT root, k, (SELECT count(*) FROM s WHERE s.root = k.root AND depth <= k) AS nodes, (SELECT count(*) FROM s WHERE s.root = k.root AND depth <= k AND node LIKE 'P:%') AS genes,
 (SELECT count(*) FROM s WHERE s.root = k.root AND depth <= k AND node LIKE 'S:%') AS loci, (SELECT count(*) FROM s WHERE s.root = k.root AND depth <= k AND node LIKE 'N:%') AS places,
 (SELECT count(*) FROM i WHERE i.root = k.root AND depth <= k) AS edges FROM k""")
def kg_khop_depths(spark, d):
    """One to four hops around every five hundredth part: nodes by kind, and the edges between them, at each depth."""
    nodes, inside = hop_counts(graph_store(spark, d)[1], _roots(spark, d, 500), _DEEP)
    depths = F.explode(F.sequence(F.greatest("depth", F.lit(1)), F.lit(_DEEP))).alias("k")  # what is there at a depth is there at all further ones
    n = nodes.select("root", "kind", "nodes", depths).groupBy("root", "k").agg(F.sum("nodes").alias("nodes"), *_kinds())
    return n.join(inside, ["root", "k"], "left").select("root", F.col("k").cast("long").alias("k"), "nodes", "genes", "loci", "places", F.coalesce("edges", F.lit(0)).alias("edges"))


#: Edges of asked genes for each task that counts pairs.
_ASKED = 1000


@query("""WITH e AS (SELECT DISTINCT 'supplier' AS relation, l_partkey AS p, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem UNION ALL SELECT 'kind', p_partkey, p_type || '/' || p_size FROM part)
SELECT a.p AS gene_a, b.p AS gene_b, a.relation, count(*) AS shared, min(a.s) AS first_shared FROM e a JOIN e b ON a.relation = b.relation AND a.s = b.s AND a.p <> b.p WHERE a.p % 100 = 0 GROUP BY ALL HAVING count(*) >= CASE WHEN a.relation = 'kind' THEN 1 ELSE 2 END""")
def kg_shared(spark, d):
    """Terms, by relation, that the asked genes (ids divisible by 100) share with any other gene.

    The asked genes' edges go to the other edges while they are few.  Pairs go to tasks by asked gene, as many tasks as a fixed number of
    asked edges gives, so that what a task counts does not grow with the tables.
    """
    e = read(spark, d, "lineitem").select(F.lit("supplier").alias("relation"), F.col("l_partkey").alias("gene_b"), F.col("l_suppkey").cast("string").alias("s")).distinct()
    e = e.union(read(spark, d, "part").select(F.lit("kind"), "p_partkey", F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"))))
    e = written(e)  # read three times below
    asked = e.withColumnRenamed("gene_b", "gene_a").where("gene_a % 100 = 0")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // _ASKED))
    j = e.join(sent_whole(asked, 200_000), ["relation", "s"]).where("gene_a <> gene_b").repartition(parts, "gene_a")
    least = F.when(F.col("relation") == "kind", 1).otherwise(2)
    return j.groupBy("gene_a", "gene_b", "relation").agg(F.count("*").alias("shared"), F.min("s").alias("first_shared")).where(F.col("shared") >= least)


_TERMS = ("licensed", "token", "mail", "10.1")
_SCORE = "5 * CAST(contains(title, term) AS INTEGER) + 3 * CAST(contains(authors, term) AS INTEGER) + 2 * CAST(contains(journal, term) AS INTEGER) + 4 * CAST(contains(doi, term) AS INTEGER)"


@query("WITH t(term) AS (VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + f"""), f AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(split_part(text, chr(10), 2)) AS authors, lower(source) AS journal, '10.1000/' || doc_id AS doi FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, sum({_SCORE}) AS score FROM f, t GROUP BY doc_id), k AS (SELECT doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, score, coalesce((SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_suppkey = doc_id ORDER BY p LIMIT 5)), '') AS genes FROM k""")
def kg_keyword_search(spark, d):
    """Top ten papers by weighted matches of the terms in title, authors, journal and DOI, with the first five linked genes."""
    part = lambda i: F.lower(F.coalesce(F.get(F.split("text", "\n", -1), F.lit(i)), F.lit("")))
    low = read(spark, d, "documents").where("text is not null").select("doc_id", part(0).alias("title"), part(1).alias("authors"), F.lower("source").alias("journal"), F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string")).alias("doi"))
    score = sum((w * F.coalesce(F.col(c).contains(t).cast("int"), F.lit(0)) for t in _TERMS for c, w in (("title", 5), ("authors", 3), ("journal", 2), ("doi", 4))), F.lit(0))
    k = low.select("doc_id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(10)
    linked = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), "l_partkey").distinct().join(F.broadcast(k.select("doc_id")), "doc_id")  # ten rows
    genes = top_k(linked, ["doc_id"], [F.asc("l_partkey")], 5).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("genes"))
    return k.join(genes, "doc_id", "left").select("doc_id", "score", F.coalesce("genes", F.lit("")).alias("genes"))


#: What is known of an item: its text, and the DOI that it was taken from.  A paper's first author is the first word of its second line.
_EVIDENCE = "lower(text) || ' doi 10.1000/' || (item_id * 7) || '.'"
_AUTHOR = "lower(regexp_extract(split_part(text, chr(10), 2), '[A-Za-z]+', 0))"


@query(f"""WITH ev AS (SELECT item_id, text AS quote, {_EVIDENCE} AS evidence FROM benchmark), p AS (SELECT doc_id, text, {_AUTHOR} AS author, '10.1000/' || doc_id || '.' AS doi FROM documents),
m AS (SELECT item_id, doc_id FROM ev JOIN p ON contains(p.text, quote) OR split_part(p.text, chr(10), 1) = split_part(quote, '. ', 1) || '.' OR (length(author) > 2 AND contains(evidence, author)) OR contains(evidence, doi))
SELECT doc_id, min(item_id) AS item_id FROM m GROUP BY doc_id""")
def kg_theta_link_first(spark, d):
    """Papers linked to the first benchmark item that they quote whole, whose name is their title, or whose evidence names their first
    author or DOI.

    The evidence is read once: authors (each once, whoever wrote how much) and DOIs are looked for in it, not papers in pairs with items.
    """
    b, docs = read(spark, d, "benchmark"), read(spark, d, "documents")
    quotes = quoted(lexical_index(spark, d), docs, b.select("item_id", F.col("text").alias("phrase")), ["item_id"], False)
    named = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("t")).join(sent_whole(b.select("item_id", F.concat(F.substring_index("text", ". ", 1), F.lit(".")).alias("t"))), "t")
    evidence = written(b.select("item_id", F.concat(F.lower("text"), F.lit(" doi 10.1000/"), (F.col("item_id") * 7).cast("string"), F.lit(".")).alias("evidence")))
    second = F.get(F.split("text", "\n", -1), F.lit(1))
    by = docs.select("doc_id", F.lower(F.regexp_extract(second, "[A-Za-z]+", 0)).alias("author"))
    # an author is a run of letters, so where evidence holds one, some run of its letters holds it
    words = evidence.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("evidence", F.lit("[a-z]{3,}"), 0))).alias("word"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.transform(F.sequence(F.lit(3), F.length("word") - i + 1), lambda n: F.col("word").substr(i, n))))
    inside = words.select("item_id", F.explode(parts).alias("author")).groupBy("author").agg(F.min("item_id").alias("item_id"))
    authors = by.join(sent_whole(inside, 500_000), "author")
    dois = evidence.select("item_id", F.explode(F.regexp_extract_all("evidence", F.lit(r"10\.1000/[0-9]+\."), 0)).alias("doi"))
    cited = docs.select("doc_id", F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string"), F.lit(".")).alias("doi")).join(sent_whole(dois), "doi")
    found = [x.select("item_id", "doc_id") for x in (quotes, named, authors, cited)]
    return reduce(lambda x, y: x.union(y), found).groupBy("doc_id").agg(F.min("item_id").alias("item_id"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), c AS (SELECT l_suppkey, count(*) AS genes FROM e GROUP BY l_suppkey)
SELECT s_nationkey, s_suppkey, genes FROM supplier JOIN c ON s_suppkey = l_suppkey QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY genes DESC, s_suppkey) <= 10""")
def kg_co_locus(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct().groupBy("s_suppkey").agg(F.count("*").alias("genes"))
    return top_k(read(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(c, "s_suppkey"), ["s_nationkey"], [F.desc("genes"), F.asc("s_suppkey")], 10).select("s_nationkey", "s_suppkey", "genes")
