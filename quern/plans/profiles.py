"""Profiles of entities: counts, dispatch by key, nested lists, accession blocks, merged and enriched nodes, loci of traits; citations of answers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quern.operators.ranking import sent_whole, top_k
from quern.plans.registry import registry
from quern.plans.lookups import trait_figures
from quern.plans.routing import CLASSIFIED, QUESTIONS, TRAITED, classified, questions, trait_keyword_map
from quern.sources.scratch import shared_dir, written
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

_str = lambda c: F.col(c).cast("string")


def _bridge(spark, d):
    """(p, s): which supplier (locus, term) holds which part (gene)."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()


_BRIDGE = "br AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"


@query("SELECT count(DISTINCT p_partkey) AS genes, count(DISTINCT p_type) AS kinds, count(DISTINCT p_brand) AS brands FROM part")
def entity_counts(spark, d):
    return read(spark, d, "part").agg(F.count_distinct("p_partkey").alias("genes"), F.count_distinct("p_type").alias("kinds"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT s_nationkey, s_name, s_acctbal FROM supplier ORDER BY s_nationkey, s_name")
def ordered_projection(spark, d):
    return read(spark, d, "supplier").select("s_nationkey", "s_name", "s_acctbal").orderBy("s_nationkey", "s_name")


_ASKED_KEY = "CASE o_orderkey % 3 WHEN 0 THEN 'P' || o_orderkey % 3000 WHEN 1 THEN 'S:' || o_orderkey % 200 ELSE CAST(o_orderkey % 30 AS STRING) END"


@query(f"""WITH a AS (SELECT DISTINCT {_ASKED_KEY.replace('STRING', 'VARCHAR')} AS k FROM orders)
SELECT k, p_name AS name FROM a JOIN part ON k = 'P' || p_partkey UNION ALL SELECT k, s_name FROM a JOIN supplier ON k = 'S:' || s_suppkey UNION ALL SELECT k, n_name FROM a JOIN nation ON k = CAST(n_nationkey AS VARCHAR)""")
def point_lookup(spark, d):
    """Keys of three formats, each looked up in the table that its format names."""
    a = read(spark, d, "orders").select(F.expr(_ASKED_KEY).alias("k")).distinct()
    keyed = lambda t, k, name: read(spark, d, t).select(k.alias("k"), F.col(name).alias("name"))
    named = [
        ("P", keyed("part", F.concat(F.lit("P"), _str("p_partkey")), "p_name")),
        ("S:", keyed("supplier", F.concat(F.lit("S:"), _str("s_suppkey")), "s_name")),
        ("", keyed("nation", _str("n_nationkey"), "n_name")),
    ]
    parts = [a.where(F.col("k").startswith(p) if p else F.col("k").rlike("^[0-9]+$")).join(t, "k") for p, t in named]
    return parts[0].union(parts[1]).union(parts[2])


_PROFILE = f"""WITH {_BRIDGE}, sl AS (SELECT p, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS suppliers FROM br GROUP BY p),
nl AS (SELECT p, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM (SELECT DISTINCT p, n_name FROM br JOIN supplier ON s = s_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY p),
fl AS (SELECT p, string_agg(l_returnflag || '=' || l_linestatus, ';' ORDER BY l_returnflag, l_linestatus) AS flags FROM (SELECT DISTINCT l_partkey AS p, l_returnflag, l_linestatus FROM lineitem) GROUP BY p),
yl AS (SELECT p, string_agg(y || ':' || n, ';' ORDER BY y) AS years FROM (SELECT l_partkey AS p, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY p)"""


@query(f"{_PROFILE} SELECT p_partkey, p_name, coalesce(md5(suppliers), '.') AS suppliers_md5, coalesce(nations, '.') AS nations, coalesce(flags, '.') AS flags, coalesce(years, '.') AS years FROM part LEFT JOIN sl ON sl.p = p_partkey LEFT JOIN nl ON nl.p = p_partkey LEFT JOIN fl ON fl.p = p_partkey LEFT JOIN yl ON yl.p = p_partkey")
def entity_profile_full(spark, d):
    """An entity with four nested lists, each made before it is joined, '.' where there is none."""
    b, li = _bridge(spark, d), read(spark, d, "lineitem")
    joined = lambda df, x, sep, name: df.groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda r: r["t"]), sep).alias(name))
    places = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("s"), "n_name")
    lists = [
        joined(b, F.struct("s", _str("s").alias("t")), ",", "suppliers"),
        joined(b.join(places, "s").select("p", "n_name").distinct(), F.struct(F.col("n_name").alias("t")), ",", "nations"),
        joined(li.select(F.col("l_partkey").alias("p"), F.concat("l_returnflag", F.lit("="), "l_linestatus").alias("t")).distinct(), F.struct("t"), ";", "flags"),
        joined(li.groupBy(F.col("l_partkey").alias("p"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n")), F.struct("y", F.concat(_str("y"), F.lit(":"), _str("n")).alias("t")), ";", "years"),
    ]
    out = read(spark, d, "part").select(F.col("p_partkey").alias("p"), "p_name")
    for x in lists:
        out = out.join(x, "p", "left")
    none = lambda c: F.coalesce(c, F.lit(".")).alias(c)
    return out.select(F.col("p").alias("p_partkey"), "p_name", F.coalesce(F.md5("suppliers"), F.lit(".")).alias("suppliers_md5"), none("nations"), none("flags"), none("years"))




@query("""SELECT 'brand' AS kind, p_brand AS accession, count(DISTINCT p_partkey) AS genes, min(p_name) AS name FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(DISTINCT p_partkey), min(p_name) FROM part GROUP BY p_type
UNION ALL SELECT 'locus', CAST(l_suppkey AS VARCHAR), count(DISTINCT l_partkey), min(s_name) FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey""")
def term_count(spark, d):
    """Genes of each accession, from the table of its kind, with a name."""
    p = read(spark, d, "part")
    of = lambda kind, c: p.groupBy(F.col(c).alias("accession")).agg(F.count_distinct("p_partkey").alias("genes"), F.min("p_name").alias("name")).select(F.lit(kind).alias("kind"), "accession", "genes", "name")
    n = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("genes"))
    locus = n.join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.lit("locus"), _str("l_suppkey"), "genes", F.col("s_name"))
    return of("brand", "p_brand").union(of("type", "p_type")).union(locus)


_FOUND = "(PF[0-9]{5}|IPR[0-9]{6}|GO:[0-9]{7})"


@query(f"""WITH {QUESTIONS}, a AS (SELECT item_id, unnest(regexp_extract_all(text, '{_FOUND}')) AS acc, generate_subscripts(regexp_extract_all(text, '{_FOUND}'), 1) AS ord FROM qs),
n AS (SELECT CASE p_size % 3 WHEN 0 THEN 'PF' WHEN 1 THEN 'IPR' ELSE 'GO' END AS kind, count(*) AS genes, min(p_partkey) AS first_gene FROM part GROUP BY 1)
SELECT item_id, string_agg(acc || ': ' || genes || ' genes from ' || first_gene, chr(10) || chr(10) ORDER BY ord) AS block FROM a JOIN n ON kind = regexp_extract(acc, '^[A-Z]+', 0) GROUP BY item_id""")
def accession_block(spark, d):
    """Every accession of a question, looked up by its kind, as blocks in the question's order."""
    a = questions(spark, d).select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(_FOUND), 1)).alias("ord", "acc")).withColumn("kind", F.regexp_extract("acc", "^[A-Z]+", 0))
    kind = F.when(F.col("p_size") % 3 == 0, "PF").when(F.col("p_size") % 3 == 1, "IPR").otherwise("GO")
    n = read(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("genes"), F.min("p_partkey").alias("first_gene"))
    line = F.concat("acc", F.lit(": "), _str("genes"), F.lit(" genes from "), _str("first_gene"))
    b = a.join(sent_whole(n), "kind").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("t")))).alias("x"))
    return b.select("item_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("block"))


#: A gene that a question names stands for the part of its last three digits; a trait's loci are those of the nation of its name's length.
_NAMED_GENE = r"(Sobic\.[0-9]{3}G[0-9]{4,6}|Sb[0-9]{2}g[0-9]{6}|MSD[0-9]|SbAB[0-9]+)"
_PART_OF = "CAST(regexp_extract(g, '([0-9]{1,3})$', 1) AS BIGINT) % 150 + 1"
_MOST_CHARS, _CUT = 800, "\n...(cut)"
_ABOUT_GENES, _ABOUT_LOCI, _ABOUT_STATS = ("gene_function", "factoid", "mechanism", "qtl_gwas"), ("qtl_gwas", "gene_function", "review"), ("review", "mechanism", "qtl_gwas")
_STATS_SQL = "event_type || ': n=' || count(DISTINCT user_id) || ', mean ' || format('{:.3f}', round(avg(value), 3)) || ', range ' || format('{:.3f}', round(min(value), 3)) || ' to ' || format('{:.3f}', round(max(value), 3))"


@query(f"""WITH {CLASSIFIED}, {TRAITED}, {_BRIDGE}, gs AS (SELECT item_id, label, regexp_extract_all(text, '{_NAMED_GENE}') AS gs FROM cl), gn AS (SELECT item_id, label, list_filter(gs, lambda z, i: list_position(gs, z) = i) AS gs FROM gs),
ge AS (SELECT item_id, label, unnest(gs[1:2]) AS g, generate_subscripts(gs[1:2], 1) AS nth FROM gn), gp AS (SELECT item_id, label, nth, {_PART_OF} AS p FROM ge),
b1 AS (SELECT item_id, nth AS place, 'Gene ' || p_partkey || ': ' || p_name AS t FROM gp JOIN part ON p = p_partkey WHERE label IN {_ABOUT_GENES}),
lg AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s) AS k FROM gp JOIN br USING (p) WHERE nth = 1 AND label IN {_ABOUT_LOCI} QUALIFY k <= 3),
lt AS (SELECT item_id, nth, s_suppkey AS s FROM tk JOIN cl USING (item_id) JOIN supplier ON s_nationkey = length(trait) WHERE nth <= 2 AND label IN {_ABOUT_LOCI} AND item_id NOT IN (SELECT item_id FROM lg)),
lf AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s) AS k FROM lt WHERE nth = (SELECT min(x.nth) FROM lt x WHERE x.item_id = lt.item_id) QUALIFY k <= 5),
b2 AS (SELECT item_id, 3 AS place, 'Loci: ' || string_agg(CAST(s AS VARCHAR), ', ' ORDER BY s) AS t FROM (SELECT item_id, s FROM lg UNION ALL SELECT item_id, s FROM lf) GROUP BY item_id),
st AS (SELECT event_type, {_STATS_SQL} AS t FROM events WHERE value IS NOT NULL GROUP BY event_type), b3 AS (SELECT item_id, 4 AS place, t FROM tk JOIN cl USING (item_id) JOIN st ON event_type = trait WHERE nth = 1 AND label IN {_ABOUT_STATS}),
bl AS (SELECT item_id, string_agg(t, chr(10) || chr(10) ORDER BY place) AS t FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) GROUP BY item_id)
SELECT item_id, CASE WHEN t IS NULL THEN '' WHEN length(t) > {_MOST_CHARS} THEN t[1:{_MOST_CHARS}] || chr(10) || '...(cut)' ELSE t END AS block FROM cl LEFT JOIN bl USING (item_id) WHERE label NOT IN ('count', 'locate', 'boundary')""")
def evidence_blocks(spark, d):
    """What the tables hold on what a question names, by its label: its first two genes, the first one's loci or else those of its
    first trait that has any, and figures of its first trait; up to 800 characters.

    Everything starts from the questions, so the tables are joined by key to what they name.
    """
    c = written(classified(spark, d).select("item_id", "label", "text"))
    g = c.select("item_id", "label", F.posexplode(F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(_NAMED_GENE), 1)), 1, 2)).alias("i", "g"))
    g = g.select("item_id", "label", (F.col("i") + 1).alias("place"), F.expr(_PART_OF).alias("p"))
    traits = trait_keyword_map(spark, d).join(c.select("item_id", "label"), "item_id").where("nth <= 2")
    genes = sent_whole(g.where(F.col("label").isin(*_ABOUT_GENES))).join(read(spark, d, "part"), F.col("p") == F.col("p_partkey"))
    b1 = genes.select("item_id", "place", F.concat(F.lit("Gene "), _str("p_partkey"), F.lit(": "), "p_name").alias("t"))
    by_gene = _bridge(spark, d).join(sent_whole(g.where((F.col("place") == 1) & F.col("label").isin(*_ABOUT_LOCI))), "p").select("item_id", "s")
    by_gene = written(top_k(by_gene, ["item_id"], [F.asc("s")], 3))
    by_trait = traits.where(F.col("label").isin(*_ABOUT_LOCI)).join(by_gene, "item_id", "left_anti").withColumn("nation", F.length("trait"))
    by_trait = by_trait.join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("nation")).select("item_id", "nth", F.col("s_suppkey").alias("s"))
    by_trait = top_k(by_trait, ["item_id"], [F.asc("nth"), F.asc("s")], 5)
    first = by_trait.groupBy("item_id").agg(F.min("nth").alias("nth"))
    loci = by_gene.select("item_id", "s").union(by_trait.join(first, ["item_id", "nth"]).select("item_id", "s"))
    b2 = loci.groupBy("item_id").agg(F.concat(F.lit("Loci: "), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s.cast("string")), ", ")).alias("t"))  # five at most
    three = lambda x: F.format_string("%.3f", x)
    st = trait_figures(read(spark, d, "events")).select(F.col("event_type").alias("trait"), F.concat("event_type", F.lit(": n="), _str("samples"), F.lit(", mean "), three("mean"), F.lit(", range "), three("low"), F.lit(" to "), three("high")).alias("t"))
    b3 = traits.where((F.col("nth") == 1) & F.col("label").isin(*_ABOUT_STATS)).join(st, "trait").select("item_id", F.lit(4).alias("place"), "t")
    every = b1.unionByName(b2.select("item_id", F.lit(3).alias("place"), "t")).unionByName(b3)
    joined = every.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "\n\n").alias("t"))  # four parts at most
    block = F.when(F.length("t") > _MOST_CHARS, F.concat(F.substring("t", 1, _MOST_CHARS), F.lit(_CUT))).otherwise(F.coalesce("t", F.lit("")))
    return c.where(~F.col("label").isin("count", "locate", "boundary")).join(joined, "item_id", "left").select("item_id", block.alias("block"))


@query(f"""WITH {_BRIDGE}, l AS (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY s) AS nth, count(*) OVER (PARTITION BY p) AS n FROM br)
SELECT p_partkey, 'Gene ' || p_partkey || ' (' || p_brand || '), ' || format('{{:,}}', CAST(floor(p_retailprice * 1000) AS BIGINT)) || ' bp: ' || string_agg('locus ' || s, ', ' ORDER BY s) FILTER (nth <= 3) || CASE WHEN max(n) > 3 THEN ' and ' || (max(n) - 3) || ' more' ELSE '' END AS text FROM part JOIN l ON p = p_partkey GROUP BY p_partkey, p_brand, p_retailprice""")
def profile_format(spark, d):
    """A profile as a line: thousands set apart, the first three of a list and the number of the rest."""
    l = _bridge(spark, d).groupBy("p").agg(F.sort_array(F.collect_list("s")).alias("s"))
    more = F.when(F.size("s") > 3, F.concat(F.lit(" and "), (F.size("s") - 3).cast("string"), F.lit(" more"))).otherwise("")
    some = F.array_join(F.transform(F.slice("s", 1, 3), lambda x: F.concat(F.lit("locus "), x.cast("string"))), ", ")
    p = read(spark, d, "part").join(l, F.col("p") == F.col("p_partkey"))
    return p.select("p_partkey", F.concat(F.lit("Gene "), _str("p_partkey"), F.lit(" ("), "p_brand", F.lit("), "), F.format_number(F.floor(F.col("p_retailprice") * 1000), 0), F.lit(" bp: "), some, more).alias("text"))


@query("""WITH c AS (SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY p_partkey), b AS (SELECT *, CASE WHEN n = 0 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' ELSE '10+' END AS bin FROM c)
SELECT bin, count(*) AS papers, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM c), 3) AS percent, (SELECT count(*) FROM c WHERE n > 0) AS cited, (SELECT round(avg(n), 4) FROM c WHERE n > 0) AS mean_cited FROM b GROUP BY bin""")
def cache_stats(spark, d):
    """The citation cache: all papers, those cited and their mean, and fixed bins with percentages."""
    some = read(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    c = read(spark, d, "part").select("p_partkey").join(some, "p_partkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    n = F.col("n")
    g = c.groupBy(F.when(n == 0, "0").when(n < 2, "1").when(n < 5, "2-4").when(n < 10, "5-9").otherwise("10+").alias("bin")).agg(F.count("*").alias("papers"), F.count_if(n > 0).alias("some"), F.sum("n").alias("sum"))
    whole = g.agg(F.sum("papers").alias("all"), F.sum("some").alias("cited"), F.round(F.sum("sum") / F.sum("some"), 4).alias("mean_cited"))
    return g.join(F.broadcast(whole)).select("bin", "papers", F.round(100.0 * F.col("papers") / F.col("all"), 3).alias("percent"), "cited", "mean_cited")  # one row


_SOME_DOI = "CASE doc_id % 4 WHEN 0 THEN '10.1/' || doc_id % 50 WHEN 1 THEN 'x' WHEN 2 THEN lower(source) || '10.2' ELSE '10.1000/' || doc_id END"


@query(f"SELECT DISTINCT trim({_SOME_DOI}) AS doi FROM documents WHERE length(trim({_SOME_DOI})) > 5 AND contains({_SOME_DOI}, '/') ORDER BY 1")
def valid_dois(spark, d):
    """DOIs to ask for: each once, long enough, with a slash, in order."""
    k = read(spark, d, "documents").select(F.trim(F.expr(_SOME_DOI)).alias("doi"))
    return k.where((F.length("doi") > 5) & F.col("doi").contains("/")).distinct().orderBy("doi")


@query("""WITH a AS (SELECT 0 AS ord, p_partkey AS id, p_name AS name, p_brand AS chr, NULL AS price FROM part UNION ALL SELECT 1, l_partkey, NULL, NULL, max(l_extendedprice) FROM lineitem GROUP BY l_partkey UNION ALL SELECT 2, doc_id, source, NULL, NULL FROM documents WHERE doc_id % 5 = 0)
SELECT id, arg_max(name, ord) FILTER (name IS NOT NULL) AS name, arg_max(chr, ord) FILTER (chr IS NOT NULL) AS chr, arg_max(price, ord) FILTER (price IS NOT NULL) AS price, count(*) AS tables FROM a GROUP BY id""")
def kg_merge_nodes(spark, d):
    """A node of each id from several tables: of each attribute the last value that is not null."""
    none = lambda t: F.lit(None).cast(t)
    a = read(spark, d, "part").select(F.lit(0).alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("chr"), none("double").alias("price"))
    b = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("m")).select(F.lit(1), F.col("l_partkey"), none("string"), none("string"), F.col("m"))
    c = read(spark, d, "documents").where("doc_id % 5 = 0").select(F.lit(2), F.col("doc_id"), F.col("source"), none("string"), none("double"))
    last = lambda x: F.max(F.when(F.col(x).isNotNull(), F.struct("ord", x)))[x].alias(x)
    return a.union(b).union(c).groupBy("id").agg(last("name"), last("chr"), last("price"), F.count("*").alias("tables"))


@query("""WITH cu AS (SELECT doc_id AS id, 'known-' || source AS symbol, doc_id AS ord FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id // 2, 'late-' || lang, 100000 + doc_id FROM documents WHERE doc_id % 7 = 0)
SELECT p_partkey, coalesce((SELECT arg_max(symbol, ord) FROM cu WHERE cu.id = p_partkey), p_name) AS symbol FROM part""")
def kg_enrich(spark, d):
    """Nodes with what a curated list says of them, its last entry; nodes that are not there are not added."""
    docs = read(spark, d, "documents")
    cu = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("p_partkey"), F.concat(F.lit("known-"), "source").alias("symbol"), F.col("doc_id").alias("ord"))
    cu = cu.union(docs.where("doc_id % 7 = 0").select(F.floor(F.col("doc_id") / 2), F.concat(F.lit("late-"), "lang"), F.col("doc_id") + 100000))
    last = cu.groupBy("p_partkey").agg(F.max(F.struct("ord", "symbol"))["symbol"].alias("s"))
    return read(spark, d, "part").join(last, "p_partkey", "left").select("p_partkey", F.coalesce("s", "p_name").alias("symbol"))


@query(f"""WITH {_BRIDGE}, l AS (SELECT p, s, s_nationkey, n_regionkey, row_number() OVER (PARTITION BY p ORDER BY s) AS nth, row_number() OVER (PARTITION BY p, n_regionkey ORDER BY s) AS in_region FROM br JOIN supplier ON s = s_suppkey JOIN nation ON n_nationkey = s_nationkey),
lo AS (SELECT p, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS loci FROM l WHERE nth <= 10 GROUP BY p), r AS (SELECT p, n_regionkey, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS t FROM l WHERE in_region <= 3 GROUP BY ALL), g AS (SELECT p, string_agg(n_regionkey || ':' || t, ';' ORDER BY n_regionkey) AS by_region FROM r GROUP BY p),
an AS (SELECT DISTINCT l_partkey AS p, l_returnflag AS db, l_linestatus || l_linenumber AS f, 'GO:' || strftime(l_shipdate, '%Y%m') AS go, 'PF' || CAST(l_quantity AS BIGINT) AS pf FROM lineitem),
fu AS (SELECT p, string_agg(db || ': ' || first || CASE WHEN n > 1 THEN ' and ' || (n - 1) || ' more' ELSE '' END, ';' ORDER BY db) AS functions FROM (SELECT p, db, min(f) AS first, count(DISTINCT f) AS n FROM an GROUP BY ALL) GROUP BY p),
go AS (SELECT p, count(*) || ': ' || array_to_string(list(go ORDER BY go)[1:10], ',') AS go_terms FROM (SELECT DISTINCT p, go FROM an) GROUP BY p), pf AS (SELECT p, count(*) || ': ' || array_to_string(list(pf ORDER BY pf)[1:5], ',') AS pfam FROM (SELECT DISTINCT p, pf FROM an) GROUP BY p)
SELECT p_partkey, p_brand, p_type, coalesce(loci, '') AS loci, coalesce(by_region, '') AS by_region, coalesce(functions, '') AS functions, coalesce(go_terms, '') AS go_terms, coalesce(pfam, '') AS pfam FROM part LEFT JOIN lo ON lo.p = p_partkey LEFT JOIN g ON g.p = p_partkey LEFT JOIN fu ON fu.p = p_partkey LEFT JOIN go ON go.p = p_partkey LEFT JOIN pf ON pf.p = p_partkey""")
def kg_gene_profile(spark, d):
    """A gene with its place, up to ten loci and three of each region, its functions by database, ten GO terms and five domains.

    Counts and the first terms only: each kind is made distinct before it is gathered, and no more than is shown is kept of it.
    """
    places = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("s"), "n_regionkey")
    l = _bridge(spark, d).join(places, "s")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    lo = l.groupBy("p").agg(text(F.slice(F.sort_array(F.collect_list("s")), 1, 10)).alias("loci"))
    r = l.groupBy("p", "n_regionkey").agg(text(F.slice(F.sort_array(F.collect_list("s")), 1, 3)).alias("t"))
    g = r.groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_regionkey", "t"))), lambda x: F.concat(x["n_regionkey"].cast("string"), F.lit(":"), x["t"])), ";").alias("by_region"))
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("db"), F.concat("l_linestatus", _str("l_linenumber")).alias("f"), F.concat(F.lit("GO:"), F.date_format("l_shipdate", "yyyyMM")).alias("go"), F.concat(F.lit("PF"), F.col("l_quantity").cast("long").cast("string")).alias("pf"))
    fu = li.groupBy("p", "db").agg(F.min("f").alias("first"), F.count_distinct("f").alias("n"))
    line = F.concat("db", F.lit(": "), "first", F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise(""))
    fu = fu.groupBy("p").agg(F.array_join(F.sort_array(F.collect_list(line)), ";").alias("functions"))  # one line for each database

    def first_terms(c: str, k: int, name: str):
        each = li.select("p", c).distinct()
        shown = top_k(each, ["p"], [F.asc(c)], k).groupBy("p").agg(F.array_join(F.sort_array(F.collect_list(c)), ",").alias("t"))
        return each.groupBy("p").agg(F.count("*").alias("n")).join(shown, "p").select("p", F.concat(_str("n"), F.lit(": "), "t").alias(name))

    p = read(spark, d, "part").select(F.col("p_partkey").alias("p"), "p_brand", "p_type").join(lo, "p", "left").join(g, "p", "left").join(fu, "p", "left")
    p = p.join(first_terms("go", 10, "go_terms"), "p", "left").join(first_terms("pf", 5, "pfam"), "p", "left")
    return p.select(F.col("p").alias("p_partkey"), "p_brand", "p_type", *(F.coalesce(c, F.lit("")).alias(c) for c in ("loci", "by_region", "functions", "go_terms", "pfam")))


@query(f"""WITH {_BRIDGE}, cu AS (SELECT p_partkey AS p, 'N' || p_size % 25 AS trait FROM part WHERE p_partkey % 10 = 0)
SELECT cu.p AS gene, trait, count(*) FILTER (trait = 'N' || s_nationkey) AS matching, count(*) FILTER (trait <> 'N' || s_nationkey) AS others, min(CASE WHEN trait = 'N' || s_nationkey THEN s END) AS first_match FROM cu JOIN br ON br.p = cu.p JOIN supplier ON s_suppkey = s GROUP BY ALL""")
def kg_trait_loci(spark, d):
    """The loci that hold a trait's curated genes, those of the same trait apart from the others."""
    cu = read(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("p"), F.concat(F.lit("N"), (F.col("p_size") % 25).cast("string")).alias("trait"))
    l = cu.join(_bridge(spark, d), "p").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.concat(F.lit("N"), _str("s_nationkey")).alias("t")), "s")
    same = F.col("trait") == F.col("t")
    return l.groupBy(F.col("p").alias("gene"), "trait").agg(F.count_if(same).alias("matching"), F.count_if(~same).alias("others"), F.min(F.when(same, F.col("s"))).alias("first_match"))


@query(f"""WITH {_BRIDGE}, lo AS (SELECT s_nationkey AS trait, s_suppkey AS s, coalesce(TRY_CAST(regexp_replace(CASE WHEN s_suppkey % 9 = 0 THEN 'unknown' ELSE 'Chr0' || s_suppkey % 10 END, '[^0-9]', '', 'g') AS INTEGER), 99) AS chr, count(*) AS genes FROM supplier JOIN br ON s = s_suppkey GROUP BY ALL),
ls AS (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY chr, genes DESC, s) AS place, count(*) FILTER (chr <> 99) OVER (PARTITION BY trait) AS mapped FROM lo QUALIFY place <= 10),
ge AS (SELECT trait, place, chr, mapped, p, row_number() OVER (PARTITION BY trait, place ORDER BY p) AS nth FROM ls JOIN br USING (s) QUALIFY nth <= 8),
un AS (SELECT trait, max(mapped) AS mapped, p, min(place * 100 + nth) AS first_seen, min(chr) AS chr FROM ge GROUP BY trait, p)
SELECT trait, p AS gene, CAST(mapped AS BIGINT) AS mapped, row_number() OVER (PARTITION BY trait ORDER BY first_seen) AS nth FROM un QUALIFY row_number() OVER (PARTITION BY trait ORDER BY first_seen) <= 50""")
def kg_trait_genes(spark, d):
    """A trait's loci by chromosome (unknown ones last) and size, ten of them with eight genes each, every gene once, up to fifty."""
    b = _bridge(spark, d)
    name = F.when(F.col("s_suppkey") % 9 == 0, "unknown").otherwise(F.concat(F.lit("Chr0"), (F.col("s_suppkey") % 10).cast("string")))
    lo = read(spark, d, "supplier").select(F.col("s_nationkey").alias("trait"), F.col("s_suppkey").alias("s"), F.coalesce(F.regexp_replace(name, "[^0-9]", "").try_cast("int"), F.lit(99)).alias("chr"))
    lo = lo.join(b.groupBy("s").agg(F.count("*").alias("genes")), "s").withColumn("mapped", F.count_if(F.col("chr") != 99).over(Window.partitionBy("trait")))
    ls = top_k(lo, ["trait"], [F.asc("chr"), F.desc("genes"), F.asc("s")], 10, "place")
    ge = top_k(ls.select("trait", "s", "place", "mapped").join(b, "s"), ["trait", "place"], [F.asc("p")], 8, "nth")
    un = ge.groupBy("trait", "p").agg(F.max("mapped").alias("mapped"), F.min(F.col("place") * 100 + F.col("nth")).alias("first_seen"))
    return top_k(un, ["trait"], [F.asc("first_seen")], 50, "nth").select("trait", F.col("p").alias("gene"), "mapped", F.col("nth").cast("long").alias("nth"))


_PATTERNS = (("upper", "[A-Z]{3,}[0-9]*"), ("mixed", "[A-Z][a-z]{2,}[0-9]+"), ("address", "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"), ("number", "[0-9]{3,}"), ("token", "token = [^ ]+"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS pattern, sym, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS sym FROM documents) WHERE length(sym) >= 3 AND upper(sym) NOT IN ('THE', 'AND', 'FOR') GROUP BY sym" for n, p in _PATTERNS))
def mine_patterns(spark, d):
    """Each pattern's own matches, so that one string may count under several: all patterns in one pass over the texts."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.regexp_extract_all("text", F.lit(p), 0).alias("s")) for n, p in _PATTERNS)))
    m = read(spark, d, "documents").select(each.alias("m")).select("m.pattern", F.explode("m.s").alias("sym"))
    return m.where((F.length("sym") >= 3) & ~F.upper("sym").isin("THE", "AND", "FOR")).groupBy("pattern", "sym").agg(F.count("*").alias("n"))


# --- citations of answers -----------------------------------------------------------------

#: An answer with groups of references in brackets, of which four exist.
_ANSWER = "text || ' [' || (turn % 5 + 1) || ',' || (conv_id % 7) || ']  and [9] then [' || (conv_id % 3 + 1) || ', ' || (turn % 4) || ' ] or [ ] end [2]'"
_GROUP = r"\[([0-9, \t]+)\]"
_VALID = ("1", "2", "3", "4")
_IDS = f"list_filter(list_transform(flatten(list_transform(regexp_extract_all(a, '{_GROUP}', 1), lambda g: string_split(g, ','))), lambda n: trim(n)), lambda n: regexp_matches(n, '^[0-9]+$'))"
_CITED = f"""an AS (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations WHERE role = 'assistant' AND text IS NOT NULL), id AS (SELECT conv_id, turn, a, {_IDS} AS ids FROM an),
od AS (SELECT *, list_filter(list_filter(ids, lambda n, i: list_position(ids, n) = i), lambda n: n IN ('1', '2', '3', '4')) AS valid, list_filter(ids, lambda n, i: list_position(ids, n) = i) AS seen FROM id)"""


def _renumbered_sql(ordered: str) -> str:
    group = f"list_transform(regexp_extract_all(a, '{_GROUP}', 1), lambda g: CASE WHEN len(list_filter(list_transform(string_split(g, ','), lambda n: list_position({ordered}, trim(n))), lambda p: p > 0)) = 0 THEN '' ELSE '[' || array_to_string(list_filter(list_transform(string_split(g, ','), lambda n: list_position({ordered}, trim(n))), lambda p: p > 0), ',') || ']' END)"
    return rf"regexp_replace(regexp_replace(array_to_string(list_transform(list_zip(regexp_split_to_array(a, '\[[0-9, \t]+\]'), {group}), lambda z: z[1] || coalesce(z[2], '')), ''), '\[[ \t]*\]', '', 'g'), '  +', ' ', 'g')"


def cited(answer: Column) -> Column:
    """The numbers in an answer's brackets, in order."""
    numbers = F.transform(F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(_GROUP), 1), lambda g: F.split(g, ",", -1))), lambda n: F.trim(n))
    return F.filter(numbers, lambda n: n.rlike("^[0-9]+$"))


def rewritten(answer: Column, ordered: Column) -> Column:
    """The answer with the numbers in `ordered` as their places there; others go, and brackets without any."""
    def group(g: Column) -> Column:
        places = F.filter(F.transform(F.split(g, ",", -1), lambda n: F.array_position(ordered, F.trim(n))), lambda p: p > 0)
        return F.when(F.size(places) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(F.transform(places, lambda p: p.cast("string")), ","), F.lit("]")))

    groups = F.transform(F.regexp_extract_all(answer, F.lit(_GROUP), 1), group)
    parts = F.zip_with(F.split(answer, r"\[[0-9, \t]+\]", -1), groups, lambda x, g: F.concat(x, F.coalesce(g, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, ""), r"\[[ \t]*\]", ""), "  +", " ")


def _answers(spark, d):
    a = read(spark, d, "conversations").where("role = 'assistant' and text is not null").select("conv_id", "turn", F.expr(_ANSWER).alias("a"))
    a = a.withColumn("seen", F.array_distinct(cited(F.col("a"))))
    return a.withColumn("valid", F.filter("seen", lambda n: n.isin(*_VALID)))


@query(f"""WITH {_CITED} SELECT conv_id, turn, CASE WHEN len(valid) = 0 THEN a ELSE {_renumbered_sql('valid')} END AS answer, array_to_string(list_transform(valid, lambda n, i: '[' || i || '] Reference ' || n), '; ') AS refs FROM od""")
def citation_rewrite(spark, d):
    """References renumbered by first appearance, numbers without a reference dropped, and the list rebuilt to match."""
    a = _answers(spark, d)
    refs = F.array_join(F.transform("valid", lambda n, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Reference "), n)), "; ")
    return a.select("conv_id", "turn", F.when(F.size("valid") == 0, F.col("a")).otherwise(rewritten(F.col("a"), F.col("valid"))).alias("answer"), refs.alias("refs"))


@query(f"""WITH {_CITED} SELECT conv_id, turn, {_renumbered_sql('seen')} AS answer, array_to_string(list_transform(seen, lambda n, i: n || '>' || i), ',') AS citation_map FROM od""")
def citation_stream_map(spark, d):
    """The same without a check of what exists, as the service does it, with the map from old to new numbers."""
    m = F.array_join(F.transform("seen", lambda n, i: F.concat(n, F.lit(">"), (i + 1).cast("string"))), ",")
    return _answers(spark, d).select("conv_id", "turn", rewritten(F.col("a"), F.col("seen")).alias("answer"), m.alias("citation_map"))


#: Thoughts before an answer, and the length of a token, which cuts the separator between them anywhere.
_THOUGHT, _TOKEN = "'It was asked [' || turn || '] <think of [3]' || role", 7


@query(f"""WITH {_CITED} SELECT conv_id, turn, {_renumbered_sql('seen')} AS answer, array_to_string(list_transform(seen, lambda n, i: n || '>' || i), ',') AS citation_map FROM od""")
def answer_stream(spark, d):
    """Answers put together from a stream of tokens, without what was thought before the separator, with their map at the end."""
    from quern.streaming.answers import SEPARATOR, assembled

    path = shared_dir(spark)
    whole = read(spark, d, "conversations").where("role = 'assistant' and text is not null").select("conv_id", "turn", F.concat(F.expr(_THOUGHT), F.lit(SEPARATOR), F.expr(_ANSWER)).alias("a"))
    n = F.ceil(F.length("a") / _TOKEN).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    tokens = whole.select("conv_id", "turn", "a", n.alias("n"), F.explode(at).alias("i")).select("conv_id", "turn", "i", F.col("a").substr(F.col("i") * _TOKEN + 1, F.lit(_TOKEN)).alias("token"), (F.col("i") + 1 == F.col("n")).alias("last"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("i")).alias("ts"))
    tokens.repartition(4, "conv_id", "i").write.parquet(f"{path}/tokens")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/tokens").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/tokens")
    run = assembled(stream).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("conv_id long, turn long, kind string, text string").parquet(f"{path}/rows").where("kind = 'answer'").withColumn("seen", F.array_distinct(cited(F.col("text"))))
    m = F.array_join(F.transform("seen", lambda n, i: F.concat(n, F.lit(">"), (i + 1).cast("string"))), ",")
    return rows.select("conv_id", "turn", rewritten(F.col("text"), F.col("seen")).alias("answer"), m.alias("citation_map"))


_KEPT = r"list_filter(list_transform(string_split(g, ','), lambda n: trim(n)), lambda n: regexp_matches(n, '^[1-3]$'))"


@query(rf"""WITH {_CITED}, g AS (SELECT conv_id, turn, a, list_transform(regexp_extract_all(a, '{_GROUP}', 1), lambda g: CASE WHEN len({_KEPT}) = 0 THEN '' ELSE '[' || array_to_string({_KEPT}, ',') || ']' END) AS gs FROM od)
SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_transform(list_zip(regexp_split_to_array(a, '\[[0-9, \t]+\]'), gs), lambda z: z[1] || coalesce(z[2], '')), ''), '\[[ \t]*\]', '', 'g'), '  +', ' ', 'g') AS answer FROM g""")
def citation_strip(spark, d):
    """Numbers beyond the reference list (of three here) are taken out of the answer."""
    def group(g: Column) -> Column:
        kept = F.filter(F.transform(F.split(g, ",", -1), lambda n: F.trim(n)), lambda n: n.rlike("^[1-3]$"))
        return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")))

    groups = F.transform(F.regexp_extract_all("a", F.lit(_GROUP), 1), group)
    parts = F.zip_with(F.split("a", r"\[[0-9, \t]+\]", -1), groups, lambda x, g: F.concat(x, F.coalesce(g, F.lit(""))))
    return _answers(spark, d).select("conv_id", "turn", F.regexp_replace(F.regexp_replace(F.array_join(parts, ""), r"\[[ \t]*\]", ""), "  +", " ").alias("answer"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL), n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role) AS idx FROM f)
SELECT conv_id, string_agg('[' || idx || '] ' || upper(role[1]) || role[2:] || '. Conversation ' || conv_id || '.', chr(10) ORDER BY idx) AS refs FROM n GROUP BY conv_id""")
def reference_list(spark, d):
    """The sources of an answer in the order of their numbers."""
    f = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    g = f.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "role"))).alias("x"))
    line = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.initcap(r["role"]), F.lit(". Conversation "), _str("conv_id"), F.lit("."))
    return g.select("conv_id", F.array_join(F.transform("x", line), "\n").alias("refs"))
