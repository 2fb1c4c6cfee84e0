"""Papers: cleaning and merging of paragraphs, titles, journals, citations, back-filled abstracts, located papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import STOPWORDS, title, tokens
from quern.operators.ranking import top_k
from quern.plans.registry import registry
from quern.plans.retrieval import HYBRID, TOKENS, reranked
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

_SMALL_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)
_FIRST_LINE = "split_part(text, chr(10), 1)"


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(regexp_split_to_array(coalesce(text, ''), '(?mi)^(?:references|appendix)[ \t]*$')[1], chr(10)),
 lambda l: trim(l) = '' OR NOT (regexp_matches(trim(l), '^[0-9]{1,4}$') OR (length(trim(l)) < 15 AND NOT regexp_matches(trim(l), '[.!?]$')))), chr(10)), '-\n', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) AS n, md5(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')) AS clean_md5 FROM c""")
def clean_document(spark, d):
    """Text before the first references or appendix heading, without page numbers and stray short lines, hyphens repaired."""
    body = F.get(F.split(F.coalesce("text", F.lit("")), r"(?mid)^(?:references|appendix)[ \t]*$", 2), F.lit(0))
    line = lambda x: F.trim(x)
    keep = lambda x: (line(x) == "") | ~(line(x).rlike("^[0-9]{1,4}$") | ((F.length(line(x)) < 15) & ~line(x).rlike("[.!?]$")))
    t = F.regexp_replace(F.array_join(F.filter(F.split(body, "\n", -1), keep), "\n"), "-\n", "")
    c = read(spark, d, "documents").select("doc_id", t.alias("t"))
    return c.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.regexp_replace("t", "\n{3,}", "\n\n")).alias("clean_md5"))


#: Paragraphs shorter than the first are dropped; chunks grow until they reach the second.
_PARAGRAPH, _CHUNK = 80, 150


def _starts(lengths: Column) -> Column:
    """Where chunks begin, from one, and the end: they close on reaching _CHUNK characters, an unfinished tail joins the one before."""
    start = F.struct(F.lit(1).alias("i"), F.lit(0).alias("filled"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, n: Column) -> Column:
        opens = a["filled"] == 0
        filled = a["filled"] + n + F.when(opens, 0).otherwise(1)
        return F.struct((a["i"] + 1).alias("i"), F.when(filled >= _CHUNK, 0).otherwise(filled).alias("filled"), F.when(opens, F.array_append(a["starts"], a["i"])).otherwise(a["starts"]).alias("starts"))

    def close(a: Column) -> Column:
        tail = (a["filled"] > 0) & (F.size(a["starts"]) > 1)
        return F.array_append(F.when(tail, F.slice(a["starts"], 1, F.greatest(F.size(a["starts"]) - 1, F.lit(0)))).otherwise(a["starts"]), a["i"])

    return F.aggregate(lengths, start, step, close)


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, p, length(p) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE length(p) >= {_PARAGRAPH}),
r AS (SELECT doc_id, i, 0 AS chunk, n AS filled FROM k WHERE i = 1
 UNION ALL SELECT k.doc_id, k.i, CASE WHEN filled >= {_CHUNK} THEN chunk + 1 ELSE chunk END, CASE WHEN filled >= {_CHUNK} THEN k.n ELSE filled + 1 + k.n END FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1),
e AS (SELECT doc_id, i, chunk, filled, max(i) OVER (PARTITION BY doc_id) AS last FROM r),
t AS (SELECT doc_id, chunk AS tail FROM e WHERE i = last AND filled < {_CHUNK} AND chunk > 0)
SELECT doc_id, CASE WHEN chunk = tail THEN chunk - 1 ELSE chunk END AS chunk, count(*) AS paragraphs, md5(string_agg(p, chr(10) ORDER BY i)) AS chunk_md5
FROM e JOIN k USING (doc_id, i) LEFT JOIN t USING (doc_id) GROUP BY 1, 2""")
def merge_short_paragraphs(spark, d):
    """Greedy merging within each row: a fold over the lengths of its paragraphs (a line each here), so nothing is shuffled."""
    p = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) >= _PARAGRAPH)
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", p.alias("p")).where("size(p) > 0")
    docs = docs.withColumn("at", _starts(F.transform("p", lambda x: F.length(x))))
    chunks = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.slice("p", F.element_at("at", i), F.element_at("at", i + 1) - F.element_at("at", i)))
    c = docs.select("doc_id", F.posexplode(chunks).alias("chunk", "ps"))
    return c.select("doc_id", "chunk", F.size("ps").cast("long").alias("paragraphs"), F.md5(F.array_join("ps", "\n")).alias("chunk_md5"))


_HEAD = "p_type || ' OF ' || upper(p_name)"


@query(f"""WITH t AS (SELECT p_partkey, {_HEAD} AS x FROM part)
SELECT p_partkey, CASE WHEN 10 * length(regexp_replace(x, '[^A-Z]', '', 'g')) <= 8 * length(regexp_replace(x, '[^A-Za-z]', '', 'g')) THEN x
 ELSE array_to_string(list_transform(string_split(x, ' '), lambda w, i: CASE WHEN regexp_matches(w, '[0-9]') THEN w WHEN i > 1 AND lower(w) IN ({_SMALL_WORDS}) THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS headline FROM t""")
def title_case(spark, d):
    """Shouted headlines in title case: small words low, words with digits as they are."""
    x = F.expr(_HEAD)
    shouted = F.length(F.regexp_replace("x", "[^A-Z]", "")) * 10 > F.length(F.regexp_replace("x", "[^A-Za-z]", "")) * 8
    first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    word = lambda w, i: F.when(w.rlike("[0-9]"), w).when((i > 0) & F.lower(w).isin(*STOPWORDS), F.lower(w)).otherwise(first(w))
    cased = F.array_join(F.transform(F.split("x", " ", -1), word), " ")
    return read(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", F.when(shouted, cased).otherwise(F.col("x")).alias("headline"))


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS kw, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark),
f AS (SELECT item_id, lower(kw) AS low, min(pos) AS pos, arg_min(kw, pos) AS kw FROM w WHERE kw <> '' GROUP BY ALL)
SELECT item_id, string_agg(kw, ' ' ORDER BY pos) AS keywords FROM f GROUP BY item_id""")
def keyword_dedup(spark, d):
    """Keywords in order, each only as it is first written, whatever its case."""
    w = read(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "kw")).where("kw <> ''")
    f = w.groupBy("item_id", F.lower("kw").alias("low")).agg(F.min(F.struct("pos", "kw")).alias("m"))
    g = f.groupBy("item_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return g.select("item_id", F.array_join(F.transform("m", lambda r: r["kw"]), " ").alias("keywords"))


@query(f"""WITH u AS (SELECT 0 AS priority, item_id AS id, lower(trim({_FIRST_LINE})) AS k FROM benchmark UNION ALL SELECT 1, doc_id, lower(trim({_FIRST_LINE})) FROM documents)
SELECT k, priority, id FROM u WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, id) = 1""")
def priority_union_dedup(spark, d):
    """One row of each key from two tables, the first table's before the second's; combined before the shuffle."""
    part = lambda t, n, i: read(spark, d, t).select(F.lit(n).alias("priority"), F.col(i).alias("id"), F.lower(F.trim(title(F.col("text")))).alias("k"))
    both = part("benchmark", 0, "item_id").unionByName(part("documents", 1, "doc_id")).where("k <> ''")
    return both.groupBy("k").agg(F.min(F.struct("priority", "id")).alias("m")).select("k", "m.priority", "m.id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def insert_ignore(spark, d):
    """The first row of each key, as an insert that leaves what is there keeps it."""
    m = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("m"))
    return m.select("user_id", "event_type", "m.event_id", "m.value")


#: Own tiers of journals: patterns at word boundaries by weight, the heaviest first.
_TIERS = ((10.0, ("src0", "src1")), (8.0, ("src[23]",)), (6.0, ("src1[0-4]",)), (4.0, ("src[4-7]",)))
_WEIGHT = " ".join(f"WHEN {' OR '.join(f'''regexp_matches(source, '{chr(92)}b{p}{chr(92)}b')''' for p in ps)} THEN {w}::DOUBLE" for w, ps in _TIERS)


@query(f"SELECT source, CASE {_WEIGHT} ELSE 3.0::DOUBLE END AS journal_score, count(*) AS papers FROM documents WHERE source IS NOT NULL GROUP BY 1, 2")
def journal_score(spark, d):
    """Scores of sources by tiers of patterns; patterns run once for each source and not for each paper."""
    score = F.lit(3.0)
    for w, ps in reversed(_TIERS):
        score = F.when(F.col("source").rlike("|".join(rf"\b{p}\b" for p in ps)), w).otherwise(score)
    g = read(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("papers"))
    return g.select("source", score.alias("journal_score"), "papers")


#: Abbreviated names, names that are the best, tiers of patterns, and words of any journal: the engine's own.
_SHORT = (("j steel", "journal of steel"), ("ann brass", "annals of brass"), ("promo lett", "promo letters"))
_BEST, _LEVELS, _ANY = ("economy", "large"), ((9.0, ("journal of steel", "annals of .*")), (7.0, ("standard.*letters", "promo")), (5.0, ("medium", "small reports"))), ("journal", "letters", "reports")
_NAME = "CASE p_partkey % 7 WHEN 0 THEN 'J. Steel' WHEN 1 THEN 'The Annals of ' || p_brand WHEN 2 THEN p_type || ' Letters' WHEN 3 THEN p_type || ', Reports' WHEN 4 THEN p_type WHEN 5 THEN 'Ann Brass' ELSE p_name END"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({x}), '^the ', ''), '[^a-z0-9]+', ' '{g}))"
_LONG = "CASE j " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SHORT) + " ELSE j END"


def _rank_sql(match: str) -> str:
    has = lambda p: f"{match}(k, '(^| )({p})( |$)')"
    tiers = " ".join(f"WHEN {' OR '.join(map(has, ps))} THEN {w}" for w, ps in _LEVELS)
    some = " OR ".join(f"contains(k, '{x}')" for x in _ANY)
    return f"CAST(CASE WHEN k IN ({', '.join(repr(x) for x in _BEST)}) THEN 10.0 {tiers} WHEN {some} THEN 4.0 ELSE 3.0 END AS DOUBLE)"


@query(f"""WITH j AS (SELECT {_PLAIN.format(x=_NAME, g=", 'g'")} AS j FROM part), k AS (SELECT {_LONG} AS k FROM j) SELECT k AS journal, {_rank_sql('regexp_matches')} AS score, count(*) AS papers FROM k GROUP BY 1, 2""")
def journal_rank(spark, d):
    """Names put plainly, abbreviations written out, then the best names, tiers of patterns in order, words of journals, or the floor; once for each name."""
    k = read(spark, d, "part").select(F.expr(_PLAIN.format(x=_NAME, g="")).alias("j")).groupBy(F.expr(_LONG).alias("k")).agg(F.count("*").alias("papers"))
    return k.select(F.col("k").alias("journal"), F.expr(_rank_sql("regexp_like")).alias("score"), "papers")


#: The year that ages count from, and bonuses by log10 of citations a year (fixed values).
_YEAR, _STEPS = 2026, ((2.0, 0.15), (1.7, 0.12), (1.3, 0.09), (1.0, 0.06), (0.7, 0.03), (0.3, 0.01))
_RATED = ((9.0, 0.12), (7.5, 0.07), (5.0, 0.03))


@query(f"""WITH c AS (SELECT l_partkey AS p_partkey, count(*) AS cites FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, 1976 + p_size AS year, cites, 3.0::DOUBLE + p_size % 8 AS journal FROM part LEFT JOIN c USING (p_partkey)),
r AS (SELECT *, CASE WHEN year > 2000 THEN cites / greatest(1, {_YEAR} - year)::DOUBLE ELSE cites / 10.0::DOUBLE END AS rate,
 CASE {' '.join(f'WHEN journal >= {a} THEN {b}::DOUBLE' for a, b in _RATED)} ELSE 0 END AS jb FROM p),
b AS (SELECT *, CASE {' '.join(f'WHEN rate > 0 AND round(log10(CASE WHEN rate > 0 THEN rate ELSE 1 END), 9) >= {a} THEN {v}::DOUBLE' for a, v in _STEPS)} ELSE 0 END AS cb FROM r)
SELECT p_partkey, round(cb, 6) AS citation_bonus, round(CASE WHEN cites IS NULL OR cites < 5 AND {_YEAR} - year <= 3 THEN jb WHEN cites < 3 AND {_YEAR} - year <= 5 THEN (jb + cb) / 2 ELSE cb END, 6) AS quality_bonus FROM b""")
def citation_bonus(spark, d):
    """Bonus by citations a year (rows of lineitem cite a part); the journal stands in for papers too young to be cited."""
    cites = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cites"))
    p = read(spark, d, "part").select("p_partkey", (1976 + F.col("p_size")).alias("year"), (3.0 + F.col("p_size") % 8).alias("journal")).join(cites, "p_partkey", "left")
    age = _YEAR - F.col("year")
    rate = F.when(F.col("year") > 2000, F.col("cites") / F.greatest(F.lit(1), age).cast("double")).otherwise(F.col("cites") / 10.0)
    log = F.round(F.log10(rate), 9)
    cb, jb = F.lit(0.0), F.lit(0.0)
    for at, v in reversed(_STEPS):
        cb = F.when(log >= at, v).otherwise(cb)
    for at, v in reversed(_RATED):
        jb = F.when(F.col("journal") >= at, v).otherwise(jb)
    p = p.withColumn("cb", cb).withColumn("jb", jb)
    young = F.col("cites").isNull() | ((F.col("cites") < 5) & (age <= 3))
    both = F.when(young, F.col("jb")).when((F.col("cites") < 3) & (age <= 5), (F.col("jb") + F.col("cb")) / 2).otherwise(F.col("cb"))
    return p.select("p_partkey", F.round("cb", 6).alias("citation_bonus"), F.round(both, 6).alias("quality_bonus"))


_LOCATE = "lang = 'en' AND lang IS NOT NULL"


@query(f"""{HYBRID} SELECT item_id, doc_id, place FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY ({_LOCATE}) DESC, quality DESC NULLS LAST, final, doc_id) AS place FROM h) WHERE place <= 6""")
def locate_rank(spark, d):
    """The best paper and up to five others: of the asked domain (language) first, then by quality, then by distance."""
    order = [F.expr(_LOCATE).desc(), F.desc_nulls_last("quality"), F.asc("final"), F.asc("doc_id")]
    return top_k(reranked(spark, d), ["item_id"], order, 6, "place").select("item_id", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"""{HYBRID}, qt AS (SELECT DISTINCT item_id, unnest({TOKENS('text')}) AS term FROM benchmark), tt AS (SELECT DISTINCT doc_id, unnest({TOKENS(_FIRST_LINE)}) AS term FROM documents),
m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM qt JOIN tt USING (term) GROUP BY item_id, doc_id QUALIFY rank <= 200),
bf AS (SELECT item_id, doc_id, 0.85::DOUBLE AS final, 'abstract' AS section FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.item_id = m.item_id AND h.doc_id = m.doc_id))
SELECT item_id, doc_id, final, 'chunk' AS section FROM h UNION ALL SELECT item_id, doc_id, final, section FROM bf""")
def abstract_backfill(spark, d):
    """Papers among the first 200 by title that gave no chunk join the hits with the fixed score 0.85, which ranks last as smaller is better."""
    asked = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    heads = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(title(F.col("text"))))).alias("term"))
    meta = heads.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    meta = top_k(meta, ["item_id"], [F.desc("n"), F.asc("doc_id")], 200).select("item_id", "doc_id")
    hits = reranked(spark, d).select("item_id", "doc_id", "final", F.lit("chunk").alias("section"))
    filled = meta.join(hits.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    return hits.unionByName(filled.select("item_id", "doc_id", F.lit(0.85).alias("final"), F.lit("abstract").alias("section")))
