"""Questions: what they name, their labels, keywords, filters and the indexes they go to.

The questions are benchmark items put into forms that people ask in; the phrases are the engine's own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import chinese_share, normal
from quern.operators.rules import Rule, from_table, labels, rule_hits
from quern.plans.registry import registry
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

_FORMS = (
    "'How many papers discuss ' || w || '?'",
    "'Which paper was published in plant cell about ' || w",
    "'What is the function of gene SbAB12 in ' || w",
    "'Overview of recent advances in ' || w",
    "'Which genes are involved in ' || w || ' and GWAS loci, or ' || x",
    "'How does ' || w || ' regulate the pathway of ' || x || ' from nature plants on ' || x",
    "'What will the market price of ' || w || ' be'",
    "'How many genes has ' || w",
    "'QTL and linkage mapping for ' || w || ', ' || x || ', ' || w",
    "'Sobic.001G123400'",
    "'Domain PF00069 and GO:0008150 with IPR000719 in Sobic.002G123400 and MSD2'",
    "'Compare ' || w || ' loci: introduce the GWAS candidate genes'",
    "'Tell me about MSD2 and the QTL of Sb03g012345'",
    "'Who are you? known gene of ' || w",
    "w || ' ' || x",
)
_QUESTION = "CASE item_id % 15 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"

#: Phrases by label, in the order in which a label can answer alone or becomes the first one.
EARLY = {"boundary": ("price", "predict", "forecast", "clinical trial", "subsidy", "tastes better"), "count": ("how many papers", "how many articles", "number of papers", "list all papers"), "locate": ("which paper", "which article", "published in", "first author", "doi of", "find the study")}
PHRASES = {
    "factoid": ("how many", "chromosome location", "genome size", "gene id"),
    "gene_function": ("function", "role", "what is", "tell me", "explain", "encode", "mutant", "about"),
    "qtl_gwas": ("qtl", "gwas", "loci", "locus", "linkage", "mapping"),
    "gene_list": ("which genes", "genes involved", "candidate genes"),
    "review": ("overview", "advances", "compare", "progress", "summary", "versus"),
    "mechanism": ("how does", "pathway", "mechanism", "regulation of", "why does"),
}
_MECHANISM_WORDS = ("how does", "how do", "mechanism", "pathway", "signaling", "promoter")
_DOMINANT, _INTRO = ("gwas", "qtl", "haplotype"), ("introduce", "describe")
ENTITY = "(^|[^A-Za-z0-9])(Sobic\\.[0-9]{3}G[0-9]{4,6}|Sb[0-9]{2}g[0-9]{6}|Sb[A-Za-z]{2,5}[0-9]{1,3}|[A-Z]{2,5}[0-9]{1,3}[a-z]?)([^A-Za-z0-9]|$)"
ACCESSION = "(PF[0-9]{5}|IPR[0-9]{6}|GO:[0-9]{7}|PTHR[0-9]{5})"

_any = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
_LISTS = {**EARLY, **PHRASES, "mechanism_words": _MECHANISM_WORDS, "dominant": _DOMINANT, "intro": _INTRO}
_FLAGS = {n: _any(w) for n, w in _LISTS.items()}
#: All phrases of all labels, found in one pass over a question.
_PHRASE_RULES = [Rule(w, n) for n, ws in _LISTS.items() for w in ws]


def _flags(match: str, held: dict[str, str]) -> dict[str, str]:
    """SQL of every signal in terms of the question `text`, its lower case `q` and what is `held`; `match` names the engine's regex test."""
    entity, accession = f"{match}(text, '(?i){ENTITY}')", f"{match}(text, '{ACCESSION}')"
    f = dict(held) | {"entity": entity, "accession": accession}
    f["factoid"] = f"({f['factoid']} OR {accession})"
    f["gene_function"] = f"({entity} AND NOT {f['mechanism_words']} AND ({f['gene_function']} OR length(trim(q)) <= 40 OR {match}(q, '(gene|protein)$')))"
    return f


_SPARK, _DUCK = _flags("regexp_like", {n: f"array_contains(found, '{n}')" for n in _LISTS}), _flags("regexp_matches", _FLAGS)
_TAGS = sorted(PHRASES)
QUESTIONS = f"qs AS (SELECT item_id, lower({_QUESTION}) AS q, {_QUESTION} AS text FROM (SELECT item_id, regexp_extract(text, '[A-Za-z]{{3,}}', 0) AS w, regexp_extract(text, '([A-Za-z]{{3,}})[^A-Za-z]*$', 1) AS x FROM benchmark))"
SIGNALS = f"{QUESTIONS}, sg AS (SELECT item_id, q, text, {', '.join(f'{v} AS is_{k}' for k, v in _DUCK.items())} FROM qs)"


def questions(spark, d):
    w, x = F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("w"), F.regexp_extract("text", "([A-Za-z]{3,})[^A-Za-z]*$", 1).alias("x")
    return read(spark, d, "benchmark").select("item_id", w, x).select("item_id", F.expr(_QUESTION).alias("text"))


def signals(spark, d):
    q = rule_hits(questions(spark, d).withColumn("q", F.lower("text")), F.col("text"), _PHRASE_RULES).withColumn("found", labels())
    # a Java regex in a SQL string: backslashes are doubled
    return q.select("item_id", "q", "text", *(F.expr(v.replace("\\", "\\\\")).alias(f"is_{k}") for k, v in _SPARK.items()))


@query(f"WITH {SIGNALS} SELECT item_id, is_entity, is_accession, {', '.join(f'is_{k}' for k in (*EARLY, *PHRASES))} FROM sg")
def question_signals(spark, d):
    """Named entities, accessions and the nine labels' conditions."""
    return signals(spark, d).select("item_id", "is_entity", "is_accession", *(f"is_{k}" for k in (*EARLY, *PHRASES)))


#: tags as in both dialects; t0 holds those without the fallbacks.
_T0 = ", ".join(f"CASE WHEN is_{t} THEN '{t}' END" for t in _TAGS)
_ORDER = ("factoid", "gene_function", "qtl_gwas", "gene_list", "review", "mechanism")


def _routes(has: str, without: str) -> tuple[str, str]:
    """SQL of the first label and the further ones; `has`(x) tests for a tag, `without`(...) lists the tags but some."""
    h = lambda x: has.format(x)
    base = "CASE " + " ".join(f"WHEN {h(t)} THEN '{t}'" for t in _ORDER) + " END"
    dominant = f"is_dominant AND is_intro AND {h('qtl_gwas')}"
    both, listed = f"{h('gene_function')} AND {h('qtl_gwas')}", f"{h('gene_list')} AND {h('qtl_gwas')}"
    early = " ".join(f"WHEN is_{e} THEN '{e}'" for e in EARLY)
    label = f"CASE {early} WHEN {dominant} THEN 'qtl_gwas' WHEN {both} THEN 'gene_function' WHEN {listed} THEN 'gene_list' ELSE {base} END"
    rest = lambda *gone: without.format(", ".join(f"'{g}'" for g in gone))
    first_rest = "CASE " + " ".join(f"WHEN {h(t)} THEN {rest(t)}" for t in _ORDER) + " END"
    pair = "CASE " + " ".join(f"WHEN {h(t)} THEN {rest(t, 'qtl_gwas')}" for t in _ORDER) + " END"
    joined = lambda x: f"'qtl_gwas' || CASE WHEN {x} = '' THEN '' ELSE ',' || {x} END"
    extras = f"CASE WHEN {' OR '.join(f'is_{e}' for e in EARLY)} THEN '' WHEN {dominant} THEN {rest('qtl_gwas')} WHEN {both} AND NOT {h('gene_list')} THEN {joined(f'({pair})')} WHEN {both} OR {listed} THEN {joined(rest('gene_list', 'qtl_gwas'))} ELSE {first_rest} END"
    return label, extras


_FALL = "CASE WHEN {n}(t0) > 0 THEN t0 WHEN is_entity THEN {a}'gene_function'{z} ELSE {a}'review'{z} END"
_LABEL, _EXTRAS = _routes("array_contains(tags, '{}')", "array_join(array_except(tags, array({})), ',')")
_LABEL_SQL, _EXTRAS_SQL = _routes("list_contains(tags, '{}')", "array_to_string(list_filter(tags, lambda y: y NOT IN ({})), ',')")
CLASSIFIED = f"""{SIGNALS}, t0 AS (SELECT *, list_filter([{_T0}], lambda z: z IS NOT NULL) AS t0 FROM sg), tg AS (SELECT *, {_FALL.format(n='len', a='[', z=']')} AS tags FROM t0),
cl AS (SELECT item_id, text, q, {_LABEL_SQL} AS label, {_EXTRAS_SQL} AS extras FROM tg)"""


def classified(spark, d):
    """(item_id, text, q, label, extras): each question's first label, and the further ones in order."""
    t = signals(spark, d).withColumn("t0", F.expr(f"filter(array({_T0}), z -> z is not null)"))
    # generators keep the optimizer from writing the tags, and filters on labels, out again for each use
    t = t.select("*", F.explode(F.array(F.expr(_FALL.format(n="size", a="array(", z=")")))).alias("tags"))
    return t.select("item_id", "text", "q", F.inline(F.array(F.struct(F.expr(_LABEL).alias("label"), F.expr(_EXTRAS).alias("extras")))))


@query(f"WITH {CLASSIFIED} SELECT item_id, label, extras FROM cl")
def classify_question(spark, d):
    """Nine labels: three answer alone, of the others one comes first, by order and by the rules for pairs."""
    return classified(spark, d).select("item_id", "label", "extras")


#: Indexes by label, in the order of search (fixed values).
INDEXES = {"factoid": ("fine", "std"), "gene_function": ("fine", "std", "large"), "mechanism": ("std", "large", "fine", "para"), "qtl_gwas": ("std", "fine", "large"), "review": ("para", "large", "std", "fine"), "gene_list": ("fine", "std", "large", "para")}
_INDEX_ROWS = [(label, name, i) for label, names in INDEXES.items() for i, name in enumerate(names)]
INDEXED = "ix(label, index_name, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _INDEX_ROWS) + ")"


@query(f"WITH {CLASSIFIED}, {INDEXED} SELECT item_id, label, index_name, CAST(ord AS BIGINT) AS ord FROM cl JOIN ix USING (label)")
def index_route(spark, d):
    """The indexes of each question; count, locate and boundary questions search none."""
    ix = spark.createDataFrame(_INDEX_ROWS, "label string, index_name string, ord long")
    return classified(spark, d).select("item_id", "label").join(F.broadcast(ix), "label").select("item_id", "label", "index_name", "ord")  # fixed rows


#: Own tables: a dictionary of fragments, contexts of genes (patterns at word boundaries), contexts of topics, terms that a domain
#: brings along, and the term that every search has.  Within a table keys go in this order.
_WORDS = (("how many", "number"), ("function", "gene function"), ("papers", "literature"), ("price", "economics"), ("pathway", "signaling pathway"), ("loci", "locus"), ("candidate", "Locus"))
_GENES = (("MSD[1-3]", "multiseeded spikelet fertility"), ("SbAB[0-9]+|AB12", "abscisic acid signaling"), ("Sobic", "gene model of the crop"))
_TOPICS = (("gwas", "association mapping panel"), ("QTL", "QTL mapping population"), ("regulate", "regulation of expression"), ("advances", "progress review"), ("linkage", "QTL mapping population"))
_DOMAINS = (("market", "value chain of the crop"), ("domain", "protein family annotation"), ("known gene", "cloned gene catalogue"), ("genes", "gene set"), ("plant cell", "cell biology"))
_BASE = "crop"
_LATIN = r"[A-Za-z][A-Za-z0-9_.-]*[A-Za-z0-9]|[A-Za-z]{2,}"
_TABLES = {"words": _WORDS, "topics": _TOPICS, "domains": _DOMAINS}
_KEY_RULES = [Rule(k, f"{name} {v}") for name, rows in _TABLES.items() for k, v in rows]
_HITS_SQL = {name: "list_filter([" + ", ".join(f"CASE WHEN contains(q, '{k.lower()}') THEN '{v}' END" for k, v in rows) + "], lambda z: z IS NOT NULL)" for name, rows in _TABLES.items()}
_BESIDE = "(^|[^A-Za-z0-9])({})([^A-Za-z0-9]|$)"
_GENES_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){_BESIDE.format(p)}') THEN '{v}' END" for p, v in _GENES) + "], lambda z: z IS NOT NULL)"
_RAW_SQL = "CASE WHEN regexp_matches(text, '[一-鿿]') THEN [] ELSE [trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))] END"
_PARTS = [_HITS_SQL["words"], f"regexp_extract_all(text, '{_LATIN}')", _GENES_SQL, _HITS_SQL["topics"], _HITS_SQL["domains"], _RAW_SQL]
_KEYWORDS = _PARTS[0]
for _part in _PARTS[1:]:
    _KEYWORDS = f"list_concat({_KEYWORDS}, {_part})"
KEYWORDED = f"""k0 AS (SELECT item_id, text, {_KEYWORDS} AS ks FROM sg), k1 AS (SELECT item_id, text, CASE WHEN contains(lower(array_to_string(ks, ' ')), '{_BASE}') THEN ks ELSE list_append(ks, '{_BASE}') END AS ks FROM k0),
kw AS (SELECT item_id, text, list_filter(ks, lambda z, i: list_position(list_transform(ks, lambda y: lower(y)), lower(z)) = i) AS ks FROM k1)"""


def keywords(spark, d):
    """(item_id, text, ks): dictionary hits, Latin tokens, contexts of genes and topics, terms of domains, the question itself if it
    holds no Chinese, and the base term where none has it; each once whatever its case."""
    s = rule_hits(questions(spark, d), F.col("text"), _KEY_RULES)
    of = lambda n: F.transform(F.filter("hits", lambda h: h["label"].startswith(f"{n} ")), lambda h: h["label"].substr(F.lit(len(n) + 2), F.lit(1000)))
    found = {n: of(n) for n in _TABLES}
    genes = F.filter(F.array(*(F.when(F.col("text").rlike(f"(?i){_BESIDE.format(p)}"), F.lit(v)) for p, v in _GENES)), lambda z: z.isNotNull())
    raw = F.when(F.col("text").rlike("[一-鿿]"), F.array().cast("array<string>")).otherwise(F.array(normal(F.col("text"))))
    ks = F.concat(found["words"], F.regexp_extract_all("text", F.lit(_LATIN), 0), genes, found["topics"], found["domains"], raw)
    s = s.select("item_id", "text", ks.alias("ks"))
    s = s.select("item_id", "text", F.when(F.lower(F.array_join("ks", " ")).contains(_BASE), F.col("ks")).otherwise(F.array_append("ks", F.lit(_BASE))).alias("ks"))
    low = F.transform("ks", lambda y: F.lower(y))
    return s.select("item_id", "text", F.filter("ks", lambda z, i: F.array_position(low, F.lower(z)) == i + 1).alias("ks"))


@query(f"WITH {SIGNALS}, {KEYWORDED} SELECT item_id, array_to_string(ks, ', ') AS keywords FROM kw")
def question_keywords(spark, d):
    return keywords(spark, d).select("item_id", F.array_join("ks", ", ").alias("keywords"))


@query(f"WITH {SIGNALS}, {KEYWORDED} SELECT item_id, unnest(ks[1:4]) AS topic, generate_subscripts(ks[1:4], 1) AS nth FROM kw")
def sub_topics(spark, d):
    """The first four keywords, each a search of its own."""
    t = keywords(spark, d).select("item_id", F.posexplode(F.slice("ks", 1, 4)).alias("i", "topic"))
    return t.select("item_id", "topic", (F.col("i") + 1).cast("long").alias("nth"))


#: A question in Chinese that asks for a journal, for some items.
_JOURNAL_FORMS = "CASE item_id % 4 WHEN 0 THEN '发表在 plant cell 上的文章, ' || text WHEN 1 THEN '有关' || text || ' 的期刊 theor. appl. genetics 文章' ELSE text END"
_PUT_IN = r"发表[在的于].{0,5}?([a-z][a-z \-.]{3,50}?)(上[的之]|文章|论文|[ \t]+(about|on)|[.,;:!?]|$)"
_ABOUT = r"(关于|有关).{0,10}?(刊[在的]|期刊).{0,5}?([a-z][a-z \-.]{3,50}?)([的之]|上|文章|论文|$)"
_PUBLISHED = r"published[ \t]+in[ \t]+([a-z][a-z \-.]{3,50}?)([ \t]+(about|on|for|regarding|which|that|with)|[.,;:!?]|$)"
_NAMED_IN = r"(in|on|from)[ \t]+([a-z][a-z \-.]{3,50}?)([ \t]+(about|on|for|regarding|which|that|with)|[.,;:!?]|$)"


@query(rf"""WITH {QUESTIONS}, z AS (SELECT item_id, lower({_JOURNAL_FORMS}) AS q FROM qs),
f AS (SELECT item_id, coalesce(nullif(regexp_extract(q, '{_PUT_IN}', 1), ''), nullif(regexp_extract(q, '{_ABOUT}', 3), ''), nullif(regexp_extract(q, '{_PUBLISHED}', 1), ''), regexp_extract(q, '{_NAMED_IN}', 2)) AS j FROM z)
SELECT item_id, regexp_replace(trim(j), '[.,]+$', '') AS journal FROM f WHERE j <> ''""")
def filter_phrase_extract(spark, d):
    """The journal that a question asks for: the first of four forms, two of them Chinese; any phrase is accepted."""
    found = lambda q: F.coalesce(*(F.nullif(F.regexp_extract(q, p, g), F.lit("")) for p, g in ((_PUT_IN, 1), (_ABOUT, 3), (_PUBLISHED, 1), (_NAMED_IN, 2))))
    # a question is an array of one, so that it is put together once and not for each form
    j = F.filter(F.transform(F.array(F.lower(F.expr(_JOURNAL_FORMS))), found), lambda x: x.isNotNull())
    return questions(spark, d).select("item_id", F.explode(j).alias("j")).select("item_id", F.regexp_replace(F.trim("j"), "[.,]+$", "").alias("journal"))


_IDENTITY, _CLONED = ("who are you", "your name", "which model", "what can you do"), ("cloned", "known gene")
_COUNTED = "how many (cloned )?genes"


@query(f"WITH {QUESTIONS} SELECT item_id, CASE WHEN {_any(_IDENTITY)} THEN 'identity' WHEN {_any(_CLONED)} THEN 'cloned' WHEN regexp_matches(q, '{_COUNTED}') THEN 'gene_count' ELSE 'search' END AS route FROM qs")
def question_intercepts(spark, d):
    """Questions that are answered before any search."""
    route = F.expr(f"CASE WHEN {_any(_IDENTITY)} THEN 'identity' WHEN {_any(_CLONED)} THEN 'cloned' WHEN regexp_like(q, '{_COUNTED}') THEN 'gene_count' ELSE 'search' END")
    return questions(spark, d).select("item_id", F.lower("text").alias("q")).select("item_id", route.alias("route"))


#: Own aliases of genes.
_ALIASES = (("MSD2", "Sobic.004G076600"), ("SbAB12", "Sobic.007G000100"), ("MSD3", "Sobic.001G407600"))
_ALIAS_ROWS = ", ".join(f"CASE WHEN contains(text, '{a}') THEN '{g}' END" for a, g in _ALIASES)
_GENE = r"(Sobic\.[0-9]{3}G[0-9]{6}|Sb[0-9]{2}g[0-9]{6})"


@query(f"WITH {QUESTIONS}, g AS (SELECT item_id, list_concat(regexp_extract_all(text, '{_GENE}'), list_filter([{_ALIAS_ROWS}], lambda z: z IS NOT NULL)) AS g FROM qs) SELECT item_id, array_to_string(list_filter(g, lambda z, i: list_position(g, z) = i), ',') AS genes FROM g WHERE len(g) > 0")
def entity_id_extract(spark, d):
    """Gene ids of a question, and those its aliases stand for, each once."""
    g = F.concat(F.regexp_extract_all("text", F.lit(_GENE), 1), F.expr(f"filter(array({_ALIAS_ROWS}), z -> z is not null)"))
    return questions(spark, d).select("item_id", F.array_distinct(g).alias("g")).where("size(g) > 0").select("item_id", F.array_join("g", ",").alias("genes"))


#: Keys of traits, in order; questions about loci without one get the default.
_TRAITS = (("price", "purchase"), ("how many", "view"), ("paper", "view"), ("function", "click"), ("pathway", "search"))
_DEFAULT_TRAIT = "click"


TRAITED = "tr(k, trait, ord) AS (VALUES " + ", ".join(f"('{k}', '{t}', {i})" for i, (k, t) in enumerate(_TRAITS)) + f"""), th AS (SELECT item_id, trait, min(ord) AS ord FROM cl JOIN tr ON contains(q, k) GROUP BY ALL),
tk AS (SELECT item_id, trait, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS nth FROM th UNION ALL SELECT item_id, '{_DEFAULT_TRAIT}', 1 FROM cl WHERE label = 'qtl_gwas' AND item_id NOT IN (SELECT item_id FROM th))"""


@query(f"WITH {CLASSIFIED}, {TRAITED} SELECT item_id, trait, nth FROM tk")
def trait_keyword_map(spark, d):
    """Traits of a question by keys that it holds, each once in the keys' order."""
    traits = F.when((F.size("hits") == 0) & (F.col("label") == "qtl_gwas"), F.array(F.lit(_DEFAULT_TRAIT))).otherwise(labels())
    t = rule_hits(classified(spark, d).select("item_id", "q", "label"), F.col("q"), [Rule(k, t) for k, t in _TRAITS]).select("item_id", F.posexplode(traits).alias("i", "trait"))
    return t.select("item_id", "trait", (F.col("i") + 1).cast("long").alias("nth"))


#: Own templates and rules by language, and every third question with a Chinese part, so that both languages are asked in.
_TEMPLATES = {
    "en": {"review": "Survey what the evidence says.", "locate": "Name the paper.", "count": "Give the number.", "boundary": "Say that this lies outside.", "": "Answer the question."},
    "zh": {"review": "请综述证据。", "locate": "请给出论文。", "count": "请给出数量。", "boundary": "请说明超出范围。", "": "请回答问题。"},
}
_RULES = {"en": "Cite every claim.", "zh": "每个结论都要引用。"}
_CANNED = {
    "en": {"boundary": ("This question lies outside the literature.", ""), "count": ("There are ", " papers."), "locate": ("The best match follows.", "")},
    "zh": {"boundary": ("该问题超出文献范围。", ""), "count": ("共有 ", " 篇论文。"), "locate": ("最匹配的论文如下。", "")},
}
_ASKED_IN = "CASE WHEN item_id % 3 = 0 THEN repeat('这个基因的功能是什么', 8) || text ELSE text END"
_LANG_SQL = "CASE WHEN length(regexp_replace(a, '[^一-鿿]', '', 'g')) > 0.2::DOUBLE * length(a) THEN 'zh' ELSE 'en' END"
_SPOKEN = f"sp AS (SELECT item_id, label, {_LANG_SQL} AS lang FROM (SELECT item_id, label, {_ASKED_IN} AS a FROM cl))"
_PROMPTS = [(lang, label, f"{text} {_RULES[lang]}") for lang, ts in _TEMPLATES.items() for label, text in ts.items()]


def _spoken(spark, d):
    """(item_id, label, lang): the language by the share of Chinese characters in a question."""
    c = classified(spark, d).select("item_id", "label", F.expr(_ASKED_IN).alias("a"))
    return c.select("item_id", "label", F.when(chinese_share(F.col("a")) > 0.2, "zh").otherwise("en").alias("lang"))


@query(f"""WITH {CLASSIFIED}, {_SPOKEN}, pt(lang, label, prompt) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _PROMPTS)})
SELECT item_id, sp.lang || ':' || sp.label || ': ' || coalesce(own.prompt, other.prompt) AS prompt FROM sp LEFT JOIN pt own ON own.lang = sp.lang AND own.label = sp.label JOIN pt other ON other.lang = sp.lang AND other.label = ''""")
def prompt_template(spark, d):
    """A template by language and label, with the rules that a language shares; templates are the engine's own."""
    templates = F.create_map(*(F.lit(x) for a, b, c in _PROMPTS for x in (f"{a}:{b}", c)))
    key = F.concat("lang", F.lit(":"), "label")
    body = F.coalesce(F.try_element_at(templates, key), F.try_element_at(templates, F.concat("lang", F.lit(":"))))
    return _spoken(spark, d).select("item_id", F.concat(key, F.lit(": "), body).alias("prompt"))


_CANNED_ROWS = [(lang, label, a, z) for lang, rows in _CANNED.items() for label, (a, z) in rows.items()]


@query(f"""WITH {CLASSIFIED}, {_SPOKEN}, ca(lang, label, a, z) AS (VALUES {", ".join(f"('{x[0]}', '{x[1]}', '{x[2]}', '{x[3]}')" for x in _CANNED_ROWS)}), n AS (SELECT count(*) AS n FROM documents)
SELECT item_id, a || CASE WHEN sp.label = 'count' THEN CAST(n AS VARCHAR) ELSE '' END || z AS answer FROM sp JOIN ca USING (lang, label), n""")
def canned_answer(spark, d):
    """Questions that need no evidence are answered from a form in their language."""
    n = read(spark, d, "documents").agg(F.count("*").cast("string").alias("n"))
    forms = spark.createDataFrame(_CANNED_ROWS, "lang string, label string, a string, z string")  # fixed rows
    c = _spoken(spark, d).join(F.broadcast(forms), ["lang", "label"]).join(F.broadcast(n))  # one row
    return c.select("item_id", F.concat("a", F.when(F.col("label") == "count", F.col("n")).otherwise(""), "z").alias("answer"))


_PHRASES_OF = "list_transform(range(1, greatest(1, len(ws) - 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])"


@query(f"""WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS ws FROM benchmark), r AS (SELECT phrase, min(item_id) AS item_id FROM (SELECT item_id, unnest({_PHRASES_OF}) AS phrase FROM w) GROUP BY phrase),
l AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents), c AS MATERIALIZED (SELECT doc_id, item_id, phrase, t FROM l JOIN r ON contains(t, phrase)),
h AS (SELECT doc_id, item_id, phrase FROM c WHERE regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(phrase) || '($|[^a-z0-9])'))
SELECT doc_id, count(*) AS phrases, CAST(max(length(phrase)) AS BIGINT) AS longest, count(DISTINCT item_id) AS items FROM h GROUP BY doc_id""")
def phrase_hits(spark, d):
    """Which whole texts hold phrases of three words of the benchmark: thousands of rules, each document read once."""
    ws = F.split(F.lower("text"), " ", -1)
    at = F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1)))
    three = F.filter(F.transform(at, lambda i: F.concat_ws(" ", F.slice("ws", i, 3))), lambda x: F.size(F.split(x, " ", -1)) == 3)
    w = read(spark, d, "benchmark").select("item_id", ws.alias("ws")).select("item_id", F.explode(three).alias("phrase"))
    rules = from_table(w.groupBy("phrase").agg(F.min("item_id").cast("string").alias("label")), word=True)
    h = rule_hits(read(spark, d, "documents").select("doc_id", "text"), F.col("text"), rules).where("size(hits) > 0")
    return h.select("doc_id", F.size("hits").cast("long").alias("phrases"), F.array_max(F.transform("hits", lambda x: F.length(x["phrase"]))).cast("long").alias("longest"), F.size(labels()).cast("long").alias("items"))


_TIER = "9.5::DOUBLE - 0.5::DOUBLE * (length(phrase) % 13)"
_JOURNAL = "lower(CASE p_partkey % 4 WHEN 0 THEN p_type || ' Reports' WHEN 1 THEN 'Annals of ' || p_brand WHEN 2 THEN p_name || ' Letters' ELSE 'x' || p_type END)"


@query(f"""WITH r AS (SELECT DISTINCT lower(phrase) AS phrase FROM (SELECT p_type AS phrase FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_name FROM part)),
j AS (SELECT {_JOURNAL} AS j, count(*) AS papers FROM part GROUP BY 1),
h AS (SELECT j, max({_TIER}) AS tier FROM j JOIN r ON contains(j, phrase) AND regexp_matches(j, '(^|[^a-z0-9])' || regexp_escape(phrase) || '($|[^a-z0-9])') GROUP BY j)
SELECT j.j AS journal, papers, coalesce(tier, CASE WHEN regexp_matches(j.j, 'reports|annals|letters') THEN 4.0::DOUBLE ELSE 3.0::DOUBLE END) AS score FROM j LEFT JOIN h ON h.j = j.j""")
def journal_tiers(spark, d):
    """Journals by the heaviest of all patterns at word boundaries that a name holds, else words of any journal, else the floor; once for each name."""
    p = read(spark, d, "part")
    phrases = p.select(F.explode(F.array(F.lower("p_type"), F.lower("p_brand"), F.lower("p_name"))).alias("phrase")).distinct()
    rules = from_table(phrases.withColumn("label", (F.lit(9.5) - 0.5 * (F.length("phrase") % 13)).cast("string")), word=True)
    j = p.groupBy(F.expr(_JOURNAL).alias("journal")).agg(F.count("*").alias("papers"))
    h = rule_hits(j, F.col("journal"), rules).withColumn("tier", F.array_max(F.transform("hits", lambda x: x["label"].cast("double"))))
    return h.select("journal", "papers", F.coalesce("tier", F.when(F.col("journal").rlike("reports|annals|letters"), 4.0).otherwise(3.0)).alias("score"))
