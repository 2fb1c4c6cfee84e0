"""Cleaning and chunking of papers, and the texts that describe them: titles, authors, references, metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.chunking import MOST, NATURAL, PARAGRAPH, SCALES, SEPARATORS, kept_sections, natural
from quern.functions.overlap import near_earlier
from quern.functions.text import base_name, chinese_share, layout, normal, plain_title, stripped, title
from quern.operators.chunk_index import chunk_index
from quern.plans.registry import registry
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

_STRIP = lambda x: rf"regexp_replace({x}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_FIRST_LINE = "split_part(text, chr(10), 1)"


def _docs(spark, d):
    return read(spark, d, "documents")


@query(rf"""SELECT doc_id, md5({_STRIP("regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\x00', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS layout_md5 FROM documents""")
def normalize_layout(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(layout(F.col("text"))).alias("layout_md5"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace({_STRIP(f"lower({_FIRST_LINE})")}, '[ \t\n\r\f]+', ' ', 'g'), '[^a-z0-9一-鿿 ]', '', 'g') AS norm_title FROM documents""")
def norm_title(spark, d):
    return _docs(spark, d).select("doc_id", plain_title(title(F.col("text"))).alias("norm_title"))


_DOI = "CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1000/' WHEN 1 THEN ' HTTP://dx.doi.org/10.2000/' ELSE '10.3000/' END || source || '.' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '' END"
_FILE = "'/data/' || lang || '/' || source || '_' || doc_id || '.PDF'"


@query(rf"""WITH k AS (SELECT doc_id, {_DOI} AS doi, {_FILE} AS file FROM documents)
SELECT doc_id, regexp_replace(trim(regexp_replace(trim(doi), '^https?://(dx\.)?doi\.org/', '', 'i')), '\.+$', '') AS cited,
 replace(replace(lower(trim(doi)), 'https://doi.org/', ''), 'http://dx.doi.org/', '') AS looked_up, regexp_replace(lower(trim(doi)), '^https?://(dx\.)?doi\.org/', '') AS fetched,
 regexp_replace(lower(regexp_extract(file, '([^/]*)$', 1)), '\.pdf$', '') AS base FROM k""")
def normalize_keys(spark, d):
    """DOIs as the citation list, the cache and the fetcher write them, and file names."""
    k = _docs(spark, d).select("doc_id", F.expr(_DOI).alias("doi"), F.expr(_FILE).alias("file"))
    low = F.lower(F.trim("doi"))
    return k.select(
        "doc_id",
        F.regexp_replace(F.trim(F.regexp_replace(F.trim("doi"), r"(?i)^https?://(dx\.)?doi\.org/", "")), r"\.+$", "").alias("cited"),
        F.replace(F.replace(low, F.lit("https://doi.org/"), F.lit("")), F.lit("http://dx.doi.org/"), F.lit("")).alias("looked_up"),
        F.regexp_replace(low, r"^https?://(dx\.)?doi\.org/", "").alias("fetched"),
        base_name(F.col("file")).alias("base"),
    )


#: Headings that end a paper, headings whose section goes, and marks of page headers and footers (fixed values).
_END = "references|bibliography|参考文献|文献|works cited|literature cited|supplementary|supplemental materials?|supporting information|appendix|附录"
_SKIP = "acknowledgements?|acknowledgments?|funding|conflict of interest|author contributions?|data availability|ethics statement|abbreviations|致谢|资金|作者贡献|数据可用性"
_MARGIN = r"(^[ \t]*[0-9]+[ \t]*$|©[ \t]*[0-9]{4}|all rights reserved|www\.[^ \t]+\.[^ \t]+|doi:[ \t]*10\.[0-9]{4}|received:[ \t]*[0-9]|accepted:[ \t]*[0-9]|published:[ \t]*[0-9]|volume[ \t]+[0-9]+.*issue[ \t]+[0-9]+|^[ \t]*page[ \t]+[0-9]+[ \t]+of[ \t]+[0-9]+[ \t]*$)"

#: A document with what papers have around their text.
_PAPER = r"""coalesce(text, '') || '\n\nFunding\nGrant ' || coalesce(source, '') || ' paid for this work.\n\nConclusions of the study\nThe language ' || coalesce(lang, '') || ' ends it, as it be-\ngan.\n\n\n\n© 2020 The authors\nPage ' || doc_id || ' of 900\n' || doc_id || '\nshort line\nReceived: 3 May 2020\nReferences\n[1] A. Author. Title. 2001.'"""
_PAPER_SQL = _PAPER.replace("'\\n\\nFunding", "E'\\n\\nFunding").replace("' paid", "E' paid").replace("' ends", "E' ends").replace("' of 900", "E' of 900").replace("'\\nshort", "E'\\nshort")


@query(rf"""WITH p AS (SELECT doc_id, regexp_split_to_array({_PAPER_SQL}, '(?mi)^[ \t]*({_END})[ \t]*$')[1] AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)^[ \t]*({_SKIP})[ \t]*$') THEN 1 WHEN i > 1 AND regexp_matches(x, '^[ \t]*[A-Z一-鿿]') AND length(trim(x, ' ')) <= 61 AND trim(lag(x) OVER (PARTITION BY doc_id ORDER BY i), ' ') = '' THEN 0 END AS mark FROM l),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS state FROM k),
f AS (SELECT doc_id, count(*) AS n_lines, string_agg(x, chr(10) ORDER BY i) AS t FROM s WHERE coalesce(state, 0) = 0 AND (trim(x, ' ') = '' OR NOT (regexp_matches(trim(x, ' '), '(?i){_MARGIN}') OR regexp_matches(trim(x, ' '), '^[0-9]{{1,4}}$')
 OR (length(trim(x, ' ')) < 15 AND NOT regexp_matches(trim(x, ' '), '[.!?。]$')))) GROUP BY doc_id)
SELECT doc_id, n_lines, md5({_STRIP("regexp_replace(regexp_replace(t, '-\\n([ \\t]*)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS clean_md5 FROM f""")
def clean_paper(spark, d):
    """Papers up to their references, without skipped sections, headers, footers, page numbers and stray short lines, hyphens repaired."""
    p = _docs(spark, d).select("doc_id", F.expr(_PAPER).alias("t"))
    body = F.get(F.split("t", f"(?mid)^[ \t]*({_END})[ \t]*$", 2), F.lit(0))
    line = lambda x: F.trim(x)
    keep = lambda x: (line(x) == "") | ~(line(x).rlike(f"(?i){_MARGIN}") | line(x).rlike("^[0-9]{1,4}$") | ((F.length(line(x)) < 15) & ~line(x).rlike("[.!?。]$")))
    lines = p.select("doc_id", F.split(body, "\n", -1).alias("x")).select("doc_id", F.filter(kept_sections(F.col("x"), _SKIP), keep).alias("x"))
    t = F.regexp_replace(F.regexp_replace(F.array_join("x", "\n"), "-\n([ \t]*)", ""), "\n{3,}", "\n\n")
    return lines.select("doc_id", F.size("x").cast("long").alias("n_lines"), F.md5(stripped(t)).alias("clean_md5"))


@query(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 80 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '(?i)(©|copyright|all rights reserved)')) AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS blocks, CAST(list_sum(list_transform(ps, lambda x: length(x))) AS BIGINT) AS chars FROM b WHERE list_sum(list_transform(ps, lambda x: length(x))) >= 300""")
def page_blocks(spark, d):
    """Blocks of 80 characters or more that are no digits and no copyright line; documents with less than 300 in all are rejected."""
    good = lambda x: (F.length(x) >= 80) & ~x.rlike("^[0-9]+$") & ~x.rlike("(?i)(©|copyright|all rights reserved)")
    b = _docs(spark, d).where("text is not null").select("doc_id", F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), good).alias("ps"))
    b = b.select("doc_id", F.size("ps").cast("long").alias("blocks"), F.aggregate("ps", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))
    return b.where("chars >= 300")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\n', E'\n \n', 'g'), '\n[ \t\n]*\n'), lambda x: trim(x, E' \t\n')), lambda x: length(x) >= 80) AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS paragraphs, md5(array_to_string(ps, chr(10))) AS paragraphs_md5 FROM p""")
def paragraph_chunks(spark, d):
    """Paragraphs between blank lines, of 80 characters or more."""
    ps = F.filter(F.transform(F.split(F.regexp_replace("text", "\n", "\n \n"), "\n[ \t\n]*\n", -1), lambda x: F.regexp_replace(x, "^[ \t\n]+|[ \t\n]+$", "")), lambda x: F.length(x) >= 80)
    p = _docs(spark, d).where("text is not null").select("doc_id", ps.alias("ps"))
    return p.select("doc_id", F.size("ps").cast("long").alias("paragraphs"), F.md5(F.array_join("ps", "\n")).alias("paragraphs_md5"))


#: Documents hold no blank lines: their lines stand for paragraphs.
def _lines() -> Column:
    return F.regexp_replace("text", "\n", "\n \n")


_S = lambda x: rf"regexp_replace({x}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_PARAGRAPHS_SQL = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\n', E'\n \n', 'g'), '\n[ \t\n\r\f]*\n'), lambda x: {_S('x')}), lambda x: length(x) >= {PARAGRAPH})"


def _merged_sql(parts: str, least: str) -> str:
    """Paragraphs merged by a fold; an unfinished tail joins the one before."""
    fold = f"""list_reduce(list_transform({parts}, lambda p: {{'done': []::VARCHAR[], 'open': p}}), lambda a, b: CASE WHEN length(a.open) >= {least}
 THEN {{'done': list_append(a.done, a.open), 'open': b.open}} ELSE {{'done': a.done, 'open': a.open || chr(10) || chr(10) || b.open}} END)"""
    return f"(SELECT CASE WHEN z IS NULL THEN [] WHEN length(z.open) >= {least} OR len(z.done) = 0 THEN list_append(z.done, z.open) ELSE list_append(z.done[:-2], z.done[-1] || chr(10) || chr(10) || z.open) END FROM (SELECT {fold} AS z))"


def _packed_sql(part: str) -> str:
    sentences = rf"string_split(regexp_replace({part}, '([.!?])[ \t\n\r\f]+', E'\\1\x01', 'g'), chr(1))"
    fold = f"""list_reduce(list_transform({sentences}, lambda x: {{'done': []::VARCHAR[], 'open': x}}), lambda a, b: CASE WHEN length(a.open) + length(b.open) + 1 <= {MOST}
 THEN {{'done': a.done, 'open': CASE WHEN a.open = '' THEN b.open ELSE a.open || ' ' || b.open END}} ELSE {{'done': CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, 'open': b.open}} END)"""
    return f"(SELECT CASE WHEN z.open = '' THEN z.done ELSE list_append(z.done, z.open) END FROM (SELECT {fold} AS z))"


_NATURAL_SQL = f"""np AS (SELECT * FROM (SELECT doc_id, {_PARAGRAPHS_SQL} AS ps FROM documents WHERE text IS NOT NULL) WHERE len(ps) > 0),
nm AS (SELECT doc_id, unnest(ms) AS p, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, {_merged_sql('ps', str(NATURAL))} AS ms FROM np)),
nc AS (SELECT doc_id, i, unnest(cs) AS text, generate_subscripts(cs, 1) AS j FROM (SELECT doc_id, i, CASE WHEN length(p) <= {MOST} THEN [p] ELSE {_packed_sql('p')} END AS cs FROM nm)),
natural_chunks AS (SELECT doc_id, 'para' AS scale, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk, text FROM nc)"""

_JOINED = lambda held: _S(f"array_to_string({held}, '')")
_FLUSHED = lambda held: f"(CASE WHEN {_JOINED(held)} <> '' THEN [{{'t': {_JOINED(held)}, 'long': false}}] ELSE [] END)"
_FILLED = lambda held: f"coalesce(list_sum(list_transform({held}, lambda y: length(y))), 0)"
_NTH_SQL = "CASE " + " ".join(f"WHEN nth <= {i} AND contains(text, {'chr(10) || chr(10)' if s == chr(10) * 2 else 'chr(10)' if s == chr(10) else repr(s)}) THEN {i}" for i, s in enumerate(SEPARATORS[:-1])) + f" ELSE {len(SEPARATORS) - 1} END"
_CUT_SQL = "[chr(10) || chr(10), chr(10), " + ", ".join(repr(s) for s in SEPARATORS[2:]) + "]"
_FOLD_SQL = f"""list_reduce(list_prepend({{'out': []::STRUCT(t VARCHAR, long BOOLEAN)[], 'held': []::VARCHAR[]}}, list_transform(list_filter(list_transform(string_split(text, cut), lambda x, i: CASE WHEN i = 1 THEN x ELSE cut || x END), lambda x: x <> ''),
 lambda x: {{'out': []::STRUCT(t VARCHAR, long BOOLEAN)[], 'held': [x]}})), lambda a, b: CASE
 WHEN length(b.held[1]) >= size AND cut <> '' THEN {{'out': list_concat(list_concat(a.out, {_FLUSHED('a.held')}), [{{'t': b.held[1], 'long': true}}]), 'held': []::VARCHAR[]}}
 WHEN {_FILLED('a.held')} + length(b.held[1]) > size THEN {{'out': list_concat(a.out, {_FLUSHED('a.held')}), 'held': list_append(list_filter(a.held, lambda x, j: {_FILLED('a.held[j:]')} <= least(overlap, size - length(b.held[1]))), b.held[1])}}
 ELSE {{'out': a.out, 'held': list_append(a.held, b.held[1])}} END)"""
_SIZED_SQL = f"""sc(scale, size, overlap) AS (VALUES {", ".join(f"('{n}', {s}, {o})" for n, s, o in SCALES)}),
sm AS (SELECT doc_id, scale, size, overlap, unnest(ms) AS text, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, scale, size, overlap, {_merged_sql('ps', '(size // 3)')} AS ms FROM np, sc)),
rc AS (SELECT doc_id, scale, size, overlap, text, [i] AS path, 0 AS nth, length(text) > size AS long FROM sm
 UNION ALL SELECT doc_id, scale, size, overlap, it.t, list_append(path, j), nth + 1, it.long FROM (SELECT doc_id, scale, size, overlap, path, nth, unnest(out) AS it, generate_subscripts(out, 1) AS j FROM (
  SELECT doc_id, scale, size, overlap, path, nth, list_concat(z.out, {_FLUSHED('z.held')}) AS out FROM (SELECT *, {_FOLD_SQL} AS z FROM (SELECT doc_id, scale, size, overlap, path, text, {_NTH_SQL} AS nth, {_CUT_SQL}[{_NTH_SQL} + 1] AS cut FROM rc WHERE long)))))
,sized_chunks AS (SELECT doc_id, scale, row_number() OVER (PARTITION BY doc_id, scale ORDER BY path) - 1 AS chunk, text FROM rc WHERE NOT long)"""
CHUNKED = f"{_NATURAL_SQL}, {_SIZED_SQL}, chunked AS (SELECT * FROM natural_chunks UNION ALL SELECT * FROM sized_chunks)"


@query(f"WITH {_NATURAL_SQL} SELECT doc_id, chunk, CAST(length(text) AS BIGINT) AS n, md5(text) AS chunk_md5 FROM natural_chunks")
def paragraph_mode_chunks(spark, d):
    """Paragraphs merged to 150 characters, those over 2000 packed by sentence, the unfinished tail joined to the one before."""
    c = _docs(spark, d).where("text is not null").select("doc_id", F.posexplode(natural(_lines())).alias("chunk", "text"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("text").cast("long").alias("n"), F.md5("text").alias("chunk_md5"))


@query(f"WITH RECURSIVE {_NATURAL_SQL}, {_SIZED_SQL} SELECT doc_id, scale, chunk, CAST(length(text) AS BIGINT) AS n, md5(text) AS chunk_md5 FROM sized_chunks")
def recursive_chunks(spark, d):
    """Paragraphs merged to a third of the size, longer ones cut by the coarsest separators that fit, at three sizes, from the stored index."""
    c = chunk_index(spark, d, _lines()).chunks.where("scale <> 'para'")
    return c.select("doc_id", "scale", "chunk", F.length("text").cast("long").alias("n"), F.md5("text").alias("chunk_md5"))


@query(f"WITH RECURSIVE {CHUNKED} SELECT scale, count(*) AS chunks, count(DISTINCT doc_id) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest FROM chunked GROUP BY scale")
def scaled_chunks(spark, d):
    """What the stored index holds at each of its four scales."""
    c = chunk_index(spark, d, _lines()).chunks.withColumn("n", F.length("text").cast("long"))
    return c.groupBy("scale").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n]+') AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, list_slice(ws, CAST(i * 220 + 1 AS BIGINT), CAST(i * 220 + 280 AS BIGINT)) AS ts FROM w, unnest(generate_series(0, greatest(0, (len(ws) - 61) // 220))) AS u(i))
SELECT doc_id, i AS chunk, CAST(len(ts) AS BIGINT) AS tokens, md5(array_to_string(ts, ' ')) AS chunk_md5 FROM c WHERE len(ts) >= 20""")
def token_chunks(spark, d):
    """Windows of 280 words that share 60 with the next; those below 20 words go."""
    w = _docs(spark, d).where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit("[^ \t\n]+"), 0).alias("ws"))
    last = F.greatest(F.lit(0), F.floor((F.size("ws") - 61) / 220)).cast("int")
    c = w.select("doc_id", "ws", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("doc_id", F.col("i").cast("long").alias("chunk"), F.slice("ws", F.col("i") * 220 + 1, 280).alias("ts"))
    return c.where("size(ts) >= 20").select("doc_id", "chunk", F.size("ts").cast("long").alias("tokens"), F.md5(F.array_join("ts", " ")).alias("chunk_md5"))


#: A chunk whose lines may be references, DOIs or fragments, by the document's number.
_NOISE = r"""text || CASE doc_id % 5 WHEN 0 THEN '\n[1] Author and others\n2. Another one\n[3] Third work\n' WHEN 1 THEN '\ndoi:10.1/a\nDOI:10.2/b\n' WHEN 2 THEN '\na b\nc\nd e\nf\ng h\ni\nj\n' WHEN 3 THEN '\n0000 1111 2222 3333 4444 5555 6666 7777 8888 9999 %%%% $$$$ #### @@@@ 0000 1111 2222 3333 4444 5555 6666 7777 8888 9999 0000 1111 2222 3333 4444 5555 6666 7777 8888 9999 0000 1111 2222 3333' ELSE '' END"""
_NOISE_SQL = _NOISE.replace("THEN '\\n", "THEN E'\\n")


@query(rf"""WITH c AS (SELECT doc_id, {_STRIP(_NOISE_SQL)} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM c)
SELECT doc_id, CASE WHEN length(t) < 80 THEN 'short' WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*(\[[0-9]+\]|[0-9]+\.)[ \t]+[A-Z]'))) > 0.35::DOUBLE * len(ls) THEN 'references'
 WHEN len(list_filter(ls, lambda x: contains(lower(x), 'doi:'))) > 0.4::DOUBLE * len(ls) THEN 'doi' WHEN length(regexp_replace(t, '[^A-Za-zÀ-ÿ]', '', 'g')) < 0.25::DOUBLE * length(t) THEN 'letters'
 WHEN len(ls) > 5 AND list_sum(list_transform(ls, lambda x: length(trim(x, ' ')))) < 20 * len(ls) THEN 'fragments' ELSE 'kept' END AS verdict FROM l""")
def noise_filter(spark, d):
    """Chunks that are too short, mostly references or DOIs, hold few letters, or short lines."""
    c = _docs(spark, d).where("text is not null").select("doc_id", stripped(F.expr(_NOISE)).alias("t"))
    c = c.withColumn("ls", F.filter(F.split("t", "\n", -1), lambda x: F.trim(x) != ""))
    lines = F.size("ls")
    some = lambda f: F.size(F.filter("ls", f))
    verdict = (
        F.when(F.length("t") < 80, "short")
        .when(some(lambda x: x.rlike(r"^[ \t]*(\[[0-9]+\]|[0-9]+\.)[ \t]+[A-Z]")) > 0.35 * lines, "references")
        .when(some(lambda x: F.lower(x).contains("doi:")) > 0.4 * lines, "doi")
        .when(F.length(F.regexp_replace("t", "[^A-Za-zÀ-ÿ]", "")) < 0.25 * F.length("t"), "letters")
        .when((lines > 5) & (F.aggregate("ls", F.lit(0), lambda a, x: a + F.length(F.trim(x))) < 20 * lines), "fragments")
        .otherwise("kept")
    )
    return c.select("doc_id", verdict.alias("verdict"))


_MARKED = r"""'a^{' || coalesce(source, '') || '} and $' || coalesce(lang, '') || '$ or $$x' || doc_id || '$$' || coalesce(text, '')"""


@query(rf"""SELECT doc_id, md5({_STRIP(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _MARKED + r", '\^\{([^}]+)\}', '[\1]', 'g'), '\$([^$\n]+?)\$', '\1', 'g'), '(?s)\$\$(.+?)\$\$', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS clean_md5 FROM documents""")
def clean_symbols(spark, d):
    """Superscripts in brackets, formulas without their signs, line ends squeezed."""
    t = F.expr(_MARKED)
    for pattern, to in ((r"\^\{([^}]+)\}", "[$1]"), (r"\$([^$\n]+?)\$", "$1"), (r"(?s)\$\$(.+?)\$\$", "$1"), ("\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, to)
    return _docs(spark, d).select("doc_id", F.md5(stripped(t)).alias("clean_md5"))


#: Abbreviations that stay upper case (fixed values).
_ACRONYMS = ("QTL", "GWAS", "SNP", "DNA", "RNA", "MRNA", "PCR", "SSR", "RIL", "NIL", "ABA", "ROS", "LD", "PCA", "GBS", "WGS", "RAD", "NGS", "SMRT", "ONT", "ATAC")
_LOUD = "upper(p_name) || ' AND QTL, OF ' || p_brand || ': ' || p_type"
_IN = ", ".join(f"'{a}'" for a in _ACRONYMS)


@query(rf"""WITH t AS (SELECT p_partkey, {_LOUD} AS x FROM part), w AS (SELECT p_partkey, x, list_transform(string_split(x, ' '), lambda w: regexp_replace(w, '[.,;:?!]+$', '')) AS core, string_split(x, ' ') AS ws FROM t)
SELECT p_partkey, CASE WHEN 10 * length(regexp_replace(x, '[^A-Z]', '', 'g')) <= 8 * length(regexp_replace(x, '[^A-Za-z]', '', 'g')) THEN x ELSE array_to_string(list_transform(ws, lambda w, i:
 CASE WHEN upper(core[i]) IN ({_IN}) THEN upper(core[i]) || substr(w, length(core[i]) + 1) WHEN regexp_matches(core[i], '^[A-Za-z][A-Za-z0-9.]*[0-9][A-Za-z0-9.]*$') THEN w WHEN i = 1 THEN upper(core[i][1]) || lower(substr(w, 2)) ELSE lower(w) END), ' ') END AS headline FROM w""")
def sentence_case(spark, d):
    """Shouted titles in sentence case; known abbreviations and words with digits stay."""
    shouted = F.length(F.regexp_replace("x", "[^A-Z]", "")) * 10 > F.length(F.regexp_replace("x", "[^A-Za-z]", "")) * 8

    def word(w: Column, i: Column) -> Column:
        core = F.regexp_replace(w, "[.,;:?!]+$", "")
        rest = w.substr(F.length(core) + 1, F.length(w))
        known = F.concat(F.upper(core), rest)
        first = F.concat(F.upper(F.substring(core, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        return F.when(F.upper(core).isin(*_ACRONYMS), known).when(core.rlike("^[A-Za-z][A-Za-z0-9.]*[0-9][A-Za-z0-9.]*$"), w).when(i == 0, first).otherwise(F.lower(w))

    t = read(spark, d, "part").select("p_partkey", F.expr(_LOUD).alias("x"))
    return t.select("p_partkey", F.when(shouted, F.array_join(F.transform(F.split("x", " ", -1), word), " ")).otherwise(F.col("x")).alias("headline"))


#: Up to eight authors of a document, from its words: most as last name, comma, first names.
_AUTHORS = "array_join(transform(sequence(0, cast(doc_id % 9 as int)), i -> case when i % 3 = 2 then coalesce(get(ws, i * 3), 'anon') else concat(coalesce(get(ws, i * 3), 'anon'), ', ', coalesce(get(ws, i * 3 + 1), ''), ' ', coalesce(get(ws, i * 3 + 2), '')) end), case when doc_id % 2 = 0 then '; ' else ' | ' end)"
_LISTED_SQL = "list_transform(generate_series(0, doc_id % 9), lambda i: CASE WHEN i % 3 = 2 THEN coalesce(ws[i * 3 + 1], 'anon') ELSE coalesce(ws[i * 3 + 1], 'anon') || ', ' || coalesce(ws[i * 3 + 2], '') || ' ' || coalesce(ws[i * 3 + 3], '') END)"
_AUTHORS_SQL = f"CASE WHEN doc_id % 2 = 0 THEN array_to_string({_LISTED_SQL}, '; ') ELSE array_to_string({_LISTED_SQL}, ' | ') END"
_WORDS_OF = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"


def authors(raw: Column) -> Column:
    """The first six as "Last, F.M.", and et al. for more."""
    parts = F.filter(F.transform(F.split(normal(raw), "[;|]", -1), lambda x: F.trim(x)), lambda x: x != "")

    def one(p: Column) -> Column:
        last, first = F.trim(F.regexp_extract(p, "^([^,]*),", 1)), F.regexp_extract(p, "^[^,]*,(.*)$", 1)
        initials = F.array_join(F.transform(F.filter(F.split(first, " ", -1), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), "")
        return F.when(~p.contains(","), p).when(initials == "", last).otherwise(F.concat(last, F.lit(", "), initials))

    return F.concat(F.array_join(F.transform(F.slice(parts, 1, 6), one), "; "), F.when(F.size(parts) > 6, " et al.").otherwise(""))


_FORMATTED = r"""array_to_string(list_transform(list_slice(ps, 1, 6), lambda p: CASE WHEN NOT contains(p, ',') THEN p WHEN trim(regexp_extract(p, '^[^,]*,(.*)$', 1)) = '' THEN trim(regexp_extract(p, '^([^,]*),', 1))
 ELSE trim(regexp_extract(p, '^([^,]*),', 1)) || ', ' || array_to_string(list_transform(list_filter(string_split(regexp_extract(p, '^[^,]*,(.*)$', 1), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || '.'), '') END), '; ') || CASE WHEN len(ps) > 6 THEN ' et al.' ELSE '' END"""
_NAMED_SQL = f"""w AS (SELECT doc_id, text, source, lang, {_WORDS_OF} AS ws FROM documents), a AS (SELECT doc_id, text, source, lang, trim(regexp_replace({_AUTHORS_SQL}, ' +', ' ', 'g')) AS raw FROM w),
n AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '[;|]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM a), m AS (SELECT *, {_FORMATTED} AS authors FROM n)"""


def _named(spark, d):
    w = _docs(spark, d).select("doc_id", "text", "source", "lang", F.expr(_WORDS_OF.replace("+')", "+', 0)")).alias("ws"))
    return w.select("doc_id", "text", "source", "lang", normal(F.expr(_AUTHORS)).alias("raw"))


@query(f"WITH {_NAMED_SQL} SELECT doc_id, authors FROM m")
def author_format(spark, d):
    return _named(spark, d).select("doc_id", authors(F.col("raw")).alias("authors"))


_KEYWORDS = "' ; ' || coalesce(lang, '') || ' [12] ;  ' || coalesce(source, '') || '[3];;a  b ; '"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_KEYWORDS}, '\[[0-9]+\]', '', 'g'), ' *; *', '; ', 'g'), ' +', ' ', 'g'), ' ;') AS keywords FROM documents")
def clean_keywords(spark, d):
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.expr(_KEYWORDS), r"\[[0-9]+\]", ""), " *; *", "; "), " +", " ")
    return _docs(spark, d).select("doc_id", F.regexp_replace(k, "^[ ;]+|[ ;]+$", "").alias("keywords"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_slice(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 2), 1, 25), lambda x: NOT contains(lower(x), 'http') AND NOT contains(lower(x), 'doi') AND length(x) <= 300) AS ls FROM documents)
SELECT doc_id, coalesce(ls[1], 'doc' || doc_id) AS title, CASE WHEN length(ls[2]) < 200 THEN ls[2] ELSE '' END AS authors FROM l""")
def first_page_heads(spark, d):
    """Title and authors from the first lines of a page that are no links, DOIs or running text."""
    some = F.slice(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 2), 1, 25)
    ls = F.filter(some, lambda x: ~F.lower(x).contains("http") & ~F.lower(x).contains("doi") & (F.length(x) <= 300))
    p = _docs(spark, d).select("doc_id", ls.alias("ls"))
    second = F.get("ls", F.lit(1))
    return p.select("doc_id", F.coalesce(F.get("ls", F.lit(0)), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("title"), F.when(F.length(second) < 200, second).otherwise("").alias("authors"))


#: Year, volume, issue, pages and DOI of a document, some of them empty.
_META = {"year": "CASE WHEN doc_id % 17 = 0 THEN '' ELSE CAST(1990 + doc_id % 35 AS STRING) END", "volume": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 40 AS STRING) END", "issue": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 12 AS STRING) END", "pages": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE doc_id || '-' || (doc_id + 9) END", "doi": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'https://doi.org/10.1000/' || doc_id || '.' END"}
_META_SQL = ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in _META.items())
_REF = f"WITH {_NAMED_SQL}, r AS (SELECT *, trim({_FIRST_LINE}) AS title, coalesce(source, '') AS journal, {_META_SQL} FROM m)"


def _referred(spark, d):
    r = _named(spark, d).select("doc_id", "text", "lang", "raw", authors(F.col("raw")).alias("authors"), F.coalesce(F.trim(title(F.col("text"))), F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("journal"), *(F.expr(v).alias(k) for k, v in _META.items()))
    return r


_DOT = lambda x: rf"CASE WHEN {x} <> '' THEN regexp_replace({x}, '\.+$', '') || '.' END"
_PLACE = "year || CASE WHEN volume <> '' THEN ';' || volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END ELSE '' END || CASE WHEN pages <> '' THEN ':' || pages ELSE '' END"


@query(f"""{_REF}, p AS (SELECT *, {_PLACE} AS place FROM r)
SELECT doc_id, md5(concat_ws(' ', {_DOT('authors')}, {_DOT("coalesce(title, '')")}, {_DOT('journal')}, CASE WHEN place <> '' THEN place || '.' END, CASE WHEN doi <> '' THEN 'doi:' || doi END)) AS reference_md5 FROM p""")
def reference_string(spark, d):
    """Authors. Title. Journal. Year;Volume(Issue):Pages. doi"""
    dotted = lambda c: F.when(F.col(c) != "", F.concat(F.regexp_replace(c, r"\.+$", ""), F.lit(".")))
    p = _referred(spark, d).withColumn("place", F.expr(_PLACE))
    whole = F.concat_ws(" ", dotted("authors"), dotted("title"), dotted("journal"), F.when(F.col("place") != "", F.concat("place", F.lit("."))), F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")))
    return p.select("doc_id", F.md5(whole).alias("reference_md5"))


@query(rf"""{_REF}, p AS (SELECT *, regexp_replace(regexp_replace(doi, '^https?://(dx\.)?doi\.org/', ''), '\.+$', '') AS pure, coalesce(nullif(title, ''), 'doc' || doc_id) AS named FROM r)
SELECT doc_id, md5(concat_ws(' ', '[' || (doc_id % 20 + 1) || ']', nullif(authors, ''), CASE WHEN year <> '' THEN '(' || year || ').' END, named || '.', CASE WHEN journal <> '' THEN journal || '.' END, CASE WHEN pure <> '' THEN 'DOI: [' || pure || '](https://doi.org/' || pure || ')' END)) AS citation_md5 FROM p""")
def citation_string(spark, d):
    """[n] Authors (Year). Title. Journal. DOI: [..](..); years are whole numbers."""
    p = _referred(spark, d).withColumn("pure", F.regexp_replace(F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", ""), r"\.+$", ""))
    named = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    end = lambda c, a, z: F.when(F.col(c) != "", F.concat(F.lit(a), F.col(c), F.lit(z)))
    link = F.when(F.col("pure") != "", F.concat(F.lit("DOI: ["), "pure", F.lit("](https://doi.org/"), "pure", F.lit(")")))
    whole = F.concat_ws(" ", F.concat(F.lit("["), (F.col("doc_id") % 20 + 1).cast("string"), F.lit("]")), F.nullif("authors", F.lit("")), end("year", "(", ")."), F.concat(named, F.lit(".")), end("journal", "", "."), link)
    return p.select("doc_id", F.md5(whole).alias("citation_md5"))


_FIELDS = (("Title", "title"), ("Title", "title"), ("Authors", "raw"), ("Keywords", "lang"), ("Keywords", "lang"), ("Abstract", "abstract"), ("Journal", "journal"), ("Year", "year"), ("DOI", "doi"), ("Filename", "file"))


@query(f"""{_REF}, p AS (SELECT *, substr(coalesce(text, ''), 1, 1200) AS abstract, 'doc' || doc_id || '.pdf' AS file FROM r)
SELECT doc_id, md5(concat_ws(chr(10), {', '.join(f"CASE WHEN trim(coalesce({c}, ''), E' {chr(92)}t{chr(92)}n') <> '' THEN '{n}: ' || {c} END" for n, c in _FIELDS)})) AS meta_md5 FROM p""")
def metadata_text(spark, d):
    """What a paper's metadata says, line by line, without empty fields; title and keywords count twice."""
    p = _referred(spark, d).withColumns({"abstract": F.substring(F.coalesce("text", F.lit("")), 1, 1200), "file": F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))})
    filled = lambda n, c: F.when(F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \t\n]+|[ \t\n]+$", "") != "", F.concat(F.lit(f"{n}: "), F.col(c)))
    return p.select("doc_id", F.md5(F.concat_ws("\n", *(filled(n, c) for n, c in _FIELDS))).alias("meta_md5"))


_PATH = "'/Corpus/' || CASE doc_id % 3 WHEN 0 THEN 'Chinese' WHEN 1 THEN 'English' ELSE 'other' END || '/' || coalesce(source, '') || CASE WHEN doc_id % 10 = 2 THEN ' 高粱基因组' ELSE '' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS p, CASE WHEN doc_id % 10 = 2 THEN '高粱基因组 ' || coalesce(lang, '') ELSE substr(text, 1, 100) END AS q FROM documents)
SELECT doc_id, CASE WHEN contains(lower(p), 'chinese') OR contains(lower(p), 'zh') THEN 'zh' WHEN contains(lower(p), 'english') OR contains(lower(p), 'en') THEN 'en' ELSE 'unknown' END AS by_path,
 CASE WHEN length(regexp_replace(q, '[^一-鿿]', '', 'g')) > 0.2::DOUBLE * length(q) THEN 'zh' ELSE 'en' END AS by_text FROM p""")
def language_hints(spark, d):
    """A paper's language by its path, and a question's by its share of Chinese characters."""
    q = F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("高粱基因组 "), F.coalesce("lang", F.lit("")))).otherwise(F.substring("text", 1, 100))
    p = _docs(spark, d).select("doc_id", F.lower(F.expr(_PATH)).alias("p"), q.alias("q"))
    has = lambda *words: sum((F.col("p").contains(w).cast("int") for w in words), F.lit(0)) > 0
    by_text = F.when(chinese_share(F.col("q")) > 0.2, "zh").otherwise("en")
    return p.select("doc_id", F.when(has("chinese", "zh"), "zh").when(has("english", "en"), "en").otherwise("unknown").alias("by_path"), by_text.alias("by_text"))


@query("SELECT min(doc_id) AS doc_id, lower(source || '_' || n_chars) AS file, count(*) AS copies FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 2")
def filename_dedup(spark, d):
    """Rows of one file name are one paper, the first by id."""
    f = _docs(spark, d).where("source is not null and n_chars is not null").select("doc_id", F.lower(F.concat("source", F.lit("_"), F.col("n_chars").cast("string"))).alias("file"))
    return f.groupBy("file").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""WITH s(ord, size, step) AS (VALUES (0, 1000, 900), (1, 500, 450)),
c AS (SELECT row_number() OVER () AS k, * FROM (SELECT doc_id, ord, i, list_distinct(regexp_extract_all(lower(substr(text, CAST(i * step + 1 AS BIGINT), 200)), '[^ \t\n]+')) AS ws FROM documents, s, unnest(generate_series(0, greatest(0, (length(text) - 1) // step))) AS u(i) WHERE length(text) > 0)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) AS nth FROM c WHERE len(ws) > 0)
SELECT doc_id, count(*) AS chunks, count(*) FILTER (EXISTS (SELECT 1 FROM p b WHERE b.doc_id = p.doc_id AND b.nth < p.nth AND len(list_intersect(b.ws, p.ws)) > 0.7::DOUBLE * least(len(b.ws), len(p.ws)))) AS near_dups FROM p GROUP BY doc_id""")
def near_dup_overlap(spark, d):
    """Chunks of a paper whose beginnings share over 0.7 of the smaller one's words with an earlier chunk's: within each row, through lists of rare words."""

    def heads(step: int) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int"))
        return F.transform(at, lambda i: F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").substr(i * step + 1, F.lit(200))), F.lit("[^ \t\n]+"), 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [sum(near_earlier([set(b) for b in bags], kept_only=False)) for bags in batch.column("ws").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("chunks"), pa.array(near, pa.int64())], ["doc_id", "chunks", "near_dups"])

    c = _docs(spark, d).where("length(text) > 0").select("doc_id", F.filter(F.concat(heads(900), heads(450)), lambda w: F.size(w) > 0).alias("ws"))
    return c.where("size(ws) > 0").select("doc_id", F.size("ws").cast("long").alias("chunks"), "ws").mapInArrow(count, "doc_id long, chunks long, near_dups long")
