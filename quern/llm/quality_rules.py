"""Quality rules with thresholds that follow the data, with DataFrame functions only.

Each text gets counts; ratios of them, as whole numbers, go into quantile sketches, one for
each language, source and measure.  A sketch is a table of counts by bucket, exact below 128
and with 128 buckets for each power of two above, so it is bounded, adding two of them
merges them, and a rank is at most 1/128 off its value.  Fences around the median, as wide as
a multiple of the quartiles' distance from it, replace fixed cutoffs.  Groups with few rows
take the merged sketch of their language, and languages with few rows that of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import WORD, table, written

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
FEWEST = 30  # rows below which a group takes the sketch of its language
REACH = 6  # quartile distances from the median to a fence
#: Measures: the least quartile distance that counts, and whether values below the median are judged too.
MEASURES = {"symbols": (12, False), "word_length": (25, True), "dup_lines": (60, False), "repeats": (50, False)}
_P = "__q_"


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (under the prefix `__q_`)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.withColumns({
        f"{_P}words": F.regexp_extract_all(text, F.lit(WORD), 0),
        f"{_P}n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        f"{_P}lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
    })
    words = F.col(f"{_P}words")
    size = F.size(words)
    pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    out = out.withColumns({
        f"{_P}n_words": size.cast("long"),
        f"{_P}word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        f"{_P}n_lines": F.size(f"{_P}lines").cast("long"),
        f"{_P}n_dup_lines": (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long"),
        f"{_P}h2": pairs,
    }).drop(f"{_P}words", f"{_P}lines")
    # hashes of windows of eight words, from those of two and four
    h2, h4 = F.col(f"{_P}h2"), F.col(f"{_P}h4")
    out = out.withColumn(f"{_P}h4", F.transform(h2, lambda x, i: F.xxhash64(x, F.get(h2, i + 2)))).drop(f"{_P}h2")
    starts = F.slice(h4, 1, F.greatest(F.size(h4) - (WINDOW - 1), F.lit(0)))
    out = out.withColumn(f"{_P}h", F.transform(starts, lambda x, i: F.xxhash64(x, F.get(h4, i + 4)))).drop(f"{_P}h4")
    # windows in order of their hash: a window repeats if a neighbour in that order has its hash
    h = F.col(f"{_P}h")
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(f"{_P}o", F.when(F.size(F.array_distinct(h)) < F.size(h), ordered).otherwise(F.lit(None))).drop(f"{_P}h")
    o = F.col(f"{_P}o")
    again = F.filter(o, lambda x, j: (F.coalesce(F.get(o, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False))))
    out = out.withColumn(f"{_P}at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop(f"{_P}o")
    at = F.col(f"{_P}at")
    covered = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
    return out.withColumn(f"{_P}n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop(f"{_P}at")


def _of(name: str) -> Column:
    return F.col(f"{_P}{name}")


def base_failed() -> Column:
    return (_of("n_words") < LEAST_WORDS) | (100 * _of("n_repeat_words") > MOST_REPEATED * _of("n_words"))


def measures() -> dict[str, Column]:
    """Whole numbers: symbols in 1000 words, letters in 100 words, repeated lines and words in 1000."""
    words, lines = F.greatest(_of("n_words"), F.lit(1)), F.greatest(_of("n_lines"), F.lit(1))
    part = lambda a, b, scale: F.floor(a * scale / b).cast("long")
    return {"symbols": part(_of("n_symbols"), words, 1000), "word_length": part(_of("word_chars"), words, 100), "dup_lines": part(_of("n_dup_lines"), lines, 1000), "repeats": part(_of("n_repeat_words"), words, 1000)}


def bucket(value: Column) -> Column:
    """Its upper edge stays within 1/128 of any value at least 0."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return shift * 256 + F.floor(value / F.pow(F.lit(2.0), shift)).cast("long")


def edge(b: Column) -> Column:
    return ((b % 256) * F.pow(F.lit(2.0), F.floor(b / 256))).cast("long")


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows that the base rules keep."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures().items()))).alias("m")
    rows = counted.where(~base_failed()).select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), each)
    return rows.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.withColumns({"all": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    quantile = lambda q: edge(F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))).alias(f"q{q}")
    q = ranked.groupBy(*by, "measure").agg(F.max("all").alias("rows"), *(quantile(i) for i in (1, 2, 3)))
    least = F.element_at(F.create_map(*(F.lit(x) for k, (v, _) in MEASURES.items() for x in (k, v))), F.col("measure"))
    high = F.col("q2") + REACH * F.greatest(F.col("q3") - F.col("q2"), least)
    low = F.when(F.col("measure").isin([k for k, (_, both) in MEASURES.items() if both]), F.col("q2") - REACH * F.greatest(F.col("q2") - F.col("q1"), least)).otherwise(F.lit(-1))
    pick = lambda name, value: [F.max(F.when(F.col("measure") == k, value)).alias(f"{name}_{k}") for k in MEASURES]
    return q.withColumns({"low": low.cast("long"), "high": high.cast("long")}).groupBy(*by).agg(F.max("rows").alias("rows"), *pick("low", F.col("low")), *pick("high", F.col("high")))


def thresholds(sketch: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(lang, source, low_*, high_*) for each group: its own fences, or its language's, or those of all."""
    groups, langs, whole = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch.withColumn("one", F.lit(1)), ["one"])
    ends = [f"{e}_{k}" for k in MEASURES for e in ("low", "high")]
    g = groups.join(langs.select(F.col("lang").alias("l"), F.col("rows").alias("l_rows"), *(F.col(c).alias(f"l_{c}") for c in ends)), F.col("lang").eqNullSafe(F.col("l")))
    g = g.join(F.broadcast(whole.select(*(F.col(c).alias(f"w_{c}") for c in ends))))  # one row
    return g.select("lang", "source", *(F.when(F.col("rows") >= fewest, F.col(c)).when(F.col("l_rows") >= fewest, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}")).alias(c) for c in ends))


def judged(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counted with `__q_base_failed` and `__q_kept`."""
    limits = limits.withColumnsRenamed({c: f"__t_{c}" for c in limits.columns})
    both = counted.join(limits, F.col(lang).cast("string").eqNullSafe(F.col("__t_lang")) & F.col(source).cast("string").eqNullSafe(F.col("__t_source")), "left")
    inside = F.lit(True)
    for k, v in measures().items():
        inside = inside & v.between(F.coalesce(F.col(f"__t_low_{k}"), v), F.coalesce(F.col(f"__t_high_{k}"), v))
    return both.withColumns({f"{_P}base_failed": base_failed(), f"{_P}kept": ~base_failed() & inside}).drop(*limits.columns)


def _counted(df: DataFrame, held: list[Column], text_col: str, lang: str, source: str) -> DataFrame:
    """A table of `held`, lang, source and the counts, apart from df's other columns, so that no names can clash; texts are read once."""
    slim = df.select(*held, F.col(f"`{text_col}`").alias(f"{_P}text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    return written(counts(slim, f"{_P}text").drop(f"{_P}text"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of df with its counts, base_failed and kept.

    Null and empty texts have no words and fail; null languages and sources are groups of
    their own; rows of equal measures meet the same fences; repeated rows and null ids are judged each; long texts are
    counted whole; other columns are not looked at; an empty table gives no rows.
    """
    counted = _counted(df, [F.col(f"`{id_col}`").alias("doc_id")], text_col, lang, source)
    limits = written(thresholds(written(sketches(counted))))
    return judged(counted, limits).select("doc_id", *(_of(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def keep_good(df: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of df that the rules keep, in df's columns, whatever their names; cases as in quality().

    Rows are written once beside their counts, so that texts are counted once and never shuffled.
    """
    counted = _counted(df, [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(f"{_P}row")], text_col, lang, source)
    limits = written(thresholds(written(sketches(counted))))
    return judged(counted, limits).where(_of("kept")).select(f"{_P}row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all whole texts of `documents`; null texts have no words and fail (see quality)."""
    return quality(table(spark, sf_dir, "documents"))


def _bucket_sql(v: str) -> str:
    return f"(greatest(length(bin({v})) - 8, 0) * 256 + ({v} >> greatest(length(bin({v})) - 8, 0)))"


def _oracle() -> str:
    ends = [(e, k) for k in MEASURES for e in ("low", "high")]
    per = "\n".join(
        f"""f{name} AS (SELECT {by}{c} max(n_all) AS n_rows, {', '.join(f"max(CASE WHEN measure = '{k}' THEN {e} END) AS {e}_{k}" for e, k in ends)} FROM (
  SELECT *, {low} AS low, q2 + {REACH} * greatest(q3 - q2, least_gap) AS high FROM (
   SELECT {by}{c} measure, max(n_all) AS n_all, CASE measure {least} END AS least_gap,
    {', '.join(f"min(CASE WHEN upto * 4 >= n_all * {q} THEN (bucket % 256) << (bucket // 256) END) AS q{q}" for q in (1, 2, 3))} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {by}{c} measure) AS n_all, sum(n) OVER (PARTITION BY {by}{c} measure ORDER BY bucket) AS upto FROM (
     SELECT {by}{c} measure, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {by}{c} measure)) {('GROUP BY ' + by) if by else ''}),"""
        for name, by, c in (("g", "lang, source", ","), ("l", "lang", ","), ("w", "", ""))
        for least in [" ".join(f"WHEN '{k}' THEN {v}" for k, (v, _) in MEASURES.items())]
        for low in [f"CASE WHEN measure IN ({', '.join(repr(k) for k, (_, b) in MEASURES.items() if b)}) THEN q2 - {REACH} * greatest(q2 - q1, least_gap) ELSE -1 END"]
    )
    ratio = {"symbols": "n_symbols * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 100 // greatest(n_words, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)"}
    inside = " AND ".join(f"m_{k} BETWEEN CASE WHEN g.n_rows >= {FEWEST} THEN g.low_{k} WHEN l.n_rows >= {FEWEST} THEN l.low_{k} ELSE w.low_{k} END AND CASE WHEN g.n_rows >= {FEWEST} THEN g.high_{k} WHEN l.n_rows >= {FEWEST} THEN l.high_{k} ELSE w.high_{k} END" for k in MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
wd AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '{WORD}') AS ws,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS g FROM wd, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS u(i)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid),
c AS (SELECT wd.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words FROM wd LEFT JOIN cover USING (rid)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {', '.join(f"CAST({v} AS BIGINT) AS m_{k}" for k, v in ratio.items())} FROM c),
sk AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, {_bucket_sql('m_' + k)} AS bucket FROM m WHERE NOT base_failed" for k in MEASURES)}) GROUP BY ALL),
{per}
z AS (SELECT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (g.n_rows IS NULL OR ({inside})) AS kept
FROM m LEFT JOIN fg g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
LEFT JOIN fl l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN fw w
"""


ORACLE_SQL = _oracle()
