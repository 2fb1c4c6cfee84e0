"""Composite scores, their change and best rows, and bootstrap intervals."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import functions as F

from quern.plans.registry import registry
from quern.sources.tables import read

QUERIES, ORACLES, query = registry()

#: Weights of distance, language, quality, diversity, cleanness and speed, and the seconds that count as no speed (fixed values).
_W, _SLOWEST = (0.30, 0.15, 0.30, 0.10, 0.10, 0.05), 5.0

_PARTS = f"""lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
dl AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, md5(d.text) AS h, quality, row_number() OVER (PARTITION BY source, md5(text) ORDER BY d.doc_id) AS nth FROM documents d LEFT JOIN lb USING (doc_id)),
vv AS (SELECT 1 AS v, * FROM dl UNION ALL SELECT 2, * FROM dl WHERE nth = 1),
s AS (SELECT v, source, avg(n_chars) / 2000.0::DOUBLE AS dist, avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END) AS lex, coalesce(avg(quality::DOUBLE), 0) AS kp,
 count(DISTINCT h) / count(*)::DOUBLE AS div, avg(CASE WHEN n_chars < 80 THEN 1.0::DOUBLE ELSE 0 END) AS noise, avg(n_chars) / 1000.0::DOUBLE AS seconds FROM vv GROUP BY v, source),
c AS (SELECT v, source, kp, div, noise, round({_W[0]}::DOUBLE * CASE WHEN dist = 0 THEN 0 ELSE greatest(0, least(1, 1 - dist / 2)) END + {_W[1]}::DOUBLE * lex + {_W[2]}::DOUBLE * kp + {_W[3]}::DOUBLE * div + {_W[4]}::DOUBLE * (1 - noise) + {_W[5]}::DOUBLE * greatest(0, 1 - seconds / {_SLOWEST}::DOUBLE), 4) AS composite FROM s)"""


def _composites(spark, d):
    """(v, source, kp, div, noise, composite), with a second for every thousand characters: v 1 over all documents, v 2 over the first of each source's equal texts."""
    labels = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("h"))
    first = docs.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    joined = docs.join(labels, "doc_id", "left")
    both = joined.withColumn("v", F.lit(1)).unionByName(joined.join(first, "doc_id", "left_semi").withColumn("v", F.lit(2)))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = both.groupBy("v", "source").agg(
        (F.avg("n_chars") / 2000.0).alias("dist"),
        share(F.col("lang") == "en").alias("lex"),
        F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(0.0)).alias("kp"),
        (F.count_distinct("h") / F.count("*").cast("double")).alias("div"),
        share(F.col("n_chars") < 80).alias("noise"),
        (F.avg("n_chars") / 1000.0).alias("seconds"),
    )
    near = F.when(F.col("dist") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dist") / 2)))
    total = _W[0] * near + _W[1] * F.col("lex") + _W[2] * F.col("kp") + _W[3] * F.col("div") + _W[4] * (1 - F.col("noise")) + _W[5] * F.greatest(F.lit(0.0), 1 - F.col("seconds") / _SLOWEST)
    return s.select("v", "source", "kp", "div", "noise", F.round(total, 4).alias("composite"))


@query(f"WITH {_PARTS} SELECT v, source, composite FROM c")
def eval_composite(spark, d):
    return _composites(spark, d).select("v", "source", "composite")


@query(f"""WITH {_PARTS} SELECT v, source, noise > 0.20::DOUBLE AS noisy, div < 0.40::DOUBLE AS repeats, kp < 0.20::DOUBLE AS misses, kp = max(kp) OVER (PARTITION BY v) AS best_kp, div = max(div) OVER (PARTITION BY v) AS best_div, noise = max(noise) OVER (PARTITION BY v) AS worst_noise FROM c WHERE source IS NOT NULL""")
def eval_recommend(spark, d):
    """What the thresholds say of each source, and where the extremes are."""
    c = _composites(spark, d).where("source is not null")
    m = c.groupBy("v").agg(F.max("kp").alias("k"), F.max("div").alias("d"), F.max("noise").alias("n"))
    j = c.join(F.broadcast(m), "v")  # a row for each of two versions
    return j.select("v", "source", (F.col("noise") > 0.20).alias("noisy"), (F.col("div") < 0.40).alias("repeats"), (F.col("kp") < 0.20).alias("misses"), (F.col("kp") == F.col("k")).alias("best_kp"), (F.col("div") == F.col("d")).alias("best_div"), (F.col("noise") == F.col("n")).alias("worst_noise"))


@query(f"""WITH {_PARTS}, p AS (SELECT source, max(CASE WHEN v = 1 THEN composite END) AS before, max(CASE WHEN v = 2 THEN composite END) AS after FROM c GROUP BY source)
SELECT source, before, after, CASE WHEN before <> 0 AND after <> 0 THEN round(after - before, 4) END AS delta, coalesce(before <> 0 AND after <> 0 AND after > before, false) AS improved FROM p""")
def eval_delta(spark, d):
    """Composites with and without copies side by side; zero counts as missing."""
    at = lambda v: F.max(F.when(F.col("v") == v, F.col("composite")))
    p = _composites(spark, d).groupBy("source").agg(at(1).alias("before"), at(2).alias("after"))
    there = (F.col("before") != 0) & (F.col("after") != 0)
    return p.select("source", "before", "after", F.when(there, F.round(F.col("after") - F.col("before"), 4)).alias("delta"), F.coalesce(there & (F.col("after") > F.col("before")), F.lit(False)).alias("improved"))


@query(f"""WITH {_PARTS} SELECT v, (list(source ORDER BY composite DESC, source))[1] AS best, (list(source ORDER BY composite, source))[1] AS worst, max(composite) AS high, min(composite) AS low FROM c WHERE source IS NOT NULL GROUP BY v""")
def eval_best(spark, d):
    c = _composites(spark, d).where("source is not null").groupBy("v")
    return c.agg(
        F.min(F.struct((-F.col("composite")).alias("k"), "source")).alias("b"),
        F.min(F.struct("composite", "source")).alias("w"),
        F.max("composite").alias("high"),
        F.min("composite").alias("low"),
    ).select("v", F.col("b.source").alias("best"), F.col("w.source").alias("worst"), "high", "low")


#: Replicates of a bootstrap (fixed value); a row's weight in each is a Poisson count of mean 1, drawn from a hash.
_REPLICATES = 10_000
_CDF = [round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), 12) for k in range(8)]
#: The least first eight hex digits of a hash whose number is at least each of the probabilities.
_LEAST = [f"{math.ceil(Fraction(c) * 2**32):08x}" for c in _CDF if c * 2**32 <= 2**32 - 1]
_DRAW = " + ".join(f"CAST(u >= {c}::DOUBLE AS INTEGER)" for c in _CDF)


@query(f"""WITH x AS (SELECT role, conv_id, turn, length(text)::DOUBLE AS x FROM conversations WHERE text IS NOT NULL),
w AS (SELECT role, b, x, ('0x' || substr(md5(b || ':' || conv_id || ':' || turn), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM x, unnest(generate_series(1, {_REPLICATES})) AS t(b)),
m AS (SELECT role, b, sum(x * ({_DRAW})) / sum({_DRAW}) AS mean FROM w GROUP BY ALL HAVING sum({_DRAW}) > 0),
q AS (SELECT role, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY role),
a AS (SELECT role, count(*) AS n, avg(x) AS mean FROM x GROUP BY role)
SELECT role, n, round(mean, 6) AS mean, round(CASE WHEN n < 5 THEN mean ELSE low END, 6) AS low, round(CASE WHEN n < 5 THEN mean ELSE high END, 6) AS high FROM a JOIN q USING (role)""")
def eval_bootstrap_ci(spark, d):
    """95% intervals of the mean length by role; under five rows the mean stands for both ends.

    Each row has a weight of its own in each replicate.  Weights need no row numbers, so replicates are summed where the rows are and only sums are shuffled.
    """
    x = read(spark, d, "conversations").where("text is not null and role is not null").select("role", "conv_id", "turn", F.length("text").cast("long").alias("x"))
    return bootstrap_means(x, "role", ["conv_id", "turn"])


def bootstrap_means(x, by, key=None):
    """(by, n, mean, low, high) from rows (by, x) that the columns `key` tell apart, or from whole values and their counts (by, x, n), whose rows are numbered."""
    if key is None:
        x, key = x.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"), [by, "x", "nth"]
    r = x.repartition(4 * x.sparkSession.sparkContext.defaultParallelism).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(_REPLICATES))))
    named = [F.col(c).cast("string") for c in ("b", *key)]
    r = r.withColumn("h", F.substring(F.md5(F.concat(named[0], *(part for c in named[1:] for part in (F.lit(":"), c)))), 1, 8))
    weight = F.lit(len(_LEAST))
    for i, least in reversed(list(enumerate(_LEAST))):  # hex digits are in the order of their numbers
        weight = F.when(F.col("h") < least, i).otherwise(weight)
    r = r.withColumn("w", F.when(F.col("h").isNotNull(), weight).cast("long"))
    m = r.groupBy(by, "b").agg((F.sum(F.col("x") * F.col("w")).cast("double") / F.sum("w")).alias("mean"), F.sum("w").alias("w")).where("w > 0")
    q = m.groupBy(by).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    a = x.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    end = lambda c: F.round(F.when(F.col("n") < 5, F.col("mean")).otherwise(F.col(c)), 6).alias(c)
    return a.join(q, by).select(by, "n", F.round("mean", 6).alias("mean"), end("low"), end("high"))
