"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key.  Its leading digits deal the rows of a source to ranges of
the key, so a hot source is spread over as many groups as any; rows are sorted within a
range, token counts are summed up before each row within its range, and the sums of the
ranges before it are added.  The mix takes whole epochs of a source and then the rows
whose prefix lies below what is left of the budget, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
DIGITS = 3  # leading hexadecimal digits of the key: 4096 ranges for each source


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share `share` of all sizes by weight; one above `most` times its size stops
    there.  With sources by the ratio of cap to weight, the capped ones come first: source
    i is capped if its cap is below its part of what the ones before it leave.  The sources (not the rows) are ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumns({"cap": F.col("source_size") * F.lit(most)})
    everything = Window.partitionBy()
    ratio = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*ratio).rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumns({"left": left, "weights": F.sum("w").over(after)})
    s = s.withColumn("capped", F.col("cap") * F.col("weights") <= F.col("left") * F.col("w"))
    # the first source that is not capped sets the level of all that follow
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", (F.col("left") / F.col("weights")).alias("level")))).over(everything)["level"]
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("w") * level)).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, row_col: str | None = None) -> DataFrame:
    """One row for each row of df: (doc_id, size, source_size, target, taken, source), and `row_col` where given.

    Null texts have size 0; null sources are one source, the last; rows with one id and
    source (repeated rows) have one key and follow each other by size.  An empty table
    gives no rows.  Rows without an id have a key by their text.  `row_col`, a unique key of the rows, orders those of equal size and gives rows
    without an id keys of their own.  Long texts count whole; other columns are not looked at.
    """
    more = [row_col] if row_col else []
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    no_id = F.concat(F.lit("row "), F.col(row_col).cast("string")) if row_col else F.concat(F.lit("text "), F.md5(text))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), no_id), F.lit(f"#{seed}")))
    rows = written(df.select(*more, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words(F.col(f"`{text_col}`").cast("string")).alias("size"), key.alias("key")))
    rows = rows.withColumn("range", F.substring("key", 1, DIGITS))
    sums = written(rows.groupBy("source", "range").agg(F.sum("size").alias("n")))
    sizes = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    goals = targets(sizes, weights, share, most)

    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select("source", "range", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("offset"))
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*more, "doc_id", "source", "range", "size", F.coalesce(F.sum("size").over(in_range), F.lit(0)).alias("inner"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    placed = placed.join(ranges, same(placed, ranges, "source", "range")).select(placed["*"], (F.col("inner") + F.col("offset")).alias("prefix"))
    out = placed.join(goals, same(placed, goals, "source")).select(placed["*"], goals["source_size"], goals["target"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("prefix")))
    return out.select(*more, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each row of `documents`; null texts have size 0, null sources are the last source (see mix)."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


_WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS_SQL} AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || '#11') AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE
                - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
lv AS (SELECT lft / ws AS level FROM r WHERE NOT cap * ws <= lft * w ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN cap * ws <= lft * w THEN cap ELSE least(cap, w * (SELECT level FROM lv)) END AS target FROM r),
p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken
FROM e
"""
