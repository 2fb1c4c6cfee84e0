"""The corpus pipeline: quality rules, SimHash near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.jaccard_dedup import similar_texts
from quern.llm.mixing import mix
from quern.llm.packing import pack
from quern.llm.pii import learn, redact
from quern.llm.quality_rules import keep_good
from quern.llm.shared import WORD, fresh, table, written


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows and
    null ids are judged each, long texts whole; further columns stay whatever their names; no rows give none.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five-word shingles, Jaccard 0.8 or more), the row of the smallest id stays.

    Rows are told apart by a key of their own: texts that differ all stay, also under one id, and rows
    without an id stay unless their group has one with an id, or another row.  Texts without words, null ones included, are
    copies of each other, as repeated rows are; of rows with equal ids the first stays.  Long texts are compared whole; further columns stay
    whatever their names; no rows give none.
    """
    row, first = fresh(docs, "row_key", "first_row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = keyed.select(F.col(row).alias("row"), "doc_id")
    groups = similar_texts(keyed, row).join(ids, "row")
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias(first))
    return keyed.join(kept.select(F.col(f"{first}.row").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars follows.

    Null texts stay null, empty ones empty; repeated rows are masked alike, long texts whole; null ids and all other columns
    stay as they are; no rows give none.
    """
    return _sized(redact(docs, learn(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated for each epoch that takes it whole; where a budget ends inside one, its first words are kept.

    Rows meet their shares by a key of their own, so null and repeated ids lose and add nothing.  Texts without words have no
    share and go; null sources are one source; long texts count whole; further columns stay whatever their names; no rows give none.
    """
    row, size, taken, words = fresh(docs, "row_key", "size_", "taken_", "words_")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    shares = mix(keyed, row_col=row).where("taken > 0").select(row, F.col("size").alias(size), F.col("taken").alias(taken))
    part = F.col(taken) % F.col(size)
    copies = F.explode(F.concat(F.array_repeat(F.col(size), (F.col(taken) / F.col(size)).cast("int")), F.filter(F.array(part), lambda x: x > 0)))
    rows = keyed.join(shares, row).select(*(F.col(f"`{c}`") for c in docs.columns), size, copies.alias(words))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col(words).cast("int")), " ")
    cut = rows.withColumn("text", F.when(F.col(words) < F.col(size), first).otherwise(F.col("text")))
    return _sized(cut.select(*(F.col(f"`{c}`") for c in docs.columns)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 ids.

    Null and empty texts are the end id alone; repeated rows and null ids are packed each, long texts cut to full windows;
    further columns are left out; no rows give no pieces.
    """
    return pack(docs)


STAGES = [("quality", quality), ("simhash_near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The learned and iterated stages are not SQL; tests/llm/test_pipeline.py holds each stage of a run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
