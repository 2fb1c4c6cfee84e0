"""Importance resampling towards a target: documents whose n-grams a target set favours are drawn more often.

N-grams are interned a block at a time in an open-addressed table of numpy arrays: the xxhash64 of an n-gram's bytes gives the
first slot to try, all open occurrences try theirs at once, those that meet a free slot claim it, and an occurrence
stays where the owner's bytes equal its own (a hash only leads to a slot); the others go on to the next one.
A slot holds its n-gram's bucket and count.  Counts are summed up by bucket over all documents and over all target texts, which
gives each bucket's gain; in a second pass the occurrences gather gains through their slots, and a document's weight is their mean.
Adding Gumbel noise and taking the highest scores draws without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import chunks, table, written

GRAMS = 1
BUCKETS = 10_000
SCALE = 1000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
BATCH = 1 << 20  # bytes of text that are cut to words at a time
BLOCK = 1 << 17  # occurrences that share a table

#: Separators become spaces, A-Z becomes a-z; digits, letters and all bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Interned:
    """The distinct n-grams of a block: for each occurrence its slot, for each slot its bucket and count."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS, hashed=xxhash.xxh64_intdigest):
        size = 1 << max(3, (2 * len(starts) - 1).bit_length())
        keys = np.fromiter((hashed(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        text, length = np.frombuffer(raw, np.uint8), ends - starts
        owner = np.full(size, -1, np.int64)
        self.slots = (keys & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(len(starts))
        while len(todo):
            at = self.slots[todo]
            free = owner[at] < 0
            owner[at[free]] = todo[free]  # of several that claim a slot, one gets it
            found = owner[at]
            same = (keys[found] == keys[todo]) & (length[found] == length[todo])
            same[same] = _equal(text, starts[found[same]], starts[todo[same]], length[todo[same]])
            todo = todo[~same]
            self.slots[todo] = (self.slots[todo] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        self.buckets = np.zeros(size, np.int64)
        self.buckets[used] = [zlib.crc32(raw[a:z]) % buckets for a, z in zip(starts[owner[used]].tolist(), ends[owner[used]].tolist(), strict=True)]
        self.counts = np.bincount(self.slots, minlength=size)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are equal, for pairs of places that differ; places that are one are equal."""
    out = np.ones(len(a), bool)
    apart = np.flatnonzero(a != b)
    if len(apart):
        a, b, length = a[apart], b[apart], length[apart]
        first = np.cumsum(length) - length
        inner = np.arange(int(length.sum())) - np.repeat(first, length)
        out[apart] = np.logical_and.reduceat(text[np.repeat(a, length) + inner] == text[np.repeat(b, length) + inner], first)
    return out


def occurrences(texts: list[bytes | None], grams: int = GRAMS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, document, words of each document): runs of 1 to `grams` words of each text, joined by one space."""
    parts = [(t or b"").translate(_FOLD).split() for t in texts]
    words = np.array([len(p) for p in parts], np.int64)
    raw = b" ".join(w for p in parts for w in p)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    starts, ends = (x[: int(words.sum())].astype(np.int64) for x in (starts, ends))
    doc = np.repeat(np.arange(len(texts)), words)
    runs = [np.flatnonzero(doc[: len(doc) - n] == doc[n:]) if n < len(doc) else np.zeros(0, np.int64) for n in range(grams)]
    first = np.concatenate(runs)
    last = np.concatenate([r + n for n, r in enumerate(runs)])
    return raw, starts[first], ends[last], doc[first], words


def _blocks(raw: bytes, starts: np.ndarray, ends: np.ndarray, buckets: int) -> Iterator[tuple[slice, Interned]]:
    for at in range(0, len(starts), BLOCK):
        part = slice(at, at + BLOCK)
        yield part, Interned(raw, starts[part], ends[part], buckets)


def _bucket_counts(grams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text", BATCH):
            raw, starts, ends, _, _ = occurrences(batch.column("text").to_pylist(), grams)
            for _, block in _blocks(raw, starts, ends, buckets):
                np.add.at(sums, block.buckets, block.counts)
        held = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all whole texts; a task sends one row for each bucket."""
    texts = df.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(_bucket_counts(grams, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """Each bucket's floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) from (bucket, n) of both; `buckets` rows come to the driver."""
    spark = source.sparkSession
    each = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = each.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = written(both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(scale * F.log(ratio)).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def _weights(gain: np.ndarray, grams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH):
            raw, starts, ends, doc, words = occurrences(batch.column("text").to_pylist(), grams)
            sums, features = np.zeros(len(words), np.int64), np.bincount(doc, minlength=len(words))
            for part, block in _blocks(raw, starts, ends, len(gain)):
                np.add.at(sums, doc[part], gain[block.buckets][block.slots])
            weight = sums // np.maximum(features, 1)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from a hash of the id, floored; a null id counts as an empty one."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an ordered partition with the partition's number and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.record_batch([batch.column("row"), pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], ["row", "part", "place"])
        at += n


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(row, rank) from 1 in a total order over all rows: ranges of it are sorted apart, and the sizes of the ranges before are added."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row").mapInArrow(_places, "row long, part long, place long"))
    sizes = sorted(map(tuple, placed.groupBy("part").count().collect()))  # one row for each partition
    upto = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    before = rows.sparkSession.createDataFrame([(p, u) for (p, _), u in zip(sizes, upto)], "part long, upto long")
    return placed.join(F.broadcast(before), "part").select("row", (F.col("upto") + F.col("place") + 1).alias("rank"))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row for each row of df: (doc_id, n_features, weight, score, rank); rank is null for rows that are not drawn.

    Null and empty texts have no features, weight 0, and are not drawn; ties go to the smaller id (null ids last), and of rows with one
    id, which have the same noise, to the one read first.  Very long texts count whole, in blocks; other columns are
    not looked at; an empty table gives no rows; without target texts all of its counts are 0.
    """
    gain = gains(bucket_counts(df, text_col, grams, buckets), bucket_counts(target, target_text, grams, buckets), buckets)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    weighed = docs.mapInArrow(_weights(gain, grams), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}))
    able = scored.where(F.col("n_words") >= least_words)
    # gains and noise lie within some ten thousand of 0, so there are some hundred steps of 64, however many rows
    steps = sorted(map(tuple, able.groupBy(F.floor(F.col("score") / 64).alias("step")).count().collect()), reverse=True)
    drawn = percent * sum(n for _, n in steps) // 100
    upto = np.cumsum([n for _, n in steps])
    last = steps[int(np.searchsorted(upto, drawn))][0] if drawn else 1 << 40
    likely = able.where(F.floor(F.col("score") / 64) >= last)
    ranks = ranked(likely, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]).where(F.col("rank") <= drawn)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of `documents` against `benchmark`, and the ranks of those drawn; null texts have no words (see resample)."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
o AS (SELECT doc_id, unnest(ws) AS w FROM d),
b AS (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark),
x AS (SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
                              lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
        FROM range(256) r(i))),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM o UNION SELECT w FROM b)),
y AS (SELECT w, list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS bytes FROM v),
k AS (SELECT w, xor(list_reduce(bytes, lambda c, z: xor(t[CAST(xor(c % 256, z) AS BIGINT) + 1], c // 256)), 4294967295) % 10000 AS bucket FROM y, x),
s AS (SELECT bucket, count(*) AS n FROM o JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1::DOUBLE) * ((SELECT count(*) FROM o) + 10000::DOUBLE)
                                          / ((s.n + 1::DOUBLE) * ((SELECT count(*) FROM b) + 10000::DOUBLE)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM o JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM e LEFT JOIN r USING (doc_id)
"""
