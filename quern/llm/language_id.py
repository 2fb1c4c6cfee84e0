"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's n-grams (one to three letters, words padded by a space) from
the most frequent down.  A document's own list is compared with each profile: every n-gram
adds the difference of its two ranks, or the profile's length where the profile lacks it.
The language out of place the least is the answer.  N-grams are keyed by their code points, so no alphabet is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import bounded_sample, chunks, discard, held_out, table, written

PROFILE = 300
SAMPLE = 2000  # learning rows for each language at most, about
NONE = "und"
_BITS = 20  # of a letter in an n-gram's key; letters lie below 2**18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point, or 0 where it is no letter."""
    points = np.arange(0x110000, dtype=np.int64)
    return np.where(np.fromiter((chr(p).isalpha() for p in points.tolist()), bool, len(points)), points, 0)


def ngrams(text: str) -> np.ndarray:
    """Keys of all n-grams in a text; spaces repeat nowhere and stand in no unigram, and trigrams have no break inside."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    c = c[keep]
    one, two = c[c > 0], (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate([one, two | 1 << 3 * _BITS, three[c[1:-1] > 0] | 2 << 3 * _BITS])


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by key."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 1 << 20):
        held: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(ngrams(text))
        for lang, parts in held.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """{language: n-gram keys by rank} from about `sample` rows for each language (chosen by id); `size` of each come to the driver."""
    named = (F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((text_col, "string", "text"), (lang_col, "string", "lang")))
    known = df.select(*named, F.col(f"`{id_col}`").alias("id")).where("text is not null and lang is not null")
    rows = written(bounded_sample(known, ["lang"], "id", sample).select("text", "lang"))
    grams = rows.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    discard(rows)
    out: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def _judge(known: dict[str, list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(known)
        every = np.unique(np.array([g for grams in known.values() for g in grams], np.int64))
        rank = np.full((len(langs), len(every) + 1), -1, np.int32)  # the last column: what no profile has
        for i, lang in enumerate(langs):
            rank[i, np.searchsorted(every, known[lang])] = np.arange(len(known[lang]))
        for batch in chunks(batches, "text", 1 << 20):
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                grams = ngrams(text or "")
                if not langs or not len(grams) or grams.min() >> 3 * _BITS:
                    names.append(NONE), scores.append(0.0)
                    continue
                own = top(*np.unique(grams, return_counts=True), size)
                at = np.searchsorted(every, own)
                theirs = rank[:, np.where(every[np.minimum(at, len(every) - 1)] == own, at, len(every))]
                out = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))), size).sum(axis=1) / (size * len(own))
                best = int(np.argmin(out))
                others = np.delete(out, best)
                names.append(langs[best])
                # how much less it is out of place than the next one, from a half up
                scores.append(float(np.clip(0.5 + (others.min() - out[best]) / (2 * max(others.min(), 1e-9)), 0, 1)) if len(others) else 1.0)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(df: DataFrame, model: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of df; texts that are null or hold no letter are `und`, score 0.

    Without any profile every row is `und`.  Equal distances go to the language that
    sorts first; long texts are read whole; repeated rows get equal answers; null ids stay; other columns are not looked at.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(_judge(model, size), "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`, learned from rows that are not held out; null texts are `und`."""
    docs = table(spark, sf_dir, "documents")
    model = profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
