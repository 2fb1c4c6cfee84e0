"""Toxicity by compression distance.

Zstandard trains two dictionaries apart: one on windows of ordinary texts, one on the passages of
toxic texts that those share and ordinary texts hardly ever hold.  Every window of a text is
compressed with the ordinary dictionary, and with both; the bytes that the toxic one saves
are the window's distance.  A logistic curve over a document's largest and summed savings,
calibrated on labelled rows, turns them to a score.

Compared alone, the two dictionaries differ in ordinary words by chance, and the largest of many windows picks
that up; the toxic one therefore stands before the ordinary one, at the same distance from the window in both.
The sizes and the level are chosen on a part of the learning rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import bounded_sample, chunks, discard, held_out, sent_whole, table, written

SAMPLE = 4000  # learning rows for each label at most, about
WINDOW = 12  # words
GRAM = 6  # bytes; passages are told by what they hold of these
OFTEN, RARELY = 0.03, 0.05  # share of toxic texts that a gram is in, and the ordinary share against it
PASSAGES, ORDINARY_WINDOWS = 50_000, 20_000  # to train on at most
TOXIC_BYTES = 512
#: (bytes of the ordinary dictionary, level) to choose from.
CHOICES = ((16_000, 5), (16_000, 12), (64_000, 5), (64_000, 12))
CUTOFF = 0.3


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def _windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = _words(text)
    return [b" " + b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def _grams(text: str | None) -> set[bytes]:
    whole = b" " + b" ".join(_words(text))
    return {whole[i : i + GRAM] for i in range(len(whole) - GRAM + 1)}


def _rows_of(column: str, made):
    """made(text) gives an iterable of byte strings: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            yield pa.record_batch([pa.array([x for text in batch.column(0).to_pylist() for x in made(text)], pa.binary())], [column])

    return run


def _telling(bad: DataFrame, good: DataFrame, n_bad: int, n_good: int) -> frozenset[bytes]:
    """Grams in many toxic texts and hardly any ordinary one; at most 1/OFTEN times the grams of a text come to the driver."""
    t = bad.mapInArrow(_rows_of("g", _grams), "g binary").groupBy("g").agg(F.count("*").alias("t")).where(F.col("t") >= max(4, OFTEN * n_bad))
    often = {bytes(r["g"]): r["t"] for r in t.collect()}
    o = good.mapInArrow(_rows_of("g", lambda text: _grams(text) & often.keys()), "g binary").groupBy("g").agg(F.count("*").alias("o"))
    seen = {bytes(r["g"]): r["o"] for r in o.collect()}
    return frozenset(g for g, n in often.items() if (seen.get(g, 0) + 0.5) / n_good <= RARELY * n / n_bad)


def _trained(size: int, samples: list[bytes]) -> bytes:
    """Zstandard's dictionary of the samples; too few to train on stand for themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(rows: DataFrame, sizes: set[int]) -> tuple[bytes, dict[int, bytes]]:
    """(toxic dictionary, ordinary dictionaries by size) from rows (text, toxic), each trained by zstandard on its own label."""
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = (rows.where(F.col("toxic") == k).select("text") for k in (1, 0))
    telling = _telling(bad, good, n.get(1, 0), max(1, n.get(0, 0)))

    def passages(text: str | None) -> list[bytes]:
        return [x for w in _words(text) if any((x := b" " + w + b" ")[i : i + GRAM] in telling for i in range(len(w) + 3 - GRAM))]

    def some(df: DataFrame, made, most: int) -> list[bytes]:
        found = df.mapInArrow(_rows_of("w", made), "w binary")
        unit = F.pmod(F.xxhash64("w", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
        found = found.where(unit < 1.5 * most / max(1, found.count()))  # about what is wanted leaves each task; all, where there is less
        return [bytes(r["w"]) for r in found.orderBy(unit, "w").limit(most).collect()]

    toxic = some(bad, passages, PASSAGES)
    ordinary = some(good, _windows, ORDINARY_WINDOWS)
    by_eight = [b"".join(toxic[i::-(-len(toxic) // 8)]) for i in range(-(-len(toxic) // 8))]  # the trainer wants samples of some length
    return _trained(TOXIC_BYTES, by_eight) if toxic else b"", {size: _trained(size, ordinary) for size in sorted(sizes)}


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(**options)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options)


class Savings:
    """Figures of a text: what the toxic dictionary saves in its windows."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int):
        self.plain, self.both = _compressor(ordinary, level).compress, _compressor(toxic + ordinary, level).compress

    def __call__(self, text: str | None) -> list[float]:
        saved = [len(self.plain(w)) - len(self.both(w)) for w in _windows(text)]
        best = sorted(saved, reverse=True)[:2] + [0, 0]
        total = sum(x for x in saved if x > 0)
        return [float(min(best[0], 10)), float(min(best[1], 10)), float(np.log1p(total)), 10 * total / (len(saved) + 5), float(np.log1p(len(saved)))]


def _features(models: list[tuple[bytes, bytes, int]]):
    """The first column is kept, the second is the text; x holds the figures of each model in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = [Savings(*m) for m in models]
        for batch in chunks(batches, "text", 1 << 20):
            out = [[x for f in figures for x in f(text)] for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [batch.schema.names[0], "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, weights with the constant last) by Newton's method; `counts` says how many rows each stands for."""
    counts = np.ones(len(x)) if counts is None else counts * (len(x) / counts.sum())
    mean = np.average(x, axis=0, weights=counts)
    spread = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=counts)) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (counts * p * (1 - p))[:, None]).T @ z + ridge * len(z) * 1e-2 * np.eye(len(w)) + 1e-9 * np.eye(len(w)), z.T @ (counts * (y - p)) - ridge * len(z) * 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _chances(x: np.ndarray, curve: tuple) -> np.ndarray:
    mean, spread, w = curve
    return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / spread, np.ones(len(x))]) @ w, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple[bytes, bytes, int], tuple | None]:
    """((toxic dictionary, ordinary dictionary, level), curve) from docs (doc_id, text) and labels (doc_id, toxic).

    About `sample` rows of each label are used; in the curve each stands for as many as its label has
    rows for one in the sample, so that the share of toxic rows is that of all labels at any size.  An id, or a text, with
    both labels is toxic.  To the driver come a bounded number of passages and one row of figures for each text.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = written(bounded_sample(known, ["toxic"], "doc_id", sample))  # about `sample` ids for each of two labels
    drawn = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", "text").join(sent_whole(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    check = F.crc32(F.coalesce("text", F.lit(""))) % 4 == 0
    rows = written(texts.select("text", "toxic", check.alias("check")))
    sizes = {(r["toxic"], r["check"]): r["count"] for r in rows.groupBy("toxic", "check").count().collect()}
    if not all(sum(sizes.get((k, c), 0) for c in (True, False)) for k in (0, 1)):
        return (b"", b"", 1), None

    def figures(models: list[tuple[bytes, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        got = rows.select(F.struct("toxic", "check").alias("k"), "text").mapInArrow(_features(models), "k struct<toxic: int, check: boolean>, x array<double>").select("k.*", "x").collect()
        y = np.array([r["toxic"] for r in got], float)
        return np.array([r["x"] for r in got]), y, np.array([r["check"] for r in got]), np.array([totals[int(k)] / drawn[int(k)] for k in y])

    choice = CHOICES[1]
    if all(sizes.get((k, c), 0) for k in (0, 1) for c in (True, False)):
        toxic, ordinary = dictionaries(rows.where("not check"), {size for size, _ in CHOICES})
        x, y, checks, weight = figures([(toxic, ordinary[size], level) for size, level in CHOICES])
        losses = []
        for part in np.split(x, len(CHOICES), axis=1):
            p = np.clip(_chances(part[checks], fit_logistic(part[~checks], y[~checks], weight[~checks])), 1e-6, 1 - 1e-6)
            losses.append(-np.average(y[checks] * np.log(p) + (1 - y[checks]) * np.log(1 - p), weights=weight[checks]))
        choice = CHOICES[int(np.argmin(losses))]
    size, level = choice
    toxic, ordinary = dictionaries(rows, {size})
    model = (toxic, ordinary[size], level)
    x, y, _, weight = figures([model])
    discard(chosen, rows)
    return model, fit_logistic(x, y, weight)


def score(df: DataFrame, model: tuple[tuple[bytes, bytes, int], tuple | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of df.

    Null and empty texts get the score of a text without windows; without labels of both kinds every score is 0.
    Long texts are windows like any other; repeated rows get equal scores; an empty table gives no rows.
    """
    known, curve = model
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if curve is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    mean, spread, w = curve
    x = docs.mapInArrow(_features([known]), "doc_id long, x array<double>")
    level = sum((F.get("x", F.lit(i)) - float(mean[i])) / float(spread[i]) * float(w[i]) for i in range(len(mean))) + float(w[-1])
    return x.select("doc_id", (1 / (1 + F.exp(-level))).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of `documents`; labels of rows whose crc32(doc_id) mod 4 is 2 are never learned from.

    Null ids are not held out and have no label; null and empty texts get a score like others (see score).
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = ~held_out(F.col("doc_id"))
    scored = score(docs, learn(docs.where(seen), labels.where(seen)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
