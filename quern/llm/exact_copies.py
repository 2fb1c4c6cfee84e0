"""Exact duplicates by polynomial fingerprints that are put together from pieces.

A text's bytes are cut to pieces.  A piece's hash is the polynomial of its bytes at a fixed base, modulo a prime, and
moving it by the length of all that comes before it multiplies it by a power of the base; so the hash of a text is the sum of
its moved pieces, whatever task hashed them and in whatever order they arrive.  The pieces of a huge text lie in many row groups
and are hashed by many tasks.  Two primes make a fingerprint of 62 bits, which decides nothing: texts of one
fingerprint and length are compared with the one that would stay, piece by piece, and those that
differ from it are grouped anew among themselves until none is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import discard, fresh, table, written

PIECE = 1 << 16
MODULI = (2147483647, 2147483629)
BASES = (1048583201, 786433711)
ROW_GROUP = 32 << 20
MOST_BITS = 28  # of the bitmap: 32 MB at most
_ROW = 32768  # bits in a row of the bitmap


def pieces(df: DataFrame, row: str, id_col: str, text: Column, piece: int = PIECE) -> DataFrame:
    """(row, doc_id, n_bytes, sha, at, bytes): each text's UTF-8 bytes in pieces, an empty one at least; sha is with the first."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.withColumns({"n_bytes": F.octet_length("raw"), "sha": F.sha2("raw", 256)})
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(piece))
    cut = rows.select("row", "doc_id", "n_bytes", "sha", "raw", F.explode(starts).alias("at"))
    part = F.substring("raw", F.col("at") + 1, F.lit(piece))
    return cut.select("row", "doc_id", F.col("n_bytes").cast("long"), F.when(F.col("at") == 0, F.col("sha")).alias("sha"), F.col("at").cast("long"), part.alias("bytes"))


def _powers(piece: int, moduli: tuple[int, ...], bases: tuple[int, ...]) -> list[np.ndarray]:
    """The powers of each base for the places in a piece, doubled up."""
    out = []
    for m, b in zip(moduli, bases, strict=True):
        p = np.ones(1, np.int64)
        while len(p) < piece:
            p = np.concatenate([p, p * pow(b, len(p), m) % m])
        out.append(p[:piece])
    return out


def _moved_hashes(piece: int, moduli: tuple[int, ...], bases: tuple[int, ...]):
    """Each piece's hashes, moved to its place: at most 2**16 products below 2**39 are added up, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(piece, moduli, bases)
        for batch in batches:
            sums = np.empty((len(moduli), batch.num_rows), np.int64)
            for k, (raw, at) in enumerate(zip(batch.column("bytes"), batch.column("at").to_pylist(), strict=True)):
                value = np.frombuffer(raw.as_buffer(), np.uint8).astype(np.int64) + 1  # so that zero bytes count
                for i, (m, b) in enumerate(zip(moduli, bases, strict=True)):
                    h = int(value @ powers[i][: len(value)]) % m
                    sums[i, k] = h * pow(b, at, m) % m
            held = [batch.column(c) for c in ("row", "doc_id", "n_bytes", "sha")]
            yield pa.record_batch([*held, pa.array(sums[0]), pa.array(sums[1])], ["row", "doc_id", "n_bytes", "sha", "h0", "h1"])

    return run


def fingerprints(cut: DataFrame, piece: int = PIECE, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES) -> DataFrame:
    """(row, doc_id, n_bytes, sha, fp) from pieces(); only numbers are shuffled."""
    moved = cut.mapInArrow(_moved_hashes(piece, moduli, bases), "row long, doc_id long, n_bytes long, sha string, h0 long, h1 long")
    h = [F.sum(f"h{i}") % m for i, m in enumerate(moduli)]
    return moved.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("sha").alias("sha"), F.shiftleft(h[0], 32).bitwiseOR(h[1]).alias("fp"))


def _led(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, fp, lead): rows whose fingerprint and length others share, with the row that would stay."""
    groups = rows.groupBy("fp", "n_bytes").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row"))["row"].alias("lead"))
    shared = written(groups.where("n > 1").drop("n"))  # a table, so that the join can split hot fingerprints
    return written(rows.join(shared, ["fp", "n_bytes"]).select("row", "doc_id", "n_bytes", "fp", "lead"))


def _likely(cut: DataFrame, led: DataFrame) -> DataFrame:
    """The pieces of led's rows and of few others: those whose bit is set in a bitmap of led's rows.

    The bitmap has 16 bits for each row up to its bound; it only spares pieces the way through the shuffle, and where it is
    too full to, all of them go.
    """
    bits = 1 << min(MOST_BITS, max(20, (16 * led.count()).bit_length()))
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    inner = F.pmod(place, F.lit(_ROW))
    marks = led.groupBy(F.floor(place / _ROW).alias("k")).agg(F.bitmap_construct_agg(inner).alias("marks"))  # bits / 32768 rows at most
    byte = F.substring(F.col("marks"), F.floor(inner / 8).cast("int") + 1, F.lit(1))
    marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), F.pmod(inner, F.lit(8)).cast("int")) == 1
    return cut.join(F.broadcast(marks), (F.floor(place / _ROW) == F.col("k")) & marked).select("row", "at", "bytes")


def _unlike(cut: DataFrame, led: DataFrame) -> DataFrame:
    """(row): the rows of led that differ from their lead in some piece; one piece of each meets at a time.

    Both joins are asked to sort and merge, so that a small table takes the same way as a large one and a hot group is divided.
    """
    shown = written(_likely(cut, led).join(led.select("row", "lead").hint("merge"), "row"))
    own = shown.where("row = lead").select("lead", "at", F.col("bytes").alias("first")).hint("merge")
    differ = shown.where("row <> lead").join(own, ["lead", "at"]).where(F.col("bytes") != F.col("first"))
    out = written(differ.select("row").distinct())
    discard(shown)
    return out


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, normalise: Callable[[Column], Column] = lambda text: text, piece: int = PIECE, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES) -> DataFrame:
    """One row for each row of df: (row, doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after `normalise`; null counts as empty, and empty texts are copies of each
    other.  Of a group the row with the largest id stays (a null id is the least); of repeated ids one row stays, the one with the largest
    `row_col`, a unique key of df's rows (one is made up where none is given).  Very long texts are hashed and
    compared in pieces; other columns are not looked at; an empty table gives no rows.
    """
    row = row_col or fresh(df, "row")[0]
    keyed = df if row_col else df.withColumn(row, F.monotonically_increasing_id())
    cut = written(pieces(keyed, row, id_col, normalise(F.col(f"`{text_col}`")), piece), row_group=ROW_GROUP)
    prints = written(fingerprints(cut, piece, moduli, bases))
    led, settled = _led(prints), []
    while True:
        unlike = _unlike(cut, led)
        settled.append(written(led.join(unlike, "row", "left_anti").select("row", "lead")))
        if not unlike.limit(1).count():
            break
        led = _led(led.join(unlike, "row", "left_semi").drop("lead"))
    discard(cut)
    classes = settled[0]
    for more in settled[1:]:
        classes = classes.union(more)
    ids = prints.select("row", F.col("doc_id").alias("keep_id"))
    sizes = classes.groupBy("lead").agg(F.count("*").alias("group_size")).join(ids.withColumnRenamed("row", "lead"), "lead")
    found = classes.join(written(sizes), "lead")
    out = prints.join(found, "row", "left")
    kept = F.coalesce(F.col("lead") == F.col("row"), F.lit(True))
    keep_id = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("row", "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that stay, in df's columns, whatever their names; cases as in copies()."""
    (row,) = fresh(df, "row_key")
    keyed = written(df.withColumn(row, F.monotonically_increasing_id()))
    stay = copies(keyed, id_col, text_col, row, **options).where("kept").select(F.col("row").alias(row))
    return keyed.join(stay, row, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all `documents`, unchanged; null texts are empty, the largest doc_id stays (see copies)."""
    return copies(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       row_number() OVER (g ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
