"""Near duplicates by word-shingle Jaccard: SimHash proposes pairs, the shingle sets decide.

Each text is the set of its five-word shingles.  Texts of equal sets meet by a 128-bit key.  The
others lie in tiles by the number of their shingles; tiles whose numbers are too far apart for the
similarity are never paired.  In a pair of tiles, SimHash fingerprints of 64 bits are compared by
exclusive or and bit counts, and what is near passes a second fingerprint.  Texts that candidates
connect in a pair of tiles are a cell.  All of a cell are compared with its first by their whole sets, which joins most of a large group of
copies in one step, however many they are; the rest are gathered in blocks and compared with all
of the cell, by every pair not yet joined.  Only verified links, as spanning forests, go to components().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import chunks, components, written
from quern.llm.simhash_dedup import BLOCK, TILE, _merge, _shingle_hashes, fingerprint, tile_pairs, tile_plan

WIDTH = 5
SHARED, OF_BOTH = 9, 4  # similarity 0.8: 9 x common shingles >= 4 x (those of one + those of the other)
RADIUS, RADIUS_BOTH = 18, 36  # of 64 bits, and of both fingerprints' 128; the README has the measured distances
STEPS = 50  # cells of the shingle count for each factor e
REACH = 12  # cells that counts with 4/5 of each other may lie apart: ln(5/4) x STEPS, and one for rounding
GATHERED = 1 << 17  # shingles in a block of verification, about


def shingle_set(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of the distinct shingles, sorted; a text below `width` words is one shingle."""
    return np.unique(np.array(_shingle_hashes(raw or b"", width), np.uint64))


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other bits for the same shingles (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, second fingerprints, numbers of shingles) of sets."""
    size = np.array([len(x) for x in sets], np.int64)
    whole = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    ends = np.cumsum(size)
    return fingerprint(whole, ends), fingerprint(_second(whole), ends), size


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "raw", 1 << 20):
            sets = [shingle_set(raw, width) for raw in batch.column(1).to_pylist()]
            fp, gp, size = sketches(sets)
            cell = np.floor(np.log(np.maximum(size, 1)) * STEPS).astype(np.int32)
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(fp.view(np.int64)), pa.array(gp.view(np.int64)), pa.array(size), pa.array(cell)], ["row", "key", "fp", "gp", "size", "cell"])

    return run


_NUMBERS = ("fp", "gp", "size", "rep")


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """A tile as one row."""
    packed = {x: pa.array([rows.column(x).to_numpy().astype("<i8").tobytes()], pa.binary()) for x in _NUMBERS}
    return pa.table({"t": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([key[1].as_py()], pa.int32())} | packed)


def _candidates(radius: int, both: int):
    """A pair of tiles (one row if a tile meets itself): members (rep, cell, lead) of the groups that candidates connect; lead is the first of them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        fp, gp, size, rep = (np.frombuffer(b"".join(rows.column(x).to_pylist()), "<i8") for x in _NUMBERS)
        fp, gp = fp.view(np.uint64), gp.view(np.uint64)
        side = np.repeat(np.arange(rows.num_rows), [len(x) // 8 for x in rows.column("fp").to_pylist()])
        order = np.lexsort((rep, size, side))
        fp, gp, size, rep, side = fp[order], gp[order], size[order], rep[order], side[order]
        label = np.arange(len(rep))
        split = int(np.searchsorted(side, 1))
        cut = lambda a, z: [(x, min(x + BLOCK, z)) for x in range(a, z, BLOCK)]
        left = cut(0, split)
        right = cut(split, len(fp)) or left
        for x in left:
            for y in right:
                if right is left and y < x or 5 * size[x[1] - 1] < 4 * size[y[0]] or 5 * size[y[1] - 1] < 4 * size[x[0]]:
                    continue
                i, j = np.nonzero(np.bitwise_count(fp[x[0] : x[1], None] ^ fp[None, y[0] : y[1]]) <= radius)
                i, j = i + x[0], j + y[0]
                ok = (i != j) & (5 * size[i] >= 4 * size[j]) & (5 * size[j] >= 4 * size[i])
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int16) + np.bitwise_count(gp[i] ^ gp[j]) <= both
                _merge(label, i[ok], j[ok])
        members = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        members = members[np.argsort(label[members], kind="stable")]
        root = label[members]
        name = ".".join(str(v) for k in key for v in k.as_py().values())
        cells = pa.array([f"{name}.{r}" for r in root.tolist()], pa.string())
        return pa.table({"rep": pa.array(rep[members]), "cell": cells, "lead": pa.array(rep[root])})

    return run


def _gathered(width: int):
    """From (rep, raw, cells): the shingle set for each cell that asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "raw", 1 << 20):
            for rep, raw, cells in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                b = shingle_set(raw, width).astype("<u8").tobytes()
                columns = ([c["cell"] for c in cells], [c["lead"] for c in cells], [rep] * len(cells), [b] * len(cells))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["cell", "lead", "rep", "b"])

    return run


def _with_lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (cell, lead, rep, b, first): whether a member is similar to its cell's first, and how many shingles it has."""
    for batch in batches:
        sets = [[np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("b", "first")]
        near = [similar(a, b) for a, b in zip(*sets, strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in ("cell", "lead", "rep")), pa.array(near, pa.bool_()), pa.array([len(x) for x in sets[0]], pa.int64())], ["cell", "lead", "rep", "near", "n"])


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """A block of sets as one row."""
    sets = rows.column("b").to_pylist()
    reps = rows.column("rep").to_numpy().astype("<i8").tobytes()
    sizes = np.array([len(x) for x in sets], "<i8").tobytes()
    return pa.table({"cell": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int32()), "rest": rows.column("rest").slice(0, 1), "blocks": rows.column("blocks").slice(0, 1), "reps": pa.array([reps], pa.binary()), "sizes": pa.array([sizes], pa.binary()), "sets": pa.array([b"".join(sets)], pa.binary())})


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 at least."""
    n = len(a) + len(b)
    if SHARED * min(len(a), len(b)) < OF_BOTH * n:
        return False
    x = np.concatenate([a, b])
    x.sort()
    return bool(SHARED * int(np.count_nonzero(x[1:] == x[:-1])) >= OF_BOTH * n)


def _verify(key: tuple, rows: pa.Table) -> pa.Table:
    """A pair of blocks (one row if a block meets itself): forest edges (a, b) of texts that are similar.

    The second block's texts are known to be one group if its number is not among the rest's.
    """
    reps, sets, ends = [], [], []
    rows = rows.sort_by("second")
    for r, z, s in zip(*(rows.column(x).to_pylist() for x in ("reps", "sizes", "sets")), strict=True):
        reps += np.frombuffer(r, "<i8").tolist()
        sets += np.split(np.frombuffer(s, "<u8"), np.cumsum(np.frombuffer(z, "<i8") // 8)[:-1])
        ends.append(len(reps))
    up = list(range(len(reps)))
    if key[2].as_py() >= rows.column("rest")[0].as_py():
        up[ends[0] :] = [ends[0]] * (len(reps) - ends[0])

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = []
    for i in range(ends[0]):
        for j in range(i + 1 if len(ends) == 1 else ends[0], ends[-1]):
            a, b = root(i), root(j)
            if a != b and similar(sets[i], sets[j]):
                up[max(a, b)] = min(a, b)
                edges.append((reps[i], reps[j]))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _rest_links(sets: DataFrame, star: DataFrame) -> DataFrame:
    """Forest edges of the members that are not similar to their cell's first, with each other and with those that are.

    Blocks of the rest are numbered before the others; pairs of blocks without any of the rest are never formed.
    """
    parts = lambda near: F.ceil(F.sum(F.when(F.col("near") == near, F.col("n")).otherwise(0)) / GATHERED).cast("int")
    counts = written(star.groupBy("cell").agg(parts(False).alias("rest"), parts(True).alias("others")).where("rest > 0"))
    at = lambda many: F.pmod(F.xxhash64("rep"), F.col(many)).cast("int")
    block = F.when(F.col("near"), F.col("rest") + at("others")).otherwise(at("rest"))
    dealt = star.join(counts, "cell").select("cell", "rep", block.alias("block"), "rest", (F.col("rest") + F.col("others")).alias("blocks"))
    blocks = sets.select("cell", "rep", "b").join(dealt, ["cell", "rep"]).groupBy("cell", "block").applyInArrow(_block, "cell string, block int, rest int, blocks int, reps binary, sizes binary, sets binary")
    met = blocks.withColumn("t", F.explode(F.sequence(F.lit(0), F.when(F.col("block") < F.col("rest"), F.col("blocks")).otherwise(F.col("rest")) - 1)))
    met = met.select("cell", F.least("block", "t").alias("x"), F.greatest("block", "t").alias("y"), "rest", "reps", "sizes", "sets", (F.col("block") > F.col("t")).alias("second"))
    return met.groupBy("cell", "x", "y").applyInArrow(_verify, "a long, b long")


def similar_texts(df: DataFrame, row_col: str, text_col: str = "text", width: int = WIDTH, tile: int = TILE, radius: int = RADIUS, both: int = RADIUS_BOTH) -> DataFrame:
    """(row, component) for each row of df, whose `row_col` is a unique long: the smallest row reachable by links.

    Links are texts whose shingle sets have a Jaccard similarity of 0.8 at least, among those whose
    fingerprints are within the radii.  Texts without words are copies of each other.
    """
    spark = df.sparkSession
    texts = df.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    sketched = written(texts.mapInArrow(_sketched(width), "row long, key binary, fp long, gp long, size long, cell int"))
    reps = written(sketched.groupBy("key").agg(F.min("row").alias("rep"), *(F.first(c).alias(c) for c in ("fp", "gp", "size", "cell"))))
    sized = reps.where("size > 0")
    cells, near = tile_plan(spark, sized.groupBy("cell").count(), ["cell"], REACH, tile)  # about 50 cells for each factor e of length
    slot = F.pmod(F.xxhash64("key"), F.col("slots")).cast("int")
    dealt = sized.join(F.broadcast(cells), "cell").select(*_NUMBERS, "t", slot.alias("s"))
    packed = written(dealt.groupBy("t", "s").applyInArrow(_tile, "t int, s int, fp binary, gp binary, size binary, rep binary"), "none")
    pairs = tile_pairs(packed, near, *_NUMBERS)
    asked = written(pairs.groupBy("x", "y").applyInArrow(_candidates(radius, both), "rep long, cell string, lead long"))

    asked = asked.groupBy("rep").agg(F.collect_list(F.struct("cell", "lead")).alias("cells"))  # one for each pair of a text's tiles at most
    found = texts.join(asked, F.col("row") == F.col("rep")).select("rep", "raw", "cells")
    sets = written(found.mapInArrow(_gathered(width), "cell string, lead long, rep long, b binary"))
    first = sets.where("rep = lead").select("cell", F.col("b").alias("first"))
    met = sets.join(first.hint("merge"), "cell").select("cell", "lead", "rep", "b", "first")
    star = written(met.mapInArrow(_with_lead, "cell string, lead long, rep long, near boolean, n long"))
    links = written(star.where("near and rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).union(_rest_links(sets, star)))
    classes = reps.select("key", "rep").join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
    return sketched.select("row", "key").join(classes.select("key", F.coalesce("component", "rep").alias("component")), "key").select("row", "component")
