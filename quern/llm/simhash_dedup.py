"""Near duplicates by SimHash, compared exactly in tiles.

Fingerprints are compared by exclusive or and bit counts.  Distinct fingerprints lie in
tiles, boxes of the bit counts of their four quarters; the counts of two fingerprints within the
radius differ by at most the radius in all, so pairs of tiles whose boxes are further apart are never formed, and
nothing is shuffled for them.  In a pair of tiles, blocks ordered by the same counts are skipped in the same way.

There are about TILES tiles, which grow with the corpus up to MOST fingerprints each, so that a fingerprint travels to a bounded number of
tiles until there are TILES x MOST (10**9) of them, and a task's memory is bounded at any size; beyond that tiles grow in number.  Tiles travel as packed rows.  A pair of tiles sends on only a spanning forest of its links, so that large groups of near
copies stay linear; components() joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import chunks, components, sent_whole, table, written

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE, BLOCK = 8192, 256
TILES = 1024
MOST = 1 << 20  # fingerprints in a tile, whatever the size of the corpus


def _shingle_hashes(raw: bytes, width: int) -> list[int]:
    words = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Majority of each bit over the hashes of each document (`ends`: where its hashes end)."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.zeros((len(ends), 64), np.int64)
    full = ends > starts
    if full.any():
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
    majority = counts * 2 > (ends - starts)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "raw", 1 << 20):
            hashes, ends = [], []
            for raw in batch.column(1).to_pylist():
                hashes += _shingle_hashes(raw or b"", width)
                ends.append(len(hashes))
            prints = fingerprint(np.array(hashes, np.uint64), np.array(ends))
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each row's word shingles; no words give 0."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    return docs.mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j; labels are roots, and the smaller root stays."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view("<u2").reshape(-1, 4)).astype(np.int16)


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """A tile as one row: its fingerprints and representatives as bytes."""
    fp, rep = (rows.column(x).to_numpy().astype("<i8").tobytes() for x in ("fp", "rep"))
    return pa.table({"t": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([key[1].as_py()], pa.int32()), "fp": pa.array([fp], pa.binary()), "rep": pa.array([rep], pa.binary())})


def _compare(radius: int):
    """A pair of tiles (one row if a tile meets itself): forest edges (a, b) between representatives."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        fp, rep = (np.frombuffer(b"".join(rows.column(x).to_pylist()), "<i8") for x in ("fp", "rep"))
        side = np.repeat(np.arange(rows.num_rows), [len(x) // 8 for x in rows.column("fp").to_pylist()])
        fp = fp.view(np.uint64)
        quarter = _quarters(np.ascontiguousarray(fp))
        order = np.lexsort((*quarter.T, side))
        fp, rep, side, quarter = fp[order], rep[order], side[order], quarter[order]
        by_rep = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[by_rep] = np.arange(len(rep))
        label = np.arange(len(rep))  # in the order of representatives, so that the root is the least one
        split = int(np.searchsorted(side, 1))
        cut = lambda a, z: [(x, min(x + BLOCK, z)) for x in range(a, z, BLOCK)]
        left = cut(0, split)
        right = cut(split, len(fp)) or left
        box = {x: (quarter[x[0] : x[1]].min(axis=0), quarter[x[0] : x[1]].max(axis=0)) for x in {*left, *right}}
        low, high = (np.array([box[x][k] for x in right]) for k in (0, 1))
        for x in left:
            gap = np.maximum(0, np.maximum(low - box[x][1], box[x][0] - high)).sum(axis=1)
            for k in np.flatnonzero(gap <= radius).tolist():
                y = right[k]
                if right is left and y < x:
                    continue
                near = np.bitwise_count(fp[x[0] : x[1], None] ^ fp[None, y[0] : y[1]]) <= radius
                i, j = np.nonzero(near)
                i, j = place[i + x[0]], place[j + y[0]]
                if len(i) > len(np.unique(i)) or x != y:
                    _merge(label, i, j)
        root = np.flatnonzero(label != np.arange(len(label)))
        ranked = rep[by_rep]
        return pa.table({"a": pa.array(ranked[root], pa.int64()), "b": pa.array(ranked[label[root]], pa.int64())})

    return run


def boxes(points: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """A tile's number for each point: points are halved along their widest side until a tile weighs `size` at most, or is one point."""
    tile, number, todo = np.zeros(len(points), np.int64), 0, [np.arange(len(points))] if len(points) else []
    while todo:
        part = todo.pop()
        reach = points[part].max(axis=0) - points[part].min(axis=0)
        if weight[part].sum() <= size or not reach.any():
            tile[part] = number
            number += 1
            continue
        side = points[part, reach.argmax()]
        order = np.argsort(side, kind="stable")
        upto = np.cumsum(weight[part[order]])
        cut = side[order[np.searchsorted(upto, upto[-1] / 2)]]
        low = side <= cut if (side > cut).any() else side < cut
        todo += [part[low], part[~low]]
    return tile


def tile_plan(spark: SparkSession, counts: DataFrame, by: list[str], reach: int, size: int, tiles: int = TILES) -> tuple[DataFrame, DataFrame]:
    """((*by, t, slots), (t, near)) from (*by, count): each point's tile and how many slots that has, and the tiles within `reach`.

    `by` are small whole numbers, so there is a bounded number of points; about `tiles` tiles at most weigh over half of `size`, until tiles of MOST are more than that.
    """
    rows = [tuple(r) for r in counts.collect()]
    points, weight = np.array([r[:-1] for r in rows], np.int64).reshape(len(rows), len(by)), np.array([r[-1] for r in rows], np.int64)
    size = max(size, min(int(weight.sum()) // tiles, MOST))
    tile = boxes(points, weight, size)
    n = int(tile.max()) + 1 if len(tile) else 0
    low, high = np.full((n, len(by)), 1 << 30), np.full((n, len(by)), -1)
    np.minimum.at(low, tile, points)
    np.maximum.at(high, tile, points)
    slots = -(-np.bincount(tile, weight, n).astype(np.int64) // size)
    near = []
    for t in range(n):
        gap = np.maximum(0, np.maximum(low - high[t], low[t] - high)).sum(axis=1)
        near.append((t, [(int(j), int(slots[j])) for j in np.flatnonzero(gap <= reach)]))
    cells = [(*map(int, p), int(t), int(slots[t])) for p, t in zip(points, tile, strict=True)]
    whole = ", ".join(f"{c} int" for c in by)
    return spark.createDataFrame(cells, f"{whole}, t int, slots int"), spark.createDataFrame(near, "t int, near array<struct<j int, k int>>")


def tile_pairs(packed: DataFrame, near: DataFrame, *columns: str) -> DataFrame:
    """(*columns, x, y): each packed tile (t, s, *columns) once for each pair of slots that it takes part in."""
    met = packed.join(sent_whole(near), "t").select("t", "s", *columns, F.explode("near").alias("p"))
    met = met.select("t", "s", *columns, "p.j", F.explode(F.sequence(F.lit(0), F.col("p.k") - 1)).alias("v"))
    own, other = F.struct("t", "s"), F.struct(F.col("j").alias("t"), F.col("v").alias("s"))
    return met.select(*columns, F.least(own, other).alias("x"), F.greatest(own, other).alias("y"))


def links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Forest edges (a, b) of representatives whose distinct fingerprints (fp, rep) differ in at most `radius` bits."""
    by = [f"q{i}" for i in range(4)]
    celled = reps.withColumns({q: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i, q in enumerate(by)})
    cells, near = tile_plan(reps.sparkSession, celled.groupBy(*by).count(), by, radius, tile)  # at most 17**4 cells
    slot = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
    dealt = celled.join(F.broadcast(cells), by).select("fp", "rep", "t", slot.alias("s"))  # bounded, as above
    packed = written(dealt.groupBy("t", "s").applyInArrow(_tile, "t int, s int, fp binary, rep binary"), "none")
    return tile_pairs(packed, near, "fp", "rep").groupBy("x", "y").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of df; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other.  Rows are copies if they are repeated, also under one id.
    Rows with a null id take part: they join fingerprints, and their component is null only if no row with an id is
    in it.  Long texts are read whole, other columns are not looked at, and an empty table gives no rows.
    """
    prints = written(fingerprints(df, id_col, text_col, width))
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    found = components(links(reps.select("fp", "rep"), radius)).withColumnRenamed("id", "rep")
    classes = written(reps.join(found, "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("c")))
    least = written(classes.groupBy("c").agg(F.min("least").alias("component_id")))  # a table, so that the join can split hot components
    return prints.join(classes.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole texts of `documents` and their components at 4 or fewer differing bits (see near_duplicates)."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
