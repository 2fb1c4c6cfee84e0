"""Removal of repeated passages by suffix order and longest previous factors.

The corpus is cut into window starts: position p stands for the suffix that begins there,
truncated to `min_len` bytes.  Its longest previous factor is the longest match that starts
earlier; in suffix order that match is with the previous or the next entry of smaller
position.  With `keep_first`, p is repeated if that factor reaches `min_len`; without it, a
match that starts later (the same array over reversed places) counts as well.

1. Anchors (suffix_anchors) gather window starts in runs.  Equal windows lie in runs of an
   equal anchor, so runs whose anchor is unique are out at once.
2. Runs with all bytes equal are one entry of the order: its later members' previous factors
   cover them.  The first of each goes on if its anchor has runs of other bytes too.
3. Runs of one anchor meet in one task, which puts their suffixes in order (prefix doubling),
   takes the common prefixes of neighbours, and the arrays above.
4. An anchor with more than LIMIT different runs (a passage that a great part of all
   documents hold) would be too much for a task.  Its runs are cut into slices at fixed distances from
   the anchor; equal windows lie in slices with an equal core (the bytes that all windows of
   a slice share), so steps 2 and 3 apply to slices, by core.  Where a core has more
   than LIMIT different slices in turn, its windows are counted one by one under a 128-bit key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import chunks, discard, table, written
from quern.llm.suffix_anchors import BLOCK, KGRAM, runs_of

MIN_LEN = 200
SLICE = 8
LIMIT = 256  # different runs of an anchor, or slices of a core, that one task orders


# --- suffix order and longest previous factors in one task --------------------------------


class SuffixRanks:
    """Ranks of the positions of `data` by their first 1, 2, 4, ... bytes (prefix doubling), up to `depth`."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n, whole = len(data), np.zeros(len(data), np.uint64)
        self.levels: list[tuple[int, np.ndarray]] = []
        for i in range(8):
            whole = (whole << np.uint64(8)) | padded[i : i + n]
            if i in (0, 1, 3):
                self.levels.append((i + 1, whole))
        self.levels.append((8, self._dense(whole)))
        while 2 * self.levels[-1][0] <= depth:
            d, rank = self.levels[-1]
            self.levels.append((2 * d, self._dense(self._joined(rank, d))))

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].astype(np.uint32)

    @staticmethod
    def _joined(rank: np.ndarray, d: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Keys of twice the depth; beyond the end stands a rank below all others."""
        after = np.concatenate([rank[d:].astype(np.uint64) + np.uint64(1), np.zeros(min(d, len(rank)), np.uint64)])
        first = rank.astype(np.uint64)
        if starts is not None:
            first, after = first[starts], after[starts]
        return (first << np.uint64(32)) | after

    def keys(self, starts: np.ndarray) -> np.ndarray:
        """Keys of `depth` bytes: they order the suffixes and are equal where those are."""
        d, rank = self.levels[-1]
        return self._joined(rank, self.depth - d, starts) if d < self.depth else rank[starts].astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b, up to `depth`."""
        length, n = np.zeros(len(a), np.int64), len(self.data)
        for d, rank in reversed(self.levels):
            p, q = a + length, b + length
            equal = (p < n) & (q < n) & (rank[np.minimum(p, n - 1)] == rank[np.minimum(q, n - 1)])
            length += d * equal
        return np.minimum(length, self.depth)


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For entries in suffix order: the common prefix with the nearest entry before that has a smaller place, 0 if none.

    common[i] is that of entries i-1 and i.  Every entry jumps back over larger places, taking over the jumps that
    those have made, and carries the least common prefix on its way.
    """
    jump, least = np.arange(len(place)) - 1, common.copy()
    going = np.flatnonzero((jump >= 0) & (place[jump] > place))
    while len(going):
        over = jump[going]
        further, lower = jump[over], np.minimum(least[going], least[over])
        jump[going], least[going] = further, lower
        going = going[(further >= 0) & (place[further] > place[going])]
    return np.where(jump >= 0, least, 0)


def longest_previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each entry in suffix order, from both neighbours of smaller place."""
    if not len(place):
        return np.zeros(0, np.int64)
    after = np.append(common[1:], 0)[::-1]
    return np.maximum(previous_factors(place, common), previous_factors(place[::-1], after)[::-1])


def longest_previous_factor(data: np.ndarray) -> np.ndarray:
    """For each position of `data`, the length of the longest match that starts earlier."""
    out = np.zeros(len(data), np.int64)
    if len(data):
        ranks, starts = SuffixRanks(data, 1 << max(3, int(len(data)).bit_length())), np.arange(len(data))
        order = np.argsort(ranks.keys(starts), kind="stable")
        common = np.zeros(len(data), np.int64)
        common[1:] = [_match(data, int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)]
        out[order] = longest_previous_factors(order, common)
    return out


def _match(data: np.ndarray, a: int, b: int) -> int:
    n = len(data) - max(a, b)
    unequal = np.flatnonzero(data[a : a + n] != data[b : b + n])
    return int(unequal[0]) if len(unequal) else n


# --- 1: runs of windows with an anchor ---------------------------------------------------

_PLACE = "id long, row long, s long"
_RUNS = f"{_PLACE}, n int, a int, k long, h long"


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _hashes(raw: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, len(first))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed: they are stored, read three times and shuffled twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in chunks(batches, "raw", BLOCK):
        yield pa.record_batch([*batch.columns[:2], pa.array([None if x is None else pack(x) for x in batch.column(2).to_pylist()], pa.binary())], ["id", "row", "z"])


def _runs(min_len: int):
    def blocks(batch: pa.RecordBatch):
        """(ids, rows, first positions, bytes) of about BLOCK bytes; long texts in pieces that overlap."""
        unzip = zstandard.ZstdDecompressor().decompress
        keys, starts, parts, size = [], [], [], 0
        for i, row, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = unzip(z) if z else b""
            for at in range(0, len(raw) - min_len + 1, BLOCK):
                piece = raw[at : at + BLOCK + min_len - 1]
                if size + len(piece) > BLOCK and parts:
                    yield keys, starts, parts
                    keys, starts, parts, size = [], [], [], 0
                keys.append((NO_ID if i is None else i, row)), starts.append(at), parts.append(piece)
                size += len(piece)
        if parts:
            yield keys, starts, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "z", BLOCK // 4):
            for keys, starts, parts in blocks(batch):
                raw = b"".join(parts)
                offsets = np.cumsum([0, *map(len, parts)])
                doc, first, last, at, anchor = runs_of(np.frombuffer(raw, np.uint8), offsets, min_len)
                s = first - offsets[doc] + np.array(starts, np.int64)[doc]
                key = np.array(keys, np.int64)[doc]
                columns = [key[:, 0], key[:, 1], s, (last - first + 1).astype(np.int32), (at - first).astype(np.int32), anchor]
                yield pa.record_batch([*(pa.array(np.ascontiguousarray(x)) for x in columns), _signed(_hashes(raw, first, last + min_len))], ["id", "row", "s", "n", "a", "k", "h"])

    return run


#: Rows without an id come after all others.
NO_ID = (1 << 63) - 1


# --- 2: classes of equal runs (or slices) --------------------------------------------------


def _known(rows: DataFrame, *more: str) -> DataFrame:
    """The rows (id, row, s, n, k, h, w) whose k recurs, as a table; w is the number of equal rows that a row stands for.

    `same`: the whole (k, h) recurs; `first`: no equal row begins earlier; `kinds`: the different h of k.
    """
    often = written(rows.groupBy("k").agg(F.sum("w").alias("c")).where("c > 1").select("k"))
    some = written(rows.join(often, "k"))
    equal = some.groupBy("k", "h").agg(F.sum("w").alias("c"), F.min(F.struct("id", "row", "s")).alias("m"))
    kinds = written(equal.groupBy("k").agg(F.count("*").alias("kinds")))
    equal = written(equal.join(kinds, "k").where("c > 1 or kinds > 1"))
    first = (F.col("m.row") == F.col("row")) & (F.col("m.s") == F.col("s"))
    known = some.join(equal, ["k", "h"]).select("id", "row", "s", "n", "k", "h", *more, (F.col("c") > 1).alias("same"), first.alias("first"), "kinds")
    out = written(known)
    discard(often, some, kinds, equal)
    return out


def _met(columns: list[list]) -> pa.RecordBatch:
    """Rows (id, row, s, n, k, h, r) of one block, with w: the first of equal ones stands for all with their number.

    The others are repeated whatever else there is; they keep w = 0, and those that follow each other in a run become one row.
    """
    i, row, s, n, k, h, r = (np.array(c, np.uint64 if at in (4, 5) else np.int64) for at, c in enumerate(columns))
    order = np.lexsort((s, row, i, h, k))
    opens = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (k[order[1:]] != k[order[:-1]]) | (h[order[1:]] != h[order[:-1]])]))
    w = np.zeros(len(order), np.int64)
    w[order[opens]] = np.diff(np.append(opens, len(order)))
    goes_on = np.zeros(len(order), bool)
    goes_on[1:] = (w[1:] == 0) & (w[:-1] == 0) & (row[1:] == row[:-1]) & (r[1:] == r[:-1]) & (s[1:] == s[:-1] + n[:-1])
    heads = np.flatnonzero(~goes_on)
    n = np.add.reduceat(n, heads) if len(heads) else n
    kept = [pa.array(x[heads]) for x in (i, row, s)] + [pa.array(n.astype(np.int32))] + [_signed(x[heads]) for x in (k, h)] + [pa.array(x[heads]) for x in (r, w)]
    return pa.record_batch(kept, ["id", "row", "s", "n", "k", "h", "r", "w"])


# --- 3 and 4: pieces that one task orders, slices and windows --------------------------------


def _segments(min_len: int):
    """From (id, row, z, runs): the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in chunks(batches, "z", BLOCK // 4):
            out: list[tuple] = []
            for i, row, z, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unzip(z)
                out += [(NO_ID if i is None else i, row, r["s"], r["n"], r["a"], r["k"], r["hot"], raw[r["s"] : r["s"] + r["n"] + min_len - 1]) for r in runs]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["id", "row", "s", "n", "a", "k", "hot", "b"])

    return run


def _slices(min_len: int, width: int):
    """From (id, row, s, n, a, k, b): slices (id, row, s, n, k, h, r, w), r the run's start."""
    digest, all_bits = xxhash.xxh3_64_intdigest, (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "b", BLOCK):
            ids, rows, starts, sizes, keys, wholes, origin = [], [], [], [], [], [], []
            for i, row, s, n, anchor, k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = 0
                while a < n:
                    j = (anchor - a) // width  # windows at distances j*width to j*width+width-1 before the anchor
                    top = anchor - j * width - width + 1  # the first of them, maybe before the run
                    z = min(n, top + width)
                    ids.append(i), rows.append(row), starts.append(s + a), sizes.append(z - a), origin.append(s)
                    keys.append(digest(b[top + width - 1 : top + min_len], (k ^ j * 0x9E3779B97F4A7C15) & all_bits))
                    wholes.append(digest(b[a : z + min_len - 1], a - top))
                    a = z
            yield _met([ids, rows, starts, sizes, keys, wholes, origin])

    return run


def _windows(min_len: int):
    """From (id, row, s, n, b): each window with its 128-bit key, as (id, row, s, n, k, h, r, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in chunks(batches, "b", BLOCK // 4):
            out = [[] for _ in range(7)]
            for i, row, s, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p in range(n):
                    for column, x in zip(out, (i, row, s + p, 1, digest(b[p : p + min_len]), digest(b[p : p + min_len], 1), s), strict=True):
                        column.append(x)
            yield _met(out)

    return run


def ordered_repeats(pieces: list[tuple], min_len: int, keep_first: bool) -> list[tuple[int, int, int]]:
    """(row, s, n): runs of repeated window starts in pieces (id, row, s, n, bytes), by the suffix order of all of them."""
    sizes = np.array([p[3] for p in pieces])
    offsets = np.cumsum([0, *(len(p[4]) for p in pieces[:-1])])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = offsets[piece] + inner
    ids, rows, firsts = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
    place = np.empty(len(piece), np.int64)
    place[np.lexsort((firsts[piece] + inner, rows[piece], ids[piece]))] = np.arange(len(piece))
    ranks = SuffixRanks(np.frombuffer(b"".join(p[4] for p in pieces), np.uint8), min_len)
    order = np.lexsort((place, ranks.keys(start)))
    in_order, common = start[order], np.zeros(len(order), np.int64)
    common[1:] = ranks.common(in_order[:-1], in_order[1:])
    factor = longest_previous_factors(place[order], common)
    if not keep_first:
        factor = np.maximum(factor, longest_previous_factors(-place[order], common))
    repeated = np.zeros(len(order) + 1, bool)
    repeated[order] = factor >= min_len
    border = np.concatenate([[True], piece[1:] != piece[:-1], [True]])
    goes_on = np.concatenate([[False], repeated[:-1]]) & ~border
    opens = np.flatnonzero(repeated & ~goes_on)
    ends = np.flatnonzero(repeated[:-1] & ~(repeated[1:] & ~border[1:])) + 1
    return [(int(rows[piece[a]]), int(firsts[piece[a]] + inner[a]), int(z - a)) for a, z in zip(opens.tolist(), ends.tolist(), strict=True)]


def _factors(min_len: int, keep_first: bool):
    """From pieces (k, id, row, s, n, b) sorted by k: repeated runs, all pieces of a k in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def found() -> pa.RecordBatch:
            columns = list(zip(*ordered_repeats(held, min_len, keep_first), strict=True)) if held else []
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns or [()] * 3, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["row", "s", "n"])

        for batch in batches:
            for k, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != last and size > BLOCK // 4:
                    yield found()
                    size = 0
                held.append(tuple(piece))
                size, last = size + len(piece[4]), k
        yield found()

    return run


# --- the operator ------------------------------------------------------------------------


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, z): a key for each row, written once with the compressed text."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    return written(docs.mapInArrow(_zipped, "id long, row long, z binary"), "none")


def repeated_spans(keyed: DataFrame, min_len: int = MIN_LEN, keep_first: bool = False, limit: int = LIMIT) -> DataFrame:
    """(row, spans): runs (s, n) of window starts in the text's UTF-8 bytes that are repeated."""
    if min_len <= KGRAM:
        raise ValueError(f"min_len must be above {KGRAM}")
    removed = F.col("same") & ~F.col("first") if keep_first else F.col("same")
    unlike, hot = F.col("first") & (F.col("kinds") > 1), F.col("kinds") > limit
    span = ("row", "s", "n")

    runs = written(keyed.mapInArrow(_runs(min_len), _RUNS))
    known = _known(runs.withColumn("w", F.lit(1)), "a")
    discard(runs)
    asked = known.where(unlike).groupBy("row").agg(F.collect_list(F.struct("s", "n", "a", "k", hot.alias("hot"))).alias("runs"))
    segments = written(keyed.join(asked, "row").select("id", "row", "z", "runs").mapInArrow(_segments(min_len), f"{_PLACE}, n int, a int, k long, hot boolean, b binary"))
    pieces = segments.where(~F.col("hot")).select("k", "id", "row", "s", "n", "b")
    found = [known.where(removed).select(*span)]

    if segments.where("hot").limit(1).count():
        keyed_piece = f"{_PLACE}, n int, k long, h long, r long, w long"
        whole = segments.where("hot").select("id", "row", "s", "n", "a", "k", "b")
        sliced = written(whole.mapInArrow(_slices(min_len, SLICE), keyed_piece))
        slices = _known(sliced.where("w > 0"), "r")
        at = F.expr(f"substring(b, cast(s - r + 1 as int), n + {min_len - 1})")
        cut = slices.where(unlike).join(whole.select("row", F.col("s").alias("r"), "b"), ["row", "r"]).select("k", "id", "row", "s", "n", at.alias("b"), hot.alias("hot"))
        pieces = pieces.union(cut.where(~F.col("hot")).drop("hot"))
        single = written(cut.where("hot").select("id", "row", "s", "n", "b").mapInArrow(_windows(min_len), keyed_piece))
        windows = _known(single.where("w > 0"))
        found += [sliced.where("w = 0").select(*span), slices.where(removed).select(*span), single.where("w = 0").select(*span), windows.where(removed).select(*span)]

    ordered = pieces.repartition("k").sortWithinPartitions("k").mapInArrow(_factors(min_len, keep_first), "row long, s long, n int")
    found.append(written(ordered))
    discard(segments)
    spans = found[0]
    for f in found[1:]:
        spans = spans.union(f)
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("spans"))


def _cut(min_len: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in chunks(batches, "z", BLOCK // 4):
            out: list[tuple] = []
            for i, z, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unzip(z) if z else b""
                kept, at, n_spans, removed = [], 0, 0, 0
                end = -1
                for span in spans or ():
                    a, b = span["s"], min(len(raw), span["s"] + span["n"] - 1 + min_len)
                    if a > end:  # else it touches the span before
                        kept.append(raw[at:a])
                        n_spans += 1
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    at = end = max(b, end)
                kept.append(raw[max(at, 0) :])
                left = b"".join(kept)
                out.append((i, len(raw), removed, n_spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, keep_first: bool = True, keep_text: bool = True, limit: int = LIMIT) -> DataFrame:
    """One row for each row of df: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text).

    Bytes under a repeated window go; with `keep_first` the earliest copy (by id, then place) stays.

    Null texts count as empty, and texts below `min_len` lose nothing.  Rows are told apart by a key of their own:
    rows without an id take part (as the last), and so do different texts under one id; repeated rows are copies
    of each other.  Long texts are read in overlapping blocks.  An empty table gives no rows; other columns are not
    looked at.  kept_text is null unless asked for, and its bytes that no longer form a character become
    U+FFFD (the digest is over the bytes).
    """
    keyed = _keyed(df, id_col, text_col)
    spans = repeated_spans(keyed, min_len, keep_first, limit)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return keyed.join(spans, "row", "left").select("id", "z", "spans").mapInArrow(_cut(min_len, keep_text), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bytes under 200-byte strings that start anywhere else too are removed from `documents`, whole texts.

    Null texts count as empty; rows without an id and repeated ids are judged like any other (see remove_repeats).
    """
    return remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, keep_text=False).drop("kept_text")
