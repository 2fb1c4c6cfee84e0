"""How much of a graph lies within so many hops of each of many roots, without rows for what is reached."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.hops import inside, kind_of, numbered
from quern.operators.ranking import sent_whole
from quern.sources.scratch import written

WORDS = 8  # of 64 roots, a block's
EDGES = 16_000_000  # of a part of the graph, about
RANGE = 128  # joints that share a row
PIECE = 1 << 16  # bytes of an array that share a row
ROWS = 1 << 14  # of bits that are handled at once
_PACKED = "bucket int, block long, depth int, part long, payload binary"
_FOUND = "what string, depth int, block long, part long, kind string, payload binary"
#: Arrays of a part of the graph, by number.
_JOINTS, _SIZES, _TARGETS, _BETWEEN, _KINDS, _NAMES, _ROOTS, _DEGREES = range(8)


def _row(payload: bytes, **columns) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array([v], pa.string() if isinstance(v, str) else pa.int32() if c in ("bucket", "depth") else pa.int64()) for c, v in columns.items()), pa.array([payload], pa.binary())], [*columns, "payload"])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows with the same keys, which lie together, as (keys, batches)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            key = tuple(values[low].tolist())
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield last, held


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From parts' edges and roots (bucket, src, a, t), a being -1 for a leaf and t -1 - 512 block - place for a root: their arrays, in pieces.

    Targets of a leaf lie together.  Joints are numbered within the part.
    """
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    held.clear()
    buckets = rows.column("bucket").to_numpy()
    for bucket in np.unique(buckets).tolist():  # one, unless partitions were put together
        some = rows if (buckets == bucket).all() else rows.filter(pa.array(buckets == bucket))
        src = some.column("src").combine_chunks().dictionary_encode()
        leaf, names = src.indices.to_numpy(), src.dictionary
        a, t = some.column("a").to_numpy(), some.column("t").to_numpy()
        del some, src
        joints = np.unique(np.concatenate([a[a >= 0], t[t >= 0]]))
        between, own, rooted = (a >= 0) & (t >= 0), (a < 0) & (t >= 0), t < 0
        size = np.bincount(leaf[own], minlength=len(names))
        there = np.unique(leaf[own | rooted])
        new = np.full(len(names), -1, np.int32)
        new[there] = np.arange(len(there))
        kinds = pa.array([x.split(":", 1)[0] for x in names.take(pa.array(there)).to_pylist()], pa.string()).dictionary_encode()
        leaf = new[leaf]
        at = lambda ids: np.searchsorted(joints, ids).astype(np.int32)
        order = np.argsort(leaf[own], kind="stable")
        ends = np.stack([at(a[between]), at(t[between])], axis=1)
        other = ends[:, 0] != ends[:, 1]
        targets, root = at(t[own]), -1 - t[rooted]
        degrees = np.bincount(np.concatenate([targets, ends[other].ravel()]), minlength=len(joints))
        loops = np.bincount(ends[~other, 0], minlength=len(joints))
        arrays = {
            _JOINTS: joints,
            _SIZES: size[there].astype(np.int32),
            _TARGETS: targets[order],
            _BETWEEN: ends[other],
            _KINDS: kinds.indices.to_numpy(),
            _NAMES: np.frombuffer("\n".join(kinds.dictionary.to_pylist()).encode(), np.uint8),
            _ROOTS: np.stack([leaf[rooted], root >> 9, root & 511], axis=1).astype(np.int64),
            _DEGREES: np.stack([joints, degrees, loops], axis=1).astype(np.int64),
        }
        for what, values in arrays.items():
            whole, step = np.ascontiguousarray(values).tobytes(), PIECE - PIECE % 24
            for n, low in enumerate(range(0, len(whole), step)):
                yield _row(whole[low : low + step], bucket=bucket, block=-1, depth=what, part=n)


class _Adjacent:
    """Neighbours of rows, as ends in one array; `back` is the same seen from the neighbours."""

    def __init__(self, sizes: np.ndarray, others: np.ndarray):
        self.sizes, self.others = sizes, others
        self.starts = np.append(0, np.cumsum(sizes, dtype=np.int64))
        self.filled = np.flatnonzero(sizes)
        self.back: _Adjacent

    @classmethod
    def pair(cls, sizes: np.ndarray, others: np.ndarray, n: int) -> tuple[_Adjacent, _Adjacent]:
        one = cls(sizes, others)
        order = np.argsort(others, kind="stable")
        two = cls(np.bincount(others, minlength=n), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order])
        one.back, two.back = two, one
        return one, two

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) of the given rows."""
        sizes = self.sizes[rows]
        shift = np.repeat(self.starts[rows] - np.append(0, np.cumsum(sizes)[:-1]), sizes) if len(rows) else np.zeros(0, np.int64)
        return np.repeat(rows, sizes), self.others[np.arange(len(shift)) + shift]

    def union(self, bits: np.ndarray) -> np.ndarray:
        """For each row the union of its neighbours' bits."""
        out = np.zeros((len(self.sizes), WORDS), np.uint64)
        some = np.flatnonzero(bits.any(axis=1))
        m = int(self.back.sizes[some].sum())
        if not m:
            return out
        if 16 * m < len(self.others):  # few neighbours have any
            other, row = self.back.of(some)
            order = np.argsort(row, kind="stable")
            row, others = row[order], other[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            rows = row[starts]
        else:
            rows, starts, others = self.filled, self.starts[self.filled], self.others
            if 3 * m < len(others):
                has = np.zeros(len(bits), bool)
                has[some] = True
                kept = has[others]
                others, upto = others[kept], np.append(0, np.cumsum(kept))[np.append(starts, len(kept))]
                there = np.diff(upto) > 0
                rows, starts = rows[there], upto[:-1][there]
        held = np.empty((ROWS, WORDS), np.uint64)
        for low in range(0, len(others), ROWS):
            high = min(low + ROWS, len(others))
            part = held[: high - low]
            np.take(bits, others[low:high], axis=0, out=part, mode="clip")
            a, z = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high)
            out[rows[a:z]] |= np.bitwise_or.reduceat(part, np.maximum(starts[a:z], low) - low, axis=0)
        return out


def _sums(bits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each root (bit) the sums of the weights, one row each, of the rows that have it."""
    out = np.zeros((len(weights), 64 * WORDS), np.int64)
    for low in range(0, len(bits), ROWS):
        w = weights[:, low : low + ROWS]
        kind = np.float32 if w.sum(axis=1).max() < 2**24 else np.float64  # sums are whole numbers, exact below that
        one = np.unpackbits(bits[low : low + ROWS].view(np.uint8), axis=1, bitorder="little")
        out += (w.astype(kind) @ one.astype(kind)).astype(np.int64)
    return out


def _nodes(payloads: list[bytes], ranges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(joints, bits) of rows, each of which holds a byte for a joint's place in its range, then the joints' bits."""
    size = 1 + 8 * WORDS
    each = [len(p) // size for p in payloads]
    places = np.frombuffer(b"".join(p[:n] for p, n in zip(payloads, each, strict=True)), np.uint8)
    bits = np.frombuffer(b"".join(p[n:] for p, n in zip(payloads, each, strict=True)), "<u8").reshape(-1, WORDS)
    return np.repeat(np.array(ranges, np.int64) * RANGE, each) + places, bits


def _rows_of(joints: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, payload) of joints in order that have bits."""
    some = bits.any(axis=1)
    joints, bits = joints[some], bits[some]
    cuts = [*np.flatnonzero(np.diff(joints // RANGE, prepend=-1)).tolist(), len(joints)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield int(joints[low] // RANGE), (joints[low:high] % RANGE).astype(np.uint8).tobytes() + bits[low:high].tobytes()


class _Part:
    """A part of the graph, and one step of one block of roots on it."""

    def __init__(self, arrays: dict[int, bytes]):
        get = lambda what, kind: np.frombuffer(arrays.get(what, b""), kind)
        self.joints = get(_JOINTS, np.int64)
        sizes, targets = get(_SIZES, np.int32), get(_TARGETS, np.int32)
        self.leaves, self.ends = _Adjacent.pair(sizes.astype(np.int64), targets, len(self.joints))
        self.between = get(_BETWEEN, np.int32).reshape(-1, 2)
        both = np.concatenate([self.between, self.between[:, ::-1]])
        both = both[np.argsort(both[:, 0], kind="stable")]
        self.near, _ = _Adjacent.pair(np.bincount(both[:, 0], minlength=len(self.joints)), both[:, 1], len(self.joints))
        self.kinds, self.names = get(_KINDS, np.int32), arrays.get(_NAMES, b"").decode().split("\n")
        self.roots = get(_ROOTS, np.int64).reshape(-1, 3)

    def step(self, block: int, depth: int, k: int, rows: dict[int, tuple[list[bytes], list[int]]]) -> Iterator[pa.RecordBatch]:
        found = {}
        for d, (payloads, ranges) in rows.items():
            joints, bits = _nodes(payloads, ranges)
            at = np.minimum(np.searchsorted(self.joints, joints), max(0, len(self.joints) - 1))
            here = self.joints[at] == joints if len(self.joints) else np.zeros(len(joints), bool)
            found[d] = np.zeros((len(self.joints), WORDS), np.uint64)
            found[d][at[here]] = bits[here]
        none = np.zeros((len(self.joints), WORDS), np.uint64)
        now = found.get(depth, none)
        root = np.zeros((len(self.leaves.sizes), WORDS), np.uint64)
        mine = self.roots[self.roots[:, 1] == block]
        np.bitwise_or.at(root, (mine[:, 0], mine[:, 2] // 64), np.uint64(1) << (mine[:, 2] % 64).astype(np.uint64))
        out = lambda what, d, part, kind, payload: _row_found(what, d, block, part, kind, payload)
        if depth < k:
            seen = root.copy()
            if earlier := [b for d, b in found.items() if d < depth]:
                seen |= self.leaves.union(np.bitwise_or.reduce(earlier))
            steps = ([(0, root)] if depth == 0 else []) + [(depth + 1, self.leaves.union(now) & ~seen)]
            near: dict[int, np.ndarray] = {depth + 1: self.near.union(now)}
            for d, leaf in steps:
                some = np.flatnonzero(leaf.any(axis=1))
                for kind in np.unique(self.kinds[some]):
                    of = some[self.kinds[some] == kind]
                    yield out("tally", d, -1, self.names[kind], _sums(leaf[of], np.stack([np.ones(len(of), np.int64), self.leaves.sizes[of]])).tobytes())
                if d < k and len(some):
                    near[d + 1] = near.get(d + 1, none) | self.ends.union(leaf)
            for d, bits in near.items():
                for part, payload in _rows_of(self.joints, bits):
                    yield out("near", d, part, "", payload)
        # edges between nodes of this depth
        level = np.zeros((1, 64 * WORDS), np.int64)
        some = np.flatnonzero(now.any(axis=1))
        if self.ends.sizes[some].sum():
            leaf = root if depth == 0 else self.leaves.union(found.get(depth - 1, none)) & ~root
            if depth > 1 and leaf.any() and (earlier := [b for d, b in found.items() if d < depth - 1]):
                leaf &= ~self.leaves.union(np.bitwise_or.reduce(earlier))
            if leaf.any():
                level += _alike(self.ends, some, now, leaf)
        if self.near.sizes[some].sum():
            level += _alike(self.near, some, now, now) // 2  # these edges are there from both ends
        if level.any():
            yield out("level", depth, -1, "", level.tobytes())


def _alike(edges: _Adjacent, rows: np.ndarray, bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each root the edges of the given rows whose two ends have its bit."""
    out = np.zeros((1, 64 * WORDS), np.int64)
    for low in range(0, len(rows), ROWS):
        row, other = edges.of(rows[low : low + ROWS])
        for x in range(0, len(row), ROWS):
            shared = bits[row[x : x + ROWS]] & others[other[x : x + ROWS]]
            shared = shared[shared.any(axis=1)]
            out += _sums(shared, np.ones((1, len(shared)), np.int64)) if len(shared) else 0
    return out


def _row_found(what: str, depth: int, block: int, part: int, kind: str, payload: bytes) -> pa.RecordBatch:
    return _row(payload, what=what, depth=depth, block=block, part=part, kind=kind)


def _stepped(depth: int, k: int):
    """For parts of the graph and, by block, the joints found at each depth so far: what the next step finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = None, None
        for (bucket, block), held in _runs(batches, ("bucket", "block")):
            if block < 0:
                pieces: dict[int, list[tuple[int, bytes]]] = {}
                for b in held:
                    for what, n, payload in zip(*(b.column(c).to_pylist() for c in ("depth", "part", "payload")), strict=True):
                        pieces.setdefault(what, []).append((n, payload))
                part, of = _Part({what: b"".join(p for _, p in sorted(ps)) for what, ps in pieces.items()}), bucket
            elif of == bucket:  # a part without edges and roots has no rows
                rows: dict[int, tuple[list, list]] = {}
                for b in held:
                    for d, n, payload in zip(*(b.column(c).to_pylist() for c in ("depth", "part", "payload")), strict=True):
                        payloads, ranges = rows.setdefault(d, ([], []))
                        payloads.append(payload), ranges.append(n)
                yield from part.step(block, depth, k, rows)
            held.clear()

    return run


def _merged(depth: int):
    """From rows (depth, block, part, payload) of joints: what is new at this depth, a row for each block and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, part), held in _runs(batches, ("block", "part")):
            new, seen = np.zeros((2, RANGE, WORDS), np.uint64)
            for b in held:
                for d, payload in zip(b.column("depth").to_pylist(), b.column("payload").to_pylist(), strict=True):
                    n = len(payload) // (1 + 8 * WORDS)
                    (new if d == depth else seen)[np.frombuffer(payload, np.uint8, n)] |= np.frombuffer(payload, "<u8", n * WORDS, n).reshape(n, WORDS)
            held.clear()
            for _, payload in _rows_of(np.arange(RANGE), new & ~seen):
                yield _row(payload, depth=depth, block=block, part=part)

    return run


def _merge(rows: DataFrame, depth: int) -> DataFrame:
    dealt = rows.select("depth", "block", "part", "payload").repartition("block", "part").sortWithinPartitions("block", "part")
    return written(dealt.mapInArrow(_merged(depth), "depth int, block long, part long, payload binary"))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one joint from roots (block, id, place) that are joints."""
    for batch in batches:
        block, number, place = (batch.column(c).to_numpy() for c in ("block", "id", "place"))
        bits = np.zeros((len(place), WORDS), np.uint64)
        bits[np.arange(len(place)), place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
        payload = [bytes([x % RANGE]) + b.tobytes() for x, b in zip(number.tolist(), bits, strict=True)]
        yield pa.record_batch([pa.array(np.zeros(len(block)), pa.int32()), pa.array(block), pa.array(number // RANGE), pa.array(payload, pa.binary())], ["depth", "block", "part", "payload"])


def _placed(depth: int, block: int, kind: str, sums: np.ndarray) -> pa.RecordBatch:
    """Rows (depth, block, kind, place, nodes, degree, loops) of sums by root."""
    places = np.flatnonzero(sums[0])
    n = len(places)
    return pa.record_batch(
        [pa.array([depth] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.string()), pa.array(places, pa.int32()), *(pa.array(s[places], pa.int64()) for s in sums)],
        ["depth", "block", "kind", "place", "nodes", "degree", "loops"],
    )


_PLACED = "depth int, block long, kind string, place int, nodes long, degree long, loops long"


def _joint_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From joints (depth, block, payload, about) in the order of depth and block: sums by root and kind."""
    for (depth, block), held in _runs(batches, ("depth", "block")):
        total: dict[str, np.ndarray] = {}
        for b in held:
            for payload, about in zip(b.column("payload").to_pylist(), b.column("about").to_pylist(), strict=True):
                n = len(payload) // (1 + 8 * WORDS)
                bits = np.frombuffer(payload, "<u8", n * WORDS, n).reshape(n, WORDS)
                known = {x["place"]: x for x in about}
                of = [known[p] for p in payload[:n]]
                for kind in {x["kind"] for x in of}:
                    some = [i for i, x in enumerate(of) if x["kind"] == kind]
                    weights = np.array([[1, of[i]["degree"], of[i]["loops"]] for i in some], np.int64).T
                    total[kind] = total.get(kind, 0) + _sums(bits[some], weights)
        held.clear()
        for kind, sums in total.items():
            yield _placed(depth, block, kind, sums)


def _leaf_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by root of the sums that steps gave: of leaves, nodes and degrees; of levels, edges."""
    for batch in batches:
        for depth, block, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("depth", "block", "kind", "payload")), strict=True):
            sums = np.frombuffer(payload, np.int64).reshape(-1, 64 * WORDS)
            yield _placed(depth, block, kind, np.concatenate([sums, np.zeros((3 - len(sums), 64 * WORDS), np.int64)]))


def _degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            yield pa.record_batch([pa.array(c) for c in np.frombuffer(payload, np.int64).reshape(-1, 3).T], ["id", "degree", "loops"])


def hop_counts(edges: DataFrame, roots: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, inside) of roots (root) over edges (src, dst), either way: (root, depth, kind, nodes), how many nodes of a kind (a name up to the colon) are just so
    many hops away, and (root, k, edges), for each depth from 1 to k how many edges lie between the nodes within so many hops.

    Nodes that some edge leads to are joints, the others leaves, whose edges all lead to joints.  Edges are dealt to parts by their source and stored as arrays; a
    part knows all edges of its leaves.  A step takes the joints that the last one found to all parts, as bits of 512 roots at a time; there a leaf is the union of its joints, is
    summed up, and gives its bits to its joints for the step after.  So only joints travel and are stored, parts x joints x blocks of roots at most; bits of leaves are never
    written.  A task holds a part's edges and a block's bits (64 bytes) of its leaves and joints.  Work is edges x blocks of roots.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    cores = spark.sparkContext.defaultParallelism
    buckets = cores * max(1, -(-edges.count() // (EDGES * cores)))
    numbers = numbered(roots)

    ends = written(edges.select(F.col("dst").alias("node")).distinct())
    groups = max(1, ends.count() // 20_000)
    group = F.pmod(F.hash("node"), F.lit(groups))
    ids = F.shiftleft(F.col("group").cast("long"), 32) + F.expr("row_number() over (partition by group order by node)") - 1
    joints = written(ends.withColumn("group", group).select("node", ids.alias("id")))

    known = sent_whole(joints, 1_000_000)
    none = F.lit(-1).cast("long")
    e = edges.join(known.toDF("dst", "t"), "dst").join(known.toDF("src", "a"), "src", "left").select("src", F.coalesce("a", none).alias("a"), "t")
    placed = written(numbers.join(known.toDF("root", "id"), "root", "left"))
    alone = placed.where("id is null").select(F.col("root").alias("src"), none.alias("a"), (-1 - F.col("block") * 512 - F.col("place")).alias("t"))
    dealt = e.union(alone).select(F.pmod(F.xxhash64("src"), F.lit(buckets)).cast("int").alias("bucket"), "src", "a", "t")
    packed = written(dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_pack, _PACKED))
    degrees = packed.where(F.col("depth") == _DEGREES).mapInArrow(_degrees, "id long, degree long, loops long").groupBy("id").agg(F.sum("degree").alias("degree"), F.sum("loops").alias("loops"))
    about = joints.join(degrees, "id").withColumn("part", F.floor(F.col("id") / RANGE)).withColumn("place", F.col("id") % RANGE)
    about = written(about.groupBy("part").agg(F.collect_list(F.struct("place", kind_of("node").alias("kind"), "degree", "loops")).alias("about")))  # RANGE at most
    graph = packed.where(F.col("depth") != _DEGREES)

    first = _merge(placed.where("id is not null").select("block", "id", "place").mapInArrow(_single, "depth int, block long, part long, payload binary"), 0)
    blocks = numbers.select(F.lit(0).alias("depth"), "block", F.lit(0).cast("long").alias("part"), F.lit(b"").alias("payload")).distinct()
    layers, found = [first], []

    def stepped(depth: int) -> DataFrame:
        there = layers[0] if depth else layers[0].union(blocks)  # every block begins
        for layer in layers[1 : depth + 1]:
            there = there.union(layer)
        there = there.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "block", "depth", "part", "payload")
        both = graph.union(there).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
        return written(both.mapInArrow(_stepped(depth, k), _FOUND), partition_by=("what",))

    for depth in range(k):
        if depth == 0 or layers[depth].limit(1).count():
            found.append(stepped(depth))
        rows = [f.where((F.col("what") == "near") & (F.col("depth") == depth + 1)) for f in found[-2:]]
        made = rows[0] if len(rows) == 1 else rows[0].union(rows[1])
        for layer in layers:
            made = made.select("depth", "block", "part", "payload").union(layer)
        layers.append(_merge(made, depth + 1))

    every = layers[0]
    for layer in layers[1:]:
        every = every.union(layer)
    of_joints = every.join(sent_whole(about), "part").select("depth", "block", "payload", "about").repartition("depth", "block").sortWithinPartitions("depth", "block").mapInArrow(_joint_sums, _PLACED)
    gathered = lambda what: _union([f.where(F.col("what") == what).select("depth", "block", "kind", "payload").mapInArrow(_leaf_sums, _PLACED) for f in found])
    summed = of_joints.union(gathered("tally")).groupBy("depth", "block", "kind", "place").agg(*(F.sum(c).alias(c) for c in ("nodes", "degree", "loops")))
    sums = written(summed.join(numbers, ["block", "place"]).select("root", "depth", "kind", "nodes", "degree", "loops"))

    last = sums.where(F.col("depth") == k).select("kind").distinct()  # the last depth has had no step; few kinds of nodes have edges within it
    pairs = edges.where("src <> dst").select(kind_of("src").alias("a"), kind_of("dst").alias("b")).distinct()
    if layers[k].limit(1).count() and pairs.join(last.toDF("a"), "a").join(last.toDF("b"), "b").limit(1).count():
        found.append(stepped(k))
    level = gathered("level").groupBy("depth", "block", "place").agg(F.sum("nodes").alias("level")).join(numbers, ["block", "place"]).select("root", "depth", "level")
    per = sums.groupBy("root", "depth").agg(F.sum("degree").alias("degree"), F.sum("loops").alias("loops")).join(level, ["root", "depth"], "left")
    return sums.select("root", "depth", "kind", "nodes"), inside(numbers.select("root"), per.withColumn("level", F.coalesce("level", F.lit(0))), k)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out
