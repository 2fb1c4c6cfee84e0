"""Neighbourhoods of a graph, of any depth."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import discard, written

_BITS = [f"b{w}" for w in range(8)]  # words of 64 roots


def doubled(edges: DataFrame) -> DataFrame:
    """(node, next): each edge (src, dst) in both directions, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "next").distinct()


def hops(both: DataFrame, roots: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(root, node, depth): what each root reaches in at most k hops over the edges (node, next), and in how many.

    A round takes the nodes that the last one found, once for each root, one step on and leaves out what was seen before; it
    is written, so that no round is run twice, and rounds end with k or when nothing is new.  A hub's edges are one hot key, which
    the join divides.  With `most`, nodes of more edges than that are reached but not passed (roots are); without it nothing is left out.
    """
    passed = both
    if most is not None:
        small = both.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("node")
        passed = written(both.join(small, "node", "left_semi"))
    seen = written(roots.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)))
    frontier, rounds = seen, [seen]
    for depth in range(1, k + 1):
        edges = both if depth == 1 else passed
        found = frontier.join(edges, "node").select("root", F.col("next").alias("node")).distinct()
        for earlier in rounds:
            found = found.join(earlier.select("root", "node"), ["root", "node"], "left_anti")
        frontier = written(found.withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            discard(frontier)
            break
        rounds.append(frontier)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def inner_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, src, dst, depth): the edges between nodes that a root reaches, with the depth from which both ends are there."""
    ends = edges.join(reached.select("root", F.col("node").alias("src"), F.col("depth").alias("d")), "src")
    return ends.join(reached.select("root", F.col("node").alias("dst"), "depth"), ["root", "dst"]).select("root", "src", "dst", F.greatest("d", "depth").alias("depth"))


def numbered(roots: DataFrame) -> DataFrame:
    """(root, block, place): each root once, in order, by blocks of 512."""
    size = F.length("root")
    numbers = roots.select("root").distinct().repartitionByRange(size, "root").sortWithinPartitions(size, "root").withColumn("id", F.monotonically_increasing_id())
    return written(numbers.select("root", F.shiftright("id", 9).alias("block"), F.col("id").bitwiseAND(511).cast("int").alias("place")))


def reach(both: DataFrame, roots: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(numbers, reached): what each root reaches in at most k hops, as bits of 512 roots at a time.

    numbers: (root, block, place).  reached: (node, depth, block, b0 ... b7), the roots of a block that reach the node in so many hops and not in fewer.  Roots
    share rows and shuffles, so a round's rows go by edges and blocks, not by roots.  A node's neighbours are one step nearer, as far or one step
    further, so what was seen before is looked for in two rounds.
    """
    numbers = numbered(roots)
    bit = F.expr("shiftleft(1L, place % 64)")
    first = [F.when(F.floor(F.col("place") / 64) == w, bit).otherwise(F.lit(0).cast("long")).alias(b) for w, b in enumerate(_BITS)]
    rounds = [written(numbers.select(F.col("root").alias("node"), F.lit(0).alias("depth"), "block", *first))]
    for depth in range(1, k + 1):
        found = rounds[-1].join(both, "node").groupBy(F.col("next").alias("node"), "block").agg(*(F.bit_or(b).alias(b) for b in _BITS))
        for earlier in rounds[-2:]:
            seen = earlier.select("node", "block", *(F.col(b).alias(f"s{b}") for b in _BITS))
            found = found.join(seen, ["node", "block"], "left").select("node", "block", *(F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"s{b}", F.lit(0).cast("long")))).alias(b) for b in _BITS))
        new = written(found.where(" or ".join(f"{b} <> 0" for b in _BITS)).select("node", F.lit(depth).alias("depth"), "block", *_BITS))
        if not new.limit(1).count():
            discard(new)
            break
        rounds.append(new)
    return numbers, reduce(lambda x, y: x.unionByName(y), rounds)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (depth, block, kind, degree, loops, b0 ...): for each of a block's roots the number of rows, and the sums of degrees and loops."""
    held: dict[tuple, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        keys = [(*key, place, *map(int, sums[:, place])) for key, sums in held.items() for place in np.flatnonzero(sums[0])]
        held.clear()
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*keys, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["depth", "block", "kind", "place", "nodes", "degree", "loops"])

    for batch in batches:
        depth, block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).dictionary_encode()
        weights = np.stack([np.ones(batch.num_rows), batch.column(3).to_numpy(), batch.column(4).to_numpy()])
        words = np.stack([batch.column(5 + w).to_numpy() for w in range(len(_BITS))], axis=1)
        keys = np.stack([depth, block, kind.indices.to_numpy()], axis=1)
        for d, b, i in np.unique(keys, axis=0):
            some = (keys == (d, b, i)).all(axis=1)
            bits = np.unpackbits(words[some].astype("<i8").view(np.uint8), axis=1, bitorder="little")
            key = (int(d), int(b), kind.dictionary[int(i)].as_py())
            held[key] = held.get(key, 0) + weights[:, some] @ bits
        if len(held) > 2000:
            yield rows()
    yield rows()


def _tallied(numbers: DataFrame, bits: DataFrame) -> DataFrame:
    """(root, depth, kind, nodes, degree, loops) from rows of bits (depth, block, kind, degree, loops, b0 ...)."""
    made = bits.select("depth", "block", "kind", "degree", "loops", *_BITS).mapInArrow(_tally, "depth int, block long, kind string, place int, nodes long, degree long, loops long")
    summed = made.groupBy("depth", "block", "kind", "place").agg(*(F.sum(c).alias(c) for c in ("nodes", "degree", "loops")))
    return summed.join(numbers, ["block", "place"]).select("root", "depth", "kind", "nodes", "degree", "loops")


def kind_of(node: str):
    return F.substring_index(node, ":", 1)


def inner_counts(numbers: DataFrame, reached: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, inside) of what reach() gives: (root, depth, kind, nodes), a node's kind being its name up to the colon, and (root, k, edges), for each depth from 1 to k
    how many edges (src, dst) lie between the nodes reached in so many hops.

    Every edge at a node of depth d is inside from depth d + 1 on.  So edges are counted by the degrees of the nodes, an edge between two depths from one
    end; only edges between nodes of one depth are joined, and only of kinds that some root has at one depth.
    """
    loops = edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("loops"))
    both = edges.where("src <> dst")
    degrees = both.select(F.col("src").alias("node")).union(both.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    n = reached.join(degrees, "node", "left").join(loops, "node", "left").withColumn("kind", kind_of("node"))
    sums = written(_tallied(numbers, n.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("degree", "loops")})))
    per = sums.groupBy("root", "depth").agg(F.sum("degree").alias("degree"), F.sum("loops").alias("loops"), F.lit(0).cast("long").alias("level"))
    at = reached.select("depth", kind_of("node").alias("a")).distinct()
    alike = at.join(at.withColumnRenamed("a", "b"), "depth").select("a", "b").distinct()
    ends = both.withColumns({"a": kind_of("src"), "b": kind_of("dst")}).join(F.broadcast(alike), ["a", "b"]).select("src", "dst")  # pairs of kinds, each once
    if ends.limit(1).count():
        other = reached.select("depth", "block", F.col("node").alias("dst"), *(F.col(b).alias(f"o{b}") for b in _BITS))
        near = ends.join(reached.withColumnRenamed("node", "src"), "src").join(other, ["depth", "block", "dst"])
        near = near.select("depth", "block", F.lit("").alias("kind"), F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("loops"), *(F.col(b).bitwiseAND(F.col(f"o{b}")).alias(b) for b in _BITS))
        level = _tallied(numbers, near).groupBy("root", "depth").agg(F.sum("nodes").alias("found"))
        per = per.join(level, ["root", "depth"], "left").withColumn("level", F.coalesce("found", F.lit(0))).drop("found")
    return sums.select("root", "depth", "kind", "nodes"), inside(numbers.select("root"), per, k)


def inside(roots: DataFrame, per: DataFrame, k: int) -> DataFrame:
    """Edges at nodes of depth d lead to depth d - 1 (counted there), d (twice) or d + 1: what a depth adds is found from the nearest on."""
    rows = per.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("depth", F.struct("degree", "loops", "level")))).alias("at"))  # at most k + 1 of a root
    start = F.struct(F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("inside"), F.array().cast("array<bigint>").alias("out"))

    def step(a, depth):
        here = F.try_element_at("at", depth)
        n = lambda c: F.coalesce(here[c], F.lit(0)).cast("long")
        inside = a["inside"] + a["up"] + n("level") + n("loops")
        up = n("degree") - a["up"] - 2 * n("level")  # edges to the next depth
        return F.struct(up.alias("up"), inside.alias("inside"), F.array_append(a["out"], inside).alias("out"))

    counts = F.aggregate(F.sequence(F.lit(0), F.lit(k)), start, step, lambda a: a["out"])
    found = rows.select("root", F.posexplode(counts).alias("k", "edges"))
    every = roots.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return every.join(found, ["root", "k"], "left").select("root", "k", F.coalesce("edges", F.lit(0)).alias("edges"))
