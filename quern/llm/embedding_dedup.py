"""Near duplicates of vectors by dual traversal of cover trees.

The top level of a large label's tree is fitted first: up to CENTRES vectors, drawn by hash, become centres.  Each
vector belongs to its nearest centre's cell, and visits another cell only if a partner may live there: a vector
within the threshold's chord of it is on the other side of the plane halfway between the two centres only if that plane is
no further away than the chord.  So most pairs of cells meet with few rows or none, before anything is shuffled.

Cells are dealt by hash to blocks of bounded size.  A task gets two blocks (or one), puts a cover tree over each
(nested levels whose radii halve; every node knows the distance to its farthest descendant) and walks both trees at once: a
pair of nodes goes on only if their centres are no further apart than both radii and the chord.  What is left at the bottom is
compared exactly, in double precision.

Equal vectors are compared once, with their number as weight.  A task sends each vector's
links as a sum and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import components, discard, sent_whole, table, written
from quern.llm.simhash_dedup import _merge

THRESHOLD = 0.98
BLOCK = 4096
LEAF = 512
TOP = 0.5  # radius of the top level in a block; wider balls hold hardly more than one vector of many dimensions
#: Centres of a label at most, and labels that get some (the largest ones; others are one cell each).
CENTRES, LABELS = 256, 64
_SLACK = 1e-5  # above the rounding of products of unit vectors in single precision
_ROWS, _BATCH = 1024, 256  # rows of a product, and centres, at once


class Node:
    """A node's children: centres, covering radii, and either a node or a vector's number each."""

    __slots__ = ("centres", "radii", "below", "point")

    def __init__(self, centres: np.ndarray, radii: np.ndarray, below: list, point: np.ndarray):
        self.centres, self.radii, self.below, self.point = centres.astype(np.float32), radii, below, point


def _leaf(unit: np.ndarray, members: np.ndarray) -> Node:
    return Node(unit[members], np.zeros(len(members)), [None] * len(members), members)


def cover_tree(unit: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree over the rows of `unit` (of length 1, in double precision)."""

    def grow(members: np.ndarray, radius: float) -> Node:
        if len(members) <= leaf or radius < 1e-6:
            return _leaf(unit, members)
        limit = 1 - radius * radius / 2  # of the products of vectors within the radius
        centres, radii, below, points = [], [], [], []
        rest = members
        while len(rest):  # the first rows that no centre before covers are centres; a batch of them at once
            head = rest[:_BATCH]
            near = unit[head] @ unit[head].T >= limit
            chosen, covered = [], np.zeros(len(head), bool)
            for i in range(len(head)):
                if not covered[i]:
                    chosen.append(i)
                    covered |= near[i]
            product = unit[rest] @ unit[head[chosen]].T
            inside = product >= limit
            inside[chosen, np.arange(len(chosen))] = True
            first = np.where(inside.any(axis=1), inside.argmax(axis=1), -1)
            order = np.argsort(first, kind="stable")
            ends = np.searchsorted(first[order], np.arange(len(chosen) + 1))
            for c, i in enumerate(chosen):
                group = order[ends[c] : ends[c + 1]]
                alone = len(group) == 1
                centres.append(head[i])
                points.append(head[i] if alone else -1)
                radii.append(0.0 if alone else float(np.sqrt(np.maximum(0, 2 - 2 * product[group, c].min()))))
                below.append(None if alone else grow(rest[group], radius / 2))
            rest = rest[first < 0]
        return Node(unit[centres], np.array(radii), below, np.array(points))

    return grow(np.arange(len(unit)), TOP)


def _as_node(node: Node, i: int) -> Node:
    """A child that is a vector, as a node of itself."""
    if node.below[i] is not None:
        return node.below[i]
    return Node(node.centres[i : i + 1], np.zeros(1), [None], node.point[i : i + 1])


def close_pairs(a: Node, b: Node, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of vector numbers whose chords may be at most `chord` (no such pair is missed)."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        flat = not x.radii.any() and not y.radii.any()
        for at in range(0, len(x.radii), _ROWS):
            reach = chord if flat else x.radii[at : at + _ROWS, None] + y.radii[None, :] + chord
            i, j = np.nonzero(x.centres[at : at + _ROWS] @ y.centres.T >= 1 - reach * reach / 2 - _SLACK)
            i += at
            done = (x.point[i] >= 0) & (y.point[j] >= 0)
            if done.any():
                yield x.point[i[done]], y.point[j[done]]
            for p, q in zip(i[~done].tolist(), j[~done].tolist(), strict=True):
                stack.append((_as_node(x, p), _as_node(y, q)))


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x with its largest component at 1, which keeps squares in range; its norms; its directions)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    return x, norm, x / norm[:, None]


# --- cells around the centres of the top level ---------------------------------------------


def _centres(groups: DataFrame, block: int) -> dict[tuple[str, int], np.ndarray]:
    """{(label, length): directions of centres} of the labels with the most vectors, if they have more than a block.

    To the driver come at most LABELS times CENTRES vectors.
    """
    large = groups.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block).orderBy(F.desc("n"), "label", "dim").limit(LABELS)
    share = large.select("label", "dim", F.least(F.lit(CENTRES), F.ceil(F.col("n") / block)).alias("c"), F.col("n"))
    unit = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / float(1 << 30)
    drawn = groups.join(F.broadcast(share), ["label", "dim"]).where(unit < 4 * F.col("c") / F.col("n")).withColumn("u", unit)  # at most LABELS rows
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("u", "rep"))
    out: dict[tuple[str, int], list] = {}
    for r in drawn.withColumn("i", rank).where("i <= c").select("label", "dim", "v").collect():
        out.setdefault((r["label"], r["dim"]), []).append(r["v"])
    return {k: _unit(np.array(v, np.float64))[2] for k, v in out.items()}


def cells(unit: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it lives there): each vector's own cell and those that it must visit.

    Of two cells only one side visits: the one of the smaller number if both numbers are even or both odd, else the other.
    """
    near = unit @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    to_plane = near[np.arange(len(unit)), home][:, None] - near  # times the distance of the centres
    number = np.arange(len(centres))
    goes = (home[:, None] < number) == ((home[:, None] + number) % 2 == 0)
    visits = goes & (number != home[:, None]) & (to_plane <= (chord + _SLACK) * apart[home] + _SLACK)
    i, j = np.nonzero(visits)
    return np.concatenate([np.arange(len(unit)), i]), np.concatenate([home, j]), np.arange(len(unit) + len(i)) < len(unit)


def _dealt(centres: dict[tuple[str, int], np.ndarray], chord: float):
    """From (label, dim, rep, w, v): the rows once for each cell that they live in or visit, with cell and home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows, cell, home = [], [], []
            for key in sorted(set(keys)):
                at = np.array([i for i, k in enumerate(keys) if k == key])
                if key in centres:
                    r, c, h = cells(_unit(_matrix(batch.column(4).take(pa.array(at)), key[1]))[2], centres[key], chord)
                else:
                    r, c, h = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                rows.append(at[r]), cell.append(c), home.append(h)
            if rows:
                taken = batch.take(pa.array(np.concatenate(rows)))
                yield pa.record_batch([*taken.columns, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home))], [*taken.schema.names, "cell", "home"])

    return run


# --- blocks and their comparison -----------------------------------------------------------


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """A block as one row."""
    number = lambda x: pa.array([rows.column(x).to_numpy().astype("<i8").tobytes()], pa.binary())
    one = {x: rows.column(x).slice(0, 1) for x in ("label", "dim", "cell", "home", "s", "homes", "visitors")}
    dim = one["dim"][0].as_py()
    return pa.table(one | {"reps": number("rep"), "ws": number("w"), "vs": pa.array([_matrix(rows.column("v"), dim).astype("<f8").tobytes()], pa.binary())})


def _compare(threshold: float):
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        blocks = []
        for reps, ws, vs in zip(*(rows.column(x).to_pylist() for x in ("reps", "ws", "vs")), strict=True):
            x, norm, unit = _unit(np.frombuffer(vs, "<f8").reshape(-1, dim))
            blocks.append((np.frombuffer(reps, "<i8"), np.frombuffer(ws, "<i8"), x, norm, cover_tree(unit)))
        a, b = blocks[0], blocks[-1]
        empty = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}
        if key[5].as_py() and len(blocks) == 1:  # visitors of a block that nobody lives in, or no visitors
            return pa.table(empty)
        first = 0 if len(blocks) == 1 else len(a[0])
        reps = a[0] if len(blocks) == 1 else np.concatenate([a[0], b[0]])
        links = np.zeros(len(reps), np.int64)
        by_rep = np.argsort(reps, kind="stable")
        place = np.empty(len(reps), np.int64)
        place[by_rep] = np.arange(len(reps))
        label = np.arange(len(reps))
        for p, q in close_pairs(a[4], b[4], chord):
            if len(blocks) == 1:
                p, q = p[p < q], q[p < q]
            for at in range(0, len(p), 1 << 14):
                i, j = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
                cosine = np.einsum("ij,ij->i", a[2][i], b[2][j]) / (a[3][i] * b[3][j])
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                np.add.at(links, i, b[1][j])
                np.add.at(links, j + first, a[1][i])
                _merge(label, place[i], place[j + first])
        root = np.empty(len(reps), np.int64)
        root[by_rep] = reps[by_rep][label]
        some = links > 0
        return pa.table({"a": pa.array(reps[some], pa.int64()), "b": pa.array(root[some], pa.int64()), "n": pa.array(links[some], pa.int64())})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of df.

    Vectors link within a label; null labels and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and neither do those of different length.
    Repeated rows are vectors of their own that link with each other.  Rows are told apart by a key of their own: one without an
    id takes part, and is kept only if its component has no id and it comes first in it.  Long vectors are compared whole,
    other columns are not looked at, and an empty table gives no rows.
    """
    kind = "array<double>" if dict(df.dtypes)[vector_col] == "array<double>" else "array<float>"
    v = F.col(f"`{vector_col}`").cast(kind).alias("v")
    named = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), v)
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~wrong & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(named.select("*", fit.alias("fit"), F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(7), "v", "label").alias("h2")))
    equal = rows.where("fit").withColumn("dim", F.size("v")).groupBy("label", "dim", "h1", "h2")
    groups = written(equal.agg(F.min("row").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")))

    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    schema = f"label string, dim int, rep long, w long, v {kind}, cell int, home boolean"
    dealt = written(groups.select("label", "dim", "rep", "w", "v").mapInArrow(_dealt(_centres(groups, block), chord), schema))
    slots = lambda who: F.ceil(F.count_if(who) / block).cast("int")
    counts = written(dealt.groupBy("label", "dim", "cell").agg(slots(F.col("home")).alias("homes"), slots(~F.col("home")).alias("visitors")))
    many = F.when(F.col("home"), F.col("homes")).otherwise(F.col("visitors"))
    dealt_out = dealt.join(sent_whole(counts), ["label", "dim", "cell"]).withColumn("s", F.pmod(F.xxhash64("rep"), many).cast("int"))
    names = "label string, dim int, cell int, home boolean, s int, homes int, visitors int"
    packed = written(dealt_out.groupBy("label", "dim", "cell", "home", "s").applyInArrow(_block, f"{names}, reps binary, ws binary, vs binary"), "none")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda x, y, visit: F.struct(x.alias("x"), y.alias("y"), F.lit(visit).alias("visit"))
    s = F.col("s")
    at_home = F.concat(F.transform(upto("homes"), lambda t: pair(F.least(s, t), F.greatest(s, t), False)), F.transform(upto("visitors"), lambda t: pair(s, t, True)))
    away = F.transform(upto("homes"), lambda t: pair(t, s, True))
    pairs = packed.withColumn("p", F.explode(F.when(F.col("home"), at_home).otherwise(away))).select("label", "dim", "cell", "p.x", "p.y", "p.visit", "reps", "ws", "vs")
    found = written(pairs.groupBy("label", "dim", "cell", "x", "y", "visit").applyInArrow(_compare(threshold), "a long, b long, n long"))
    discard(dealt, counts, packed)

    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    classes = components(found.select("a", "b"))
    known = groups.select("h1", "h2", "rep", "w").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("h1", "h2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    slim = rows.select("row", "vec_id", "fit", "h1", "h2")
    linked = written(slim.where("fit").join(known, ["h1", "h2"]).select("row", "vec_id", "n_links", "c").union(slim.where("not fit").select("row", "vec_id", F.lit(0).cast("long"), F.col("row"))))
    least = written(linked.groupBy("c").agg(F.min("vec_id").alias("component_id"), F.min("row").alias("first")))  # a table, so that the join can split hot components
    kept = F.when(F.col("component_id").isNull(), F.col("row") == F.col("first")).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return linked.join(least, "c").select("vec_id", "n_links", "component_id", kept.alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of `embeddings` at a cosine of 0.98 or more within their label, their components and which one is kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id
"""
