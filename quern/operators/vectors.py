"""Nearest vectors of a set of queries: blocks of rows against blocks of queries, as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import sent_whole, top_k

ROWS, QUERIES = 2048, 512  # of a block


def _vectors(column: pa.Array) -> np.ndarray:
    dim = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _packed(ids: pa.Array, vectors: pa.Array, metric: str) -> tuple[bytes, bytes]:
    """Ids and vectors (of length 1 for cosines) as bytes."""
    x = _vectors(vectors)
    if metric == "cosine":
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return ids.to_numpy().astype("<i8").tobytes(), x.astype("<f8").tobytes()


def _row_blocks(metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, vs = _packed(part.column(0), part.column(1), metric)
                yield pa.record_batch([pa.array([ids], pa.binary()), pa.array([vs], pa.binary())], ["ids", "vs"])

    return run


def _query_block(metric: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, vs = _packed(rows.column("id").combine_chunks(), rows.column("v").combine_chunks(), metric)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "query_ids": pa.array([ids], pa.binary()), "qs": pa.array([vs], pa.binary())})

    return run


def _best(k: int, metric: str, digits: int):
    """From (ids, vs, query_ids, qs): the k nearest rows of the block for each query, other than itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vs, query_ids, qs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, q = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                x, y = np.frombuffer(vs, "<f8").reshape(len(i), -1), np.frombuffer(qs, "<f8").reshape(len(q), -1)
                near = y @ x.T
                if metric == "l2":
                    near = -np.sqrt(np.maximum(0, (y * y).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * near))
                near = np.round(near, digits)
                near[q[:, None] == i] = -np.inf
                order = np.lexsort((np.broadcast_to(i, near.shape), -near), axis=1)[:, :k]
                score = np.take_along_axis(near, order, axis=1)
                there = np.isfinite(score)
                yield pa.record_batch([pa.array(np.repeat(q, order.shape[1])[there.ravel()]), pa.array(i[order][there]), pa.array(score[there])], ["query_id", "id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "cosine", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query by cosine, or by distance ("l2", negated), ties by id.

    Scores are rounded to `digits` before they are ranked; a row is not its own neighbour; null vectors are left out.  Vectors
    have one length.  Rows stay where they are: each block of them meets each block of queries, of which the tasks get all at once only while those
    are few, and sends k rows for each query.
    """
    named = lambda df: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = named(queries)
    blocks = max(1, -(-asked.count() // QUERIES))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_query_block(metric), "block int, query_ids binary, qs binary")
    met = named(rows).mapInArrow(_row_blocks(metric), "ids binary, vs binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = met.join(sent_whole(packed, 64), "block").select("ids", "vs", "query_ids", "qs").mapInArrow(_best(k, metric, digits), "query_id long, id long, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
