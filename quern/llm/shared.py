"""What the operators of this folder share: written tables that cut lineage, components, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ranking import sent_whole
from quern.sources.scratch import discard, written

#: The white space that separates words everywhere in this folder (ASCII only).
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "bounded_sample", "chunks", "components", "discard", "fresh", "held_out", "sent_whole", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, by: list[str], id_col: str, cap: int) -> DataFrame:
    """About `cap` rows for each value of `by` (all, where there are fewer), chosen by a hash of the id.

    Only counts reach the shuffle: the share to keep comes from them, so no group is sorted.
    """
    share = df.groupBy(*by).agg(F.least(F.lit(1.0), F.lit(float(cap)) / F.count("*")).alias("__share"))
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(sent_whole(share), by).where(unit < F.col("__share")).drop("__share")


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of the column `text` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            below = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, below + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the undirected edges (a, b): the smallest id it reaches.

    Labels fall to the smallest neighbour's and then jump to their label's label, which
    halves long chains; each round is written out and the one before deleted, until nothing moves.  Joins are plain
    equi-joins, whose hot keys adaptive execution splits.  Edges with a null end join nothing.
    """
    ends = edges.where("a <> b")
    both = written(ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("id"), "l", F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        seen = both.join(labels.select(F.col("id").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "id")
        lower = labels.join(seen, "id").select("id", "l", F.least("l", "m").alias("n"))
        jump = labels.select(F.col("id").alias("n"), F.col("l").alias("j"))
        new = written(lower.join(jump, "n").select("id", F.least("n", "j").alias("l"), (F.least("n", "j") < F.col("l")).alias("moved")))
        discard(labels)
        labels = new
    discard(both)
    return labels.select("id", F.col("l").alias("component"))
