"""Results of a stream kept by key: successes are stored once, failures are tried again, a replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from quern.sources.scratch import exists

Work = Callable[[DataFrame], DataFrame]


def _folder(path: str, kind: str, batch: int) -> str:
    return f"{path}/{kind}/batch={batch}"


def _apply(rows: DataFrame, work: Work, path: str, batch: int) -> None:
    """Stores what `work` makes of rows (with a column `ok`), each batch in folders of its own that a replay overwrites."""
    done = work(rows)
    done.write.mode("overwrite").parquet(_folder(path, "tried", batch))
    tried = rows.sparkSession.read.schema(done.schema).parquet(_folder(path, "tried", batch))
    tried.where("ok").drop("ok").write.mode("overwrite").parquet(_folder(path, "rows", batch))
    tried.where("not coalesce(ok, false)").drop("ok").withColumn("attempt", F.col("attempt") + 1).write.mode("overwrite").parquet(_folder(path, "failed", batch))


def _failed(spark: SparkSession, path: str, batch: int, schema: StructType) -> DataFrame | None:
    folder = _folder(path, "failed", batch)
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else None


def upserts(stream: DataFrame, path: str, work: Work) -> DataStreamWriter:
    """A writer that does `work` on each micro-batch and on what failed in the one before.

    `work` gets the stream's rows with `attempt` (from 0) and returns them with a boolean `ok`.  A batch reads the failures of the batch before it
    and leaves its own, so that a batch that is run again after a crash reads and overwrites the same folders.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("attempt", F.lit(0))
        failed = _failed(batch.sparkSession, path, number - 1, rows.schema)
        _apply(rows.unionByName(failed) if failed is not None else rows, work, path, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state")


def retry(spark: SparkSession, path: str, schema: StructType, work: Work, last_batch: int) -> int:
    """Tries what is left of the last batch again, as a batch of its own; the number of the batch that is the last now."""
    failed = _failed(spark, path, last_batch, schema)
    if failed is None or not failed.limit(1).count():
        return last_batch
    _apply(failed, work, path, last_batch + 1)
    return last_batch + 1


def latest(spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str]) -> DataFrame:
    """The last successful row of each key by `order`, whatever batch stored it."""
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in {*key, *order, "batch"}]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*key, *(f"m.{c}" for c in [*order, *rest]))
