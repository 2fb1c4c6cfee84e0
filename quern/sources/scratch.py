"""Tables that a job writes for itself, below the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir.

    Only a session of one machine may leave that unset; it gets a temporary folder, which goes when Python ends.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = spark.conf.get("quern.local.dir", None)
        if not top:
            top = tempfile.mkdtemp(prefix="quern-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
            spark.conf.set("quern.local.dir", top)
    return f"{top}/quern-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd", row_group: int | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and survives lost executors.

    `row_group` bytes make a row group, the smallest part that tasks share a file by; `partition_by` columns make
    folders, which a filter or a join on them leaves unread.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    how = df.write.option("compression", compression)
    how = how.option("parquet.block.size", row_group) if row_group else how
    (how.partitionBy(*partition_by) if partition_by else how).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark reads."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t.quern_path)


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Puts the folder `new` in the place of `old`, which stays as `old`.bak (one before that goes)."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    files = path(old).getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(path(old)):
        files.delete(path(f"{old}.bak"), True)
        files.rename(path(old), path(f"{old}.bak"))
    files.rename(path(new), path(old))
