"""What the stateful streams share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """States of the processors here have several variables and timers, which only this store holds."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
