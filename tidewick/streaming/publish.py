"""Publishing of session documents from a stream: a day is built anew when its store has changed, and only then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def current(stored: DataFrame) -> DataFrame:
    """One row for each symbol and day of the store: real ones before estimates, then the first that came."""
    order = Window.partitionBy("symbol", "d").orderBy(F.col("est"), "batch")
    return stored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def versions(rows: DataFrame) -> DataFrame:
    """d, version: a number of each day that changes with any of its rows."""
    return rows.groupBy("d").agg(F.sum(F.xxhash64(*sorted(c for c in rows.columns if c not in ("d", "batch"))).cast("decimal(38,0)")).cast("string").alias("version"))


def publisher(store: str, published: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: keeps a batch of sessions (symbol, d, est, ...) in the store and publishes the days that it changes.

    The store is partitioned by day and batch, and a batch overwrites its own partitions, so a batch that
    comes again leaves the store as it was. A day is published (build() of its current rows, with its
    version) if the store's version of it is not the published one: a late symbol publishes its day
    anew and no other; a replay, or an estimate of what is real already, publishes nothing. Only
    days of the batch are read.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(number)).persist()
        try:
            days = [r["d"] for r in rows.select("d").distinct().collect()]  # the days of a batch
            if not days:
                return
            _overwrite(rows, store, "d", "batch")
            own = current(spark.read.schema(rows.schema).parquet(store).where(F.col("d").isin(days)))
            now = versions(own)
            if _exists(spark, published):
                known = spark.read.parquet(published).where(F.col("d").isin(days)).select("d", "version").distinct()
                now = now.join(known, ["d", "version"], "left_anti")
            changed = [r["d"] for r in now.collect()]  # as many at most
            if changed:
                fresh = versions(own.where(F.col("d").isin(changed)))
                _overwrite(build(own.where(F.col("d").isin(changed))).join(F.broadcast(fresh), "d"), published, "d")
        finally:
            rows.unpersist()

    return publish
