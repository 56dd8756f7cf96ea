"""Balanced contiguous shards from a global prefix sum of byte sizes (JVM only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored, utf8_bytes

SHARDS = 8


def byte_shards(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """rows with `shard` and `slot`: rows in the order of `order`, cut at equal byte targets.

    Rows are range-partitioned once and kept (they should be slim: keys and sizes). Each partition's
    totals, one row each, give every partition its first byte and row; a running sum inside the
    partition does the rest. A row belongs to the shard that its first byte falls in, so a shard's
    size differs from the target by less than one row's size. Only the per-partition totals are
    broadcast, as many rows as there are partitions. Null keys come first, equal keys stand next to
    each other in any order, an empty table gives no rows. Columns of the names __* are this
    function's own.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = (
        ranged.groupBy("__part")
        .agg(F.sum(size).alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        .select(
            "__part",
            F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__byte0"),
            F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__row0"),
            F.sum("__bytes").over(whole).alias("__total"),
        )
    )
    inside = Window.partitionBy("__part").orderBy(*order, size)
    placed = (
        ranged.join(F.broadcast(totals), "__part")
        .withColumn("__row", F.col("__row0") + F.row_number().over(inside) - 1)
        .withColumn(
            "__start",
            F.col("__byte0") + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, __start * {shards} div greatest(__total, 1)) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))  # one row a shard
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("__row") - F.col("__first"))
        .drop("__part", "__byte0", "__row0", "__total", "__row", "__start", "__first")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return byte_shards(docs, ["doc_id"], "size", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
