"""Exact deduplication with a split of heavy hitters (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh, stored

#: Digests that the frequent-items sketch follows, and how many of them may be broadcast.
SKETCH_ITEMS = 8192
HEAVY_ITEMS = 1024

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the fast path is for pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def duplicate_groups(digests: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """digests with keep_id (the largest id of equal digests), group_size and kept.

    A Misra-Gries summary (Spark's frequent-items sketch, merged over partitions, of fixed size) names
    the digests that may be frequent. Their exact count and largest id come from a map-side combined
    aggregate of at most HEAVY_ITEMS rows, which is broadcast: rows of a hot group are settled where
    they are read and never meet in one task. All other digests are shuffled as usual; a group among
    them is below a known share of the rows. Null ids lose to others; rows that repeat an id within a
    group are alike and are all marked as kept if that id is; an empty table gives no rows.
    """
    digests = stored(digests)
    found = digests.agg(F.expr(f"approx_top_k({digest_col}, {HEAVY_ITEMS}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("n"))
    # a digest of more than n / HEAVY_ITEMS rows is surely in the summary
    heavy = found.select(F.explode("top").alias("t"), "n").where(
        F.col("t.count") > F.greatest(F.lit(8), F.expr(f"n div {HEAVY_ITEMS}"))
    ).select(F.col("t.item").alias(digest_col))
    winners = stored(
        digests.join(F.broadcast(heavy), digest_col)
        .groupBy(digest_col)
        .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    hot = digests.join(F.broadcast(winners), digest_col)
    group = Window.partitionBy(digest_col)
    rest = (
        digests.join(F.broadcast(winners.select(digest_col)), digest_col, "left_anti")
        .withColumn("keep_id", F.max(id_col).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return hot.unionByName(rest).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """Pipeline stage: docs without rows whose text equals (A-Z lower-cased) the text of a row with a larger doc_id; columns stay.

    Null texts count as empty and equal each other. Null ids lose to others. Rows that repeat both doc_id
    and text count as one. An empty table stays empty.
    """
    own, same, id_ = fresh(docs, "digest", "same", "id")
    marked = docs.withColumn(own, digest(F.col("text")))
    groups = stored(duplicate_groups(marked.select("doc_id", F.col(own).alias("__digest")), "doc_id", "__digest").where("kept").select("doc_id", "__digest"))
    again = groups.groupBy("doc_id", "__digest").count().where("count > 1").limit(1).count()
    if again:
        marked = marked.dropDuplicates(["doc_id", own])
    keep = groups.select(F.col("doc_id").alias(id_), F.col("__digest").alias(same))
    out = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(same)), "left_semi")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", digest(F.col("text")).alias("text_sha256"))
    return duplicate_groups(docs, "doc_id", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
