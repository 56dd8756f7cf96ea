"""The ledger of scored cones: each issue day, horizon and level once, when its returns are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regime import LEVELS

KEY = ("d", "h", "level")


def sessions(bars: DataFrame) -> DataFrame:
    """d, session: the calendar, all dates with any bar, numbered from 1. One row a date."""
    return bars.select("d").distinct().withColumn("session", F.row_number().over(Window.orderBy("d")))


def session_returns(bars: DataFrame, calendar: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """bars (symbol, d, c) with sr{h}: the log return up to the h-th session of the calendar after d, null where the symbol has no bar on it."""
    rows = bars.join(F.broadcast(calendar), "d")  # sessions
    order = Window.partitionBy("symbol").orderBy("session")
    returns = {f"sr{h}": F.ln(F.max("c").over(order.rangeBetween(h, h)) / F.col("c")) for h in horizons}
    return rows.withColumns(returns).drop("session")


def matured(cones: DataFrame, closes: DataFrame | None, calendar: DataFrame, first: int, last: int) -> DataFrame:
    """d, h, level, n, hit, scored_on of the cones whose horizon ends in the sessions first to last.

    cones: symbol, d, h and quantiles (log returns); closes: symbol, d, c. A horizon counts sessions of the
    calendar, so a symbol that has no bar on either day takes no part. hit: the share of symbols
    whose return lies in the level's band, ends included. Without closes the cones carry that return (ret), null
    for those that take no part.
    """
    due = calendar.where(F.col("session").between(first, last)).select(F.col("d").alias("scored_on"), F.col("session").alias("__due"))
    issued = cones.join(F.broadcast(calendar), "d").withColumn("__due", F.col("session") + F.col("h"))  # sessions
    issued = issued.join(F.broadcast(due), "__due")
    if closes is None:
        rows = issued.where("ret IS NOT NULL AND symbol IS NOT NULL")
    else:
        then = closes.select("symbol", "d", F.col("c").alias("__c0"))
        now = closes.select("symbol", F.col("d").alias("scored_on"), F.col("c").alias("__c1"))
        rows = issued.join(then, ["symbol", "d"]).join(now, ["symbol", "scored_on"]).withColumn("ret", F.ln(F.col("__c1") / F.col("__c0")))
    inside = [F.struct(F.lit(v).alias("level"), F.col("ret").between(F.col(f"q{a}"), F.col(f"q{b}")).cast("int").alias("hit")) for v, (a, b) in LEVELS.items()]
    rows = rows.select("d", "h", "scored_on", F.explode(F.array(*inside)).alias("x")).select("d", "h", "scored_on", "x.*")
    return rows.groupBy("d", "h", "level", "scored_on").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit")).select(*KEY, "n", "hit", "scored_on")


def between(ledger: DataFrame, calendar: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of ledger that matured() gives for the sessions first to last alone."""
    due = calendar.where(F.col("session").between(first, last)).select(F.col("d").alias("scored_on"))
    return ledger.join(F.broadcast(due), "scored_on", "left_semi")  # sessions


def merged(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """ledger with the rows of fresh whose key it does not have; what was scored once stays as it is."""
    return ledger.unionByName(fresh.join(ledger.select(*KEY), list(KEY), "left_anti"))


def append(fresh: DataFrame, path: str) -> None:
    """Appends to the ledger at path what it does not have yet, so a run that is repeated adds nothing.

    Only keys of the ledger are read. The append is one job whose files appear when it commits.
    """
    spark = fresh.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.parquet(path).select(*KEY), list(KEY), "left_anti")
    fresh.write.mode("append").parquet(path)
