"""The same operators on streams of ticks and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_candles(ticks: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Candles of a stream of ticks (symbol, ts, acc, price, vol, side), one for each symbol and window, once it is over."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", length).alias("w"))
        .agg(
            F.min_by("price", "acc").alias("o"),
            F.max("price").alias("h"),
            F.min("price").alias("l"),
            F.max_by("price", "acc").alias("c"),
            F.sum(F.when(F.col("side") == "PS", F.col("vol")).otherwise(0)).alias("buy"),
            F.sum(F.when(F.col("side") == "PB", F.col("vol")).otherwise(0)).alias("sell"),
        )
        .select("symbol", F.col("w.start").alias("start"), "o", "h", "l", "c", "buy", "sell")
    )


def alerts_once(alerts: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of alerts (symbol, d, ts, ...) without repeats of (symbol, d)."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "d"])


def order_sessions(ticks: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of orders of one symbol, side and exact volume with no gap longer than `gap`."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", "side", "vol", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("symbol", "side", "vol", F.col("w.start").alias("start"), "n")
    )
