"""Conditional events on bars, and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_symbol, ahead, back, roll, true


def volume_spike(bars: DataFrame, multiple: float = 2.0, least_change: float = 0.03, log_days: int | None = 60) -> DataFrame:
    """Rising bars of `multiple` times the mean volume of the 20 bars before, among each symbol's last log_days bars.

    With pct, ratio, avg20 and what came after 5 and 10 sessions (r5, r10).
    """
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    rows = bars.withColumns(
        {
            "avg20": roll(F.avg, "v", 20, 1),
            "pct": F.col("c") / F.nullif(back("c"), F.lit(0.0)) - 1,
            "r5": ahead("c", 5) / F.col("c") - 1,
            "r10": ahead("c", 10) / F.col("c") - 1,
            "__late": F.row_number().over(late),
        }
    )
    hit = (F.col("avg20") > 0) & (F.col("v") >= multiple * F.col("avg20")) & (F.col("c") > F.col("o")) & (F.col("pct") >= least_change - 1e-12)
    rows = rows.where(hit)
    if log_days is not None:
        rows = rows.where(F.col("__late") <= log_days)
    return rows.withColumn("ratio", F.col("v") / F.col("avg20")).drop("__late")


def red_volume_demand(roll=roll) -> Column:
    """Falling bar on volume at a 60-bar low after a fall of 5 % in 10 sessions."""
    return true(
        (F.col("c") < F.col("o"))
        & (F.col("v") >= 1.5 * roll(F.avg, "v", 20, 1))
        & (F.col("l") <= 1.03 * roll(F.min, "l", 60, 1))
        & (F.col("c") / back("c", 10) - 1 <= -0.05)
    )


def gap_fill_demand(roll=roll) -> Column:
    """Gap down and its recovery the day after, at a 60-bar low after a fall of 5 %."""
    gap = (back("c") < back("o")) & (back("o") <= 0.99 * back("c", 2)) & (F.col("c") > F.col("o")) & (F.col("c") > back("o"))
    low = roll(F.min, "l", 3) <= 1.03 * roll(F.min, "l", 60, 3)
    return true(gap & low & (back("c", 3) / back("c", 13) - 1 <= -0.05))


def keep_first(marked: DataFrame, flag: str, apart: int = 5) -> DataFrame:
    """symbol, d of flagged bars, without those within `apart` bars of the last one kept.

    Whether a bar stays depends on the one kept before it, so flagged bars are folded in order. Only
    flagged bars enter the fold.
    """
    rows = marked.withColumn("__i", F.row_number().over(by_symbol())).where(flag)
    lists = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), "d"))).alias("at"))
    kept = F.aggregate(
        "at",
        F.filter("at", lambda x: F.lit(False)),
        lambda out, x: F.when((F.size(out) == 0) | (x["i"] - F.element_at(out, -1)["i"] > apart), F.array_append(out, x)).otherwise(out),
    )
    return lists.select("symbol", F.explode(F.when(F.size("at") > 0, kept)).alias("e")).select("symbol", "e.d")


def event_log(bars: DataFrame, events: DataFrame, last: int = 250) -> DataFrame:
    """events (symbol, d, code) of each symbol's last bars, with ret10, ret_now and age in sessions."""
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    frame = Window.partitionBy("symbol").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = bars.withColumns(
        {
            "age": (F.row_number().over(late) - 1).cast("long"),
            "ret10": ahead("c", 10) / F.col("c") - 1,
            "ret_now": F.last("c").over(frame) / F.col("c") - 1,
        }
    ).where(F.col("age") < last)
    return rows.join(events, ["symbol", "d"]).select("symbol", "d", "code", "age", "ret10", "ret_now")


def log_summary(log: DataFrame) -> DataFrame:
    """code, n, n_done, ret10, n_up, ret_now: what came after the events of a log, of those that are 10 sessions old."""
    return log.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ret10").alias("n_done"),
        F.avg("ret10").alias("ret10"),
        F.count_if(F.col("ret10") > 0).alias("n_up"),
        F.avg("ret_now").alias("ret_now"),
    )
