"""Gates and merges on the way into the bar and tick stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def day() -> WindowSpec:
    return Window.partitionBy("symbol", "d").orderBy("acc")



def normalise(raw: DataFrame) -> DataFrame:
    """Ticks of text columns price, vol and acc, cast; rows that cannot be cast or are not above 0 go; sides in upper case."""
    rows = raw.withColumns(
        {
            "price": F.expr("try_cast(price AS double)"),
            "vol": F.expr("try_cast(vol AS bigint)"),
            "acc": F.expr("try_cast(acc AS bigint)"),
            "side": F.upper(F.coalesce("side", F.lit(""))),
        }
    )
    return rows.where((F.col("price") > 0) & (F.col("vol") > 0) & F.col("acc").isNotNull())


def newest_session(ticks: DataFrame) -> DataFrame:
    """Ticks of each symbol's last date."""
    last = ticks.groupBy("symbol").agg(F.max("d").alias("d"))
    return ticks.join(last, ["symbol", "d"], "left_semi")


def first_of_each(ticks: DataFrame, arrival: str) -> DataFrame:
    """The first arrival of each running total."""
    order = Window.partitionBy("symbol", "d", "acc").orderBy(arrival)
    return ticks.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def shortfall(ticks: DataFrame, share: float = 0.002, points: int = 3) -> DataFrame:
    """symbol, d, gap, gap_points, accepted: shares that the running total counts but no tick has, and at how many places.

    Rejected: more ticks than counted, a gap above the share, or one in too many places.
    """
    rows = ticks.withColumn("__jump", (F.col("acc") != F.coalesce(F.lag("acc").over(day()), F.lit(0)) + F.col("vol")).cast("int"))
    out = rows.groupBy("symbol", "d").agg((F.max("acc") - F.sum("vol")).alias("gap"), F.sum("__jump").alias("gap_points"), F.max("acc").alias("__acc"))
    bad = (F.col("gap") < 0) | (F.col("gap") > share * F.col("__acc")) | ((F.col("gap") > 0) & (F.col("gap_points") > points))
    return out.withColumn("accepted", ~bad).drop("__acc")


def settled(minutes: DataFrame, cut: int = 14 * 3600 + 44 * 60) -> DataFrame:
    """symbol, d, n, settled: whether the last minute bar is at or after the closing auction."""
    return minutes.groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("n"), (F.max("sec") >= cut).alias("settled"))


def quorum(sessions: DataFrame, least_bars: int = 30, share: float = 0.2) -> DataFrame:
    """d, voters, lacking, wait: dates on which a share of the symbols with enough bars is not settled."""
    votes = sessions.where(F.col("n") >= least_bars)
    out = votes.groupBy("d").agg(F.count(F.lit(1)).alias("voters"), F.count_if(~F.col("settled")).alias("lacking"))
    return out.withColumn("wait", F.col("lacking") >= share * F.col("voters"))


def days_of(minutes: DataFrame) -> DataFrame:
    """Daily bars of minute bars."""
    return minutes.groupBy("symbol", "d").agg(
        F.min_by("o", "sec").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "sec").alias("c"), F.sum("v").alias("v")
    )


def merge_today(daily: DataFrame, minutes: DataFrame) -> DataFrame:
    """daily, with the minutes' bar wherever it has strictly more volume."""
    own = minutes.select("symbol", "d", F.struct("o", "h", "l", "c", "v").alias("__m"))
    rows = daily.join(own, ["symbol", "d"], "left")
    better = F.coalesce(F.col("__m.v") > F.col("v"), F.lit(False))
    return rows.select("symbol", "d", *[F.when(better, F.col(f"__m.{x}")).otherwise(F.col(x)).alias(x) for x in "ohlcv"])


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both, new ones in place of stored ones of the same (symbol, d), with status: kept, changed, added or same."""
    values = [F.col(x) for x in "ohlcv"]
    a = stored.select("symbol", "d", F.struct(*values).alias("__a"))
    b = new.select("symbol", "d", F.struct(*values).alias("__b"))
    rows = a.join(b, ["symbol", "d"], "full")
    status = F.when(F.col("__b").isNull(), "kept").when(F.col("__a").isNull(), "added").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return rows.withColumn("status", status).withColumn("__x", F.coalesce("__b", "__a")).select("symbol", "d", "__x.*", "status")


def readjusted(stored: DataFrame, new: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """symbol, d, ratio: symbols whose past closes were adjusted: the date of the worst ratio, the earliest of equals.

    The last new bar is left out, as it may still be trading.
    """
    last = new.groupBy("symbol").agg(F.max("d").alias("__last"))
    rows = stored.select("symbol", "d", F.col("c").alias("__old")).join(new.select("symbol", "d", "c"), ["symbol", "d"]).join(last, "symbol").where("d < __last")
    rows = rows.withColumn("ratio", F.col("c") / F.nullif(F.col("__old"), F.lit(0.0)))
    rows = rows.withColumn("off", F.round(F.abs(F.col("ratio") - 1), 9)).where(F.col("off") > tolerance)
    worst = Window.partitionBy("symbol").orderBy(F.desc("off"), "d")
    return rows.withColumn("__n", F.row_number().over(worst)).where("__n = 1").select("symbol", "d", "ratio")


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("symbol").distinct(), "symbol", "left_anti")


def close_asof(asked: DataFrame, bars: DataFrame) -> DataFrame:
    """asked (symbol, d) with the close of the latest bar up to d: one union and one window, not a join by range."""
    key = F.struct(F.lit(0).alias("kind"), F.col("c").alias("c"))
    both = bars.select("symbol", "d", F.lit(0).alias("__ask"), key.alias("__bar")).unionByName(asked.select("symbol", "d", F.lit(1).alias("__ask"), F.lit(None).cast("struct<kind:int,c:double>").alias("__bar")))
    order = Window.partitionBy("symbol").orderBy("d", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("close", F.last("__bar", ignorenulls=True).over(order)["c"]).where("__ask = 1").select("symbol", "d", "close")


def put_sessions(stored: DataFrame, new: DataFrame, keep: int = 70) -> DataFrame:
    """Sessions (symbol, d, est, total) of both: a real one beats an estimate, the older one beats its equal; the last `keep` of each symbol stay."""
    both = stored.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    best = Window.partitionBy("symbol", "d").orderBy("est", "__age")
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    rows = both.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return rows.withColumn("__k", F.dense_rank().over(late)).where(F.col("__k") <= keep).drop("__age", "__n", "__k")


def bag_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, n: how the sides of two sources' ticks agree; each tick meets one of equal time, price and volume at most, in the order of acc."""
    keys = ["symbol", "d", "sec", "price", "vol"]

    def counted(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("acc", "side")
        return rows.withColumn("price", F.round("price", 3)).withColumn("__n", F.row_number().over(order)).select(*keys, "__n", F.col("side").alias(name))

    met = counted(left, "a").join(counted(right, "b"), [*keys, "__n"], "left")
    return met.groupBy(F.concat_ws("/", "a", F.coalesce("b", F.lit("-"))).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def volume_check(totals: DataFrame, daily: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """symbol, d, off: sessions whose ticks' total is off the daily volume by more than the tolerance."""
    rows = totals.join(daily.select("symbol", "d", "v"), ["symbol", "d"]).where("v > 0")
    off: Column = F.abs(F.col("total") - F.col("v")) / F.col("v")
    return rows.withColumn("off", off).where(F.col("off") > tolerance).select("symbol", "d", "off")


def new_alerts(found: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts of (symbol, d) that were not sent yet."""
    return found.join(sent.select("symbol", "d").distinct(), ["symbol", "d"], "left_anti")


def sent_after(sent: DataFrame, found: DataFrame, day: DataFrame, keep: int = 30) -> DataFrame:
    """symbol, d, fresh: what counts as sent once the new ones of found are: nothing older than `keep` days before `day` (one row, day)."""
    both = sent.select("symbol", "d").distinct().withColumn("fresh", F.lit(False)).unionByName(new_alerts(found, sent).select("symbol", "d").distinct().withColumn("fresh", F.lit(True)))
    return both.join(F.broadcast(day), F.col("d") >= F.date_sub("day", keep), "left_semi")  # one row


def payloads(alerts: DataFrame, most: int = 6) -> DataFrame:
    """d, n, body: one text for each date's alerts, a digest of counts if there are more than `most`."""
    line = F.format_string("%s %s %.2f", F.col("symbol"), F.col("direction"), F.col("level"))
    rows = alerts.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(line)).alias("lines"), F.count_if(F.col("direction") == "up").alias("ups"))
    digest = F.format_string("%d alerts: %d up, %d down", F.col("n"), F.col("ups"), F.col("n") - F.col("ups"))
    return rows.select("d", "n", F.when(F.col("n") > most, digest).otherwise(F.array_join("lines", "; ")).alias("body"))


def drop_unsettled(bars: DataFrame, now: Column, settled: str = "15:30") -> DataFrame:
    """bars without one dated today, before the time of day at which a session's bar is settled."""
    today = (F.col("d") == F.to_date(now)) & (F.date_format(now, "HH:mm") < settled)
    return bars.where(~F.coalesce(today, F.lit(False)))


def replace_history(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored, with every bar of the symbols that new has replaced by those of new."""
    return stored.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new)


def stale(bars: DataFrame, trade_date: DataFrame) -> DataFrame:
    """symbol, last_date: symbols whose last bar is not of the trade date (one row, d)."""
    last = bars.groupBy("symbol").agg(F.max("d").alias("last_date"))
    return last.join(F.broadcast(trade_date), F.col("last_date") != F.col("d"), "left_semi")  # one row


def settled_days(minutes: DataFrame, closing: int = 53_040) -> DataFrame:
    """symbol, d, settled: days of minute bars that may be built from; older days without the closing auction are left out."""
    days = minutes.groupBy("symbol", "d").agg((F.max("sec") >= closing).alias("settled"))
    newest = Window.partitionBy("symbol")
    return days.withColumn("__last", F.max("d").over(newest)).where(F.col("settled") | (F.col("d") == F.col("__last"))).drop("__last")


def put_records(stored: DataFrame, new: DataFrame, keep: int = 60) -> DataFrame:
    """Records (symbol, d, ...) of both, new ones in place of stored ones; the last `keep` dates of all stay."""
    both = stored.join(new.select("symbol", "d"), ["symbol", "d"], "left_anti").unionByName(new)
    last = both.select("d").distinct().orderBy(F.desc("d")).limit(keep)
    return both.join(F.broadcast(last), "d", "left_semi")  # `keep` rows
