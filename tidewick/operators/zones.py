"""Volume by price: ticks to orders, price levels, sessions, profiles, zones and alerts.

Sides name the passive party: PS is an active purchase, PB an active sale, all others have no active
side. Price levels stay in long form, one row per (symbol, d, price).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Prices are in thousands; a sweep of this value or more counts as large.
BIG_VALUE = 500_000.0
MAX_BINS = 60
EPS = 1e-6
VALUE_AREA = 0.70
ZONE_VOLUME, BUY_SHARE, SELL_SHARE = 1.2, 0.58, 0.42


def day() -> WindowSpec:
    return Window.partitionBy("symbol", "d").orderBy("acc")


def active(side: str = "side") -> Column:
    return F.col(side).isin("PS", "PB")


def _islands(ticks: DataFrame, *same: str) -> DataFrame:
    """ticks with `run`, which grows where a column of `same` differs from the tick before or a side is not active."""
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(day()))
    return ticks.withColumn("run", F.sum(F.when(new | ~active(), 1).otherwise(0)).over(day()))


def orders(ticks: DataFrame) -> DataFrame:
    """Consecutive ticks of one second, price and active side are one order; others stay alone."""
    rows = _islands(ticks, "sec", "price", "side")
    return rows.groupBy("symbol", "d", "run").agg(
        F.first("sec").alias("sec"), F.first("price").alias("price"), F.first("side").alias("side"), F.sum("vol").alias("vol"), F.min("acc").alias("acc")
    ).drop("run")


def levels(ticks: DataFrame, big_value: float = BIG_VALUE) -> DataFrame:
    """symbol, d, price, buy, sell, x, big_buy, big_sell: volumes by exact price.

    Consecutive ticks of one second and active side are a sweep; all of a sweep is large if its value
    over all its prices is.
    """
    rows = _islands(ticks, "sec", "side")
    value = F.sum(F.col("price") * F.col("vol")).over(Window.partitionBy("symbol", "d", "run"))
    rows = rows.withColumn("big", value >= big_value)
    buy, sell = F.col("side") == "PS", F.col("side") == "PB"

    def volume(when: Column) -> Column:
        return F.sum(F.when(when, F.col("vol")).otherwise(0))

    return rows.groupBy("symbol", "d", F.round("price", 3).alias("price")).agg(
        volume(buy).alias("buy"),
        volume(sell).alias("sell"),
        volume(~active()).alias("x"),
        volume(buy & F.col("big")).alias("big_buy"),
        volume(sell & F.col("big")).alias("big_sell"),
    )


def sessions(ticks: DataFrame) -> DataFrame:
    """symbol, d, close (last tick), total, ticks and gap: shares that the running total counts but no tick has."""
    return ticks.groupBy("symbol", "d").agg(
        F.max_by("price", "acc").alias("close"),
        F.sum("vol").alias("total"),
        F.count(F.lit(1)).alias("ticks"),
        F.greatest(F.max("acc") - F.sum("vol"), F.lit(0)).alias("gap"),
    )


def session_stats(by_level: DataFrame) -> DataFrame:
    """Active flows of each session; values of large orders in billions, null without an active side."""
    total = by_level.groupBy("symbol", "d").agg(
        F.sum("buy").alias("buy"),
        F.sum("sell").alias("sell"),
        F.sum("x").alias("x"),
        F.sum(F.col("big_buy") * F.col("price")).alias("__b"),
        F.sum(F.col("big_sell") * F.col("price")).alias("__s"),
    )
    any_side = F.col("buy") + F.col("sell") > 0
    return total.select(
        "symbol",
        "d",
        "buy",
        "sell",
        "x",
        (F.col("buy") - F.col("sell")).alias("net"),
        F.when(any_side, F.col("buy") / (F.col("buy") + F.col("sell"))).alias("buy_share"),
        F.when(any_side, F.col("__b") / 1e6).alias("big_buy_val"),
        F.when(any_side, F.col("__s") / 1e6).alias("big_sell_val"),
        F.when(any_side, (F.col("__b") - F.col("__s")) / 1e6).alias("big_net_val"),
        (~any_side & (F.col("x") > 0)).alias("no_side"),
    )


def recent(rows: DataFrame, n: int) -> DataFrame:
    """Rows of each symbol's last n dates, with `back`: 1 for the last one."""
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    return rows.withColumn("back", F.dense_rank().over(late)).where(F.col("back") <= n)


def tick_size(price: Column) -> Column:
    return F.when(price < 10, 0.01).when(price < 50, 0.05).otherwise(0.1)


def profile(by_level: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """symbol, bin, lo, hi, and the volumes of dense price bins over all rows of a symbol.

    A bin is the least multiple of the tick size that gives at most max_bins; bins without volume are
    there with zeros, as the mean over bins counts them.
    """
    rows = by_level.where((F.col("price") > 0) & (F.col("buy") + F.col("sell") + F.col("x") > 0))
    span = rows.groupBy("symbol").agg(F.min("price").alias("__lo"), F.max("price").alias("__hi"))
    step = tick_size(F.col("__hi"))
    width = F.round(step * F.greatest(F.lit(1), F.ceil(F.greatest(F.col("__hi") - F.col("__lo"), step) / (step * max_bins) - EPS)), 4)
    span = span.withColumn("width", width)
    span = span.withColumn("base", F.round(F.floor(F.col("__lo") / F.col("width") + EPS) * F.col("width"), 4))
    span = span.withColumn("n", (F.floor((F.col("__hi") - F.col("base")) / F.col("width") + EPS) + 1).cast("int")).drop("__lo", "__hi")
    at = F.least(F.col("n") - 1, F.floor((F.col("price") - F.col("base")) / F.col("width") + EPS)).cast("int")
    sums = [F.sum(c).alias(c) for c in ("buy", "sell", "x", "big_buy", "big_sell")]
    filled = rows.join(span, "symbol").withColumn("bin", at).groupBy("symbol", "bin").agg(*sums, F.countDistinct("d").alias("sessions"))
    dense = span.select("symbol", "base", "width", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    out = dense.join(filled, ["symbol", "bin"], "left").na.fill(0)
    return out.select(
        "symbol",
        "bin",
        F.round(F.col("base") + F.col("bin") * F.col("width"), 4).alias("lo"),
        F.round(F.col("base") + (F.col("bin") + 1) * F.col("width"), 4).alias("hi"),
        "buy", "sell", "x", "big_buy", "big_sell", "sessions",
        (F.col("buy") + F.col("sell") + F.col("x")).alias("total"),
    )


def value_area(bins: DataFrame, share: float = VALUE_AREA) -> DataFrame:
    """symbol, poc, val_bin, vah_bin, total: the bin of most volume (the first of equals) and the area around it.

    The area grows to the larger neighbour, downwards between equals, until it holds the share of all
    volume. One fold over at most as many steps as there are bins.
    """
    lists = bins.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bin", "total"))).alias("b"), F.sum("total").alias("total"))
    lists = lists.withColumn("t", F.transform("b", lambda x: x["total"]))
    lists = lists.withColumn("poc", (F.array_position("t", F.array_max("t")) - 1).cast("int"))
    # F.get is null outside of the array: -1 stands for no neighbour
    below, above = "coalesce(IF(a.lo > 0, t[a.lo - 1], NULL), -1)", "coalesce(IF(a.hi < size(t) - 1, t[a.hi + 1], NULL), -1)"
    done = f"(a.acc >= total * {share}D OR ({below} < 0 AND {above} < 0))"
    step = f"IF({done}, a, IF({above} > {below}, named_struct('lo', a.lo, 'hi', a.hi + 1, 'acc', a.acc + {above}), named_struct('lo', a.lo - 1, 'hi', a.hi, 'acc', a.acc + {below})))"
    area = F.expr(f"aggregate(sequence(1, size(t)), named_struct('lo', poc, 'hi', poc, 'acc', t[poc]), (a, i) -> {step})")
    return lists.withColumn("area", area).select("symbol", "poc", F.col("area.lo").alias("val_bin"), F.col("area.hi").alias("vah_bin"), "total")


def zones(bins: DataFrame, buy: str = "buy", sell: str = "sell", total: Column | None = None) -> DataFrame:
    """symbol, side, lo, hi, vol, buy, sell, share: neighbouring bins of high volume that one side rules."""
    every = Window.partitionBy("symbol")
    total = F.col("total") if total is None else total
    share = F.col(buy) / F.nullif(F.col(buy) + F.col(sell), F.lit(0))
    mean = F.sum(total).over(every) / F.count(F.lit(1)).over(every)
    side = F.when(share >= BUY_SHARE, "buy").when(share <= SELL_SHARE, "sell")
    rows = bins.withColumn("vol", total).withColumn("side", F.when((mean > 0) & (total >= ZONE_VOLUME * mean), side))
    order = Window.partitionBy("symbol").orderBy("bin")
    rows = rows.withColumn("run", F.sum(F.when(F.col("side").eqNullSafe(F.lag("side").over(order)), 0).otherwise(1)).over(order))
    return (
        rows.where("side IS NOT NULL")
        .groupBy("symbol", "run", "side")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("vol").alias("vol"), F.sum(buy).alias("buy"), F.sum(sell).alias("sell"))
        .select("symbol", "side", "lo", "hi", "vol", "buy", "sell", (F.col("buy") / (F.col("buy") + F.col("sell"))).alias("share"))
    )


def top_levels(by_level: DataFrame, n: int = 5) -> DataFrame:
    """symbol, kind, rank, price, vol, pct, sessions: the exact prices of most volume, for each of four kinds."""
    size = tick_size(F.col("price"))
    rounded = by_level.withColumn("price", F.round(F.rint(F.col("price") / size) * size, 4))
    sums = rounded.groupBy("symbol", "price").agg(*[F.sum(c).alias(c) for c in ("buy", "sell", "big_buy", "big_sell")], F.countDistinct("d").alias("sessions"))
    rows = sums.select("symbol", "price", "sessions", F.expr("stack(4, 'buy', buy, 'sell', sell, 'big_buy', big_buy, 'big_sell', big_sell) AS (kind, vol)"))
    rows = rows.withColumn("pct", F.col("vol") / F.nullif(F.sum("vol").over(Window.partitionBy("symbol", "kind")), F.lit(0)))
    best = Window.partitionBy("symbol", "kind").orderBy(F.desc("vol"), "price")
    return rows.where("vol > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("symbol", "kind", "rank", "price", "vol", "pct", "sessions")


def market_row(stats: DataFrame, n: int = 5) -> DataFrame:
    """Each symbol's last session and its last n sessions summed."""
    rows = recent(stats, n)
    last = F.col("back") == 1
    return rows.groupBy("symbol").agg(
        F.max("d").alias("d"),
        F.sum(F.when(last, F.col("net"))).alias("net"),
        F.sum("buy").alias("buy_n"),
        F.sum("sell").alias("sell_n"),
        F.sum("net").alias("net_n"),
        F.sum("big_net_val").alias("big_net_n"),
    )


def force(buy: Column, sell: Column, change: Column) -> Column:
    """Who moves the price in a session: none, bal, up, prop, down or dist."""
    flow = (buy - sell) / F.nullif(buy + sell, F.lit(0))
    change = F.coalesce(change, F.lit(0.0))
    return (
        F.when(flow.isNull(), "none")
        .when(F.abs(flow) < 0.05, "bal")
        .when(flow > 0, F.when(change > 0.003, "up").otherwise("prop"))
        .otherwise(F.when(change < -0.003, "down").otherwise("dist"))
    )


def with_change(stats: DataFrame, closes: DataFrame) -> DataFrame:
    """stats with the session's close c, the close before it pc, and force."""
    own = Window.partitionBy("symbol").orderBy("d")
    rows = stats.join(closes.select("symbol", "d", F.col("close").alias("c")), ["symbol", "d"]).withColumn("pc", F.lag("c").over(own))
    return rows.withColumn("force", force(F.col("buy"), F.col("sell"), F.col("c") / F.col("pc") - 1))


def verdict(rows: DataFrame, n: int = 10) -> DataFrame:
    """symbol, n, flow, chg, verdict over the last n sessions of with_change.

    A force that rules half of the sessions names the verdict; if half have none, there is none; else
    the window's flow and change are classified.
    """
    late = recent(rows, n)
    forces = ("up", "prop", "down", "dist", "bal", "none")
    sums = late.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("buy").alias("buy"),
        F.sum("sell").alias("sell"),
        F.min_by(F.coalesce("pc", "c"), "d").alias("base"),
        F.max_by("c", "d").alias("last"),
        *[F.count_if(F.col("force") == f).alias(f"n_{f}") for f in forces],
    )
    flow = (F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0))
    out = sums.withColumns({"flow": flow, "chg": F.col("last") / F.col("base") - 1})
    up, down = F.col("chg") >= 0.015, F.col("chg") <= -0.015
    whole = (
        F.when(F.col("flow").isNull(), "none")
        .when(F.col("flow") >= 0.05, F.when(up, "chased_up").when(down, "held_down").otherwise("absorbed_in"))
        .when(F.col("flow") <= -0.05, F.when(down, "sold_down").when(up, "sold_into").otherwise("absorbed_out"))
        .otherwise("bal")
    )
    named = F.when(F.col("n_none") * 2 >= F.col("n"), "none")
    for f in forces[:-1]:
        most = F.lit(True)
        for g in forces[:-1]:
            most = most & (F.col(f"n_{f}") >= F.col(f"n_{g}"))
        named = named.when((F.col(f"n_{f}") * 2 >= F.col("n")) & most, f)
    return out.select("symbol", "n", "flow", "chg", named.otherwise(whole).alias("verdict"))


def estimate_levels(minutes: DataFrame, opening: int = 33300, closing: int = 53100) -> DataFrame:
    """symbol, d, price, buy, sell, x estimated from minute bars (symbol, d, sec, o, h, l, c, v).

    A rising bar bought, a falling one sold, a flat one goes by the close before or else carries on;
    bars up to the opening and from the closing auction on have no side. A bar's volume is spread evenly
    over its prices, the rest goes to the price nearest to its close.
    """
    order = Window.partitionBy("symbol", "d").orderBy("sec")
    pc = F.lag("c").over(order)
    own = (
        F.when(F.col("c") > F.col("o"), "buy")
        .when(F.col("c") < F.col("o"), "sell")
        .when(F.col("c") > pc, "buy")
        .when(F.col("c") < pc, "sell")
    )
    auction = (F.col("sec") <= opening) | (F.col("sec") >= closing)
    rows = minutes.withColumn("__own", F.when(~auction, own))
    carried = F.coalesce(F.last("__own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("buy"))
    rows = rows.withColumn("side", F.when(auction, "x").otherwise(carried)).where("v > 0")
    size = tick_size(F.col("c"))
    rows = rows.withColumns({"__lo": F.rint(F.col("l") / size).cast("long"), "__hi": F.rint(F.col("h") / size).cast("long"), "__size": size})
    rows = rows.withColumns({"__n": F.col("__hi") - F.col("__lo") + 1, "__near": F.least(F.greatest(F.rint(F.col("c") / size).cast("long"), "__lo"), "__hi")})
    grid = rows.withColumn("__k", F.explode(F.sequence("__lo", "__hi")))
    vol = F.floor(F.col("v") / F.col("__n")) + F.when(F.col("__k") == F.col("__near"), F.col("v") % F.col("__n")).otherwise(0)
    grid = grid.withColumns({"vol": vol.cast("long"), "price": F.round(F.col("__k") * F.col("__size"), 3)})
    return grid.groupBy("symbol", "d", "price").agg(*[F.sum(F.when(F.col("side") == s, F.col("vol")).otherwise(0)).alias(s) for s in ("buy", "sell", "x")])


def minute_bars(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """symbol, d, sec, o, h, l, c, v of each interval of ticks."""
    return ticks.groupBy("symbol", "d", (F.floor(F.col("sec") / seconds) * seconds).cast("int").alias("sec")).agg(
        F.min_by("price", "acc").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "acc").alias("c"), F.sum("vol").alias("v")
    )
