"""Hidden algorithmic flow: equal orders at a steady beat, and baskets of many symbols in one second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rolling import true

MIN_ORDERS = 100
MIN_SIZE = 500
#: (longest gap in seconds, fewest orders) of the two passes that look for a steady beat, and of the last one, for even gaps.
STEADY = ((600, 6), (180, 6))
EVEN = (180, 8, 0.3)
TOLERANCE, SHARE = 0.15, 0.85
BASKET_SYMBOLS = 5
#: Seconds of the auctions, which gather orders of all symbols anyway.
SKIPPED = (9 * 3600 + 15 * 60, 13 * 3600)


def day() -> WindowSpec:
    return Window.partitionBy("symbol", "d").orderBy("acc")


def active_orders(ticks: DataFrame) -> DataFrame:
    """symbol, d, i, sec, side (B or S), vol, price: ticks of one second and side in a row, auctions left out first."""
    rows = ticks.where(F.col("side").isin("PS", "PB")).withColumn("side", F.when(F.col("side") == "PS", "B").otherwise("S"))
    new = ~(F.col("sec").eqNullSafe(F.lag("sec").over(day())) & F.col("side").eqNullSafe(F.lag("side").over(day())))
    rows = rows.withColumn("i", F.sum(new.cast("int")).over(day()))
    return rows.groupBy("symbol", "d", "i").agg(
        F.first("sec").alias("sec"), F.first("side").alias("side"), F.sum("vol").alias("vol"), F.max_by("price", "acc").alias("price")
    )


def candles(orders: DataFrame, seconds: int = 300) -> DataFrame:
    """Candles of active orders with bought and sold volume."""
    return orders.groupBy("symbol", "d", (F.floor(F.col("sec") / seconds) * seconds).cast("int").alias("start")).agg(
        F.min_by("price", "i").alias("o"),
        F.max("price").alias("h"),
        F.min("price").alias("l"),
        F.max_by("price", "i").alias("c"),
        F.sum(F.when(F.col("side") == "B", F.col("vol")).otherwise(0)).alias("buy"),
        F.sum(F.when(F.col("side") == "S", F.col("vol")).otherwise(0)).alias("sell"),
    )


def segments(orders: DataFrame, gap: int) -> DataFrame:
    """orders with `seg`: within one side and exact volume, a new one after a gap of more than `gap` seconds; and the gap before each."""
    order = Window.partitionBy("symbol", "d", "side", "vol").orderBy("sec", "i")
    before = F.col("sec") - F.lag("sec").over(order)
    rows = orders.withColumn("__g", before)
    rows = rows.withColumn("seg", F.sum(F.when(F.col("__g") <= gap, 0).otherwise(1)).over(order))
    return rows.withColumn("gap", F.when(F.col("__g") <= gap, F.col("__g"))).drop("__g")


_SEGMENT = ("symbol", "d", "side", "vol", "seg")


def on_beat(rows: DataFrame) -> DataFrame:
    """segments with beat, their median gap, good and missed: whether a gap is on the beat, and how many beats it left out.

    A gap of one to three beats within TOLERANCE of a beat is on it.
    """
    beat = F.percentile("gap", F.lit(0.5)).over(Window.partitionBy(*_SEGMENT))
    rows = rows.withColumn("beat", beat)
    times = F.rint(F.col("gap") / F.nullif(F.col("beat"), F.lit(0.0)))
    good = times.between(1, 3) & (F.abs(F.col("gap") - times * F.col("beat")) <= TOLERANCE * F.col("beat"))
    return rows.withColumns({"good": F.coalesce(good, F.lit(False)).cast("int"), "missed": F.when(good, times - 1).otherwise(0)})


def _cv(own: WindowSpec | None = None) -> Column:
    over = lambda x: x if own is None else x.over(own)
    return F.when(over(F.avg("gap")) > 0, over(F.stddev_pop("gap")) / over(F.avg("gap"))).otherwise(9.0)


def _measures() -> dict[str, Column]:
    """Of a segment: n, first, last, cv of its gaps, the share of gaps on the beat and missed beats."""
    return {
        "n": F.count(F.lit(1)),
        "first": F.min("sec"),
        "last": F.max("sec"),
        "avg_price": F.avg("price"),
        "cv": _cv(),
        "beat": F.first("beat"),
        "good": F.sum("good"),
        "missed": F.sum("missed").cast("long"),
        "gaps": F.count("gap"),
        "prices": F.collect_list("price"),
    }


def measured(rows: DataFrame) -> DataFrame:
    """One row per segment with what _measures() tells of it."""
    return on_beat(rows).groupBy(*_SEGMENT).agg(*[how.alias(name) for name, how in _measures().items()])


def chains(orders: DataFrame, min_size: int = MIN_SIZE, steady=STEADY, even=EVEN) -> DataFrame:
    """symbol, d, side, size, rule, n, first, last, cv, missed, avg_price, prices: orders of one exact size at a steady beat.

    Three passes over the orders of a size: segments of the long gap, then of the short one, then even
    ones. A later segment with any order that an earlier pass used is out. All passes are windows over the orders
    of a symbol's day, side and size, so orders are made and dealt once.
    """
    rows = orders.where(F.col("vol") >= min_size).withColumn("__used", F.lit(False))
    passes = [(gap, lambda x, n=n: (x("n") >= n) & (x("beat") > 0) & (x("good") >= SHARE * x("gaps"))) for gap, n in steady]
    passes.append((even[0], lambda x: (x("n") >= even[1]) & (x("cv") < even[2])))
    hits = []
    for k, (gap, rule) in enumerate(passes):
        rows = on_beat(segments(rows, gap))
        own = Window.partitionBy(*_SEGMENT)
        of = {name: how.over(own) for name, how in _measures().items() if name in ("n", "good", "gaps")} | {"cv": _cv(own), "beat": F.col("beat")}
        taken = F.max("__used").over(own)
        rows = rows.withColumns({"__rule": true(rule(of.get)), "__taken": taken}).withColumn("__hit", F.col("__rule") & ~F.col("__taken"))
        kept = F.struct(F.lit(k).alias("rule"), *[F.col(c).alias(c) for c in ("seg", "gap", "beat", "good", "missed")])
        rows = rows.withColumn(f"__{k}", F.when(F.col("__hit"), kept))
        met = F.col("symbol").isNotNull() & F.col("d").isNotNull()  # else it is equal to nothing
        rows = rows.withColumn("__used", F.col("__used") | (F.col("__hit") & met)).drop("seg", "gap", "beat", "good", "missed", "__rule", "__taken", "__hit")
        hits.append(f"__{k}")
    found = rows.select("symbol", "d", "side", "vol", "sec", "price", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("*", "x.*")
    found = found.groupBy(*_SEGMENT, "rule").agg(*[how.alias(name) for name, how in _measures().items()])
    return found.select("symbol", "d", "side", F.col("vol").alias("size"), "rule", "n", "first", "last", "cv", "missed", "avg_price", "prices")


def shuffled(orders: DataFrame, seed: int) -> DataFrame:
    """The null: times and prices stay, (side, vol) are dealt anew within each day, in the order of a hash."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "symbol", F.col("d").cast("string"), F.col("i").cast("string")))
    dealt = orders.select("symbol", "d", "side", "vol", F.row_number().over(Window.partitionBy("symbol", "d").orderBy(key)).alias("i"))
    return orders.select("symbol", "d", "i", "sec", "price").join(dealt, ["symbol", "d", "i"])


#: Shuffles whose mean is the null of chains, and how far the null of baskets shifts a symbol's time.
SHUFFLES, SHIFT = 5, 1800


def replicated(orders: DataFrame, shuffles: int = SHUFFLES) -> DataFrame:
    """orders as they are (symbol 'S#0') and under each of so many shuffles ('S#1', ...): the replicate is a dimension, so one plan judges all."""
    rows = orders.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(shuffles))))
    key = F.md5(F.concat_ws("|", "rep", "symbol", F.col("d").cast("string"), F.col("i").cast("string")))
    order = Window.partitionBy("symbol", "d", "rep").orderBy(F.when(F.col("rep") == 0, F.col("i")), key)
    dealt = rows.select("symbol", "d", "rep", "side", "vol", F.row_number().over(order).alias("i"))
    met = orders.select("symbol", "d", "i", "sec", "price").join(dealt, ["symbol", "d", "i"])
    return met.withColumn("symbol", F.concat_ws("#", "symbol", "rep")).drop("rep")


def chain_null(orders: DataFrame, min_size: int, steady: tuple, even: tuple, shuffles: int = SHUFFLES) -> DataFrame:
    """symbol, d, chains, fake: how many chains a symbol's day has, and how many on average once its orders are shuffled. Days without any count too."""
    found = chains(replicated(orders, shuffles), min_size, steady, even)
    name = F.split("symbol", "#")
    found = found.select(name[0].alias("symbol"), "d", (name[1] == "0").alias("own"))
    counts = found.groupBy("symbol", "d").agg(F.count_if("own").alias("chains"), (F.count_if(~F.col("own")) / shuffles).alias("fake"))
    return orders.select("symbol", "d").distinct().join(counts, ["symbol", "d"], "left").fillna({"chains": 0, "fake": 0.0})


def basket_null(orders: DataFrame, least_value: float, symbols: int = BASKET_SYMBOLS, unit: int = 1) -> DataFrame:
    """d, baskets, fake: how many baskets a day has, and how many once every symbol's time is shifted by up to SHIFT seconds, in whole units, by a hash of its name."""
    most = SHIFT // unit
    by = (F.conv(F.substring(F.sha1(F.concat_ws("|", "symbol", F.lit("7"))), 1, 8), 16, 10).cast("long") % (2 * most + 1) - most) * unit
    rows = orders.where((F.col("vol") * F.col("price") >= least_value) & ~F.col("sec").isin(*SKIPPED)).select("symbol", "d", "side", "sec", by.alias("by"))
    rows = rows.withColumn("fake", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("at", F.col("sec") + F.when(F.col("fake"), F.col("by")).otherwise(0))
    met = rows.groupBy("d", "fake", "at", "side").agg(F.countDistinct("symbol").alias("n")).where(F.col("n") >= symbols)
    return met.groupBy("d").agg(F.count_if(~F.col("fake")).alias("baskets"), F.count_if("fake").alias("fake"))


def flow_null(by_chain: DataFrame, by_basket: DataFrame) -> DataFrame:
    """d, chains, chains_null, chains_false, baskets, baskets_null, baskets_false: what a day has, what chance gives, and the share of the former that chance explains (null without any)."""
    chained = by_chain.groupBy("d").agg(F.sum("chains").alias("chains"), F.sum("fake").alias("chains_null"))
    rows = chained.join(by_basket.select("d", "baskets", F.col("fake").alias("baskets_null")), "d", "left").fillna(0, ["baskets", "baskets_null"])
    false = {f"{x}_false": F.least(F.col(f"{x}_null") / F.nullif(F.col(x), F.lit(0)), F.lit(1.0)) for x in ("chains", "baskets")}
    return rows.withColumns(false)


def baskets(orders: DataFrame, least_value: float, symbols: int = BASKET_SYMBOLS) -> DataFrame:
    """d, sec, side, n, val, members: seconds in which at least so many symbols have a large order on one side."""
    value = F.col("vol") * F.col("price")
    rows = orders.where((value >= least_value) & ~F.col("sec").isin(*SKIPPED))
    return (
        rows.groupBy("d", "sec", "side")
        .agg(F.countDistinct("symbol").alias("n"), F.sum(value).alias("val"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("members"))
        .where(F.col("n") >= symbols)
    )


def symbol_day(orders: DataFrame, whale: float, least: int = MIN_ORDERS) -> DataFrame:
    """symbol, d, n, open, close, vwap, val and the value of large orders by side, for days with enough orders."""
    value = F.col("vol") * F.col("price")

    def large(side: str) -> Column:
        return F.sum(F.when((value >= whale) & (F.col("side") == side), value).otherwise(0.0))

    return (
        orders.groupBy("symbol", "d")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("price", "i").alias("open"),
            F.max_by("price", "i").alias("close"),
            (F.sum(value) / F.sum("vol")).alias("vwap"),
            F.sum(value).alias("val"),
            large("B").alias("whale_buy"),
            large("S").alias("whale_sell"),
        )
        .where(F.col("n") >= least)
    )


def day_view(found: DataFrame, days: DataFrame) -> DataFrame:
    """chains with val, pct of the day's value, waves (chains of that side and size), deviation from vwap and carry: seen on the symbol's day before."""
    value = F.col("n") * F.col("size") * F.col("avg_price")
    rows = found.join(days.select("symbol", "d", "vwap", F.col("val").alias("day_val")), ["symbol", "d"])
    rows = rows.withColumns(
        {
            "val": value,
            "pct": 100 * value / F.nullif(F.col("day_val"), F.lit(0.0)),
            "waves": F.count(F.lit(1)).over(Window.partitionBy("symbol", "d", "side", "size")),
            "dev": 100 * (F.col("avg_price") / F.col("vwap") - 1),
        }
    )
    order = days.select("symbol", "d").withColumn("next", F.lead("d").over(Window.partitionBy("symbol").orderBy("d")))
    seen = found.select("symbol", "d", "side", "size").distinct().join(order, ["symbol", "d"]).select("symbol", F.col("next").alias("d"), "side", "size", F.lit(True).alias("carry"))
    return rows.join(seen, ["symbol", "d", "side", "size"], "left").withColumn("carry", F.coalesce("carry", F.lit(False)))


def basket_members(orders: DataFrame, least_value: float, symbols: int = BASKET_SYMBOLS) -> DataFrame:
    """Large orders with val and in_basket: whether a basket of their second and side has them."""
    value = F.col("vol") * F.col("price")
    keys = baskets(orders, least_value, symbols).select("d", "sec", "side", F.lit(True).alias("in_basket"))
    rows = orders.withColumn("val", value).where(F.col("val") >= least_value)
    return rows.join(keys, ["d", "sec", "side"], "left").withColumn("in_basket", F.coalesce("in_basket", F.lit(False)))


def combined(days: DataFrame, found: DataFrame, members: DataFrame, whale: float) -> DataFrame:
    """symbol, d, algo, bk, whale, comb: net value of a day's chains, of its large orders in baskets, of its large orders, and all that together.

    What chains and large orders both have counts once, and large orders that belong to baskets do not count.
    """
    sign = F.when(F.col("side") == "B", 1).otherwise(-1)
    value = F.aggregate("prices", F.lit(0.0), lambda a, p: a + p * F.col("size"))
    large = F.aggregate("prices", F.lit(0.0), lambda a, p: a + F.when(p * F.col("size") >= whale, p * F.col("size")).otherwise(0.0))
    by_chain = found.groupBy("symbol", "d").agg(F.sum(sign * value).alias("algo"), F.sum(sign * large).alias("overlap"))
    by_basket = members.where("in_basket").groupBy("symbol", "d").agg(F.sum(sign * F.col("val")).alias("bk"), F.sum(F.when(F.col("val") >= whale, sign * F.col("val")).otherwise(0.0)).alias("bk_whale"))
    rows = days.select("symbol", "d", (F.col("whale_buy") - F.col("whale_sell")).alias("whale"))
    rows = rows.join(by_chain, ["symbol", "d"], "left").join(by_basket, ["symbol", "d"], "left").fillna(0.0, ["algo", "overlap", "bk", "bk_whale"])
    return rows.withColumn("comb", F.col("whale") + F.col("algo") - F.col("overlap") - F.col("bk_whale"))


def site_index(days: DataFrame, found: DataFrame, keep: int = 20) -> DataFrame:
    """d, symbols, chains, net and whale of the last `keep` sessions."""
    last = days.select("d").distinct().orderBy(F.desc("d")).limit(keep)
    sign = F.when(F.col("side") == "B", 1).otherwise(-1)
    by_chain = found.groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("chains"), F.sum(sign * F.col("n") * F.col("size") * F.col("avg_price")).alias("net"))
    rows = days.join(F.broadcast(last), "d", "left_semi").join(by_chain, ["symbol", "d"], "left")  # `keep` rows
    return rows.groupBy("d").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.coalesce(F.sum("chains"), F.lit(0)).alias("chains"),
        F.coalesce(F.sum("net"), F.lit(0.0)).alias("net"),
        F.sum(F.col("whale_buy") - F.col("whale_sell")).alias("whale"),
    )
