"""Candlestick patterns: each one a condition on a bar and the bars before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import by_symbol, roll, true

#: Fixed values of the rules.
SMALL, DOJI, SHADOW, OTHER_SHADOW, SOLID, BIG = 0.30, 0.10, 2.0, 0.10, 0.60, 0.80
LIMIT, CLIMAX_BODY, CLIMAX_CLOSE, CLIMAX_VOLUME = 0.065, 2.0, 0.8, 2.0
METHODS_BODY, METHODS_REACH = 0.5, 0.10
FIRST_ROW = 12

#: name -> (bars, side)
PATTERNS = {
    "bull_engulfing": (2, "buy"),
    "bear_engulfing": (2, "sell"),
    "morning_star": (3, "buy"),
    "evening_star": (3, "sell"),
    "morning_doji_star": (3, "buy"),
    "evening_doji_star": (3, "sell"),
    "three_white_soldiers": (3, "buy"),
    "three_black_crows": (3, "sell"),
    "hammer_confirm": (2, "buy"),
    "hanging_man_confirm": (2, "sell"),
    "inv_hammer_confirm": (2, "buy"),
    "shooting_star_confirm": (2, "sell"),
    "piercing": (2, "buy"),
    "dark_cloud": (2, "sell"),
    "three_inside_down": (3, "sell"),
    "limit_up_climax": (1, "buy"),
    "limit_down_volume": (1, "buy"),
    "falling_three_methods": (5, "sell"),
}


class Candle:
    """Expressions on the bar n rows back, from the columns that `with_lags` made."""

    def __init__(self, n: int):
        self.o, self.h, self.l, self.c = (F.col(f"__{x}{n}") for x in "ohlc")
        self.body = F.abs(self.c - self.o)
        self.spread = self.h - self.l
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.upper, self.lower = self.h - self.top, self.bottom - self.l
        self.mid = (self.o + self.c) / 2
        self.bull, self.bear = self.c > self.o, self.c < self.o
        self.big = self.body >= BIG * F.col("__body10")
        small = self.body <= SMALL * self.spread
        self.doji = self.body <= DOJI * self.spread
        self.solid = self.body / F.nullif(self.spread, F.lit(0.0)) > SOLID
        self.hammer = small & (self.lower >= SHADOW * self.body) & (self.upper <= OTHER_SHADOW * self.spread)
        self.inverted = small & (self.upper >= SHADOW * self.body) & (self.lower <= OTHER_SHADOW * self.spread)


def with_lags(bars: DataFrame) -> DataFrame:
    """bars with the prices of this bar and the four before it, mean body of 10, mean volume and highest close of 20 bars before."""
    lags = {f"__{x}{n}": F.lag(x, n).over(by_symbol()) if n else F.col(x) for x in "ohlc" for n in range(5)}
    return bars.withColumns(
        lags
        | {
            "__row": F.row_number().over(by_symbol()),
            "__body10": roll(F.avg, F.abs(F.col("c") - F.col("o")), 10, 1),
            "__v20": roll(F.avg, "v", 20, 1),
            "__c20": roll(F.max, "c", 20, 1),
        }
    )


def conditions() -> dict[str, Column]:
    c, p, a = Candle(0), Candle(1), Candle(2)
    first, mids = Candle(4), [Candle(3), Candle(2), Candle(1)]
    change = c.c / p.c - 1

    def star(up: bool, doji: bool) -> Column:
        middle = (p.body <= 0.3 * a.body) & (p.doji if doji else F.lit(True))
        return a.big & middle & ((a.bear & c.bull & (c.c > a.mid)) if up else (a.bull & c.bear & (c.c < a.mid)))

    def march(up: bool) -> Column:
        side = [x.bull if up else x.bear for x in (a, p, c)]
        further = ((p.c > a.c) & (c.c > p.c)) if up else ((p.c < a.c) & (c.c < p.c))
        inside = (p.o > a.bottom) & (p.o < a.top) & (c.o > p.bottom) & (c.o < p.top)
        return side[0] & side[1] & side[2] & a.solid & p.solid & c.solid & further & inside

    rest = F.lit(True)
    for m in mids:
        reach = METHODS_REACH * first.spread
        rest = rest & (m.body <= METHODS_BODY * first.body) & (m.h <= first.h + reach) & (m.l >= first.l - reach)
    return {
        "bull_engulfing": p.bear & c.bull & c.big & (c.o <= p.c) & (c.c >= p.o),
        "bear_engulfing": p.bull & c.bear & c.big & (c.o >= p.c) & (c.c <= p.o),
        "morning_star": star(True, False),
        "evening_star": star(False, False),
        "morning_doji_star": star(True, True),
        "evening_doji_star": star(False, True),
        "three_white_soldiers": march(True),
        "three_black_crows": march(False),
        "hammer_confirm": p.hammer & c.bull & (c.c > p.h),
        "hanging_man_confirm": p.hammer & c.bear & (c.c < p.l),
        "inv_hammer_confirm": p.inverted & c.bull & (c.c > p.h),
        "shooting_star_confirm": p.inverted & c.bear & (c.c < p.l),
        "piercing": p.bear & p.big & c.bull & (c.o <= p.c) & (c.c > p.mid) & (c.c < p.o),
        "dark_cloud": p.bull & p.big & c.bear & (c.o >= p.c) & (c.c < p.mid) & (c.c > p.o),
        "three_inside_down": a.bull & a.big & p.bear & (p.o <= a.c) & (p.c >= a.o) & c.bear & (c.c < p.l),
        "limit_up_climax": (F.col("__row") > 20)
        & (change >= LIMIT)
        & c.bull
        & (c.body >= CLIMAX_BODY * F.col("__body10"))
        & ((c.c - c.l) / F.nullif(c.spread, F.lit(0.0)) >= CLIMAX_CLOSE)
        & (F.col("v") >= CLIMAX_VOLUME * F.col("__v20"))
        & (c.c > F.col("__c20")),
        "limit_down_volume": (change <= -LIMIT) & (F.col("__v20") > 0) & (F.col("v") >= CLIMAX_VOLUME * F.col("__v20")),
        "falling_three_methods": first.bear & first.big & rest & c.bear & (c.c < first.c),
    }


def detect(bars: DataFrame, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """symbol, d, pattern, side, close: one row per pattern that ends at a bar.

    A pattern counts from the 12th bar of a symbol, when the mean body of the 10 bars before is above
    0 and every bar of the pattern has a range.
    """
    found = []
    for name, rule in conditions().items():
        n, side = PATTERNS[name]
        ready = (F.col("__row") >= FIRST_ROW) & (F.col("__body10") > 0)
        for k in range(n):
            ready = ready & (Candle(k).spread > 0)
        if name not in disabled:
            found.append(F.when(true(ready & rule), F.struct(F.lit(name).alias("pattern"), F.lit(side).alias("side"))))
    rows = with_lags(bars).withColumn("__found", F.explode(F.array_compact(F.array(*found))))
    return rows.select("symbol", "d", "__found.pattern", "__found.side", F.col("c").alias("close"))
