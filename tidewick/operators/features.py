"""Columns of the feature frame: one row per (symbol, d), from bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_symbol, ahead, back, roll, true

RETURNS = (1, 5, 10, 20)
HORIZONS = (5, 10, 20)
PATH = 20
RANK_WINDOW = 250
#: A day's change from which it counts as a limit day.
LIMIT = 0.065
GAP = 0.01
MIN_BARS = 60


def with_returns(bars: DataFrame) -> DataFrame:
    """r1, r5, r10, r20: log returns over so many sessions."""
    return bars.withColumns({f"r{k}": F.ln(F.col("c") / back("c", k)) for k in RETURNS})


def with_volatility(frame: DataFrame) -> DataFrame:
    """vol20: sample deviation of r1 over 20 sessions. Needs with_returns."""
    return frame.withColumn("vol20", roll(F.stddev_samp, "r1", 20))


def with_rank(frame: DataFrame, previous: int = RANK_WINDOW, name: str = "vol20_rank") -> DataFrame:
    """Share of the `previous` last values of vol20, today's not among them, that are below today's."""
    frame = frame.withColumn("__past", F.collect_list("vol20").over(by_symbol().rowsBetween(-previous, -1)))
    below = F.size(F.filter("__past", lambda x: x < F.col("vol20")))
    return frame.withColumn(name, F.when((F.size("__past") == previous) & F.col("vol20").isNotNull(), below / previous)).drop("__past")


def with_scores(frame: DataFrame) -> DataFrame:
    """z5, z10, z20: returns in units of what vol20 lets expect."""
    return frame.withColumns({f"z{k}": F.col(f"r{k}") / F.nullif(F.col("vol20") * F.sqrt(F.lit(float(k))), F.lit(0.0)) for k in HORIZONS})


def donchian() -> Column:
    """Place of the close between the lows and highs of the 20 sessions before."""
    lo, hi = roll(F.min, "l", 20, 1), roll(F.max, "h", 20, 1)
    return (F.col("c") - lo) / F.nullif(hi - lo, F.lit(0.0))


def drawdown() -> Column:
    return F.col("c") / roll(F.max, "c", 60) - 1


def volume_columns(roll=roll) -> tuple[dict[str, Column], dict[str, Column]]:
    """vol_ratio, vol_z20 and the volume of a rising bar, and what with_volume() makes of them."""
    v = F.col("v").cast("double")
    mean, dev = roll(F.avg, v, 20), roll(F.stddev_samp, v, 20)
    first = {"vol_ratio": v / F.nullif(mean, F.lit(0.0)), "vol_z20": (v - mean) / F.nullif(dev, F.lit(0.0)), "__up": F.when(back("c").isNotNull() & (F.col("c") > back("c")), v).otherwise(0.0)}
    return first, {"spike3": true(roll(F.max, "vol_ratio", 3) >= 2), "upvol_share": roll(F.sum, "__up", 20) / F.nullif(roll(F.sum, v, 20), F.lit(0.0))}


def with_volume(frame: DataFrame, roll=roll) -> DataFrame:
    """vol_ratio, vol_z20, spike3 and upvol_share over 20 sessions, today's among them."""
    first, second = volume_columns(roll)
    return frame.withColumns(first).withColumns(second).drop("__up")


def change() -> Column:
    return F.col("c") / back("c") - 1


def with_limits(frame: DataFrame) -> DataFrame:
    """hit_ceiling, hit_floor, and n_ceiling5: how many of 5 sessions hit the ceiling."""
    frame = frame.withColumns({"hit_ceiling": true(change() >= LIMIT), "hit_floor": true(change() <= -LIMIT)})
    return frame.withColumn("n_ceiling5", roll(F.sum, F.col("hit_ceiling").cast("int"), 5))


def with_gap(frame: DataFrame) -> DataFrame:
    gap = F.col("o") / back("c") - 1
    return frame.withColumns({"gap": gap, "gap_big": true(F.abs(gap) > GAP)})


def climax(roll=roll) -> Column:
    """Limit-up bar of wide body and volume that closes near its high and above the 20 closes before."""
    body, spread = F.abs(F.col("c") - F.col("o")), F.nullif(F.col("h") - F.col("l"), F.lit(0.0))
    return true(
        (change() >= LIMIT)
        & (F.col("c") > F.col("o"))
        & (body >= 2 * roll(F.avg, body, 10, 1))
        & ((F.col("c") - F.col("l")) / spread >= 0.8)
        & (F.col("v") >= 2 * roll(F.avg, "v", 20, 1))
        & (F.col("c") > roll(F.max, "c", 20, 1))
    )


def with_climax(frame: DataFrame, roll=roll) -> DataFrame:
    frame = frame.withColumn("climax", climax(roll))
    return frame.withColumn("climax3", F.max("climax").over(by_symbol().rowsBetween(-2, 0)))


def index_columns(index: DataFrame) -> DataFrame:
    """d and the index's returns and volatility, from the index's own bars."""
    frame = with_volatility(with_returns(index))
    return frame.select("d", *[F.col(c).alias(f"idx_{c}") for c in ("r5", "r20", "vol20")])


def join_index(frame: DataFrame, index: DataFrame, fill: int = 3) -> DataFrame:
    """frame with the index columns of its date; gaps take the value of at most `fill` rows before."""
    columns = [c for c in index.columns if c != "d"]
    frame = frame.join(F.broadcast(index), "d", "left")  # one row per session of one symbol
    past = by_symbol().rowsBetween(-fill, 0)
    return frame.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def with_labels(frame: DataFrame) -> DataFrame:
    """fr5, fr10, fr20: forward log returns; y5, y10, y20: whether they are up, null where not known yet."""
    returns = {f"fr{k}": F.ln(ahead("c", k) / F.col("c")) for k in HORIZONS}
    return frame.withColumns(returns).withColumns({f"y{k}": F.col(f"fr{k}") > 0 for k in HORIZONS})


def with_path(frame: DataFrame, steps: int = PATH) -> DataFrame:
    """path: cumulative forward log returns of 1 to `steps` sessions, null unless all are known."""
    closes = F.collect_list("c").over(by_symbol().rowsBetween(1, steps))
    frame = frame.withColumn("__next", closes)
    return frame.withColumn("path", F.when(F.size("__next") == steps, F.transform("__next", lambda x: F.ln(x / F.col("c"))))).drop("__next")


def garman_klass() -> Column:
    """Volatility from the range and the body of 20 sessions."""
    import math

    day = 0.5 * F.pow(F.ln(F.col("h") / F.col("l")), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(F.col("c") / F.col("o")), 2)
    mean = roll(F.avg, day, 20)
    return F.when(mean.isNotNull(), F.sqrt(F.greatest(mean, F.lit(0.0))))


def long_enough(bars: DataFrame, n: int = MIN_BARS) -> DataFrame:
    """Bars of symbols with at least n of them."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n)
    return bars.join(counts, "symbol", "left_semi")


def feature_frame(bars: DataFrame, index: DataFrame) -> DataFrame:
    """All window features at once; windows of one partitioning share one sort."""
    frame = with_volatility(with_returns(bars))
    frame = with_scores(frame if "vol20_rank" in bars.columns else with_rank(frame))
    frame = with_climax(with_gap(with_limits(with_volume(frame))))
    frame = frame.withColumns({"don20_pos": donchian(), "dd_from_high60": drawdown(), "dow": F.weekday("d")})
    return with_path(with_labels(join_index(frame, index_columns(index))))
