"""The four conditional events of a bar, each kept once in a spell, and the cones of what came after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_symbol, roll, true
from . import events, features, regime, structure, trend

#: The codes in the order in which they are shown.
CODES = ("climax", "sc", "red_vol_demand", "gap_fill_demand")
ACTIVE, LEAST_POOL, ATR = 10, 30, 14


def flags(bars: DataFrame) -> DataFrame:
    """symbol, d and a column for each code: whether the bar shows the event."""
    atr = trend.atr(bars, ATR).withColumnRenamed("value", "atr")
    return atr.select("symbol", "d", *[c.alias(code) for code, c in flag_columns().items()])


def flag_columns(roll=roll) -> dict[str, Column]:
    """Whether a bar shows each event. Needs atr, after Wilder over ATR bars. A symbol that is null has no selling climax."""
    sc = true(structure.climax(True, roll)) & F.col("symbol").isNotNull()
    return {"climax": features.climax(roll), "sc": sc, "red_vol_demand": events.red_volume_demand(roll), "gap_fill_demand": events.gap_fill_demand(roll)}


def codes(flags: dict[str, Column]) -> Column:
    """The codes of a bar's events as an array."""
    return F.array_compact(F.array(*[F.when(flags[c], F.lit(c)) for c in CODES]))


def kept(flagged: DataFrame, apart: int = 5) -> DataFrame:
    """symbol, d, code of events, without those within `apart` bars of the last one of the same code that is kept.

    Only flagged bars enter the fold, one for each (symbol, code).
    """
    rows = flagged.withColumn("i", F.row_number().over(by_symbol()))
    return kept_codes(rows.select("symbol", "d", "i", codes({c: F.col(c) for c in CODES}).alias("codes")), apart)


def kept_codes(rows: DataFrame, apart: int = 5) -> DataFrame:
    """kept() of bars (symbol, d, i, their number within the symbol) with the array of their codes."""
    rows = rows.select("symbol", "d", "i", F.explode("codes").alias("code"))
    lists = rows.groupBy("symbol", "code").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("at"))
    first = F.filter("at", lambda x: F.lit(False))
    fold = F.aggregate("at", first, lambda out, x: F.when((F.size(out) == 0) | (x["i"] - F.element_at(out, -1)["i"] > apart), F.array_append(out, x)).otherwise(out))
    return lists.select("symbol", "code", F.explode(fold).alias("e")).select("symbol", "e.d", "code")


def event_frame(flagged: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, d and a column for each code: whether the bar has the event, kept once in a spell."""
    wide = found.groupBy("symbol", "d").agg(*[F.bool_or(F.col("code") == c).alias(c) for c in CODES])
    rows = flagged.select("symbol", "d").join(wide, ["symbol", "d"], "left")
    return rows.select("symbol", "d", *[F.coalesce(c, F.lit(False)).alias(c) for c in CODES])


def pools(found: DataFrame, frame: DataFrame) -> DataFrame:
    """symbol, d, pool (the code), steps: events whose forward path is known. frame: symbol, d, vol20, path."""
    return regime.with_steps(found.join(frame, ["symbol", "d"])).withColumnRenamed("code", "pool")


def active(found: DataFrame, frame: DataFrame, within: int = ACTIVE) -> DataFrame:
    """Events of each symbol's last bars with age, vol20 and c."""
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    rows = frame.withColumn("age", (F.row_number().over(late) - 1).cast("long")).where(F.col("age") <= within)
    return rows.join(found, ["symbol", "d"]).where("vol20 > 0")


def scored_log(found: DataFrame, frame: DataFrame, cones: DataFrame, last: int = 250) -> DataFrame:
    """Events of each symbol's last bars with ret10, live (a cone was issued that day), its low80 and high80, and in80 once ten sessions are over."""
    rows = active(found, frame, last - 1).join(cones.select("symbol", "d", "code", "q10", "q90"), ["symbol", "d", "code"], "left")
    inside = F.when(F.col("fr10").isNotNull(), F.col("fr10").between(F.col("q10"), F.col("q90")))
    return rows.withColumns(
        {
            "ret10": F.exp("fr10") - 1,
            "live": F.col("q10").isNotNull(),
            "low80": F.col("c") * F.exp("q10"),
            "high80": F.col("c") * F.exp("q90"),
            "in80": inside,
        }
    )


def touched(path: Column) -> Column:
    """Whether a path of cumulative log returns rises by 5 % before it falls by 5 %."""

    def first(hit) -> Column:
        at = F.array_position(F.transform(F.slice(path, 1, regime.TOUCH), lambda x: hit(F.round(x, 9))), True)
        return F.when(at == 0, regime.TOUCH + 1).otherwise(at)

    return first(lambda x: x >= round(regime.UP, 9)) < first(lambda x: x <= round(regime.DOWN, 9))


def event_scales(rows: DataFrame, low: float = 0.8, high: float = 3.0, step: float = 0.05) -> DataFrame:
    """code, level, scale, cov_after: the least width of a grid at which cones of events catch a level's share of returns (else the greatest), and the share caught.

    rows: code, ret, q5 .. q95. A row is counted at its least width of the 45, before it is shuffled.
    """
    cover = regime.cover_by_width(rows, ["code"], regime.width_grid(low, high, step))
    fits = F.when(F.col("cov") >= F.col("level") / 100, F.col("s"))
    return cover.groupBy("code", "level").agg(F.coalesce(F.min(fits), F.lit(high)).alias("scale"), F.coalesce(F.min_by("cov", fits), F.max_by("cov", "s")).alias("cov_after"))


def paired_scores(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Cones of events and of regimes for the same days, scored side by side for each year and code.

    rows: year, code, n_pool, ret, p_touch, hit (whether the real path touched the upper bound first), q5 .. q95
    of the event's cone and a5 .. a95 of the regime's. Suffixes: ev, app, and wide for the event's cone
    widened by scales (code, level, scale). pin: mean pinball loss of the seven quantiles, in per cent.
    """
    wide = scales.groupBy("code").pivot("level", list(regime.LEVELS)).agg(F.first("scale"))
    rows = rows.join(F.broadcast(wide), "code")  # a row a code
    widened = {"w50": F.col("q50")}
    for level, pair in regime.LEVELS.items():
        widened |= {f"w{q}": F.col("q50") + F.col(f"`{level}`") * (F.col(f"q{q}") - F.col("q50")) for q in pair}
    rows = rows.withColumns(widened)

    def pinball(x: str) -> Column:
        loss = [F.greatest(q / 100 * (F.col("ret") - F.col(f"{x}{q}")), (q / 100 - 1) * (F.col("ret") - F.col(f"{x}{q}"))) for q in regime.QUANTILES]
        return F.avg(sum(loss[1:], loss[0]) / len(loss)) * 100

    kinds = {"ev": "q", "app": "a", "wide": "w"}
    hit = F.col("hit").cast("int")
    return rows.groupBy("year", "code").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("n_pool").alias("n_pool"),
        *[F.avg(F.col("ret").between(F.col(f"{x}10"), F.col(f"{x}90")).cast("int")).alias(f"cov80_{k}") for k, x in kinds.items()],
        *[pinball(x).alias(f"pin_{k}") for k, x in kinds.items()],
        *[F.avg(F.exp(f"{x}50") - 1).alias(f"med_{k}") for k, x in kinds.items() if k != "wide"],
        F.avg(F.exp("ret") - 1).alias("real_mean"),
        F.avg("p_touch").alias("touch_ev"),
        F.avg(hit).alias("touch_real"),
        F.avg(F.pow(F.col("p_touch") - hit, 2)).alias("brier_touch"),
    )


def history(days: DataFrame, found: DataFrame, hits: DataFrame) -> DataFrame:
    """days with n_alerts, cov5 and cov10: events of the day, and the share that its cones of 80 % caught after 5 and 10 sessions."""
    alerts = found.groupBy("d").agg(F.count(F.lit(1)).alias("n_alerts"))
    caught = hits.where("level = 80").groupBy("d").agg(*[F.max(F.when(F.col("h") == h, F.col("hit"))).alias(f"cov{h}") for h in (5, 10)])
    return days.join(alerts, "d", "left").join(caught, "d", "left").fillna(0, ["n_alerts"])
