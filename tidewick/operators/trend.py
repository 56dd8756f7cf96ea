"""Averages that remember, and the trend that follows from them.

Each value depends on the one before it, so each is one pass over the bars of a symbol in the order of
their dates, linear in them, in the task that holds the symbol.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Together, by_symbol, rolled

_BAR = ("symbol", "d", "o", "h", "l", "c", "v")


def _along(bars: DataFrame, out: str, fold: Callable[[pd.DataFrame], dict[str, list]], *more: str) -> DataFrame:
    """bars with the columns `out` that fold makes of the sorted bars of one symbol."""
    import pyarrow as pa
    import pyarrow.compute as pc

    own = bars.select(*_BAR, *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    flags = {x.split()[0] for x in out.split(", ") if x.endswith(" boolean")}

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("d", "ascending")]))
        for name, values in fold(table.drop_columns(["symbol", "d"]).to_pandas()).items():
            table = table.append_column(name, pa.array(values, from_pandas=True, type=pa.bool_() if name in flags else pa.float64()))
        return table

    return own.groupBy("symbol").applyInArrow(run, f"{schema}, {out}")


def _smoothed(values: list[float], n: int, step: Callable[[float, float], float]) -> list[float | None]:
    """The mean of the first n values, then what step makes of the last result and a value; None before."""
    out: list[float | None] = []
    total, last = 0.0, None
    for i, x in enumerate(values):
        if i < n:
            total += x
            last = total / n if i == n - 1 else None
        else:
            last = step(last, x)
        out.append(last)
    return out


def _true_ranges(frame: pd.DataFrame) -> list[float]:
    h, l, c = (frame[x].tolist() for x in "hlc")
    return [h[i] - l[i] if not i else max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(len(h))]


def ema(bars: DataFrame, n: int, column: str = "c") -> DataFrame:
    """bars with `value`: exponential mean, seeded with the mean of the first n, null before."""
    a = 2.0 / (n + 1)
    b = 1 - 2.0 / (n + 1)
    return _along(bars, "value double", lambda frame: {"value": _smoothed(frame[column].tolist(), n, lambda e, x: a * x + b * e)})


def atr(bars: DataFrame, n: int) -> DataFrame:
    """bars with `value`: mean true range after Wilder, seeded with the mean of the first n, null before."""
    return _along(bars, "value double", lambda frame: {"value": _wilder(frame, n)})


def atr_running(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with `value`: true range smoothed by 1/n from the first bar on."""
    return _along(bars, "value double", lambda frame: {"value": _smoothed(_true_ranges(frame), 1, lambda e, x: e + (x - e) / n)})


#: Sessions and width of the trend's bands.
LENGTH, WIDTH = 10, 3.0


def _wilder(frame: pd.DataFrame, n: int) -> list[float | None]:
    return _smoothed(_true_ranges(frame), n, lambda e, x: (e * (n - 1) + x) / n)


def _supertrend(frame: pd.DataFrame, ranges: list[float | None], width: float) -> tuple[list, list]:
    """Direction and line of each bar, null while its range is."""
    ups, lines = [], []
    fu = fl = before = None
    up = False
    for h, l, c, a in zip(*(frame[x].tolist() for x in ("h", "l", "c")), ranges, strict=True):
        if a is None:
            ups.append(None)
            lines.append(None)
            continue
        bu, bl = (h + l) / 2 + width * a, (h + l) / 2 - width * a
        if before is None:
            fu, fl, up = bu, bl, False
        else:
            fu = bu if bu < fu or before > fu else fu
            fl = bl if bl > fl or before < fl else fl
            up = not c < fl if up else c > fu
        ups.append(up)
        lines.append(fl if up else fu)
        before = c
    return ups, lines


def supertrend(bars: DataFrame, n: int = LENGTH, width: float = WIDTH) -> DataFrame:
    """bars with up and line: bands of `width` ATR that only tighten until the close is beyond them. It starts as down; bars before the first ATR are left out."""

    def fold(frame: pd.DataFrame) -> dict[str, list]:
        ups, lines = _supertrend(frame, _wilder(frame, n), width)
        return {"up": ups, "line": lines}

    return _along(bars, "up boolean, line double", fold).where("up IS NOT NULL")


def _share_below(values: np.ndarray, previous: int) -> np.ndarray:
    """The share of the `previous` last values, each value's own not among them, that are below it; null unless all are known."""
    out = np.full(len(values), np.nan)
    if len(values) > previous:
        past, own = np.lib.stride_tricks.sliding_window_view(values, previous)[:-1], values[previous:]
        unknown = np.concatenate([[0], np.isnan(values).cumsum()])
        known = ~np.isnan(own) & (unknown[previous:-1] == unknown[: -previous - 1])
        out[previous:] = np.where(known, (past < own[:, None]).sum(axis=1) / previous, np.nan)
    return out


def columns(bars: DataFrame, means: tuple[int, ...] = (), line: bool = False, running: bool = False, wilder: int = 0, ranked: dict[str, int] | None = None, together: Together | None = None) -> DataFrame:
    """bars with ema{n} for each of means, st_up and st_line if line, atr if running or by `wilder`, and of the ranked columns {x}_rank, the share of so many values before that are below, and the rolling values of together: all in one pass over a symbol."""
    ranked, together = ranked or {}, together or Together()
    values, windows = {f"{name}_of": x for name, x in together.values().items()}, together.windows()
    names = [f"ema{n} double" for n in means] + ["st_up boolean", "st_line double"] * line + ["atr double"] * bool(running or wilder) + [f"{x} double" for x in (*[f"{x}_rank" for x in ranked], *windows)]

    def fold(frame: pd.DataFrame) -> dict[str, list]:
        close = frame["c"].tolist()
        out = {f"ema{n}": _smoothed(close, n, lambda e, x, n=n: 2.0 / (n + 1) * x + (1 - 2.0 / (n + 1)) * e) for n in means}
        if line:
            out["st_up"], out["st_line"] = _supertrend(frame, _wilder(frame, LENGTH), WIDTH)
        if running:
            out["atr"] = _smoothed(_true_ranges(frame), 1, lambda e, x: e + (x - e) / 14)
        if wilder:
            out["atr"] = _wilder(frame, wilder)
        for x, previous in ranked.items():
            out[f"{x}_rank"] = _share_below(frame[x].to_numpy(), previous)
        return out | {name: rolled(f, frame[f"{name}_of"].to_numpy(), n, end) for name, (f, n, end) in windows.items()}

    return _along(bars.withColumns(values) if values else bars, ", ".join(names), fold, *ranked, *values).drop(*values)


def trend_signals(bars: DataFrame, mean: int = 10, warm_up: int = 40) -> DataFrame:
    """symbol, d, signal: st_exit when the trend turns down, st_buy at the first close above the mean in an up-run."""
    st = supertrend(bars)
    with_mean = ema(bars, mean).select("symbol", "d", F.col("value").alias("mean"), F.row_number().over(by_symbol()).alias("row"))
    rows = st.join(with_mean, ["symbol", "d"]).withColumn("was", F.lag("up").over(by_symbol()))
    rows = rows.withColumn("run", F.sum(F.when(F.col("was") == F.col("up"), 0).otherwise(1)).over(by_symbol()))
    strong = F.col("up") & (F.col("c") > F.col("mean"))
    within = Window.partitionBy("symbol", "run").orderBy("d")
    rows = rows.withColumn("times", F.sum(F.coalesce(strong, F.lit(False)).cast("int")).over(within)).withColumn("strong", strong)
    ready = (F.col("row") > warm_up) & F.col("was").isNotNull()
    exit_ = F.when(ready & ~F.col("up") & F.col("was"), F.lit("st_exit"))
    # an up-run that some down-run came before: the first run is down by definition
    buy = F.when(ready & F.col("strong") & (F.col("times") == 1), F.lit("st_buy"))
    return rows.select("symbol", "d", F.explode(F.array_compact(F.array(exit_, buy))).alias("signal"))


def trend_state(bars: DataFrame, mean: int = 10) -> DataFrame:
    """Each bar's trend: up, line, since when, for how many sessions, and whether the close is above the mean."""
    st = supertrend(bars).withColumn("was", F.lag("up").over(by_symbol()))
    st = st.withColumn("run", F.sum(F.when(F.col("was") == F.col("up"), 0).otherwise(1)).over(by_symbol()))
    run = Window.partitionBy("symbol", "run").orderBy("d")
    rows = st.withColumns({"since": F.first("d").over(run), "days": F.row_number().over(run).cast("long")})
    means = ema(bars, mean).select("symbol", "d", F.col("value").alias("mean"))
    return rows.join(means, ["symbol", "d"]).select("symbol", "d", "up", "line", "since", "days", (F.col("c") > F.col("mean")).alias("above_mean"))


def cards(bars: DataFrame, n: int = 22) -> DataFrame:
    """The last n bars of each symbol with st (trend line), up, ema (of 10) and sig (st_buy, st_exit or null)."""
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    own = bars.withColumn("__late", F.row_number().over(late))
    line = supertrend(bars).select("symbol", "d", F.col("line").alias("st"), "up")
    mean = ema(bars, 10).select("symbol", "d", F.col("value").alias("ema"))
    signals = trend_signals(bars).select("symbol", "d", F.col("signal").alias("sig"))
    rows = own.where(F.col("__late") <= n).drop("__late")
    for side in (line, mean, signals):
        rows = rows.join(side, ["symbol", "d"], "left")
    return rows
