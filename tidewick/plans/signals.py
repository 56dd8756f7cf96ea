"""Queries of candlestick patterns, events and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import r6
from ..operators import events as E
from ..operators import patterns as P
from ..operators import trend as T
from ..operators.features import climax
from ..sources.market import BARS_SQL, bars
from .features import CLIMAX_SQL, FRAME_SQL
from .registry import query

_LAGS = ", ".join(f"lag({x}, {n}) OVER w AS {x}{n}" for n in range(1, 5) for x in "ohlc")


def _candle(n: int) -> dict[str, str]:
    o, h, lo, c = (f"{x}{n or ''}" for x in "ohlc")
    body, rng = f"abs({c} - {o})", f"({h} - {lo})"
    up, down = f"({h} - greatest({o}, {c}))", f"(least({o}, {c}) - {lo})"
    return {
        "o": o, "h": h, "l": lo, "c": c, "body": body, "rng": rng, "bull": f"{c} > {o}", "bear": f"{c} < {o}", "mid": f"(({o} + {c}) / 2)",
        "big": f"{body} >= 0.8 * body10", "solid": f"{body} / nullif({rng}, 0) > 0.6", "doji": f"{body} <= 0.1 * {rng}",
        "hammer": f"{body} <= 0.3 * {rng} AND {down} >= 2 * {body} AND {up} <= 0.1 * {rng}",
        "inverted": f"{body} <= 0.3 * {rng} AND {up} >= 2 * {body} AND {down} <= 0.1 * {rng}",
        "top": f"greatest({o}, {c})", "bottom": f"least({o}, {c})",
    }


def _rules() -> dict[str, str]:
    c, p, a, e = _candle(0), _candle(1), _candle(2), _candle(4)

    def star(first, last, beyond, doji):
        return f"{a[first]} AND {a['big']} AND {p['body']} <= 0.3 * {a['body']} AND {c[last]} AND c {beyond} {a['mid']}" + (f" AND {p['doji']}" if doji else "")

    def march(side, s):
        inside = f"o1 > {a['bottom']} AND o1 < {a['top']} AND o > {p['bottom']} AND o < {p['top']}"
        return " AND ".join([x[k] for x in (a, p, c) for k in (side, "solid")] + [f"c1 {s} c2", f"c {s} c1", inside])

    mids = " AND ".join(f"{m['body']} <= 0.5 * {e['body']} AND {m['h']} <= h4 + 0.1 * {e['rng']} AND {m['l']} >= l4 - 0.1 * {e['rng']}" for m in map(_candle, (3, 2, 1)))
    return {
        "bull_engulfing": f"{p['bear']} AND {c['bull']} AND {c['big']} AND o <= c1 AND c >= o1",
        "bear_engulfing": f"{p['bull']} AND {c['bear']} AND {c['big']} AND o >= c1 AND c <= o1",
        "morning_star": star("bear", "bull", ">", False),
        "evening_star": star("bull", "bear", "<", False),
        "morning_doji_star": star("bear", "bull", ">", True),
        "evening_doji_star": star("bull", "bear", "<", True),
        "three_white_soldiers": march("bull", ">"),
        "three_black_crows": march("bear", "<"),
        "hammer_confirm": f"{p['hammer']} AND {c['bull']} AND c > h1",
        "hanging_man_confirm": f"{p['hammer']} AND {c['bear']} AND c < l1",
        "inv_hammer_confirm": f"{p['inverted']} AND {c['bull']} AND c > h1",
        "shooting_star_confirm": f"{p['inverted']} AND {c['bear']} AND c < l1",
        "piercing": f"{p['bear']} AND {p['big']} AND {c['bull']} AND o <= c1 AND c > {p['mid']} AND c < o1",
        "dark_cloud": f"{p['bull']} AND {p['big']} AND {c['bear']} AND o >= c1 AND c < {p['mid']} AND c > o1",
        "three_inside_down": f"{a['bull']} AND {a['big']} AND {p['bear']} AND o1 <= c2 AND c1 >= o2 AND {c['bear']} AND c < l1",
        "limit_up_climax": "i > 20 AND c / c1 - 1 >= 0.065 AND c > o AND abs(c - o) >= 2 * body10 AND (c - l) / nullif(h - l, 0) >= 0.8 AND v >= 2 * v20 AND c > c20",
        "limit_down_volume": "c / c1 - 1 <= -0.065 AND v20 > 0 AND v >= 2 * v20",
        "falling_three_methods": f"{e['bear']} AND {e['big']} AND {mids} AND {c['bear']} AND c < c4",
    }


CANDLES_SQL = BARS_SQL + f""",
cd AS (
  SELECT *, row_number() OVER w AS i, {_LAGS},
         CASE WHEN count(*) OVER b = 10 THEN avg(abs(c - o)) OVER b END AS body10,
         CASE WHEN count(*) OVER p = 20 THEN avg(v) OVER p END AS v20,
         CASE WHEN count(*) OVER p = 20 THEN max(c) OVER p END AS c20
  FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY d),
         b AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
         p AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
)"""

_DETECT = "\nUNION ALL\n".join(
    f"SELECT symbol, d, '{name}' AS pattern, '{P.PATTERNS[name][1]}' AS side, c AS close FROM cd WHERE i >= 12 AND body10 > 0 AND "
    + " AND ".join(f"{_candle(k)['rng']} > 0" for k in range(P.PATTERNS[name][0]))
    + f" AND ({rule})"
    for name, rule in _rules().items()
)


@query(_DETECT, CANDLES_SQL)
def candle_patterns(spark, sf_dir):
    return P.detect(bars(spark, sf_dir))


@query(f"SELECT pattern, side, count(*) AS n, count(DISTINCT symbol) AS symbols FROM ({_DETECT}) GROUP BY pattern, side", CANDLES_SQL)
def candle_pattern_counts(spark, sf_dir):
    return P.detect(bars(spark, sf_dir)).groupBy("pattern", "side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


@query(
    """SELECT symbol, d, c, round(pct, 6) AS pct, round(ratio, 6) AS ratio, round(avg20, 6) AS avg20, round(r5, 6) AS r5, round(r10, 6) AS r10
    FROM (SELECT *, c / nullif(c1, 0) - 1 AS pct, v / v20 AS ratio, v20 AS avg20,
                 lead(c, 5) OVER w / c - 1 AS r5, lead(c, 10) OVER w / c - 1 AS r10, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS late
          FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY d))
    WHERE v20 > 0 AND v >= 2 * v20 AND c > o AND pct >= 0.03 - 1e-12""",
    CANDLES_SQL,
)
def volume_spike(spark, sf_dir):
    out = E.volume_spike(bars(spark, sf_dir), log_days=None)
    return out.select("symbol", "d", "c", *[r6(x).alias(x) for x in ("pct", "ratio", "avg20", "r5", "r10")])


EVENTS_SQL = FRAME_SQL + """,
evt AS (
  SELECT *,
    coalesce(c < o AND v >= 1.5 * CASE WHEN count(*) OVER p = 20 THEN avg(v) OVER p END
      AND l <= 1.03 * CASE WHEN count(*) OVER q = 60 THEN min(l) OVER q END AND c / lag(c, 10) OVER w - 1 <= -0.05, false) AS red_vol_demand,
    coalesce(c1 < lag(o) OVER w AND lag(o) OVER w <= 0.99 * lag(c, 2) OVER w AND c > o AND c > lag(o) OVER w
      AND CASE WHEN count(*) OVER t = 3 THEN min(l) OVER t END <= 1.03 * CASE WHEN count(*) OVER u = 60 THEN min(l) OVER u END
      AND lag(c, 3) OVER w / lag(c, 13) OVER w - 1 <= -0.05, false) AS gap_fill_demand
  FROM ret
  WINDOW w AS (PARTITION BY symbol ORDER BY d),
         p AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         q AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
         t AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         u AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 62 PRECEDING AND 3 PRECEDING)
)"""


@query("SELECT symbol, d, red_vol_demand FROM evt", EVENTS_SQL)
def red_volume_demand(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", E.red_volume_demand().alias("red_vol_demand"))


@query("SELECT symbol, d, gap_fill_demand FROM evt", EVENTS_SQL)
def gap_fill_demand(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", E.gap_fill_demand().alias("gap_fill_demand"))


#: Kept events: the next one is the first flagged bar more than 5 bars after the last one kept.
KEPT_SQL = EVENTS_SQL + """,
kept AS (
  WITH RECURSIVE k AS (
    SELECT symbol, min(i) AS i FROM evt WHERE red_vol_demand GROUP BY symbol
    UNION ALL
    SELECT symbol, (SELECT min(e.i) FROM evt e WHERE e.red_vol_demand AND e.symbol = k.symbol AND e.i > k.i + 5) AS i FROM k WHERE i IS NOT NULL
  ) SELECT e.symbol, e.d, e.i, e.c FROM k JOIN evt e ON k.symbol = e.symbol AND k.i = e.i
)"""


@query("SELECT symbol, d FROM kept", KEPT_SQL)
def event_dedup(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("hit", E.red_volume_demand())
    return E.keep_first(rows, "hit")


@query(
    """SELECT k.symbol, k.d, 'red_vol_demand' AS code, b.age, round(b.ret10, 6) AS ret10, round(b.ret_now, 6) AS ret_now
    FROM kept k JOIN (
      SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) - 1 AS age, lead(c, 10) OVER (PARTITION BY symbol ORDER BY d) / c - 1 AS ret10,
             first_value(c) OVER (PARTITION BY symbol ORDER BY d DESC) / c - 1 AS ret_now FROM bars) b ON k.symbol = b.symbol AND k.d = b.d
    WHERE b.age < 250""",
    KEPT_SQL,
)
def event_log(spark, sf_dir):
    own = bars(spark, sf_dir)
    kept = E.keep_first(own.withColumn("hit", E.red_volume_demand()), "hit").withColumn("code", F.lit("red_vol_demand"))
    return E.event_log(own, kept).select("symbol", "d", "code", "age", r6("ret10").alias("ret10"), r6("ret_now").alias("ret_now"))


@query(
    """SELECT year(d) AS year, count(*) FILTER (climax) AS n_climax, count(*) FILTER (vol20 > 0.02) AS n_wide FROM clim GROUP BY year(d)""",
    CLIMAX_SQL,
)
def climax_by_year(spark, sf_dir):
    from .features import frame

    rows = frame(spark, sf_dir).withColumn("climax", climax())
    return rows.groupBy(F.year("d").alias("year")).agg(F.count_if("climax").alias("n_climax"), F.count_if(F.col("vol20") > 0.02).alias("n_wide"))


def ema_sql(name: str, n: int) -> str:
    return f"""
{name} AS (
  WITH RECURSIVE e AS (
    SELECT i, d, symbol, m AS value FROM (SELECT *, avg(c) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM ret) WHERE i = {n}
    UNION ALL
    SELECT r.i, r.d, r.symbol, {2.0 / (n + 1)} ::double * r.c + {1 - 2.0 / (n + 1)} ::double * e.value FROM e JOIN ret r ON r.symbol = e.symbol AND r.i = e.i + 1
  ) SELECT * FROM e
)"""


TR_SQL = FRAME_SQL + """,
trng AS (SELECT *, CASE WHEN c1 IS NULL THEN h - l ELSE greatest(h - l, abs(h - c1), abs(l - c1)) END AS tr FROM ret)"""


def atr_sql(n: int) -> str:
    return TR_SQL + f""",
atr AS (
  WITH RECURSIVE e AS (
    SELECT i, d, symbol, h, l, c, m AS value FROM (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM trng) WHERE i = {n}
    UNION ALL
    SELECT r.i, r.d, r.symbol, r.h, r.l, r.c, (e.value * {n - 1} + r.tr) / {n} FROM e JOIN trng r ON r.symbol = e.symbol AND r.i = e.i + 1
  ) SELECT * FROM e
)"""


@query("SELECT b.symbol, b.d, round(a.value, 6) AS ema10, round(e.value, 6) AS ema50, round(b.c / a.value - 1, 6) AS ema10_pos, round(b.c / e.value - 1, 6) AS ema50_pos FROM ret b LEFT JOIN a ON a.symbol = b.symbol AND a.i = b.i LEFT JOIN e ON e.symbol = b.symbol AND e.i = b.i", FRAME_SQL + "," + ema_sql("a", 10) + "," + ema_sql("e", 50))
def moving_averages(spark, sf_dir):
    own = bars(spark, sf_dir)
    a = T.ema(own, 10).withColumnRenamed("value", "ema10")
    e = T.ema(own, 50).select("symbol", "d", F.col("value").alias("ema50"))
    out = a.join(e, ["symbol", "d"])
    return out.select("symbol", "d", r6("ema10").alias("ema10"), r6("ema50").alias("ema50"), r6(F.col("c") / F.col("ema10") - 1).alias("ema10_pos"), r6(F.col("c") / F.col("ema50") - 1).alias("ema50_pos"))


@query("SELECT symbol, d, round(value, 6) AS atr10 FROM atr", atr_sql(10))
def atr_wilder10(spark, sf_dir):
    return T.atr(bars(spark, sf_dir), 10).where("value IS NOT NULL").select("symbol", "d", r6("value").alias("atr10"))


@query("SELECT symbol, d, round(value, 6) AS atr14 FROM atr", atr_sql(14))
def atr_wilder14(spark, sf_dir):
    return T.atr(bars(spark, sf_dir), 14).where("value IS NOT NULL").select("symbol", "d", r6("value").alias("atr14"))


RUNNING_ATR_SQL = TR_SQL + """,
ratr AS (
  WITH RECURSIVE e AS (
    SELECT i, d, symbol, tr AS value FROM trng WHERE i = 1
    UNION ALL
    SELECT r.i, r.d, r.symbol, e.value + (r.tr - e.value) / 14 FROM e JOIN trng r ON r.symbol = e.symbol AND r.i = e.i + 1
  ) SELECT * FROM e
)"""


@query("SELECT r.symbol, r.d, round(a.value, 6) AS atr, round(a.value / r.c, 6) AS atr_pct FROM ratr a JOIN ret r ON a.symbol = r.symbol AND a.i = r.i", RUNNING_ATR_SQL)
def atr_running14(spark, sf_dir):
    return T.atr_running(bars(spark, sf_dir)).select("symbol", "d", r6("value").alias("atr"), r6(F.col("value") / F.col("c")).alias("atr_pct"))


#: The mean range of 14 sessions, by names of its own beside the one of 10.
_ATR14 = atr_sql(14)[len(FRAME_SQL) :].replace("trng", "trng14").replace("atr AS", "atr14 AS")

FOUR_SQL = EVENTS_SQL + CLIMAX_SQL[len(FRAME_SQL) :] + _ATR14 + """,
sc0 AS (SELECT b.*, a.value AS atr, lag(b.c, 15) OVER x AS ref, CASE WHEN count(*) OVER y = 20 THEN avg(b.v) OVER y END AS av
  FROM ret b LEFT JOIN atr14 a ON a.symbol = b.symbol AND a.i = b.i
  WINDOW x AS (PARTITION BY b.symbol ORDER BY b.d), y AS (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
fl AS MATERIALIZED (
  SELECT symbol, d, i, 'climax' AS code FROM clim WHERE climax
  UNION ALL SELECT symbol, d, i, 'red_vol_demand' FROM evt WHERE red_vol_demand
  UNION ALL SELECT symbol, d, i, 'gap_fill_demand' FROM evt WHERE gap_fill_demand
  UNION ALL SELECT symbol, d, i, 'sc' FROM sc0 WHERE v >= 2 * av AND av > 0 AND atr IS NOT NULL AND c / ref - 1 <= -0.10 AND (c <= o OR abs(c - o) <= 0.2 * greatest(h - l, 1e-9)) AND (c <= c1 * (1 - 0.065) OR h - l >= 1.5 * atr)
),
kept4 AS MATERIALIZED (
  WITH RECURSIVE k AS (
    SELECT symbol, code, min(i) AS i FROM fl GROUP BY symbol, code
    UNION ALL
    SELECT symbol, code, (SELECT min(e.i) FROM fl e WHERE e.symbol = k.symbol AND e.code = k.code AND e.i > k.i + 5) AS i FROM k WHERE i IS NOT NULL
  ) SELECT r.symbol, r.d, r.i, r.c, k.code FROM k JOIN ret r ON k.symbol = r.symbol AND k.i = r.i
)"""


TREND_SQL = atr_sql(10) + """,
band AS (SELECT *, (h + l) / 2 + 3 * value AS bu, (h + l) / 2 - 3 * value AS bl FROM atr),
strend AS (
  WITH RECURSIVE e AS (
    SELECT i, d, symbol, c, bu AS fu, bl AS fl, false AS up FROM band WHERE i = 10
    UNION ALL
    SELECT i, d, symbol, c, fu, fl, CASE WHEN was THEN NOT (c < fl) ELSE c > fu END
    FROM (SELECT b.i, b.d, b.symbol, b.c, CASE WHEN b.bu < e.fu OR e.c > e.fu THEN b.bu ELSE e.fu END AS fu,
                 CASE WHEN b.bl > e.fl OR e.c < e.fl THEN b.bl ELSE e.fl END AS fl, e.up AS was
          FROM e JOIN band b ON b.symbol = e.symbol AND b.i = e.i + 1)
  ) SELECT * FROM e
)"""


@query("SELECT symbol, d, up, round(CASE WHEN up THEN fl ELSE fu END, 6) AS line FROM strend", TREND_SQL)
def supertrend(spark, sf_dir):
    return T.supertrend(bars(spark, sf_dir)).select("symbol", "d", "up", r6("line").alias("line"))


RUNS_SQL = TREND_SQL + "," + ema_sql("a", 10) + """,
runs AS (
  SELECT s.*, a.value AS mean, lag(s.up) OVER w AS was, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER w AS run
  FROM (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY i) IS DISTINCT FROM up AS flip FROM strend) s LEFT JOIN a ON a.symbol = s.symbol AND a.i = s.i
  WINDOW w AS (PARTITION BY s.symbol ORDER BY s.i)
)"""


@query(
    """SELECT symbol, d, 'st_exit' AS signal FROM runs WHERE i > 40 AND NOT up AND was
    UNION ALL
    SELECT symbol, d, 'st_buy' AS signal FROM (
      SELECT *, sum(CASE WHEN up AND c > mean THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY i) AS times FROM runs)
    WHERE i > 40 AND was IS NOT NULL AND up AND c > mean AND times = 1""",
    RUNS_SQL,
)
def trend_signals(spark, sf_dir):
    return T.trend_signals(bars(spark, sf_dir))


@query(
    """SELECT symbol, d, up, round(CASE WHEN up THEN fl ELSE fu END, 6) AS line, first_value(d) OVER w AS since, row_number() OVER w AS days, c > mean AS above_mean
    FROM runs WINDOW w AS (PARTITION BY symbol, run ORDER BY i)""",
    RUNS_SQL,
)
def trend_state(spark, sf_dir):
    return T.trend_state(bars(spark, sf_dir)).withColumn("line", r6("line"))
