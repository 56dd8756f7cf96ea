"""Queries of stores, joins and pages that the daily job keeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rolling import r6
from ..operators import events as E
from ..operators import features as X
from ..operators import flow as A
from ..operators import ingest as G
from ..operators import structure as S
from ..operators import trend as T
from ..operators import zones as Z
from ..sources.market import BARS_SQL, INDEX, bars, ticks
from . import cones, structures, volume
from .registry import query
from .signals import KEPT_SQL, RUNS_SQL, TREND_SQL, ema_sql


@query(
    """SELECT clock, symbol, count(*) AS n, max(d) AS last_d FROM bars, (VALUES ('15:29'), ('15:30')) AS t(clock), (SELECT max(d) AS today FROM bars)
    WHERE NOT (d = today AND clock < '15:30') GROUP BY clock, symbol""",
    BARS_SQL,
)
def settled_bars(spark, sf_dir):
    """What is left a minute before the day is settled, and then."""
    own = bars(spark, sf_dir)
    clocks = own.agg(F.max("d").alias("today")).select("today", F.explode(F.array(F.lit("15:29"), F.lit("15:30"))).alias("clock"))
    rows = own.join(F.broadcast(clocks))  # two rows
    now = F.to_timestamp(F.concat_ws(" ", F.col("today").cast("string"), "clock"))
    return G.drop_unsettled(rows, now).groupBy("clock", "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last_d"))


@query(
    """SELECT symbol, d, round(c, 6) AS c FROM bars WHERE symbol NOT IN ('S1', 'S2')
    UNION ALL SELECT symbol, d, round(0.79::double * c, 6) FROM bars WHERE symbol IN ('S1', 'S2') AND d >= (SELECT min(d) FROM bars) + 300""",
    BARS_SQL,
)
def history_replaced(spark, sf_dir):
    """S1 and S2 delivered anew, adjusted and without their first 300 days."""
    own = bars(spark, sf_dir)
    first = own.agg(F.date_add(F.min("d"), 300).alias("first"))
    new = own.where(F.col("symbol").isin("S1", "S2")).join(F.broadcast(first), F.col("d") >= F.col("first")).drop("first")  # one row
    out = G.replace_history(own, new.withColumns({x: F.lit(0.79) * F.col(x) for x in "ohlc"}))
    return out.select("symbol", "d", r6("c").alias("c"))


@query("SELECT symbol, max(d) AS last_date FROM bars GROUP BY symbol HAVING max(d) <> (SELECT max(d) FROM bars)", BARS_SQL)
def stale_symbols(spark, sf_dir):
    own = bars(spark, sf_dir)
    return G.stale(own, own.agg(F.max("d").alias("d")))


@query(
    """SELECT k.symbol, k.d, CASE WHEN i.known THEN i.vol END AS idx_vol, CASE WHEN i.known THEN i.upvol END AS idx_upvol, CASE WHEN i.known THEN i.st END AS idx_st
    FROM keyed k LEFT JOIN (SELECT * FROM keyed WHERE symbol = 'S0') i ON k.d = i.d WHERE k.symbol <> 'S0'""",
    cones.KEYED_SQL,
)
def index_regime(spark, sf_dir):
    """Each symbol's day with the regime that the index has on the same date."""
    rows = cones.keyed(spark, sf_dir)
    index = rows.where(F.col("symbol") == INDEX).select("d", *[F.col(a).alias(f"idx_{a}") for a in ("vol", "upvol", "st")])
    return rows.where(F.col("symbol") != INDEX).select("symbol", "d").join(F.broadcast(index), "d", "left").select("symbol", "d", "idx_vol", "idx_upvol", "idx_st")  # sessions of one symbol


@query(
    """WITH ix AS (SELECT b.d, s.up, b.c > e.value AS above FROM ret b LEFT JOIN strend s ON s.symbol = b.symbol AND s.i = b.i LEFT JOIN e ON e.symbol = b.symbol AND e.i = b.i WHERE b.symbol = 'S0')
    SELECT a.symbol, a.d, last_value(ix.up IGNORE NULLS) OVER w AS idx_st_up, last_value(ix.above IGNORE NULLS) OVER w AS idx_above_ema50
    FROM bars a LEFT JOIN ix ON a.d = ix.d WINDOW w AS (PARTITION BY a.symbol ORDER BY a.d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    TREND_SQL + "," + ema_sql("e", 50),
)
def index_trend(spark, sf_dir):
    own = bars(spark, sf_dir)
    index = own.where(F.col("symbol") == INDEX)
    mean = T.ema(index, 50).select("d", (F.col("c") > F.col("value")).alias("idx_above_ema50"))
    columns = mean.join(T.supertrend(index).select("d", F.col("up").alias("idx_st_up")), "d", "left")
    return X.join_index(own, columns).select("symbol", "d", "idx_st_up", "idx_above_ema50")


@query("SELECT symbol, d, up, round(c / CASE WHEN up THEN fl ELSE fu END - 1, 6) AS st_dist FROM strend", TREND_SQL)
def trend_distance(spark, sf_dir):
    """How far the close lies from the trend line."""
    own = bars(spark, sf_dir).select("symbol", "d", F.col("c").alias("close"))
    rows = T.supertrend(bars(spark, sf_dir)).select("symbol", "d", "up", "line").join(own, ["symbol", "d"])
    return rows.select("symbol", "d", "up", r6(F.col("close") / F.col("line") - 1).alias("st_dist"))


@query(
    """WITH b AS (SELECT *, CAST(floor(sec / 60) * 60 AS int) AS minute FROM act WHERE vol * price >= 10000),
    k AS (SELECT d, minute, side FROM b WHERE minute NOT IN (33300, 46800) GROUP BY d, minute, side HAVING count(DISTINCT symbol) >= 2)
    SELECT b.symbol, b.d, b.i, b.side, k.minute IS NOT NULL AS in_basket FROM b LEFT JOIN k ON b.d = k.d AND b.minute = k.minute AND b.side = k.side""",
    volume.ORDERS_SQL,
)
def basket_orders(spark, sf_dir):
    """Large orders, flagged where others bought or sold along; minutes stand for seconds as in order_baskets."""
    by_minute = volume.orders(spark, sf_dir).withColumn("sec", (F.floor(F.col("sec") / 60) * 60).cast("int"))
    return A.basket_members(by_minute, 10_000.0, 2).select("symbol", "d", "i", "side", "in_basket")


@query(
    """WITH l AS (SELECT k.symbol, k.d, b.ret10, b.ret_now FROM kept k JOIN (
      SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) - 1 AS age, lead(c, 10) OVER (PARTITION BY symbol ORDER BY d) / c - 1 AS ret10,
             first_value(c) OVER (PARTITION BY symbol ORDER BY d DESC) / c - 1 AS ret_now FROM bars) b ON k.symbol = b.symbol AND k.d = b.d WHERE b.age < 250)
    SELECT 'red_vol_demand' AS code, count(*) AS n, count(ret10) AS n_done, round(avg(ret10), 6) AS ret10, count(*) FILTER (ret10 > 0) AS n_up, round(avg(ret_now), 6) AS ret_now FROM l HAVING count(*) > 0""",
    KEPT_SQL,
)
def event_log_summary(spark, sf_dir):
    own = bars(spark, sf_dir)
    kept = E.keep_first(own.withColumn("hit", E.red_volume_demand()), "hit").withColumn("code", F.lit("red_vol_demand"))
    return E.log_summary(E.event_log(own, kept)).withColumns({c: r6(c) for c in ("ret10", "ret_now")})


@query(
    """SELECT b.symbol, b.d, round(b.c, 4) AS c, b.v, round(CASE WHEN s.up THEN s.fl ELSE s.fu END, 2) AS st, s.up, round(a.value, 2) AS ema, g.signal AS sig
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS late FROM ret) b
    LEFT JOIN strend s ON s.symbol = b.symbol AND s.i = b.i LEFT JOIN a ON a.symbol = b.symbol AND a.i = b.i LEFT JOIN (
      SELECT symbol, d, 'st_exit' AS signal FROM runs WHERE i > 40 AND NOT up AND was
      UNION ALL SELECT symbol, d, 'st_buy' FROM (SELECT *, sum(CASE WHEN up AND c > mean THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY i) AS times FROM runs)
      WHERE i > 40 AND was IS NOT NULL AND up AND c > mean AND times = 1) g ON g.symbol = b.symbol AND g.d = b.d WHERE b.late <= 22""",
    RUNS_SQL,
)
def card_candles(spark, sf_dir):
    rows = T.cards(bars(spark, sf_dir))
    return rows.select("symbol", "d", F.round("c", 4).alias("c"), "v", F.round("st", 2).alias("st"), "up", F.round("ema", 2).alias("ema"), "sig")


_CHART = structures.N_SQL.replace(
    BARS_SQL,
    BARS_SQL.replace("bars AS (", "every AS (")
    + """,
bars AS (SELECT symbol, d, o, h, l, c, v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS late, count(*) OVER (PARTITION BY symbol) AS n FROM every) WHERE late <= 400 AND least(n, 400) >= 60)""",
)


@query(
    """WITH z AS (SELECT symbol, greatest(max(t) + 1 - 120, 0) AS s0 FROM nb GROUP BY symbol)
    SELECT n.symbol, n.t - z.s0 AS i, n.d, round(n.o, 4) AS o, round(n.h, 4) AS h, round(n.l, 4) AS l, round(n.c, 4) AS c, max(CASE WHEN s.up THEN round(s.p, 4) END) AS high, max(CASE WHEN NOT s.up THEN round(s.p, 4) END) AS low
    FROM nb n JOIN z ON z.symbol = n.symbol LEFT JOIN sw s ON s.symbol = n.symbol AND s.t = n.t WHERE n.t >= z.s0 GROUP BY ALL""",
    _CHART,
)
def chart_slice(spark, sf_dir):
    """The bars of each symbol's chart with its swings: structure of the last 400 bars, of which 120 are drawn, numbered from 0."""
    return S.chart(bars(spark, sf_dir)).select("symbol", "i", "d", *[F.round(x, 4).alias(x) for x in ("o", "h", "l", "c", "high", "low")])


@query(
    """WITH z AS (SELECT symbol, greatest(max(t) + 1 - 120, 0) AS s0 FROM nb GROUP BY symbol)
    SELECT b.symbol, b.s - z.s0 AS s, b.t - z.s0 AS t, round(b.p, 4) AS p, b.up, CASE WHEN was IS NULL OR was = up THEN 'BOS' ELSE 'CHoCH' END AS label FROM br b JOIN z ON z.symbol = b.symbol WHERE b.s >= z.s0""",
    _CHART,
)
def chart_breaks(spark, sf_dir):
    return S.chart_breaks(bars(spark, sf_dir)).select("symbol", "s", "t", F.round("p", 4).alias("p"), "up", "label")


@query(
    """SELECT a.symbol, a.d, round(a.c / a.c0 / (b.c / z.c) - 1, 6) AS rs20 FROM (SELECT *, lag(c, 20) OVER w AS c0, lag(d, 20) OVER w AS d0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) a
    JOIN bars b ON b.symbol = 'S0' AND b.d = a.d JOIN bars z ON z.symbol = 'S0' AND z.d = a.d0 WHERE a.symbol <> 'S0'""",
    BARS_SQL,
)
def relative_strength(spark, sf_dir):
    own = bars(spark, sf_dir)
    return S.relative_strength(own.where(F.col("symbol") != INDEX), own.where(F.col("symbol") == INDEX)).withColumn("rs20", r6("rs20"))


@query("SELECT symbol, d, settled FROM (SELECT symbol, d, max(sec) >= 53040 AS settled, max(d) OVER (PARTITION BY symbol) AS last FROM mins GROUP BY symbol, d) WHERE settled OR d = last", volume.MINUTES_SQL)
def settled_days(spark, sf_dir):
    return G.settled_days(Z.minute_bars(ticks(spark, sf_dir)))


_STORE = volume.DAYS_SQL + """,
put AS (SELECT symbol, d, val + 1 AS val FROM days WHERE day(d) % 2 = 1 AND (symbol, d) NOT IN (SELECT symbol, d FROM days WHERE day(d) % 3 = 0) UNION ALL SELECT symbol, d, val FROM days WHERE day(d) % 3 = 0)"""


@query("SELECT symbol, d, round(val, 4) AS val FROM put SEMI JOIN (SELECT DISTINCT d FROM put ORDER BY d DESC LIMIT 20) k ON k.d = put.d", _STORE)
def flow_store(spark, sf_dir):
    """Records of odd days stored before, of every third day delivered now; 20 dates are kept."""
    own = A.symbol_day(volume.orders(spark, sf_dir), volume.BIG, 20).select("symbol", "d", "val")
    out = G.put_records(own.where(F.day("d") % 2 == 1).withColumn("val", F.col("val") + 1), own.where(F.day("d") % 3 == 0), 20)
    return out.select("symbol", "d", F.round("val", 4).alias("val"))


@query(
    """WITH k AS (SELECT DISTINCT d FROM days ORDER BY d DESC LIMIT 20),
    ch AS (SELECT symbol, d, count(*) AS n, sum(CASE WHEN side = 'B' THEN 1 ELSE -1 END * n * vol * avg_price) AS net FROM chains GROUP BY symbol, d)
    SELECT y.d, count(*) AS symbols, CAST(coalesce(sum(c.n), 0) AS bigint) AS chains, round(coalesce(sum(c.net), 0), 4) AS net, round(sum(y.whale_buy - y.whale_sell), 4) AS whale
    FROM days y SEMI JOIN k ON k.d = y.d LEFT JOIN ch c ON c.symbol = y.symbol AND c.d = y.d GROUP BY y.d""",
    volume.DAYS_SQL,
)
def flow_index(spark, sf_dir):
    """The index of the last 20 sessions' pages."""
    own = volume.orders(spark, sf_dir)
    out = A.site_index(A.symbol_day(own, volume.BIG, 20), A.chains(own, volume.SIZE, volume.STEADY, volume.EVEN), 20)
    return out.withColumns({c: F.round(c, 4) for c in ("net", "whale")})


_COMBINED = volume.DAYS_SQL + """,
mb AS (SELECT *, CAST(floor(sec / 60) * 60 AS int) AS minute, vol * price AS val, CASE WHEN side = 'B' THEN 1 ELSE -1 END AS sg FROM act WHERE vol * price >= 10000),
mk AS (SELECT d, minute, side FROM mb WHERE minute NOT IN (33300, 46800) GROUP BY d, minute, side HAVING count(DISTINCT symbol) >= 2),
bk AS (SELECT symbol, d, sum(sg * val) AS bk, sum(CASE WHEN val >= 25000 THEN sg * val ELSE 0 END) AS bk_whale FROM mb SEMI JOIN mk ON mk.d = mb.d AND mk.minute = mb.minute AND mk.side = mb.side GROUP BY symbol, d),
ca AS (SELECT symbol, d, sum(CASE WHEN side = 'B' THEN 1 ELSE -1 END * vol * list_sum(prices)) AS algo,
  sum(CASE WHEN side = 'B' THEN 1 ELSE -1 END * coalesce(list_sum(list_filter(list_transform(prices, lambda p: vol * p), lambda x: x >= 25000)), 0)) AS overlap FROM chains GROUP BY symbol, d)"""


@query(
    """SELECT y.symbol, y.d, round(coalesce(a.algo, 0), 4) AS algo, round(coalesce(b.bk, 0), 4) AS bk, round(y.whale_buy - y.whale_sell, 4) AS whale,
    round(y.whale_buy - y.whale_sell + coalesce(a.algo - a.overlap, 0) - coalesce(b.bk_whale, 0), 4) AS comb
    FROM days y LEFT JOIN ca a ON a.symbol = y.symbol AND a.d = y.d LEFT JOIN bk b ON b.symbol = y.symbol AND b.d = y.d""",
    _COMBINED,
)
def combined_flow(spark, sf_dir):
    """Large orders and chains together, without what both have and without the large orders of baskets."""
    own = volume.orders(spark, sf_dir)
    by_minute = own.withColumn("sec", (F.floor(F.col("sec") / 60) * 60).cast("int"))
    members = A.basket_members(by_minute, 10_000.0, 2)
    out = A.combined(A.symbol_day(own, volume.BIG, 20), A.chains(own, volume.SIZE, volume.STEADY, volume.EVEN), members, volume.BIG)
    return out.select("symbol", "d", *[F.round(c, 4).alias(c) for c in ("algo", "bk", "whale", "comb")])
