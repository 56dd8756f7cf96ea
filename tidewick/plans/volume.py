"""Queries of volume by price and of hidden flow, on ticks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rolling import r6
from ..operators import flow as A
from ..operators import sliding as L
from ..operators import zones as Z
from ..sources.market import TICKS_SQL, ticks
from .registry import query

#: Thresholds to the scale of the stand-in ticks.
BIG, BINS = 25_000.0, 40
STEADY, EVEN, SIZE = ((20_000, 4), (9_000, 4)), (9_000, 5, 0.6), 200

LEVELS_SQL = TICKS_SQL + """,
t1 AS (
  SELECT *, side NOT IN ('PS', 'PB') OR lag(sec) OVER w IS DISTINCT FROM sec OR lag(side) OVER w IS DISTINCT FROM side AS new_sweep,
         side NOT IN ('PS', 'PB') OR lag(sec) OVER w IS DISTINCT FROM sec OR lag(side) OVER w IS DISTINCT FROM side OR lag(price) OVER w IS DISTINCT FROM price AS new_order
  FROM ticks WINDOW w AS (PARTITION BY symbol, d ORDER BY acc)
),
t2 AS (
  SELECT *, sum(new_sweep::int) OVER w AS sweep, sum(new_order::int) OVER w AS ord
  FROM t1 WINDOW w AS (PARTITION BY symbol, d ORDER BY acc ROWS UNBOUNDED PRECEDING)
),
t3 AS (SELECT *, sum(price * vol) OVER (PARTITION BY symbol, d, sweep) >= 25000 AS big FROM t2),
levels AS (
  SELECT symbol, d, round(price, 3) AS price,
         CAST(sum(CASE WHEN side = 'PS' THEN vol ELSE 0 END) AS bigint) AS buy, CAST(sum(CASE WHEN side = 'PB' THEN vol ELSE 0 END) AS bigint) AS sell,
         CAST(sum(CASE WHEN side NOT IN ('PS', 'PB') THEN vol ELSE 0 END) AS bigint) AS x,
         CAST(sum(CASE WHEN side = 'PS' AND big THEN vol ELSE 0 END) AS bigint) AS big_buy, CAST(sum(CASE WHEN side = 'PB' AND big THEN vol ELSE 0 END) AS bigint) AS big_sell
  FROM t3 GROUP BY symbol, d, round(price, 3)
),
sess AS (SELECT symbol, d, max_by(price, acc) AS close, CAST(sum(vol) AS bigint) AS total, count(*) AS ticks, CAST(greatest(max(acc) - sum(vol), 0) AS bigint) AS gap FROM ticks GROUP BY symbol, d),
st0 AS (
  SELECT symbol, d, CAST(sum(buy) AS bigint) AS buy, CAST(sum(sell) AS bigint) AS sell, CAST(sum(x) AS bigint) AS x, sum(big_buy * price) AS b, sum(big_sell * price) AS s
  FROM levels GROUP BY symbol, d
),
stats AS (
  SELECT symbol, d, buy, sell, x, buy - sell AS net, CASE WHEN buy + sell > 0 THEN buy / (buy + sell) END AS buy_share,
         CASE WHEN buy + sell > 0 THEN b / 1e6 END AS big_buy_val, CASE WHEN buy + sell > 0 THEN s / 1e6 END AS big_sell_val,
         CASE WHEN buy + sell > 0 THEN (b - s) / 1e6 END AS big_net_val, buy + sell = 0 AND x > 0 AS no_side
  FROM st0
)"""


def levels(spark, sf_dir):
    return Z.levels(ticks(spark, sf_dir), BIG)


@query("SELECT symbol, d, sec, round(price, 4) AS price, vol, side, acc FROM ticks", TICKS_SQL)
def ticks_from_events(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("price", F.round("price", 4))


@query("SELECT symbol, d, any_value(sec) AS sec, round(any_value(price), 4) AS price, any_value(side) AS side, CAST(sum(vol) AS bigint) AS vol, min(acc) AS acc FROM t2 GROUP BY symbol, d, ord", LEVELS_SQL)
def orders_merge(spark, sf_dir):
    return Z.orders(ticks(spark, sf_dir)).withColumn("price", F.round("price", 4))


@query("SELECT * FROM levels", LEVELS_SQL)
def session_levels(spark, sf_dir):
    return levels(spark, sf_dir)


@query("SELECT symbol, d, round(close, 4) AS close, total, ticks, gap FROM sess", LEVELS_SQL)
def session_totals(spark, sf_dir):
    return Z.sessions(ticks(spark, sf_dir)).withColumn("close", F.round("close", 4))


_VALUES = ("buy_share", "big_buy_val", "big_sell_val", "big_net_val")


@query("SELECT symbol, d, buy, sell, x, net, round(buy_share, 6) AS buy_share, round(big_buy_val, 6) AS big_buy_val, round(big_sell_val, 6) AS big_sell_val, round(big_net_val, 6) AS big_net_val, no_side FROM stats", LEVELS_SQL)
def session_stats(spark, sf_dir):
    return Z.session_stats(levels(spark, sf_dir)).withColumns({c: r6(c) for c in _VALUES})


PROFILE_SQL = LEVELS_SQL + """,
recent AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS back FROM levels) WHERE back <= 20),
span0 AS (SELECT symbol, min(price) AS lo, max(price) AS hi FROM recent WHERE price > 0 AND buy + sell + x > 0 GROUP BY symbol),
span1 AS (SELECT *, CASE WHEN hi < 10 THEN 0.01::double WHEN hi < 50 THEN 0.05::double ELSE 0.1::double END AS step FROM span0),
span2 AS (SELECT *, round(step * greatest(1, ceil(greatest(hi - lo, step) / (step * 40) - 1e-6::double)), 4) AS width FROM span1),
span3 AS (SELECT *, round(floor(lo / width + 1e-6::double) * width, 4) AS base FROM span2),
span AS (SELECT *, CAST(floor((hi - base) / width + 1e-6::double) + 1 AS int) AS n FROM span3),
filled AS (
  SELECT r.symbol, CAST(least(s.n - 1, floor((r.price - s.base) / s.width + 1e-6::double)) AS int) AS bin, sum(buy) AS buy, sum(sell) AS sell, sum(x) AS x,
         sum(big_buy) AS big_buy, sum(big_sell) AS big_sell, count(DISTINCT d) AS sessions
  FROM recent r JOIN span s ON r.symbol = s.symbol WHERE r.price > 0 AND buy + sell + x > 0 GROUP BY 1, 2
),
dense AS (SELECT symbol, base, width, unnest(range(n)) AS bin FROM span),
bins AS (
  SELECT a.symbol, CAST(a.bin AS int) AS bin, round(a.base + a.bin * a.width, 4) AS lo, round(a.base + (a.bin + 1) * a.width, 4) AS hi,
         CAST(coalesce(b.buy, 0) AS bigint) AS buy, CAST(coalesce(b.sell, 0) AS bigint) AS sell, CAST(coalesce(b.x, 0) AS bigint) AS x,
         CAST(coalesce(b.big_buy, 0) AS bigint) AS big_buy, CAST(coalesce(b.big_sell, 0) AS bigint) AS big_sell, coalesce(b.sessions, 0) AS sessions,
         CAST(coalesce(b.buy + b.sell + b.x, 0) AS bigint) AS total
  FROM dense a LEFT JOIN filled b ON a.symbol = b.symbol AND a.bin = b.bin
)"""


def profile(spark, sf_dir):
    return Z.profile(Z.recent(levels(spark, sf_dir), 20), BINS)


@query("SELECT * FROM bins", PROFILE_SQL)
def profile_bins(spark, sf_dir):
    return profile(spark, sf_dir)


AREA_SQL = PROFILE_SQL + """,
lists AS (SELECT symbol, list(total ORDER BY bin) AS t, CAST(sum(total) AS bigint) AS total FROM bins GROUP BY symbol),
area AS (
  WITH RECURSIVE g AS (
    SELECT symbol, t, total, list_position(t, list_max(t)) AS poc, list_position(t, list_max(t)) AS lo, list_position(t, list_max(t)) AS hi, list_max(t) AS acc FROM lists
    UNION ALL
    SELECT symbol, t, total, poc, CASE WHEN above > below THEN lo ELSE lo - 1 END, CASE WHEN above > below THEN hi + 1 ELSE hi END, acc + greatest(above, below)
    FROM (SELECT *, CASE WHEN lo > 1 THEN t[lo - 1] ELSE -1 END AS below, CASE WHEN hi < len(t) THEN t[hi + 1] ELSE -1 END AS above FROM g WHERE acc < total * 0.7::double)
    WHERE above >= 0 OR below >= 0
  ) SELECT symbol, poc - 1 AS poc, min(lo) - 1 AS val_bin, max(hi) - 1 AS vah_bin, total FROM g GROUP BY symbol, poc, total
)"""


@query("SELECT symbol, CAST(poc AS int) AS poc, CAST(val_bin AS int) AS val_bin, CAST(vah_bin AS int) AS vah_bin, total FROM area", AREA_SQL)
def value_area(spark, sf_dir):
    return Z.value_area(profile(spark, sf_dir))


def _zones_sql(buy: str, sell: str, total: str) -> str:
    return f"""
    WITH z0 AS (
      SELECT *, {total} AS vol, sum({total}) OVER (PARTITION BY symbol) / count(*) OVER (PARTITION BY symbol) AS mean, {buy} / nullif({buy} + {sell}, 0) AS share0 FROM bins
    ),
    z1 AS (SELECT *, CASE WHEN mean > 0 AND vol >= 1.2 * mean THEN CASE WHEN share0 >= 0.58 THEN 'buy' WHEN share0 <= 0.42 THEN 'sell' END END AS side FROM z0),
    z2 AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY symbol ORDER BY bin) IS NOT DISTINCT FROM side THEN 0 ELSE 1 END AS new FROM z1),
    z3 AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM z2)
    SELECT symbol, side, min(lo) AS lo, max(hi) AS hi, CAST(sum(vol) AS bigint) AS vol, CAST(sum({buy}) AS bigint) AS buy, CAST(sum({sell}) AS bigint) AS sell,
           round(sum({buy}) / (sum({buy}) + sum({sell})), 6) AS share
    FROM z3 WHERE side IS NOT NULL GROUP BY symbol, run, side"""


@query(_zones_sql("buy", "sell", "total"), PROFILE_SQL)
def flow_zones(spark, sf_dir):
    return Z.zones(profile(spark, sf_dir)).withColumn("share", r6("share"))


@query(_zones_sql("big_buy", "big_sell", "(big_buy + big_sell)"), PROFILE_SQL)
def whale_zones(spark, sf_dir):
    return Z.zones(profile(spark, sf_dir), "big_buy", "big_sell", F.col("big_buy") + F.col("big_sell")).withColumn("share", r6("share"))


@query(
    """WITH s AS (SELECT symbol, round(round_even(price / 0.05::double, 0) * 0.05::double, 4) AS price, sum(buy) AS buy, sum(sell) AS sell, sum(big_buy) AS big_buy, sum(big_sell) AS big_sell, count(DISTINCT d) AS sessions
               FROM recent GROUP BY 1, 2),
    k AS (SELECT symbol, price, sessions, 'buy' AS kind, buy AS vol FROM s UNION ALL SELECT symbol, price, sessions, 'sell', sell FROM s
          UNION ALL SELECT symbol, price, sessions, 'big_buy', big_buy FROM s UNION ALL SELECT symbol, price, sessions, 'big_sell', big_sell FROM s),
    p AS (SELECT *, vol / nullif(sum(vol) OVER (PARTITION BY symbol, kind), 0) AS pct FROM k)
    SELECT symbol, kind, row_number() OVER (PARTITION BY symbol, kind ORDER BY vol DESC, price) AS rank, price, CAST(vol AS bigint) AS vol, round(pct, 6) AS pct, sessions
    FROM p WHERE vol > 0 QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY vol DESC, price) <= 5""",
    PROFILE_SQL,
)
def top_levels(spark, sf_dir):
    return Z.top_levels(Z.recent(levels(spark, sf_dir), 20)).withColumn("pct", r6("pct"))


@query(
    """SELECT symbol, max(d) AS d, CAST(sum(CASE WHEN back = 1 THEN net END) AS bigint) AS net, CAST(sum(buy) AS bigint) AS buy_n, CAST(sum(sell) AS bigint) AS sell_n,
           CAST(sum(net) AS bigint) AS net_n, round(sum(big_net_val), 6) AS big_net_n
    FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS back FROM stats) WHERE back <= 5 GROUP BY symbol""",
    LEVELS_SQL,
)
def market_row(spark, sf_dir):
    return Z.market_row(Z.session_stats(levels(spark, sf_dir))).withColumn("big_net_n", r6("big_net_n"))


FORCE_SQL = LEVELS_SQL + """,
ch AS (SELECT s.*, e.close AS c, lag(e.close) OVER (PARTITION BY s.symbol ORDER BY s.d) AS pc FROM stats s JOIN sess e ON s.symbol = e.symbol AND s.d = e.d),
fc AS (
  SELECT *, CASE WHEN buy + sell = 0 THEN 'none' WHEN abs((buy - sell) / (buy + sell)) < 0.05::double THEN 'bal'
      WHEN buy > sell THEN CASE WHEN coalesce(c / pc - 1, 0) > 0.003::double THEN 'up' ELSE 'prop' END
      ELSE CASE WHEN coalesce(c / pc - 1, 0) < -0.003::double THEN 'down' ELSE 'dist' END END AS force
  FROM ch
)"""


def changes(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    return Z.with_change(Z.session_stats(Z.levels(rows, BIG)), Z.sessions(rows))


@query("SELECT symbol, d, net, force FROM fc", FORCE_SQL)
def flow_force(spark, sf_dir):
    return changes(spark, sf_dir).select("symbol", "d", "net", "force")


@query(
    """WITH l AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS back FROM fc) WHERE back <= 10),
    a AS (SELECT symbol, count(*) AS n, sum(buy) AS buy, sum(sell) AS sell, arg_min(coalesce(pc, c), d) AS base, arg_max(c, d) AS last,
                 count(*) FILTER (force = 'up') AS u, count(*) FILTER (force = 'prop') AS p, count(*) FILTER (force = 'down') AS w, count(*) FILTER (force = 'dist') AS t,
                 count(*) FILTER (force = 'bal') AS b, count(*) FILTER (force = 'none') AS x FROM l GROUP BY symbol),
    f AS (SELECT *, (buy - sell) / nullif(buy + sell, 0) AS flow, last / base - 1 AS chg FROM a)
    SELECT symbol, n, round(flow, 6) AS flow, round(chg, 6) AS chg,
      CASE WHEN x * 2 >= n THEN 'none' WHEN u * 2 >= n AND u >= greatest(p, w, t, b) THEN 'up' WHEN p * 2 >= n AND p >= greatest(u, w, t, b) THEN 'prop'
           WHEN w * 2 >= n AND w >= greatest(u, p, t, b) THEN 'down' WHEN t * 2 >= n AND t >= greatest(u, p, w, b) THEN 'dist' WHEN b * 2 >= n AND b >= greatest(u, p, w, t) THEN 'bal'
           WHEN flow IS NULL THEN 'none'
           WHEN flow >= 0.05::double THEN CASE WHEN chg >= 0.015::double THEN 'chased_up' WHEN chg <= -0.015::double THEN 'held_down' ELSE 'absorbed_in' END
           WHEN flow <= -0.05::double THEN CASE WHEN chg <= -0.015::double THEN 'sold_down' WHEN chg >= 0.015::double THEN 'sold_into' ELSE 'absorbed_out' END
           ELSE 'bal' END AS verdict
    FROM f""",
    FORCE_SQL,
)
def flow_verdict(spark, sf_dir):
    return Z.verdict(changes(spark, sf_dir)).withColumns({"flow": r6("flow"), "chg": r6("chg")})


MINUTES_SQL = TICKS_SQL + """,
mins AS (SELECT symbol, d, CAST(floor(sec / 60) * 60 AS int) AS sec, min_by(price, acc) AS o, max(price) AS h, min(price) AS l, max_by(price, acc) AS c, CAST(sum(vol) AS bigint) AS v
         FROM ticks GROUP BY 1, 2, 3)"""


@query("SELECT symbol, d, sec, round(o, 4) AS o, round(h, 4) AS h, round(l, 4) AS l, round(c, 4) AS c, v FROM mins", MINUTES_SQL)
def minute_bars(spark, sf_dir):
    return Z.minute_bars(ticks(spark, sf_dir)).withColumns({x: F.round(x, 4) for x in "ohlc"})


@query(
    """WITH a AS (SELECT *, sec <= 33300 OR sec >= 53100 AS auction, lag(c) OVER (PARTITION BY symbol, d ORDER BY sec) AS pc FROM (SELECT symbol, d, sec, round(o, 4) AS o, round(h, 4) AS h, round(l, 4) AS l, round(c, 4) AS c, v FROM mins)),
    b AS (SELECT *, CASE WHEN auction THEN NULL WHEN c > o THEN 'buy' WHEN c < o THEN 'sell' WHEN c > pc THEN 'buy' WHEN c < pc THEN 'sell' END AS own FROM a),
    e AS (SELECT *, CASE WHEN auction THEN 'x' ELSE coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol, d ORDER BY sec ROWS UNBOUNDED PRECEDING), 'buy') END AS side,
                 CAST(round_even(l / 0.05::double, 0) AS bigint) AS lo, CAST(round_even(h / 0.05::double, 0) AS bigint) AS hi, CAST(round_even(c / 0.05::double, 0) AS bigint) AS near FROM b),
    g AS (SELECT *, unnest(range(lo, hi + 1)) AS k, hi - lo + 1 AS n FROM e WHERE v > 0),
    s AS (SELECT symbol, d, side, round(k * 0.05::double, 3) AS price, v // n + CASE WHEN k = greatest(lo, least(hi, near)) THEN v % n ELSE 0 END AS vol FROM g)
    SELECT symbol, d, price, CAST(sum(CASE WHEN side = 'buy' THEN vol ELSE 0 END) AS bigint) AS buy, CAST(sum(CASE WHEN side = 'sell' THEN vol ELSE 0 END) AS bigint) AS sell,
           CAST(sum(CASE WHEN side = 'x' THEN vol ELSE 0 END) AS bigint) AS x FROM s GROUP BY 1, 2, 3""",
    MINUTES_SQL,
)
def estimated_levels(spark, sf_dir):
    bars = Z.minute_bars(ticks(spark, sf_dir)).withColumns({x: F.round(x, 4) for x in "ohlc"})
    return Z.estimate_levels(bars)


#: Whale pairs of sparse ticks are farther apart.
PAIR_GAP = 1.0

#: The sessions before each session, once for each window: what value areas and pairs are taken from.
_BEFORE = """sn AS (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS z FROM (SELECT DISTINCT symbol, d FROM levels)),
wn AS (SELECT unnest([10, 20, 40]) AS w),
chg AS (SELECT st.symbol, st.d, big_net_val, close AS c, lag(close) OVER (PARTITION BY st.symbol ORDER BY st.d) AS pc FROM stats st JOIN sess ON sess.symbol = st.symbol AND sess.d = st.d)"""
SLID_SQL = LEVELS_SQL + ",\n" + _BEFORE + """,
recent AS (SELECT concat_ws('@', e.symbol, e.d, w) AS symbol, l.d, price, buy, sell, x, big_buy, big_sell
  FROM sn e JOIN wn ON true JOIN sn m ON m.symbol = e.symbol AND m.z BETWEEN e.z - w AND e.z - 1 JOIN levels l ON l.symbol = m.symbol AND l.d = m.d),""" + AREA_SQL[AREA_SQL.index("\nspan0 AS") :] + """,
edges AS MATERIALIZED (SELECT split_part(a.symbol, '@', 1) AS symbol, CAST(split_part(a.symbol, '@', 2) AS date) AS d, CAST(split_part(a.symbol, '@', 3) AS int) AS w, lo.lo AS val, hi.hi AS vah
  FROM area a JOIN bins lo ON lo.symbol = a.symbol AND lo.bin = a.val_bin JOIN bins hi ON hi.symbol = a.symbol AND hi.bin = a.vah_bin),
brk AS MATERIALIZED (SELECT e.symbol, e.d, w, CASE WHEN pc <= vah AND c > vah AND big_net_val > 0 THEN 'up' WHEN pc >= val AND c < val AND big_net_val < 0 THEN 'down' END AS direction, val, vah
  FROM edges e JOIN chg ON chg.symbol = e.symbol AND chg.d = e.d)"""

_PAIRS_SQL = LEVELS_SQL + ",\n" + _BEFORE + f""",
wl AS (SELECT e.symbol, e.d, w, k, round(round_even(price / 0.05::double, 0) * 0.05::double, 4) AS price, sum(big_buy) AS b, sum(big_sell) AS s
  FROM sn e JOIN wn ON true JOIN (SELECT unnest([0, 1]) AS k) ON true JOIN sn m ON m.symbol = e.symbol AND m.z BETWEEN e.z - w - k + 1 AND e.z - k JOIN levels l ON l.symbol = m.symbol AND l.d = m.d WHERE e.z > 1 GROUP BY 1, 2, 3, 4, 5),
wp AS (SELECT * FROM (SELECT symbol, d, w, k, first(price ORDER BY b DESC, price) FILTER (b > 0) AS buy_p, first(price ORDER BY s DESC, price) FILTER (s > 0) AS sell_p FROM wl GROUP BY 1, 2, 3, 4) WHERE abs(buy_p - sell_p) <= {PAIR_GAP} + 1e-9),
prs AS MATERIALIZED (SELECT symbol, d, w, buy_p, sell_p FROM wp n WHERE k = 0 AND NOT EXISTS (SELECT 1 FROM wp o WHERE o.k = 1 AND o.symbol = n.symbol AND o.d = n.d AND o.w = n.w))"""


def _slid(spark, sf_dir):
    """(stats with closes, sliding profiles) of all sessions."""
    rows = ticks(spark, sf_dir)
    by_level = Z.levels(rows, BIG)
    return Z.with_change(Z.session_stats(by_level), Z.sessions(rows)), L.slide(by_level, L.WINDOWS, BINS, PAIR_GAP)


@query("SELECT symbol, d, CAST(w AS integer) AS w, val, vah FROM edges", SLID_SQL)
def sliding_value_areas(spark, sf_dir):
    """The value area of the 10, 20 and 40 sessions before each session."""
    return _slid(spark, sf_dir)[1].where("val IS NOT NULL").select("symbol", "d", "w", "val", "vah")


@query("SELECT symbol, d, CAST(w AS integer) AS w, direction, CASE direction WHEN 'up' THEN vah ELSE val END AS level FROM brk WHERE direction IS NOT NULL", SLID_SQL)
def break_alerts(spark, sf_dir):
    """Closes that leave the value area of any of three windows, with large orders behind them."""
    return L.breaks(*_slid(spark, sf_dir))


@query("SELECT symbol, d, CAST(w AS integer) AS w, buy_p, sell_p FROM prs", _PAIRS_SQL)
def pair_alerts(spark, sf_dir):
    """Whale pairs of each session's windows that the session before did not have."""
    return L.pairs(_slid(spark, sf_dir)[1])


@query(
    """WITH b AS (SELECT symbol, d, count(*) AS n_breaks, min(w) AS first_break FROM brk WHERE direction IS NOT NULL GROUP BY symbol, d), p AS (SELECT symbol, d, count(*) AS n_pairs FROM prs GROUP BY symbol, d)
    SELECT symbol, d, c AS close, round(big_net_val, 6) AS big_net_val, coalesce(n_breaks, 0) AS n_breaks, CAST(first_break AS integer) AS first_break, coalesce(n_pairs, 0) AS n_pairs
    FROM b FULL JOIN p USING (symbol, d) JOIN chg USING (symbol, d)""",
    SLID_SQL + _PAIRS_SQL[len(LEVELS_SQL + ",\n" + _BEFORE) :],
)
def session_alerts(spark, sf_dir):
    """One row for each symbol and session with an alert on any window."""
    out = L.alerts(*_slid(spark, sf_dir))
    counts = [F.size("breaks").cast("long").alias("n_breaks"), F.get("breaks", F.lit(0))["w"].alias("first_break"), F.size("pairs").cast("long").alias("n_pairs")]
    return out.select("symbol", "d", "close", F.round("big_net_val", 6).alias("big_net_val"), *counts)


ORDERS_SQL = TICKS_SQL + """,
a0 AS (SELECT *, CASE WHEN side = 'PS' THEN 'B' ELSE 'S' END AS s FROM ticks WHERE side IN ('PS', 'PB')),
a1 AS (SELECT *, CASE WHEN lag(sec) OVER w IS NOT DISTINCT FROM sec AND lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS new FROM a0 WINDOW w AS (PARTITION BY symbol, d ORDER BY acc)),
a2 AS (SELECT *, sum(new) OVER (PARTITION BY symbol, d ORDER BY acc ROWS UNBOUNDED PRECEDING) AS i FROM a1),
act AS (SELECT symbol, d, CAST(i AS bigint) AS i, any_value(sec) AS sec, any_value(s) AS side, CAST(sum(vol) AS bigint) AS vol, max_by(price, acc) AS price FROM a2 GROUP BY symbol, d, i)"""


def orders(spark, sf_dir):
    return A.active_orders(ticks(spark, sf_dir))


@query("SELECT symbol, d, i, sec, side, vol, round(price, 4) AS price FROM act", ORDERS_SQL)
def active_orders(spark, sf_dir):
    return orders(spark, sf_dir).withColumn("price", F.round("price", 4))


@query(
    """SELECT symbol, d, CAST(floor(sec / 300) * 300 AS int) AS start, round(min_by(price, i), 4) AS o, round(max(price), 4) AS h, round(min(price), 4) AS l, round(max_by(price, i), 4) AS c,
    CAST(sum(CASE WHEN side = 'B' THEN vol ELSE 0 END) AS bigint) AS buy, CAST(sum(CASE WHEN side = 'S' THEN vol ELSE 0 END) AS bigint) AS sell FROM act GROUP BY 1, 2, 3""",
    ORDERS_SQL,
)
def candles5(spark, sf_dir):
    return A.candles(orders(spark, sf_dir)).withColumns({x: F.round(x, 4) for x in "ohlc"})


def _segment_sql(name: str, gap: int) -> str:
    return f"""
{name}0 AS (SELECT *, sec - lag(sec) OVER (PARTITION BY symbol, d, side, vol ORDER BY sec, i) AS g FROM own),
{name}1 AS (SELECT *, sum(CASE WHEN g <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, d, side, vol ORDER BY sec, i ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN g <= {gap} THEN g END AS gap FROM {name}0),
{name}2 AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY symbol, d, side, vol, seg) AS beat FROM {name}1),
{name}3 AS (SELECT *, round_even(gap / nullif(beat, 0), 0) AS k FROM {name}2),
{name}4 AS (SELECT *, coalesce(k BETWEEN 1 AND 3 AND abs(gap - k * beat) <= 0.15::double * beat, false) AS good FROM {name}3),
{name} AS (
  SELECT symbol, d, side, vol, seg, count(*) AS n, min(sec) AS first, max(sec) AS last, avg(price) AS avg_price, CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 9.0 END AS cv,
         any_value(beat) AS beat, count(*) FILTER (good) AS good, CAST(sum(CASE WHEN good THEN k - 1 ELSE 0 END) AS bigint) AS missed, count(gap) AS gaps, list(price) AS prices
  FROM {name}4 GROUP BY symbol, d, side, vol, seg
)"""


CHAINS_SQL = (
    ORDERS_SQL
    + f",\nown AS (SELECT * FROM act WHERE vol >= {SIZE}),"
    + _segment_sql("p", STEADY[0][0])
    + ","
    + _segment_sql("q", STEADY[1][0])
    + f""",
h0 AS (SELECT * FROM p WHERE n >= {STEADY[0][1]} AND beat > 0 AND good >= 0.85::double * gaps),
u0 AS (SELECT r.symbol, r.d, r.side, r.vol, r.i FROM p1 r SEMI JOIN h0 USING (symbol, d, side, vol, seg)),
h1 AS (SELECT * FROM q WHERE n >= {STEADY[1][1]} AND beat > 0 AND good >= 0.85::double * gaps
       AND (symbol, d, side, vol, seg) NOT IN (SELECT r.symbol, r.d, r.side, r.vol, r.seg FROM q1 r SEMI JOIN u0 USING (symbol, d, side, vol, i))),
u1 AS (SELECT * FROM u0 UNION ALL SELECT r.symbol, r.d, r.side, r.vol, r.i FROM q1 r SEMI JOIN h1 USING (symbol, d, side, vol, seg)),
h2 AS (SELECT * FROM q WHERE n >= {EVEN[1]} AND cv < {EVEN[2]}
       AND (symbol, d, side, vol, seg) NOT IN (SELECT r.symbol, r.d, r.side, r.vol, r.seg FROM q1 r SEMI JOIN u1 USING (symbol, d, side, vol, i))),
chains AS (SELECT *, 0 AS rule FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)"""
)
_CHAIN = "symbol, d, side, vol AS size, rule, n, first, last, round(cv, 6) AS cv, missed, round(avg_price, 6) AS avg_price"


@query(f"SELECT {_CHAIN} FROM chains", CHAINS_SQL)
def order_chains(spark, sf_dir):
    out = A.chains(orders(spark, sf_dir), SIZE, STEADY, EVEN).drop("prices")
    return out.withColumns({"cv": r6("cv"), "avg_price": r6("avg_price")})


@query(
    """SELECT symbol, d, side, vol, seg, n, round(cv, 6) AS cv, round(beat, 6) AS beat, good, missed FROM q""",
    CHAINS_SQL,
)
def order_segments(spark, sf_dir):
    own = orders(spark, sf_dir).where(F.col("vol") >= SIZE)
    return A.measured(A.segments(own, STEADY[1][0])).select("symbol", "d", "side", "vol", "seg", "n", r6("cv").alias("cv"), r6("beat").alias("beat"), "good", "missed")


_SHUFFLED = ORDERS_SQL + """,
dealt AS (SELECT symbol, d, side, vol, row_number() OVER (PARTITION BY symbol, d ORDER BY md5(concat_ws('|', 1, symbol, CAST(d AS varchar), i))) AS i FROM act)"""


@query("SELECT a.symbol, a.d, a.i, a.sec, round(a.price, 4) AS price, b.side, b.vol FROM act a JOIN dealt b ON a.symbol = b.symbol AND a.d = b.d AND a.i = b.i", _SHUFFLED)
def shuffle_null(spark, sf_dir):
    return A.shuffled(orders(spark, sf_dir), 1).withColumn("price", F.round("price", 4))


@query(
    """SELECT d, minute, side, count(DISTINCT symbol) AS n, round(sum(val), 4) AS val, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS members
    FROM (SELECT d, symbol, side, CAST(floor(sec / 60) * 60 AS int) AS minute, vol * price AS val FROM act WHERE vol * price >= 10000)
    WHERE minute NOT IN (33300, 46800) GROUP BY d, minute, side HAVING count(DISTINCT symbol) >= 2""",
    ORDERS_SQL,
)
def order_baskets(spark, sf_dir):
    """The stand-in ticks are sparse: minutes stand for seconds, two symbols for five."""
    by_minute = orders(spark, sf_dir).withColumn("sec", (F.floor(F.col("sec") / 60) * 60).cast("int"))
    return A.baskets(by_minute, 10_000.0, 2).select("d", F.col("sec").alias("minute"), "side", "n", F.round("val", 4).alias("val"), "members")


#: Chains of the orders as they are and under five shuffles, a symbol's replicates told apart by its name.
_REPLICATED = ORDERS_SQL + f""",
reps AS (SELECT unnest(range(0, {A.SHUFFLES + 1})) AS rep),
rd AS (SELECT symbol, d, rep, side, vol, row_number() OVER (PARTITION BY symbol, d, rep ORDER BY CASE WHEN rep = 0 THEN i END, md5(concat_ws('|', rep, symbol, CAST(d AS varchar), i))) AS i FROM act, reps),
rp AS (SELECT concat_ws('#', a.symbol, b.rep) AS symbol, a.d, a.i, a.sec, a.price, b.side, b.vol FROM act a JOIN rd b ON a.symbol = b.symbol AND a.d = b.d AND a.i = b.i)""" + CHAINS_SQL[len(ORDERS_SQL) :].replace("FROM act WHERE", "FROM rp WHERE") + f""",
bk0 AS (SELECT d, symbol, side, CAST(floor(sec / 60) * 60 AS int) AS minute, (CAST(('0x' || left(sha1(concat_ws('|', symbol, 7)), 8)) AS bigint) % {2 * (A.SHIFT // 60) + 1} - {A.SHIFT // 60}) * 60 AS shift FROM act WHERE vol * price >= 10000),
bk1 AS (SELECT d, side, symbol, fake, minute + CASE WHEN fake THEN shift ELSE 0 END AS moved FROM bk0, (SELECT unnest([false, true]) AS fake) WHERE minute NOT IN (33300, 46800)),
bk2 AS (SELECT d, fake FROM bk1 GROUP BY d, fake, moved, side HAVING count(DISTINCT symbol) >= 2),
bks AS (SELECT d, count(*) FILTER (NOT fake) AS baskets, count(*) FILTER (fake) AS baskets_null FROM bk2 GROUP BY d),
chn AS (SELECT split_part(symbol, '#', 1) AS symbol, d, count(*) FILTER (symbol LIKE '%#0') AS chains, count(*) FILTER (symbol NOT LIKE '%#0') / {A.SHUFFLES}::double AS fake FROM chains GROUP BY 1, 2),
chd AS (SELECT a.symbol, a.d, coalesce(c.chains, 0) AS chains, coalesce(c.fake, 0) AS fake FROM (SELECT DISTINCT symbol, d FROM act) a LEFT JOIN chn c ON c.symbol = a.symbol AND c.d = a.d)"""


@query("SELECT symbol, d, chains, round(fake, 6) AS fake FROM chd", _REPLICATED)
def chain_null(spark, sf_dir):
    """Chains of each symbol's day beside their mean over five shuffles."""
    return A.chain_null(orders(spark, sf_dir), SIZE, STEADY, EVEN).withColumn("fake", r6("fake"))


@query(
    """SELECT d, CAST(sum(chains) AS bigint) AS chains, round(sum(fake), 6) AS chains_null, round(least(sum(fake) / nullif(sum(chains), 0), 1.0), 6) AS chains_false, coalesce(any_value(baskets), 0) AS baskets, coalesce(any_value(baskets_null), 0) AS baskets_null,
           round(least(any_value(baskets_null)::double / nullif(any_value(baskets), 0), 1.0), 6) AS baskets_false FROM chd LEFT JOIN bks USING (d) GROUP BY d""",
    _REPLICATED,
)
def hidden_flow_null(spark, sf_dir):
    """Chains and baskets of each day, what chance gives of them, and the share that it explains. Minutes stand for seconds, two symbols for five."""
    own = orders(spark, sf_dir)
    by_minute = own.withColumn("sec", (F.floor(F.col("sec") / 60) * 60).cast("int"))
    out = A.flow_null(A.chain_null(own, SIZE, STEADY, EVEN), A.basket_null(by_minute, 10_000.0, 2, 60))
    return out.withColumns({c: r6(c) for c in ("chains_null", "chains_false", "baskets_false")})


DAYS_SQL = CHAINS_SQL + """,
days AS (
  SELECT symbol, d, count(*) AS n, min_by(price, i) AS open, max_by(price, i) AS close, sum(vol * price) / sum(vol) AS vwap, sum(vol * price) AS val,
         sum(CASE WHEN vol * price >= 25000 AND side = 'B' THEN vol * price ELSE 0 END) AS whale_buy, sum(CASE WHEN vol * price >= 25000 AND side = 'S' THEN vol * price ELSE 0 END) AS whale_sell
  FROM act GROUP BY symbol, d HAVING count(*) >= 20
)"""


@query("SELECT symbol, d, n, round(open, 4) AS open, round(close, 4) AS close, round(vwap, 6) AS vwap, round(val, 4) AS val, round(whale_buy, 4) AS whale_buy, round(whale_sell, 4) AS whale_sell FROM days", DAYS_SQL)
def symbol_days(spark, sf_dir):
    out = A.symbol_day(orders(spark, sf_dir), BIG, 20)
    return out.withColumns({c: F.round(c, 4) for c in ("open", "close", "val", "whale_buy", "whale_sell")} | {"vwap": r6("vwap")})


@query(
    """WITH nxt AS (SELECT symbol, d, lead(d) OVER (PARTITION BY symbol ORDER BY d) AS next FROM days),
    seen AS (SELECT DISTINCT c.symbol, n.next AS d, c.side, c.vol FROM chains c JOIN nxt n ON c.symbol = n.symbol AND c.d = n.d)
    SELECT c.symbol, c.d, c.side, c.vol AS size, c.rule, c.first, round(c.n * c.vol * c.avg_price, 4) AS val, round(100 * c.n * c.vol * c.avg_price / y.val, 6) AS pct,
           count(*) OVER (PARTITION BY c.symbol, c.d, c.side, c.vol) AS waves, round(100 * (c.avg_price / y.vwap - 1), 6) AS dev, s.vol IS NOT NULL AS carry
    FROM chains c JOIN days y ON c.symbol = y.symbol AND c.d = y.d LEFT JOIN seen s ON s.symbol = c.symbol AND s.d = c.d AND s.side = c.side AND s.vol = c.vol""",
    DAYS_SQL,
)
def chain_day_view(spark, sf_dir):
    own = orders(spark, sf_dir)
    out = A.day_view(A.chains(own, SIZE, STEADY, EVEN), A.symbol_day(own, BIG, 20))
    return out.select("symbol", "d", "side", "size", "rule", "first", F.round("val", 4).alias("val"), r6("pct").alias("pct"), "waves", r6("dev").alias("dev"), "carry")


@query(
    """SELECT symbol, d, CAST(sum(net) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) AS bigint) AS cum_net,
    CAST(sum(net) OVER w5 AS bigint) AS net5, round(c / lag(c, 5) OVER (PARTITION BY symbol ORDER BY d) - 1, 6) AS chg5 FROM fc WINDOW w5 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    FORCE_SQL,
)
def cumulative_flow(spark, sf_dir):
    """Running net flow beside the price: where the two part over 5 sessions they diverge."""
    own = Window.partitionBy("symbol").orderBy("d")
    rows = changes(spark, sf_dir)
    return rows.select(
        "symbol",
        "d",
        F.sum("net").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_net"),
        F.sum("net").over(own.rowsBetween(-4, 0)).alias("net5"),
        r6(F.col("c") / F.lag("c", 5).over(own) - 1).alias("chg5"),
    )
