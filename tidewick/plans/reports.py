"""Queries of what the daily pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reuse import once
from ..functions.rolling import r6
from ..operators import events as E
from ..operators import flow as A
from ..operators import ingest as G
from ..operators import regime as C
from ..operators import reports as P
from ..operators import structure as S
from ..operators import zones as Z
from ..sources.market import bars, ticks
from . import cones, structures, volume
from .registry import query
from .signals import CANDLES_SQL

_DAYS = volume.LEVELS_SQL + """,
db AS (SELECT symbol, d, CASE WHEN symbol = 'T1' THEN 0.909::double * max_by(price, acc) ELSE max_by(price, acc) END AS c FROM ticks WHERE day(d) % 4 <> 0 GROUP BY symbol, d),
fac AS (SELECT s.symbol, s.d, CASE WHEN abs(b.c / nullif(s.close, 0) - 1) < 0.005::double OR b.c / nullif(s.close, 0) IS NULL THEN 1.0::double ELSE b.c / s.close END AS f FROM sess s JOIN db b ON s.symbol = b.symbol AND s.d = b.d)"""


def _adjusted(spark, sf_dir):
    """Daily closes with symbol T1 on another scale, none on every 4th day."""
    daily = Z.sessions(ticks(spark, sf_dir)).where(F.day("d") % 4 != 0)
    return daily.select("symbol", "d", F.when(F.col("symbol") == "T1", F.lit(0.909) * F.col("close")).otherwise(F.col("close")).alias("c"))


@query("SELECT symbol, d, round(f, 6) AS f FROM fac", _DAYS)
def adjust_factors(spark, sf_dir):
    rows = Z.sessions(ticks(spark, sf_dir)).join(_adjusted(spark, sf_dir), ["symbol", "d"])
    return rows.select("symbol", "d", r6(P.adjust_factor()).alias("f"))


@query(
    """SELECT l.symbol, l.d, round(l.price * f.f, 3) AS price, CAST(sum(buy) AS bigint) AS buy, CAST(sum(sell) AS bigint) AS sell, CAST(sum(x) AS bigint) AS x
    FROM levels l JOIN (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS back FROM fac) WHERE back <= 12) f ON l.symbol = f.symbol AND l.d = f.d
    WHERE buy + sell + x > 0 GROUP BY 1, 2, 3""",
    _DAYS,
)
def footprint(spark, sf_dir):
    return P.footprint(volume.levels(spark, sf_dir), Z.sessions(ticks(spark, sf_dir)), _adjusted(spark, sf_dir))


@query(
    """SELECT symbol, w, count(*) AS n, count(big_net_val) AS n_real, CAST(sum(buy) AS bigint) AS buy, CAST(sum(sell) AS bigint) AS sell, CAST(sum(net) AS bigint) AS net,
    round(sum(buy) / nullif(sum(buy) + sum(sell), 0), 6) AS buy_share, round(sum(big_net_val), 6) AS big_net
    FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS back FROM stats), (VALUES (10), (20), (40)) AS t(w) WHERE back <= w GROUP BY symbol, w""",
    volume.LEVELS_SQL,
)
def flow_windows(spark, sf_dir):
    return P.flow_windows(Z.session_stats(volume.levels(spark, sf_dir))).withColumns({c: r6(c) for c in ("buy_share", "big_net")})


@query(
    """WITH m AS (SELECT symbol, sum(net) / nullif(sum(buy) + sum(sell), 0) AS value FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS back FROM stats) WHERE back <= 5 GROUP BY symbol)
    SELECT 'bought' AS "order", row_number() OVER (ORDER BY -value, symbol) AS rank, symbol, round(value, 6) AS value FROM m WHERE value IS NOT NULL QUALIFY row_number() OVER (ORDER BY -value, symbol) <= 3
    UNION ALL SELECT 'sold', row_number() OVER (ORDER BY value, symbol), symbol, round(value, 6) FROM m WHERE value IS NOT NULL QUALIFY row_number() OVER (ORDER BY value, symbol) <= 3""",
    volume.LEVELS_SQL,
)
def market_ranking(spark, sf_dir):
    return P.ranking(Z.market_row(Z.session_stats(volume.levels(spark, sf_dir)))).withColumn("value", r6("value"))


@query(
    """WITH s AS (SELECT symbol, round(round_even(price / 0.05::double, 0) * 0.05::double, 4) AS price, sum(big_buy) AS b, sum(big_sell) AS s FROM recent GROUP BY 1, 2),
    p AS (SELECT symbol, first(price ORDER BY b DESC, price) FILTER (b > 0) AS buy_p, first(price ORDER BY s DESC, price) FILTER (s > 0) AS sell_p FROM s GROUP BY symbol)
    SELECT * FROM p WHERE abs(buy_p - sell_p) <= 1.0 + 1e-9""",
    volume.PROFILE_SQL,
)
def whale_pairs(spark, sf_dir):
    return P.whale_pairs(Z.top_levels(Z.recent(volume.levels(spark, sf_dir), 20)), 1.0)


@query(
    """WITH lv AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) AS bk FROM levels),
    x AS (SELECT w, 0 AS k, lv.* FROM lv, (VALUES (10), (20), (40)) AS t(w) WHERE bk <= w UNION ALL SELECT w, 1, lv.* FROM lv, (VALUES (10), (20), (40)) AS t(w) WHERE bk BETWEEN 2 AND w + 1),
    s AS (SELECT w, k, symbol, round(round_even(price / 0.05::double, 0) * 0.05::double, 4) AS price, sum(big_buy) AS b, sum(big_sell) AS s FROM x GROUP BY 1, 2, 3, 4),
    p AS (SELECT w, k, symbol, first(price ORDER BY b DESC, price) FILTER (b > 0) AS buy_p, first(price ORDER BY s DESC, price) FILTER (s > 0) AS sell_p FROM s GROUP BY w, k, symbol),
    near AS (SELECT * FROM p WHERE abs(buy_p - sell_p) <= 1.0 + 1e-9)
    SELECT symbol, w, buy_p, sell_p FROM near n WHERE k = 0 AND NOT EXISTS (SELECT 1 FROM near o WHERE o.k = 1 AND o.w = n.w AND o.symbol = n.symbol)""",
    volume.LEVELS_SQL,
)
def new_whale_pairs(spark, sf_dir):
    return P.new_whale_pairs(volume.levels(spark, sf_dir), gap=1.0)


@query(
    f"""SELECT z.symbol, z.side, z.lo, z.hi, round(100 * ((z.lo + z.hi) / 2 / s.close - 1), 6) AS dist FROM ({volume._zones_sql('buy', 'sell', 'total')}) z
    JOIN (SELECT symbol, max_by(close, d) AS close FROM sess GROUP BY symbol) s ON s.symbol = z.symbol""",
    volume.PROFILE_SQL,
)
def zone_distance(spark, sf_dir):
    last = Z.sessions(ticks(spark, sf_dir)).groupBy("symbol").agg(F.max_by("close", "d").alias("close"))
    return P.with_distance(Z.zones(volume.profile(spark, sf_dir)), last).select("symbol", "side", "lo", "hi", r6("dist").alias("dist"))


@query(
    """SELECT symbol, count(*) AS n, round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg((r10 > 0)::int), 6) AS up10 FROM (
      SELECT *, lead(c, 5) OVER w / c - 1 AS r5, lead(c, 10) OVER w / c - 1 AS r10 FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY d))
    WHERE v20 > 0 AND v >= 2 * v20 AND c > o AND c / nullif(c1, 0) - 1 >= 0.03 - 1e-12 GROUP BY symbol""",
    CANDLES_SQL,
)
def spike_summary(spark, sf_dir):
    return P.spike_summary(E.volume_spike(bars(spark, sf_dir), log_days=None)).withColumns({c: r6(c) for c in ("r5", "r10", "up10")})


@query(
    """SELECT symbol, CAST(floor(sec / 900) * 900 AS int) AS slot, round(sum(CASE WHEN side = 'B' THEN vol * price ELSE -vol * price END), 4) AS net, count(*) AS n FROM act WHERE vol * price >= 10000 GROUP BY 1, 2""",
    volume.ORDERS_SQL,
)
def basket_heat(spark, sf_dir):
    return P.heat(A.active_orders(ticks(spark, sf_dir)), 10_000.0).withColumn("net", F.round("net", 4))


@query(
    """WITH la AS (SELECT symbol, max(t) AS last, max_by(c, t) AS c, max_by(atr, t) AS atr FROM ab GROUP BY symbol),
    al AS (SELECT b.*, la.last, la.c, la.atr, greatest(lo - la.c, la.c - hi, 0.0) AS dist,
             CASE WHEN NOT bull THEN CASE WHEN NOT EXISTS (SELECT 1 FROM nb n WHERE n.symbol = b.symbol AND n.t > b.m AND n.c > b.hi) THEN 'bear' END
                  WHEN brk_close IS NULL THEN 'bull' WHEN brk IS NULL THEN 'bb' END AS kind
           FROM bk b JOIN la ON la.symbol = b.symbol WHERE la.last - m <= 60),
    z AS (SELECT symbol, k, kind, lo, hi, CASE WHEN dist = 0 THEN 'in' WHEN dist <= atr THEN 'near' ELSE 'far' END AS pos, round(dist / nullif(atr, 0), 2) AS dist_atr, round(dist / c, 4) AS dist_pct,
            lo > c AS above, last - m AS age, touch IS NOT NULL AS touched FROM al WHERE kind IS NOT NULL)
    SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY dist_atr NULLS FIRST, k, kind) AS integer) AS rank FROM z""",
    structures.BLOCKS_SQL,
)
def order_blocks_in_force(spark, sf_dir):
    """Blocks and breakers that still count at each symbol's last bar, the nearest first."""
    own = once(structures.with_atr(spark, sf_dir))  # read for blocks, for their later bars and for the last one
    return P.zones_in_force(S.order_blocks(own, broken=True), own)


@query(
    """SELECT h, level, count(*) AS days, round(avg((mean BETWEEN 0.76 AND 0.84)::int), 6) AS in_band FROM (
      SELECT h, level, count(*) OVER w AS n, avg(hit) OVER w AS mean FROM (SELECT d, h, level, round(hit, 9) AS hit FROM hits) WINDOW w AS (PARTITION BY h, level ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE n = 60 GROUP BY h, level""",
    cones._HITS,
)
def rolling_coverage(spark, sf_dir):
    daily = C.hits(cones._issued(spark, sf_dir)).withColumn("hit", F.round("hit", 9))
    return P.rolling_coverage(daily).withColumn("in_band", r6("in_band"))


def _chips_sql() -> str:
    names = {"climax": "climax_y"}
    cases = [f"CASE {names.get(a, a)} " + " ".join(f"WHEN '{v}' THEN '{t}'" for v, t in w.items()) + " END" for a, w in P.CHIPS.items()]
    return f"SELECT symbol, d, concat_ws(', ', {', '.join(cases)}) AS chips FROM keyed WHERE known"


@query(_chips_sql(), cones.KEYED_SQL)
def regime_chips(spark, sf_dir):
    return cones.keyed(spark, sf_dir).where("vol IS NOT NULL").select("symbol", "d", P.chips().alias("chips"))


@query("SELECT symbol, d, total FROM sess WHERE (symbol, d) NOT IN (SELECT symbol, d FROM sess WHERE day(d) % 2 = 0)", volume.LEVELS_SQL)
def unsent_sessions(spark, sf_dir):
    """Rows of (symbol, d) that were not sent yet; those of even days count as sent."""
    rows = Z.sessions(ticks(spark, sf_dir)).select("symbol", "d", "total")
    return G.new_alerts(rows, rows.where(F.day("d") % 2 == 0))


@query(
    """WITH day AS (SELECT max(d) AS day FROM sess)
    SELECT symbol, d, day(d) % 2 = 1 AS fresh FROM sess, day WHERE d >= day - 30""",
    volume.LEVELS_SQL,
)
def sent_sessions(spark, sf_dir):
    """What counts as sent after today: sessions of odd days are new, those of even days were sent before."""
    rows = Z.sessions(ticks(spark, sf_dir)).select("symbol", "d")
    return G.sent_after(rows.where(F.day("d") % 2 == 0), rows, rows.agg(F.max("d").alias("day")))
