"""Queries of market structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import r6
from ..operators import phases as W
from ..operators import structure as S
from ..operators import trend as T
from ..sources.market import BARS_SQL, bars
from .registry import query
from .signals import RUNNING_ATR_SQL, atr_sql

N_SQL = BARS_SQL + """,
nb AS (SELECT *, CAST(row_number() OVER w - 1 AS int) AS t, lag(h) OVER w AS h1, lag(h, 2) OVER w AS h2, lead(h) OVER w AS g1, lead(h, 2) OVER w AS g2,
       lag(l) OVER w AS l1, lag(l, 2) OVER w AS l2, lead(l) OVER w AS k1, lead(l, 2) OVER w AS k2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
sw0 AS (SELECT symbol, d, t, h AS p, true AS up FROM nb WHERE t >= 2 AND g2 IS NOT NULL AND h > greatest(h1, h2) AND h >= greatest(g1, g2)
        UNION ALL SELECT symbol, d, t, l, false FROM nb WHERE t >= 2 AND g2 IS NOT NULL AND l < least(l1, l2) AND l <= least(k1, k2)),
sw AS (SELECT *, lag(p) OVER w AS last, lead(t) OVER w + 2 AS until FROM sw0 WINDOW w AS (PARTITION BY symbol, up ORDER BY t)),
br0 AS (SELECT s.symbol, s.t AS s, s.p, s.up, min(n.t) AS t FROM sw s JOIN nb n ON n.symbol = s.symbol AND n.t >= s.t + 2 AND (s.until IS NULL OR n.t < s.until)
        AND CASE WHEN s.up THEN n.c > s.p ELSE n.c < s.p END GROUP BY 1, 2, 3, 4),
br AS (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY t, up DESC) AS was FROM br0)"""


@query("SELECT symbol, d, t, p, up, CASE WHEN up THEN CASE WHEN last IS NULL OR p > last THEN 'HH' ELSE 'LH' END ELSE CASE WHEN last IS NULL OR p < last THEN 'LL' ELSE 'HL' END END AS label FROM sw", N_SQL)
def swing_points(spark, sf_dir):
    return S.swings(bars(spark, sf_dir))


@query("SELECT symbol, s, t, p, up, CASE WHEN was IS NULL OR was = up THEN 'BOS' ELSE 'CHoCH' END AS label FROM br", N_SQL)
def structure_breaks(spark, sf_dir):
    return S.breaks(bars(spark, sf_dir))


A_SQL = RUNNING_ATR_SQL + "," + N_SQL[len(BARS_SQL) + 1 :] + """,
ab AS (SELECT n.*, r.value AS atr, max(n.t) OVER (PARTITION BY n.symbol) AS tmax FROM nb n JOIN ratr r ON n.symbol = r.symbol AND n.d = r.d)"""


def with_atr(spark, sf_dir):
    return T.atr_running(bars(spark, sf_dir)).withColumnRenamed("value", "atr")


@query(
    """WITH g AS (SELECT symbol, t, tmax, k2 - h >= 0.5 * atr AS up, CASE WHEN k2 - h >= 0.5 * atr THEN h ELSE g2 END AS lo, CASE WHEN k2 - h >= 0.5 * atr THEN k2 ELSE l END AS hi
               FROM ab WHERE k2 - h >= 0.5 * atr OR l - g2 >= 0.5 * atr)
    SELECT g.symbol, g.t + 1 AS t, coalesce(min(n.t), least(g.t + 22, any_value(g.tmax))) AS "end", g.lo, g.hi, g.up
    FROM g LEFT JOIN nb n ON n.symbol = g.symbol AND n.t BETWEEN g.t + 3 AND g.t + 22 AND CASE WHEN g.up THEN n.l <= g.lo ELSE n.h >= g.hi END
    GROUP BY g.symbol, g.t, g.lo, g.hi, g.up""",
    A_SQL,
)
def fair_value_gaps(spark, sf_dir):
    return S.fair_value_gaps(with_atr(spark, sf_dir))


_FORCE = """fo AS (
  SELECT n.symbol, n.t, max_by(CASE WHEN b.t IS NULL OR b.t > n.t THEN s.p END, s.t) FILTER (s.up) AS high0, arg_max_null(CASE WHEN b.t IS NULL OR b.t > n.t THEN s.p END, s.t) FILTER (s.up) AS high,
         arg_max_null(CASE WHEN b.t IS NULL OR b.t > n.t THEN s.p END, s.t) FILTER (NOT s.up) AS low
  FROM nb n LEFT JOIN sw s ON s.symbol = n.symbol AND n.t >= s.t + 2 AND (s.until IS NULL OR n.t < s.until)
       LEFT JOIN br b ON b.symbol = s.symbol AND b.s = s.t AND b.up = s.up GROUP BY n.symbol, n.t
)"""


@query(f"WITH {_FORCE} SELECT symbol, t, high, low FROM fo", N_SQL)
def structure_levels(spark, sf_dir):
    return S.levels_in_force(bars(spark, sf_dir))


def _blocks(bull: bool) -> str:
    s, level = ("1", "high") if bull else ("-1", "low")
    broke = [" OR ".join(f"coalesce({s} * (c{i} - {level}) > 0, false)" for i in range(1, j + 1)) for j in (1, 2, 3)]
    cases = " ".join(f"WHEN {s} * (c{j} - c) >= 1.5 * atr AND ({broke[j - 1]}) THEN t + {j}" for j in (1, 2, 3))
    return f"SELECT symbol, t AS k, l AS lo, h AS hi, {str(bull).lower()} AS bull, CASE {cases} END AS m FROM ob0 WHERE t >= 20 AND {s} * (c - o) < 0 AND {s} * (c1 - o1) > 0"


BLOCKS_SQL = A_SQL + f""",
{_FORCE},
    ob0 AS (SELECT a.symbol, a.t, a.o, a.h, a.l, a.c, a.atr, f.high, f.low, lead(a.c) OVER w AS c1, lead(a.c, 2) OVER w AS c2, lead(a.c, 3) OVER w AS c3, lead(a.o) OVER w AS o1
            FROM ab a JOIN fo f ON a.symbol = f.symbol AND a.t = f.t WINDOW w AS (PARTITION BY a.symbol ORDER BY a.t)),
    ob AS (SELECT * FROM ({_blocks(True)} UNION ALL {_blocks(False)}) WHERE m IS NOT NULL),
    lt AS (SELECT o.*, n.t AS ta, CASE WHEN o.bull THEN n.l > o.hi ELSE n.h < o.lo END AS away FROM ob o LEFT JOIN nb n ON n.symbol = o.symbol AND n.t BETWEEN o.m + 1 AND o.m + 60),
    ar AS (SELECT *, min(CASE WHEN away THEN ta END) OVER (PARTITION BY symbol, k, bull) AS gone FROM lt),
    obt AS MATERIALIZED (SELECT symbol, k, m, lo, hi, bull, min(CASE WHEN ta > gone AND NOT away THEN ta END) AS touch FROM ar GROUP BY symbol, k, m, lo, hi, bull),
    bk1 AS (SELECT o.*, (SELECT min(n.t) FROM nb n WHERE n.symbol = o.symbol AND n.t > o.m AND n.t <= o.m + 60 AND n.c < o.lo) AS brk_close FROM obt o WHERE bull),
    bk2 AS (SELECT o.*, (SELECT min(n.t) FROM nb n WHERE n.symbol = o.symbol AND n.t > o.brk_close AND n.t <= o.brk_close + 60 AND n.h < o.lo) AS gone FROM bk1 o),
    bk AS MATERIALIZED (SELECT o.* EXCLUDE (gone), (SELECT min(n.t) FROM nb n WHERE n.symbol = o.symbol AND n.t > o.gone AND n.t <= o.brk_close + 60 AND n.h >= o.lo) AS brk FROM bk2 o
      UNION ALL SELECT o.*, NULL, NULL FROM obt o WHERE NOT bull)"""


@query("SELECT symbol, k, m, lo, hi, bull, touch FROM obt", BLOCKS_SQL)
def order_blocks(spark, sf_dir):
    return S.order_blocks(with_atr(spark, sf_dir))


@query("SELECT symbol, k, m, lo, hi, bull, touch, brk_close, brk FROM bk", BLOCKS_SQL)
def breaker_blocks(spark, sf_dir):
    """Upward blocks that a close went through, and the first return to them from below."""
    return S.order_blocks(with_atr(spark, sf_dir), broken=True)


@query(
    """WITH w AS (SELECT b.*, a.value AS atr, lag(b.c, 15) OVER x AS ref, lag(b.c) OVER x AS pc, CASE WHEN count(*) OVER y = 20 THEN avg(b.v) OVER y END AS av
      FROM bars b LEFT JOIN atr a ON a.symbol = b.symbol AND a.d = b.d
      WINDOW x AS (PARTITION BY b.symbol ORDER BY b.d), y AS (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, v >= 2 * av AND av > 0 AND atr IS NOT NULL AS loud, h - l >= 1.5 * atr AS wide, abs(c - o) <= 0.2 * greatest(h - l, 1e-9) AS slim FROM w)
    SELECT symbol, d, 'sc' AS kind FROM z WHERE loud AND c / ref - 1 <= -0.10 AND (c <= o OR slim) AND (c <= pc * (1 - 0.065) OR wide)
    UNION ALL SELECT symbol, d, 'bc' FROM z WHERE loud AND c / ref - 1 >= 0.10 AND (c >= o OR slim) AND (c >= pc * (1 + 0.065) OR wide)""",
    atr_sql(14),
)
def wyckoff_climaxes(spark, sf_dir):
    own = T.atr(bars(spark, sf_dir), 14).withColumnRenamed("value", "atr")
    return S.climaxes(own)


@query(
    """WITH a AS (SELECT symbol, d, CASE WHEN count(*) OVER w = 20 THEN max(h) OVER w END AS hi, CASE WHEN count(*) OVER w = 20 THEN min(l) OVER w END AS lo, list(h) OVER w AS hs, list(l) OVER w AS ls,
        CASE WHEN count(*) OVER p = 40 THEN max(c) OVER p END AS prior, regr_slope(c, t) OVER w / avg(c) OVER w AS slope
      FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND 20 PRECEDING))
    SELECT symbol, d, lo, hi, round(slope, 6) AS slope FROM a WHERE hi / lo - 1 BETWEEN 0.06 AND 0.35 AND prior >= 1.10 * hi
      AND len(list_filter(hs, lambda x: x >= hi - 0.15 * (hi - lo))) >= 2 AND len(list_filter(ls, lambda x: x <= lo + 0.15 * (hi - lo))) >= 2 AND abs(slope) <= 0.004""",
    N_SQL,
)
def trading_ranges(spark, sf_dir):
    return S.ranges(bars(spark, sf_dir)).withColumn("slope", r6("slope"))


def _reversal(up: bool) -> str:
    same, own, cmp, beyond = ("c < o", "min(l)", "<=", "n.c > r.p") if up else ("c > o", "max(h)", ">=", "n.c < r.p")
    return f"""SELECT r.symbol, r.s, min(n.t) AS t, r.p, {str(up).lower()} AS up FROM (
      SELECT *, least(e + 20, coalesce(lead(e) OVER (PARTITION BY symbol ORDER BY s), tmax)) AS until FROM (
        SELECT symbol, run, min(t) AS s, max(t) AS e, min_by(o, t) AS p, {own} AS own, max_by(ext, t) AS ext, any_value(tmax) AS tmax FROM (
          SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, {same} AS same, CASE WHEN lag({same}) OVER (PARTITION BY symbol ORDER BY t) IS NOT DISTINCT FROM ({same}) THEN 0 ELSE 1 END AS new,
                   {own} OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ext, max(t) OVER (PARTITION BY symbol) AS tmax FROM nb))
        WHERE same GROUP BY symbol, run)
      WHERE e - s + 1 >= 2 AND own {cmp} ext AND e < tmax) r
    JOIN nb n ON n.symbol = r.symbol AND n.t > r.e AND n.t <= least(r.until, r.tmax) AND {beyond} GROUP BY r.symbol, r.s, r.p"""


@query(f"{_reversal(True)} UNION ALL {_reversal(False)}", N_SQL)
def delivery_reversals(spark, sf_dir):
    return S.reversals(bars(spark, sf_dir))


@query("SELECT label, up, count(*) AS n FROM (SELECT up, CASE WHEN was IS NULL OR was = up THEN 'BOS' ELSE 'CHoCH' END AS label FROM br) GROUP BY label, up", N_SQL)
def structure_break_counts(spark, sf_dir):
    return S.breaks(bars(spark, sf_dir)).groupBy("label", "up").agg(F.count(F.lit(1)).alias("n"))


# -- phases of accumulation and distribution ---------------------------------------------------------


def _walked(spark, sf_dir):
    return W.walk(W.signs(bars(spark, sf_dir)))


@query()
def wyckoff_events(spark, sf_dir):
    """Rows only: the automaton is beyond SQL that can be read; tests/test_phases.py compares it with one that looks back at all bars."""
    return W.events(_walked(spark, sf_dir)).withColumn("vol_ratio", r6("vol_ratio"))


@query()
def wyckoff_signals(spark, sf_dir):
    """What was found at each symbol's last bar, the most reliable first."""
    return W.signals(_walked(spark, sf_dir))


@query()
def wyckoff_board(spark, sf_dir):
    """Each symbol's phase, edges, age and last event."""
    return W.board(_walked(spark, sf_dir))


@query(
    """WITH s AS (SELECT b.*, row_number() OVER x - 1 AS t, a.value AS atr, avg(b.v) OVER y AS av, lag(b.v) OVER x AS v1, lag(b.v, 2) OVER x AS v2, lag(b.c) OVER x AS p1, lag(b.c, 4) OVER x AS p4
      FROM bars b LEFT JOIN atr a ON a.symbol = b.symbol AND a.d = b.d
      WINDOW x AS (PARTITION BY b.symbol ORDER BY b.d), y AS (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    ok AS (SELECT * FROM s WHERE t >= 40 AND atr > 0 AND av > 0 AND h > l)
    SELECT symbol, d, CAST(t AS int) AS t, 'er_absorb' AS id, round(v / av, 6) AS vol_ratio FROM ok WHERE v / av >= 2 AND abs(c - o) / atr / (v / av) < 0.5
    UNION ALL SELECT symbol, d, CAST(t AS int), 'no_demand', round(v / av, 6) FROM ok WHERE c > o AND v < v1 AND v < v2 AND h - l < 0.7 * atr AND p1 > p4""",
    atr_sql(14),
)
def wyckoff_labels(spark, sf_dir):
    """Effort without result, and rises that nobody buys."""
    found = W.events(_walked(spark, sf_dir)).where("id IN ('er_absorb', 'no_demand')")
    return found.select("symbol", "d", "t", "id", r6("vol_ratio").alias("vol_ratio"))
