"""Queries of regimes, pools, cones and calibration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.reuse import once
from ..functions.rolling import Together, r6
from ..operators import conditional as K
from ..operators import evaluate as V
from ..operators import features as X
from ..operators import ledger as G
from ..operators import regime as R
from ..operators import trend as T
from ..sources.market import bars, dates
from .features import FRAME_SQL
from .registry import query
from .signals import FOUR_SQL, TREND_SQL

def keyed(spark, sf_dir, events: bool = False, path: bool = True, own=None):
    """Bars with volatility and its rank, volume features, forward path (if wanted), the regime's axes and, if asked for, the codes of events.

    The trades are walked once (not at all for bars of one's own), and one pass over a symbol gives all that depends on the bar before it.
    """
    frame = X.with_volatility(X.with_returns(bars(spark, sf_dir) if own is None else own))
    together = Together()
    volume, _, flags = X.volume_columns(together), X.climax(together), K.flag_columns(together) if events else {}
    frame = frame.withColumns({"vol20": F.round("vol20", 12), "__up": volume[0]["__up"]})
    frame = T.columns(frame, line=True, wilder=K.ATR if events else 0, ranked={"vol20": RANK}, together=together)
    frame = X.with_gap(X.with_climax(X.with_volume(frame, together), together))
    frame = frame.withColumn("upvol_share", F.round("upvol_share", 9))
    if events:
        frame = frame.withColumn("codes", K.codes(flags | {"climax": F.col("climax")}))
    frame = frame.drop(*together.values())
    return (X.with_path(frame) if path else frame).withColumns(R.regime_columns())


RANK = X.RANK_WINDOW

KEYED_SQL = TREND_SQL + f""",
k0 AS (
  SELECT symbol, d, i, o, h, l, c, v, c1, r20, round(vol20, 12) AS vol20,
    CASE WHEN count(*) OVER w = 20 THEN v / nullif(avg(v) OVER w, 0) END AS vol_ratio,
    CASE WHEN count(*) OVER w = 20 THEN round(sum(CASE WHEN c > c1 THEN v ELSE 0 END) OVER w / nullif(sum(v) OVER w, 0), 9) END AS upvol_share,
    coalesce(c / c1 - 1 >= 0.065 AND c > o AND abs(c - o) >= 2 * CASE WHEN count(*) OVER b = 10 THEN avg(abs(c - o)) OVER b END
       AND (c - l) / nullif(h - l, 0) >= 0.8 AND v >= 2 * CASE WHEN count(*) OVER p = 20 THEN avg(v) OVER p END
       AND c > CASE WHEN count(*) OVER p = 20 THEN max(c) OVER p END, false) AS climax
  FROM vola
  WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
         p AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
),
k1 AS (
  SELECT *, coalesce(CASE WHEN count(vol_ratio) OVER t = 3 THEN max(vol_ratio) OVER t END >= 2, false) AS spike3, bool_or(climax) OVER t AS climax3,
         coalesce(abs(o / c1 - 1) > 0.01, false) AS gap_big, count(vol20) OVER q AS n_past, list(vol20) FILTER (WHERE vol20 IS NOT NULL) OVER q AS past, list(c) OVER f AS nxt
  FROM k0
  WINDOW t AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         q AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {RANK} PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)
),
k2 AS (SELECT *, CASE WHEN n_past = {RANK} AND vol20 IS NOT NULL THEN len(list_filter(past, lambda x: x < vol20)) / {RANK} END AS rk, s.up AS st_up FROM k1 LEFT JOIN (SELECT symbol AS of_, i AS at_, up FROM strend) s ON s.of_ = k1.symbol AND s.at_ = k1.i),
keyed AS MATERIALIZED (
  SELECT *, rk IS NOT NULL AND upvol_share IS NOT NULL AND st_up IS NOT NULL AS known,
    CASE WHEN rk <= 0.33 THEN 'low' WHEN rk <= 0.67 THEN 'mid' ELSE 'high' END AS vol,
    CASE WHEN upvol_share <= 0.40 THEN 'low' WHEN upvol_share <= 0.60 THEN 'mid' ELSE 'high' END AS upvol,
    CASE WHEN st_up THEN 'up' ELSE 'down' END AS st, CASE WHEN spike3 THEN 'yes' ELSE 'no' END AS spike,
    CASE WHEN climax3 THEN 'yes' ELSE 'no' END AS climax_y, CASE WHEN gap_big THEN 'yes' ELSE 'no' END AS gap
  FROM k2
),
rows_ AS (SELECT *, ln(nxt[5] / c) AS s5, ln(nxt[10] / c) AS s10, ln(nxt[20] / c) AS s20 FROM keyed WHERE known AND len(nxt) = 20 AND vol20 > 0)"""

_AXES = "vol, upvol, st, spike, climax, gap"


@query(
    "SELECT symbol, d, CASE WHEN known THEN vol END AS vol, CASE WHEN known THEN upvol END AS upvol, CASE WHEN known THEN st END AS st, CASE WHEN known THEN spike END AS spike, CASE WHEN known THEN climax_y END AS climax, CASE WHEN known THEN gap END AS gap FROM keyed",
    KEYED_SQL,
)
def regime_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("symbol", "d", *R.AXES)


_COUNTS = """cnt AS (
  SELECT vol, upvol, st, spike, climax_y AS climax, gap, count(*) AS n,
         grouping(vol) + grouping(upvol) + grouping(st) + grouping(spike) + grouping(climax_y) + grouping(gap) AS level,
         avg((s5 > 0)::int) AS up5, avg((s10 > 0)::int) AS up10, avg((s20 > 0)::int) AS up20
  FROM rows_ GROUP BY ROLLUP (vol, upvol, st, spike, climax_y, gap)
)"""


@query(f"SELECT {_AXES}, n, CAST(level AS int) AS level, round(up5, 6) AS up5, round(up10, 6) AS up10, round(up20, 6) AS up20 FROM cnt", KEYED_SQL + ",\n" + _COUNTS)
def regime_rollup(spark, sf_dir):
    out = R.pool_counts(R.pool_rows(keyed(spark, sf_dir)))
    return out.withColumns({f"up{h}": r6(f"up{h}") for h in R.HORIZONS})


_PREFIX = "array_to_string(list_value(coalesce({0}vol, ''), coalesce({0}upvol, ''), coalesce({0}st, ''), coalesce({0}spike, ''), coalesce({0}{1}, ''), coalesce({0}gap, ''))[1:6 - {2}], '|')"
_POOLS = _COUNTS + f""",
pools AS (SELECT {_PREFIX.format('', 'climax', 'level')} AS pool, level, n, up5, up10, up20 FROM cnt),
tried AS (SELECT symbol, d, lv AS l, {_PREFIX.format('k.', 'climax_y', 'lv')} AS p FROM keyed k, range(0, 7) AS r(lv) WHERE known),
chosen AS (
  SELECT t.symbol, t.d, CAST(p.level AS int) AS level, p.n, p.pool, p.up5, p.up10, p.up20
  FROM tried t JOIN pools p ON t.p = p.pool AND t.l = p.level WHERE p.n >= 200 OR p.level = 6
  QUALIFY row_number() OVER (PARTITION BY t.symbol, t.d ORDER BY p.level) = 1
)"""


@query("SELECT symbol, d, level, n, pool, round(up5, 6) AS up5, round(up10, 6) AS up10, round(up20, 6) AS up20 FROM chosen", KEYED_SQL + ",\n" + _POOLS)
def pool_shrinkage(spark, sf_dir):
    rows = once(keyed(spark, sf_dir).select("symbol", "d", "vol20", "path", *R.AXES))  # read for pools and days
    keys = rows.where("vol IS NOT NULL").select("symbol", "d", *R.AXES)
    out = R.pool_for(keys, R.pool_counts(R.pool_rows(rows)))
    return out.select("symbol", "d", "level", "n", "pool", *[r6(f"up{h}").alias(f"up{h}") for h in R.HORIZONS])


@query("SELECT symbol, d, CAST(('0x' || left(sha1(concat_ws('|', symbol, CAST(d AS varchar))), 8)) AS bigint) AS seed FROM bars", FRAME_SQL)
def cone_seed(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", R.seed_of(F.col("symbol"), F.col("d")).alias("seed"))


#: Paths of a cone that is issued, and of one of the many that are scored.
PATHS, SCORED_PATHS = 2000, 300


def _simulated(spark, sf_dir, paths: int = PATHS):
    """Paths of each symbol's last day with a regime."""
    rows = once(keyed(spark, sf_dir).select("symbol", "d", "vol20", "path", *R.AXES))  # read for pools, their rows and targets
    own = R.pool_rows(rows)
    last = Window.partitionBy("symbol").orderBy(F.desc("d"))
    keys = rows.where("vol IS NOT NULL AND vol20 > 0").withColumn("__r", F.row_number().over(last)).where("__r = 1")
    targets = R.pool_for(keys.select("symbol", "d", "vol20", *R.AXES), R.pool_counts(own))
    targets = targets.select(F.col("symbol").alias("id"), R.seed_of(F.col("symbol"), F.col("d")).alias("seed"), "vol20", "pool", "level", "n")
    pool = R.next_row(own, targets)
    return R.bootstrap(targets, pool, paths)


_SIM = KEYED_SQL + ",\n" + _POOLS + """,
target AS (
  SELECT c.symbol, c.level, c.n, c.pool, k.vol20, CAST(('0x' || left(sha1(concat_ws('|', c.symbol, CAST(c.d AS varchar))), 8)) AS bigint) AS seed
  FROM chosen c JOIN keyed k ON c.symbol = k.symbol AND c.d = k.d WHERE k.vol20 > 0 QUALIFY row_number() OVER (PARTITION BY c.symbol ORDER BY c.d DESC) = 1
),
tagged AS (SELECT lv AS l, """ + _PREFIX.format("k.", "climax_y", "lv") + """ AS pool, symbol, d, list_transform(range(1, 21), lambda j: (ln(nxt[j] / c) - CASE WHEN j = 1 THEN 0 ELSE ln(nxt[j - 1] / c) END) / vol20) AS steps FROM rows_ k, range(0, 7) AS r(lv)),
numbered AS (SELECT pool, l, row_number() OVER (PARTITION BY pool, l ORDER BY symbol, d) - 1 AS row, steps FROM tagged),
dr AS (
  SELECT t.symbol, t.pool, t.level, t.vol20, p.path, b.block,
    (((((t.seed * 1103515 + p.path * 7919 + b.block * 104729 + 15485863) % 2147483647) * 48271) % 2147483647) % t.n) AS row,
    (((((t.seed * 1103515 + p.path * 7919 + b.block * 104729 + 2 * 15485863) % 2147483647) * 48271) % 2147483647) % 16) AS start
  FROM target t, range(0, 2000) AS p(path), range(0, 4) AS b(block)
),
st AS (
  SELECT d.symbol, d.path, d.block, j, greatest(-ln(1.07), least(ln(1.07), n.steps[d.start + j] * d.vol20)) AS x
  FROM dr d JOIN numbered n ON n.pool = d.pool AND n.l = d.level AND n.row = d.row, range(1, 6) AS q(j)
),
step AS (
  SELECT symbol, path, block * 5 + j AS i, sum(x) OVER (PARTITION BY symbol, path ORDER BY block, j) AS cum FROM (SELECT *, x FROM st)
),
sim AS (
  SELECT symbol, path, sum(x) FILTER (block < 1) AS c5, sum(x) FILTER (block < 2) AS c10, sum(x) AS c20 FROM st GROUP BY symbol, path
),
cone AS (
  SELECT symbol, h, quantile_cont(x, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q
  FROM (SELECT symbol, 5 AS h, c5 AS x FROM sim UNION ALL SELECT symbol, 10, c10 FROM sim UNION ALL SELECT symbol, 20, c20 FROM sim) GROUP BY symbol, h
)"""


@query("SELECT symbol, h, " + ", ".join(f"round(q[{i + 1}], 6) AS q{q}" for i, q in enumerate(R.QUANTILES)) + " FROM cone", _SIM)
def probability_cone(spark, sf_dir):
    out = R.quantiles(_simulated(spark, sf_dir))
    return out.select(F.col("id").alias("symbol"), "h", *[r6(f"q{q}").alias(f"q{q}") for q in R.QUANTILES])


@query(
    """SELECT symbol AS id, round(avg((coalesce(gained, 11) < coalesce(lost, 11))::int), 6) AS touch_up FROM (
      SELECT symbol, path, min(i) FILTER (cum >= ln(1.05)) AS gained, min(i) FILTER (cum <= ln(0.95)) AS lost FROM step WHERE i <= 10 GROUP BY symbol, path) GROUP BY symbol""",
    _SIM,
)
def touch_probability(spark, sf_dir):
    return R.touch_first(_simulated(spark, sf_dir)).withColumn("touch_up", r6("touch_up"))


@query(
    """WITH shape AS (SELECT symbol, path, list(cum ORDER BY i) AS x FROM step GROUP BY symbol, path),
    c0 AS (SELECT symbol, arg_min(x, (x[20], path)) AS a, arg_max(x, (x[20], -path)) AS b FROM shape GROUP BY symbol),
    m AS (WITH RECURSIVE m AS (
      SELECT symbol, a, b, 0 AS k FROM c0
      UNION ALL
      SELECT symbol, coalesce(list(va ORDER BY i) FILTER (va IS NOT NULL), any_value(a)), coalesce(list(vb ORDER BY i) FILTER (vb IS NOT NULL), any_value(b)), any_value(k) + 1 FROM (
        SELECT m.symbol, any_value(m.a) AS a, any_value(m.b) AS b, any_value(m.k) AS k, g.i, avg(s.x[g.i]) FILTER (near) AS va, avg(s.x[g.i]) FILTER (NOT near) AS vb
        FROM m JOIN (SELECT s.symbol, s.x, list_distance(s.x, m2.a) <= list_distance(s.x, m2.b) AS near FROM shape s JOIN m m2 ON m2.symbol = s.symbol) s ON s.symbol = m.symbol, range(1, 21) AS g(i)
        WHERE m.k < 15 GROUP BY m.symbol, g.i) GROUP BY symbol
    ) SELECT * FROM m),
    fin AS (SELECT symbol, a, b FROM m WHERE k = 15),
    prev AS (SELECT symbol, a, b FROM m WHERE k = 14),
    w AS (SELECT p.symbol, avg((list_distance(s.x, p.a) <= list_distance(s.x, p.b))::int) AS wa FROM prev p JOIN shape s ON s.symbol = p.symbol GROUP BY p.symbol),
    u AS (SELECT f.symbol AS id, wa AS weight, f.a[20] AS last, 0 AS o FROM fin f JOIN w ON w.symbol = f.symbol UNION ALL SELECT f.symbol, 1 - wa, f.b[20], 1 FROM fin f JOIN w ON w.symbol = f.symbol)
    SELECT id, CASE row_number() OVER (PARTITION BY id ORDER BY -weight, o) WHEN 1 THEN 'A' ELSE 'B' END AS name, round(weight, 6) AS weight, round(last, 6) AS last FROM u""",
    _SIM,
)
def cone_scenarios(spark, sf_dir):
    out = R.scenarios(_simulated(spark, sf_dir))
    return out.select("id", "name", r6("weight").alias("weight"), r6(F.element_at("path", -1)).alias("last"))


def _scored(spark, sf_dir, calendar=None, more=None, events: bool = False, own=None):
    """Targets of every year whose pools hold MIN_POOL rows, each with its pool as of that year, and the frame.

    Their returns are fr{h}, over h bars; with a calendar also sr{h}, over h of its sessions. more: columns of the frame
    that go with them. The frame has closes and whether twenty bars follow (later), not the paths, which are twenty times as
    large: it stays dealt by symbol, so that R.learned() makes them where they are read. With events it has the codes of events and i, a bar's number.
    """
    frame = X.with_labels(keyed(spark, sf_dir, events=events, path=False, own=own)).withColumns({"later": F.count("c").over(_own().rowsBetween(1, R.STEPS)) == R.STEPS, **(more or {})})
    frame = frame.withColumn("i", F.row_number().over(_own())) if events else frame
    frame = frame if calendar is None else G.session_returns(frame, calendar, R.HORIZONS)
    returns = [f"{k}{h}" for k in (("fr",) if calendar is None else ("fr", "sr")) for h in R.HORIZONS] + list(more or {})
    rows = once(frame.select("symbol", "d", "c", "vol20", "later", *R.AXES, *returns, *(("codes", "i") if events else ())))  # read for pools, targets and what came
    able = F.col("vol").isNotNull() & F.col("later") & (F.col("vol20") > 0)
    days = [r for r in rows.groupBy("d").agg(F.count_if(able).alias("n")).collect() if r["d"] is not None]  # a row a date
    before = lambda y: sum(r["n"] for r in days if r["d"] < dt.date(y, 1, 1) - dt.timedelta(R.PURGE))
    years = [y for y in sorted({r["d"].year for r in days}) if before(y) >= R.MIN_POOL]
    keys = rows.where(F.col("vol").isNotNull() & (F.col("vol20") > 0)).withColumn("asof", F.year("d")).where(F.col("asof").isin(years))
    counts = once(R.yearly_counts(rows.where(able), years))  # values of six axes, by year
    return R.yearly_pool(keys.select("symbol", "d", "vol20", "asof", *R.AXES, *returns), counts).where("level IS NOT NULL"), rows


def _issued(spark, sf_dir, horizons=R.HORIZONS, scored=None, more: tuple[str, ...] = (), returns: str = "fr"):
    """Bootstrap cones of every day of the scored years, from pools of what was known before the year, and what came (ret, null where not known yet).

    Returns and further columns of the targets go with a target to its pool and come back with its cone, so no cone is shuffled for them.
    """
    targets, rows = scored or _scored(spark, sf_dir)
    own = F.struct("symbol", "d", *[f"{returns}{h}" for h in horizons], *more)
    drawn = targets.select(own.alias("id"), R.seed_of(F.col("symbol"), F.col("d")).alias("seed"), "vol20", R.until_year(F.col("asof")).alias("until"), "pool", "level", "n")
    cone = R.cones(drawn, R.learned(rows.withColumn("known", F.unix_date("d"))), SCORED_PATHS, horizons)
    ret = F.coalesce(*[F.when(F.col("h") == h, F.col(f"id.{returns}{h}")) for h in horizons])
    return cone.select("id.symbol", "id.d", "h", *[f"q{q}" for q in R.QUANTILES], ret.alias("ret"), *[f"id.{c}" for c in more])


_YEARS = KEYED_SQL + f""",
yrs AS MATERIALIZED (SELECT y FROM (SELECT DISTINCT year(d) AS y FROM bars) t WHERE (SELECT count(*) FROM rows_ k WHERE k.d < make_date(t.y, 1, 1) - 35) >= {R.MIN_POOL}),
learn AS MATERIALIZED (SELECT yrs.y, lv AS l, """ + _PREFIX.format("k.", "climax_y", "lv") + """ AS pool, k.symbol, k.d, k.s5, k.s10, k.s20 FROM rows_ k, yrs, range(0, 7) AS r(lv) WHERE k.d < make_date(yrs.y, 1, 1) - 35),
ycnt AS MATERIALIZED (SELECT y, l, pool, count(*) AS n, avg((s5 > 0)::int) AS up5, avg((s10 > 0)::int) AS up10, avg((s20 > 0)::int) AS up20 FROM learn GROUP BY ALL),
ytried AS (SELECT k.symbol, k.d, k.vol20, yrs.y, lv AS l, """ + _PREFIX.format("k.", "climax_y", "lv") + """ AS p FROM keyed k, yrs, range(0, 7) AS r(lv) WHERE known AND vol20 > 0 AND year(k.d) = yrs.y),
ytarget AS MATERIALIZED (SELECT t.symbol, t.d, t.vol20, t.y, c.l, c.pool, c.n, c.up5, c.up10, c.up20 FROM ytried t JOIN ycnt c ON c.y = t.y AND c.l = t.l AND c.pool = t.p WHERE c.n >= 200 OR c.l = 6
  QUALIFY row_number() OVER (PARTITION BY t.symbol, t.d ORDER BY c.l) = 1)"""

def draw_sql(path: str, block: str, salt: int, seed: str = "t.seed") -> str:
    """regime.draw() before the last modulus."""
    return f"(((({seed} * 1103515 + {path} * 7919 + {block} * 104729 + {salt} * 15485863) % 2147483647) * 48271) % 2147483647)"


_SLICES = f"CAST(ceil({{0}}n / {R.SLICE}) AS bigint)"
#: Slices by powers of two.
_DOUBLED = f"CASE WHEN ({{0}}n - 1) // {R.SLICE} < 1 THEN 1::bigint ELSE CAST(pow(2, len(bin(CAST(({{0}}n - 1) // {R.SLICE} AS bigint)))) AS bigint) END"


def sliced_sql(rows: str, keys: str, slices: str = _SLICES, order: str = "symbol, d") -> str:
    """Rows of pools with their slice, their number in it and its size: rows has the keys, symbol, d and n, the size of the pool."""
    seed = "CAST(('0x' || left(sha1(concat_ws('|', symbol, CAST(d AS varchar))), 8)) AS bigint)"
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys}, sl ORDER BY {order}) - 1 AS row, count(*) OVER (PARTITION BY {keys}, sl) AS m
  FROM (SELECT *, {seed} % ({slices.format('')}) AS sl FROM {rows})"""


def drawn_sql(target: str, slices: str, same: str, paths: int, blocks: int, number: str = _SLICES) -> str:
    """Rows of target for each path and block, with the slice, the row in it and the start that they draw; slices: the keys, sl and m, met by `same`."""
    return f"""SELECT t.*, {draw_sql('t.path', 't.block', 1)} % z.m AS row, {draw_sql('t.path', 't.block', 2)} % 16 AS start
  FROM (SELECT t.*, p.path, b.block, {draw_sql(f'(p.path % {R.GROUPS})', '0', 3)} % ({number.format('t.')}) AS sl FROM {target} t, range(0, {paths}) AS p(path), range(0, {blocks}) AS b(block)) t
  JOIN {slices} z ON {same} AND z.sl = t.sl"""


_HITS = _YEARS + f""",
ystep AS (SELECT symbol, d, list_transform(range(1, 21), lambda j: (ln(nxt[j] / c) - CASE WHEN j = 1 THEN 0 ELSE ln(nxt[j - 1] / c) END) / vol20) AS steps FROM rows_),
yrow AS MATERIALIZED ({sliced_sql('(SELECT l.y, l.l, l.pool, l.symbol, l.d, c.n FROM learn l JOIN ycnt c ON c.y = l.y AND c.l = l.l AND c.pool = l.pool SEMI JOIN ytarget t ON t.y = l.y AND t.l = l.l AND t.pool = l.pool)', 'y, l, pool')}),
yslice AS (SELECT y, l, pool, sl, any_value(m) AS m FROM yrow GROUP BY ALL),
ypool AS MATERIALIZED (SELECT r.y, r.l, r.pool, r.sl, r.row, s.steps FROM yrow r JOIN ystep s ON s.symbol = r.symbol AND s.d = r.d),
yseed AS (SELECT *, CAST(('0x' || left(sha1(concat_ws('|', symbol, CAST(d AS varchar))), 8)) AS bigint) AS seed FROM ytarget),
ydr AS ({drawn_sql('yseed', 'yslice', 'z.y = t.y AND z.l = t.l AND z.pool = t.pool', SCORED_PATHS, 4)}),
yx AS (
  SELECT e.symbol, e.d, e.path, e.block, """ + " + ".join(f"greatest(-ln(1.07), least(ln(1.07), p.steps[e.start + {j}] * e.vol20))" for j in range(1, 6)) + """ AS x
  FROM ydr e JOIN ypool p ON p.y = e.y AND p.l = e.l AND p.pool = e.pool AND p.sl = e.sl AND p.row = e.row
),
yend AS (SELECT symbol, d, path, sum(x) FILTER (block < 1) AS x5, sum(x) FILTER (block < 2) AS x10, sum(x) AS x20 FROM yx GROUP BY symbol, d, path),
yq AS MATERIALIZED (SELECT symbol, d, quantile_cont(x5, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q5, quantile_cont(x10, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q10, quantile_cont(x20, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q20 FROM yend GROUP BY symbol, d),
lab AS (
  SELECT symbol, d, ln(lead(c, 5) OVER w / c) AS f5, ln(lead(c, 10) OVER w / c) AS f10, ln(lead(c, 20) OVER w / c) AS f20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)
),
iss AS MATERIALIZED (
  SELECT symbol, d, h, q, ret FROM (
    SELECT y.symbol, y.d, unnest([{'h': 5, 'q': q5, 'ret': f5}, {'h': 10, 'q': q10, 'ret': f10}, {'h': 20, 'q': q20, 'ret': f20}], recursive := true) FROM yq y JOIN lab b ON b.symbol = y.symbol AND b.d = y.d)
  WHERE ret IS NOT NULL
),
lev AS (SELECT * FROM (VALUES (50, 3, 5), (80, 2, 6), (90, 1, 7)) AS t(level, a, b)),
hits AS MATERIALIZED (SELECT d, h, level, avg((ret BETWEEN q[a] AND q[b])::int) AS hit FROM iss, lev GROUP BY d, h, level)"""


@query("SELECT d, h, level, round(hit, 6) AS hit FROM hits", _HITS)
def cone_hits(spark, sf_dir):
    return R.hits(_issued(spark, sf_dir)).withColumn("hit", r6("hit"))


@query(
    """WITH s AS (SELECT h, level, list(hit ORDER BY d) AS x FROM hits GROUP BY h, level)
    SELECT h, level, list_reduce(x, lambda a, y: round(greatest(0.5::double, least(3.0::double, a * exp(0.05::double * (level / 100 - y)))), 4), 1.0::double) AS s, CAST(least(len(x), 250) AS bigint) AS n FROM s""",
    _HITS,
)
def conformal_update(spark, sf_dir):
    return R.calibrate(R.hits(_issued(spark, sf_dir))).select("h", "level", "s", F.size("hits").cast("long").alias("n"))


@query(
    """WITH s AS (SELECT h, list(round(hit, 4) ORDER BY d) AS x FROM hits WHERE level = 80 GROUP BY h)
    SELECT h, CAST(least(len(x), 250) AS bigint) AS n, round(list_avg(x[-60:]), 6) AS recent,
           CASE WHEN len(x) < 20 THEN 'pending' WHEN list_avg(x[-60:]) < 0.74 THEN 'narrow' WHEN list_avg(x[-60:]) > 0.86 THEN 'wide' ELSE 'ok' END AS verdict FROM s""",
    _HITS,
)
def conformal_verdict(spark, sf_dir):
    return R.verdicts(R.calibrate(R.hits(_issued(spark, sf_dir)))).withColumn("recent", r6("recent"))


@query(
    """WITH s0 AS (SELECT h, level, list_reduce(list(hit ORDER BY d), lambda a, y: round(greatest(0.5::double, least(3.0::double, a * exp(0.05::double * (level / 100 - y)))), 4), 1.0::double) AS s FROM hits GROUP BY h, level),
    s AS MATERIALIZED (SELECT h, max(s) FILTER (level = 50) AS a, max(s) FILTER (level = 80) AS b, max(s) FILTER (level = 90) AS c FROM s0 GROUP BY h)
    SELECT i.symbol, i.d, i.h, round(q[4] + c * (q[1] - q[4]), 6) AS q5, round(q[4] + b * (q[2] - q[4]), 6) AS q10, round(q[4] + a * (q[3] - q[4]), 6) AS q25,
           round(q[4] + a * (q[5] - q[4]), 6) AS q75, round(q[4] + b * (q[6] - q[4]), 6) AS q90, round(q[4] + c * (q[7] - q[4]), 6) AS q95
    FROM iss i JOIN s ON s.h = i.h""",
    _HITS,
)
def conformal_widen(spark, sf_dir):
    cone = once(R.beside(_issued(spark, sf_dir), None))  # read for scales and for what they widen
    state = R.calibrate(R.hits(cone)).select("h", "level", "s")
    return R.widen(cone, state).select("symbol", "d", "h", *[r6(f"q{q}").alias(f"q{q}") for q in R.QUANTILES if q != 50])


@query(
    """SELECT h, round(avg(greatest(tau * (ret - q[k]), (tau - 1) * (ret - q[k]))), 8) AS pinball, count(*) AS n
    FROM iss, (VALUES (0.05::double, 1), (0.1::double, 2), (0.25::double, 3), (0.5::double, 4), (0.75::double, 5), (0.9::double, 6), (0.95::double, 7)) AS t(tau, k) GROUP BY h""",
    _HITS,
)
def pinball_loss(spark, sf_dir):
    rows = R.beside(_issued(spark, sf_dir), None)
    rows = rows.select("h", "ret", F.explode(F.array(*[F.struct(F.lit(q / 100).alias("tau"), F.col(f"q{q}").alias("q")) for q in R.QUANTILES])).alias("t")).select("h", "t.tau", (F.col("ret") - F.col("t.q")).alias("e"))
    return rows.groupBy("h").agg(F.round(F.avg(F.greatest(F.col("tau") * F.col("e"), (F.col("tau") - 1) * F.col("e"))), 8).alias("pinball"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT year(d) AS year, h, round(avg((ret BETWEEN q[3] AND q[5])::int), 6) AS cov50, round(avg((ret BETWEEN q[2] AND q[6])::int), 6) AS cov80,
    round(avg((ret BETWEEN q[1] AND q[7])::int), 6) AS cov90, round(avg(q[6] - q[2]), 6) AS width80 FROM iss GROUP BY year(d), h""",
    _HITS,
)
def coverage_by_year(spark, sf_dir):
    rows = R.beside(_issued(spark, sf_dir), None)
    covers = [r6(F.avg(F.col("ret").between(F.col(f"q{a}"), F.col(f"q{b}")).cast("int"))).alias(f"cov{v}") for v, (a, b) in R.LEVELS.items()]
    return rows.groupBy(F.year("d").alias("year"), "h").agg(*covers, r6(F.avg(F.col("q90") - F.col("q10"))).alias("width80"))


@query(
    """SELECT h, level, coalesce(min(s) FILTER (cov >= level / 100), 3.0) AS scale FROM (
      SELECT h, level, s, avg((ret BETWEEN q[4] + s * (q[a] - q[4]) AND q[4] + s * (q[b] - q[4]))::int) AS cov FROM iss, lev, (SELECT round(0.8::double + k * 0.05::double, 2) AS s FROM range(0, 45) AS r(k)) GROUP BY h, level, s) GROUP BY h, level""",
    _HITS,
)
def scale_fit(spark, sf_dir):
    return R.fit_scale(_issued(spark, sf_dir))


@query(
    """SELECT t.l AS level, h, count(*) AS n, round(avg((ret BETWEEN q[2] AND q[6])::int), 6) AS cov80, round(avg(q[6] - q[2]), 6) AS width80
    FROM iss i JOIN ytarget t ON t.symbol = i.symbol AND t.d = i.d GROUP BY t.l, h HAVING count(*) >= 100""",
    _HITS,
)
def coverage_by_level(spark, sf_dir):
    """By how many axes the pool of a cone had to drop."""
    rows = R.beside(_issued(spark, sf_dir, more=("level",)), None)
    out = rows.groupBy("level", "h").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("ret").between(F.col("q10"), F.col("q90")).cast("int"))).alias("cov80"), r6(F.avg(F.col("q90") - F.col("q10"))).alias("width80"))
    return out.where("n >= 100")


@query("SELECT symbol, d, h, " + ", ".join(f"round(q[{i + 1}], 6) AS q{q}" for i, q in enumerate(R.QUANTILES)) + ", round(ret, 6) AS ret FROM iss", _HITS)
def scored_cones(spark, sf_dir):
    """Bootstrap cones of the scored years beside what came."""
    return R.beside(_issued(spark, sf_dir), None).select("symbol", "d", "h", *[r6(f"q{q}").alias(f"q{q}") for q in R.QUANTILES], r6("ret").alias("ret"))


_TRADES = _HITS + """,
net AS (SELECT symbol, d, lead(c, 11) OVER w * (1 - 0.0015::double - 0.001::double) / (lead(o) OVER w * (1 + 0.0015::double)) - 1 AS net11 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
sg AS (SELECT year(y.d) AS year, n.net11, t.up10 >= 0.6::double AND y.q10[3] > 0 AS s FROM yq y JOIN ytarget t ON t.symbol = y.symbol AND t.d = y.d JOIN net n ON n.symbol = y.symbol AND n.d = y.d WHERE net11 IS NOT NULL)"""


@query(
    """SELECT year, count(*) FILTER (s) AS trades, round(avg(net11) FILTER (s), 6) AS net, round(avg((net11 > 0)::int) FILTER (s), 6) AS win, round(avg(net11), 6) AS all_net, round(avg((net11 > 0)::int), 6) AS all_win FROM sg GROUP BY year""",
    _TRADES,
)
def backtest_by_year(spark, sf_dir):
    """Bought where the pool rose in six of ten cases and three quarters of the cone lie above today's price."""
    scored = _scored(spark, sf_dir, more={"net": V.net_return(11)})
    rows = _issued(spark, sf_dir, (10,), scored, ("up10", "net")).where("symbol IS NOT NULL").withColumn("year", F.year("d"))
    return V.backtest(rows, (F.col("up10") >= 0.6) & (F.col("q25") > 0)).withColumns({c: r6(c) for c in ("net", "win", "all_net", "all_win")})


@query("SELECT symbol, d, l AS level, n, pool, round(up5, 6) AS p5, round(up10, 6) AS p10 FROM ytarget", _YEARS)
def anchored_pools(spark, sf_dir):
    """Each day's pool and its share of rises, of what was known five weeks before the year began."""
    out = _scored(spark, sf_dir)[0]
    return out.select("symbol", "d", "level", "n", "pool", r6("up5").alias("p5"), r6("up10").alias("p10"))


@query(
    """WITH cal AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) AS z FROM (SELECT DISTINCT d FROM bars)),
    need AS MATERIALIZED (SELECT cal.z, i.d, h, level, ceil(least(coalesce(CASE WHEN ret >= q[4] THEN (ret - q[4]) / nullif(q[b] - q[4], 0) ELSE (ret - q[4]) / nullif(q[a] - q[4], 0) END, 9.0), 9.0) * 10000) AS cell
      FROM iss i JOIN cal ON cal.d = i.d, lev),
    days AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY h, level ORDER BY z) AS k FROM (SELECT h, level, z, any_value(d) AS d, list(cell) AS cells FROM need GROUP BY h, level, z)),
    run AS (WITH RECURSIVE run AS (
      SELECT h, level, 0::bigint AS k, 1.0::double AS s, NULL::date AS d, NULL::double AS hit, []::double[] AS due, []::bigint[] AS due_at FROM (SELECT DISTINCT h, level FROM days)
      UNION ALL
      SELECT h, level, k, s, d, hit, list_append(due[m + 1:], hit), list_append(due_at[m + 1:], z + h) FROM (
        SELECT *, len(list_filter(cells, lambda x: x <= round(s * 10000))) / len(cells) AS hit FROM (
          SELECT n.h, n.level, n.k, n.z, n.d, n.cells, r.due, r.due_at, len(list_filter(r.due_at, lambda x: x <= n.z)) AS m,
                 list_reduce(list_filter(r.due, lambda x, i: r.due_at[i] <= n.z), lambda a, y: round(greatest(0.5::double, least(3.0::double, a * exp(0.05::double * (n.level / 100 - y)))), 4), r.s) AS s
          FROM run r JOIN days n ON n.h = r.h AND n.level = r.level AND n.k = r.k + 1))
    ) SELECT * FROM run)
    SELECT d, h, level, round(s, 4) AS s, round(hit, 6) AS hit FROM run WHERE k > 0""",
    _HITS,
)
def sequential_calibration(spark, sf_dir):
    """The scale in force on each day, as it learns what a day's cones caught h sessions later."""
    cone = _issued(spark, sf_dir)
    calendar = dates(spark, sf_dir).withColumn("session", F.row_number().over(Window.orderBy("d")))  # a row a session
    return R.sequential(cone, None, calendar).select("d", "h", "level", F.round("s", 4).alias("s"), r6("hit").alias("hit"))


@query(
    """WITH cal AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) AS z FROM (SELECT DISTINCT d FROM bars)),
    q3 AS (SELECT symbol, d, unnest([{'h': 5, 'q': q5}, {'h': 10, 'q': q10}, {'h': 20, 'q': q20}], recursive := true) FROM yq),
    rt AS (SELECT q3.d, q3.h, q3.q, u.d AS scored_on, ln(b.c / a.c) AS ret FROM q3 JOIN cal c ON c.d = q3.d JOIN cal u ON u.z = c.z + q3.h
      JOIN bars a ON a.symbol = q3.symbol AND a.d = q3.d JOIN bars b ON b.symbol = q3.symbol AND b.d = u.d)
    SELECT d, h, level, count(*) AS n, round(avg((ret BETWEEN q[a] AND q[b])::int), 6) AS hit, scored_on FROM rt, lev GROUP BY d, h, level, scored_on""",
    _HITS,
)
def maturity_ledger(spark, sf_dir):
    """Cones scored in two runs whose sessions overlap: each issue day, horizon and level is in the ledger once."""
    calendar = once(G.sessions(dates(spark, sf_dir)))
    n = calendar.count()
    cone = _issued(spark, sf_dir, scored=_scored(spark, sf_dir, calendar), returns="sr")
    every = once(G.matured(cone, None, calendar, 1, n))  # three levels of three horizons a session
    early, late = G.between(every, calendar, 1, n - 15), G.between(every, calendar, n - 60, n)
    return G.merged(early, late).withColumn("hit", r6("hit"))


# -- the forecast of the last sessions ---------------------------------------------------------------

#: Sessions that are replayed, and the settings of the alert by probability.
REPLAYED, P_MIN, N_MIN = 90, 0.58, 200
#: The events that give an alert on their day.
PUSHED = K.CODES


def _forecasts(spark, sf_dir, sessions: int):
    """One row for each symbol with a bar on each of the last sessions: pool, probabilities, cone, alerts; pools hold what was known that day.

    Pools grow by what becomes known on a session: a row is held once, whatever the number of sessions. The
    scale of the cones begins at 1 and learns of a session's cones ten sessions later, so one session has none.
    """
    frame = keyed(spark, sf_dir, events=True, path=False).withColumns({"known_on": F.lead("d", 20).over(_own()), "before": F.lag("c").over(_own()), "i": F.row_number().over(_own())})
    frame = X.with_labels(frame).withColumn("later", F.count("c").over(_own().rowsBetween(1, R.STEPS)) == R.STEPS)
    returns = [f"fr{h}" for h in R.HORIZONS]
    frame = once(frame.select("symbol", "d", "i", "c", "before", "known_on", "later", "vol20", "codes", *R.AXES, *returns))  # the calendar is its days; stays dealt by symbol
    calendar = once(G.sessions(frame))
    last = calendar.count()
    first = max(1, last - sessions + 1)
    days = F.broadcast(calendar)  # sessions
    frame = frame.join(days, "d").join(days.select(F.col("d").alias("known_on"), F.col("session").alias("known")), "known_on", "left")
    learn = R.learned(frame)
    own = frame.where(F.col("session") >= first).withColumn("asof", F.col("session"))
    ready = own.where(F.col("vol").isNotNull() & (F.col("vol20") > 0)).select("symbol", "d", "vol20", "asof", *R.AXES)
    counts = once(R.growing_counts(frame.where("vol IS NOT NULL AND later AND vol20 > 0"), first, last))
    targets = R.yearly_pool(ready, counts).where("level IS NOT NULL")
    drawn = targets.select(F.struct("symbol", "d").alias("id"), R.seed_of(F.col("symbol"), F.col("d")).alias("seed"), "vol20", F.col("asof").alias("until"), "pool", "level", "n")
    cone = R.cones(drawn, learn, PATHS, (10,), grown=True).select("id.symbol", "id.d", "h", *[f"q{q}" for q in R.QUANTILES])
    if sessions > 1:
        cone = once(cone)
        scale = F.broadcast(_carried(own, cone, calendar, first))  # sessions
        cone = cone.join(scale, "d")
        for a, b, s in ((10, 90, "s80"), (25, 75, "s50")):
            cone = cone.withColumns({f"q{q}": F.col("q50") + F.col(s) * (F.col(f"q{q}") - F.col("q50")) for q in (a, b)})
    cone = cone.select("symbol", "d", "q10", "q25", "q50", "q90")
    base = counts.where(F.col("level") == len(R.AXES)).select("asof", F.col("up10").alias("base10"))
    hit = K.kept_codes(frame.where(F.size("codes") > 0)).where(F.col("code").isin(*PUSHED)).groupBy("symbol", "d")
    hit = hit.agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("events"))
    rows = own.select("symbol", "d", "asof", F.col("c").alias("price"), "before").join(targets.select("symbol", "d", "level", "n", "up5", "up10"), ["symbol", "d"], "left")
    rows = rows.join(cone, ["symbol", "d"], "left").join(F.broadcast(base), "asof", "left").join(hit, ["symbol", "d"], "left")  # a row a session
    out = R.forecast_items(rows, P_MIN, N_MIN)
    return out.join(scale, "d", "left") if sessions > 1 else out


def _carried(closes, cone, calendar, first: int):
    """d, s50, s80: the scales in force on each session from first on, of cones after 10 sessions of the calendar."""
    days = F.broadcast(calendar)  # sessions
    own = closes.select("symbol", "d", "c").join(days, "d").where(F.col("session") >= first)
    later = own.select("symbol", (F.col("session") - 10).alias("session"), F.col("c").alias("__c"))
    real = own.join(later, ["symbol", "session"]).select("symbol", "d", F.lit(10).alias("h"), F.ln(F.col("__c") / F.col("c")).alias("ret"))
    every = calendar.where(F.col("session") >= first).select("session", "d", F.lit(10).alias("h"), F.explode(F.array(*[F.lit(v) for v in R.LEVELS])).alias("level"))
    scale = R.sequential(cone, real, calendar, every)
    return scale.groupBy("d").agg(*[F.max(F.when(F.col("level") == v, F.col("s"))).alias(f"s{v}") for v in (50, 80)])


def _own():
    return Window.partitionBy("symbol").orderBy("d")


#: The scales from session to session, and the cones that they widen.
_SCALED = """fcal AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) AS z FROM (SELECT DISTINCT d FROM bars)),
fret AS (SELECT f.d, f.q, ln(b.c / a.c) AS ret FROM fraw f JOIN fcal c ON c.d = f.d JOIN fcal u ON u.z = c.z + 10 JOIN bars a ON a.symbol = f.symbol AND a.d = f.d JOIN bars b ON b.symbol = f.symbol AND b.d = u.d),
flev AS (SELECT * FROM (VALUES (50, 2, 4), (80, 1, 5)) AS t(level, a, b)),
fneed AS (SELECT d, level, list(ceil(least(coalesce(CASE WHEN ret >= q[3] THEN (ret - q[3]) / nullif(q[b] - q[3], 0) ELSE (ret - q[3]) / nullif(q[a] - q[3], 0) END, 9.0), 9.0) * 10000)) AS cells FROM fret, flev GROUP BY d, level),
fdays AS MATERIALIZED (SELECT v.level, s.s AS d, c.z, n.cells, row_number() OVER (PARTITION BY v.level ORDER BY c.z) AS k FROM fs s JOIN fcal c ON c.d = s.s, flev v LEFT JOIN fneed n ON n.d = s.s AND n.level = v.level),
frun AS MATERIALIZED (WITH RECURSIVE run AS (
  SELECT level, 0::bigint AS k, 1.0::double AS s, NULL::date AS d, []::double[] AS due, []::bigint[] AS due_at FROM flev
  UNION ALL
  SELECT level, k, s, d, CASE WHEN cells IS NULL THEN due[m + 1:] ELSE list_append(due[m + 1:], len(list_filter(cells, lambda x: x <= round(s * 10000))) / len(cells)) END, CASE WHEN cells IS NULL THEN due_at[m + 1:] ELSE list_append(due_at[m + 1:], z + 10) END FROM (
    SELECT n.level, n.k, n.z, n.d, n.cells, r.due, r.due_at, len(list_filter(r.due_at, lambda x: x <= n.z)) AS m,
           list_reduce(list_filter(r.due, lambda x, i: r.due_at[i] <= n.z), lambda a, y: round(greatest(0.5::double, least(3.0::double, a * exp(0.05::double * (n.level / 100 - y)))), 4), r.s) AS s
    FROM run r JOIN fdays n ON n.level = r.level AND n.k = r.k + 1)
  ) SELECT * FROM run WHERE k > 0),
fscale AS MATERIALIZED (SELECT d, max(s) FILTER (level = 50) AS s50, max(s) FILTER (level = 80) AS s80 FROM frun GROUP BY d),
fq AS (SELECT f.symbol, f.d, [q[3] + s80 * (q[1] - q[3]), q[3] + s50 * (q[2] - q[3]), q[3], q[3] + s50 * (q[4] - q[3]), q[3] + s80 * (q[5] - q[3])] AS q FROM fraw f JOIN fscale s ON s.d = f.d),"""


def _forecast_sql(sessions: int) -> str:
    return FOUR_SQL + "," + KEYED_SQL[len(FRAME_SQL) + 1 :] + f""",
fs AS MATERIALIZED (SELECT DISTINCT d AS s FROM bars ORDER BY d DESC LIMIT {sessions}),
kn AS (SELECT symbol, d, lead(d, 20) OVER (PARTITION BY symbol ORDER BY d) AS known_on FROM bars),
flearn AS MATERIALIZED (SELECT fs.s, lv AS l, """ + _PREFIX.format("k.", "climax_y", "lv") + """ AS pool, k.symbol, k.d, kn.known_on, k.s5, k.s10 FROM rows_ k JOIN kn ON kn.symbol = k.symbol AND kn.d = k.d, fs, range(0, 7) AS r(lv) WHERE kn.known_on <= fs.s),
fcnt AS MATERIALIZED (SELECT s, l, pool, count(*) AS n, avg((s5 > 0)::int) AS up5, avg((s10 > 0)::int) AS up10 FROM flearn GROUP BY ALL),
ftried AS (SELECT k.symbol, k.d, k.vol20, lv AS l, """ + _PREFIX.format("k.", "climax_y", "lv") + """ AS p FROM keyed k SEMI JOIN fs ON fs.s = k.d, range(0, 7) AS r(lv) WHERE known AND vol20 > 0),
ftarget AS MATERIALIZED (SELECT t.symbol, t.d, t.vol20, c.l, c.pool, c.n, c.up5, c.up10, CAST(('0x' || left(sha1(concat_ws('|', t.symbol, CAST(t.d AS varchar))), 8)) AS bigint) AS seed
  FROM ftried t JOIN fcnt c ON c.s = t.d AND c.l = t.l AND c.pool = t.p WHERE c.n >= 200 OR c.l = 6 QUALIFY row_number() OVER (PARTITION BY t.symbol, t.d ORDER BY c.l) = 1),
fstep AS (SELECT symbol, d, list_transform(range(1, 21), lambda j: (ln(nxt[j] / c) - CASE WHEN j = 1 THEN 0 ELSE ln(nxt[j - 1] / c) END) / vol20) AS steps FROM rows_),
frow AS MATERIALIZED (""" + sliced_sql("(SELECT l.s, l.l, l.pool, l.symbol, l.d, l.known_on, c.n FROM flearn l JOIN fcnt c ON c.s = l.s AND c.l = l.l AND c.pool = l.pool SEMI JOIN ftarget t ON t.d = l.s AND t.l = l.l AND t.pool = l.pool)", "s, l, pool", _DOUBLED, "known_on, symbol, d") + """),
fslice AS (SELECT s, l, pool, sl, any_value(m) AS m FROM frow GROUP BY ALL),
fpool AS MATERIALIZED (SELECT r.s, r.l, r.pool, r.sl, r.row, x.steps FROM frow r JOIN fstep x ON x.symbol = r.symbol AND x.d = r.d),
fdr AS (""" + drawn_sql("ftarget", "fslice", "z.s = t.d AND z.l = t.l AND z.pool = t.pool", PATHS, 2, _DOUBLED) + """),
fx AS (SELECT e.symbol, e.d, e.path, """ + " + ".join(f"greatest(-ln(1.07), least(ln(1.07), p.steps[e.start + {j}] * e.vol20))" for j in range(1, 6)) + """ AS x
  FROM fdr e JOIN fpool p ON p.s = e.d AND p.l = e.l AND p.pool = e.pool AND p.sl = e.sl AND p.row = e.row),
fraw AS MATERIALIZED (SELECT symbol, d, quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM (SELECT symbol, d, path, sum(x) AS x FROM fx GROUP BY symbol, d, path) GROUP BY symbol, d),
""" + (_SCALED if sessions > 1 else "fq AS (SELECT symbol, d, q FROM fraw),") + """
item AS (
  SELECT b.symbol, b.d, round(b.c, 4) AS price, round(100 * (b.c / nullif(b.c1, 0) - 1), 2) AS change_pct, t.n IS NOT NULL AS ok, CAST(t.l AS int) AS level, t.n, round(t.up5, 3) AS p5, round(t.up10, 3) AS p10, round(g.up10, 3) AS base10,
    round(b.c * exp(q[1]), 4) AS q10, round(b.c * exp(q[2]), 4) AS q25, round(b.c * exp(q[3]), 4) AS q50, round(b.c * exp(q[5]), 4) AS q90,
    coalesce(t.up10 >= 0.58::double AND t.n >= 200 AND q[2] > 0, false) AS alert_p10, k.events IS NOT NULL AS alert_event, coalesce(k.events, '') AS alert_events
  FROM ret b SEMI JOIN fs ON fs.s = b.d LEFT JOIN ftarget t ON t.symbol = b.symbol AND t.d = b.d LEFT JOIN fq ON fq.symbol = b.symbol AND fq.d = b.d
  LEFT JOIN (SELECT * FROM fcnt WHERE l = 6) g ON g.s = b.d LEFT JOIN (SELECT symbol, d, string_agg(code, ',' ORDER BY code) AS events FROM kept4 GROUP BY symbol, d) k ON k.symbol = b.symbol AND k.d = b.d
)"""


@query("SELECT * FROM item", _forecast_sql(1))
def forecast_item(spark, sf_dir):
    return _forecasts(spark, sf_dir, 1)


@query("SELECT i.*, round(s.s50, 4) AS s50, round(s.s80, 4) AS s80 FROM item i LEFT JOIN fscale s ON s.d = i.d", _forecast_sql(REPLAYED))
def forecast_replay(spark, sf_dir):
    """The forecasts of the last 90 sessions, each by what was known on that day, with the scale carried from day to day."""
    return _forecasts(spark, sf_dir, REPLAYED).withColumns({s: F.round(s, 4) for s in ("s50", "s80")})
