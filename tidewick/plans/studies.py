"""Queries of ingestion gates, studies and backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.reuse import once
from ..functions.rolling import r6
from ..operators import direction as D
from ..operators import evaluate as V
from ..operators import features as X
from ..operators import ingest as G
from ..operators import zones as Z
from ..sources.market import BARS_SQL, INDEX, TICKS_SQL, bars, ticks
from . import cones
from .features import FRAME_SQL
from .registry import query
from .volume import LEVELS_SQL, MINUTES_SQL, SLID_SQL, break_alerts

# -- ingestion ---------------------------------------------------------------------------------------


def _holed(spark, sf_dir):
    """All ticks, each of which comes twice; on even days those of 1,000 report 200 too little, so that the running total has gaps."""
    short = (F.col("vol") == 1000) & (F.day("d") % 2 == 0)
    rows = ticks(spark, sf_dir).withColumn("vol", F.when(short, F.col("vol") - 200).otherwise(F.col("vol")))
    return rows.withColumn("arrival", F.explode(F.array(F.lit(0), F.lit(1))))


_HOLED = TICKS_SQL + """,
holed AS (SELECT * REPLACE (CASE WHEN vol = 1000 AND day(d) % 2 = 0 THEN vol - 200 ELSE vol END AS vol), unnest([0, 1]) AS arrival FROM ticks),
once AS (SELECT * FROM holed QUALIFY row_number() OVER (PARTITION BY symbol, d, acc ORDER BY arrival) = 1)"""


@query("SELECT symbol, d, acc, vol, arrival FROM once", _HOLED)
def tick_dedup(spark, sf_dir):
    return G.first_of_each(_holed(spark, sf_dir), "arrival").select("symbol", "d", "acc", "vol", "arrival")


@query(
    """SELECT symbol, d, gap, gap_points, NOT (gap < 0 OR gap > 0.002::double * a OR (gap > 0 AND gap_points > 3)) AS accepted FROM (
      SELECT symbol, d, CAST(max(acc) - sum(vol) AS bigint) AS gap, CAST(sum((acc <> p + vol)::int) AS bigint) AS gap_points, max(acc) AS a
      FROM (SELECT *, coalesce(lag(acc) OVER (PARTITION BY symbol, d ORDER BY acc), 0) AS p FROM once) GROUP BY symbol, d)""",
    _HOLED,
)
def shortfall_gate(spark, sf_dir):
    return G.shortfall(G.first_of_each(_holed(spark, sf_dir), "arrival"))


@query("SELECT symbol, d, sec, price, vol, side, acc FROM (SELECT symbol, d, sec, round(price, 4) AS price, vol, CASE WHEN side = 'ATC' THEN '' ELSE side END AS side, acc FROM ticks) WHERE vol > 100 AND price > 0", TICKS_SQL)
def tick_normalise(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    raw = rows.select(
        "symbol", "d", "sec", F.round("price", 4).cast("string").alias("price"), F.when(F.col("vol") > 100, F.col("vol").cast("string")).otherwise("n/a").alias("vol"),
        F.when(F.col("side") != "ATC", F.lower("side")).alias("side"), F.col("acc").cast("string").alias("acc"),
    )
    return G.normalise(raw)


@query("SELECT symbol, d, acc, vol FROM ticks SEMI JOIN (SELECT symbol, max(d) AS d FROM ticks GROUP BY symbol) m USING (symbol, d)", TICKS_SQL)
def newest_session(spark, sf_dir):
    return G.newest_session(ticks(spark, sf_dir)).select("symbol", "d", "acc", "vol")


@query("SELECT d, count(*) AS voters, count(*) FILTER (NOT s) AS lacking, count(*) FILTER (NOT s) >= 0.2::double * count(*) AS wait FROM (SELECT symbol, d, max(sec) >= 53040 AS s FROM mins GROUP BY symbol, d HAVING count(*) >= 30) GROUP BY d", MINUTES_SQL)
def quorum_gate(spark, sf_dir):
    return G.quorum(G.settled(Z.minute_bars(ticks(spark, sf_dir))))


_DAILY = MINUTES_SQL + """,
md AS (SELECT symbol, d, min_by(o, sec) AS o, max(h) AS h, min(l) AS l, max_by(c, sec) AS c, CAST(sum(v) AS bigint) AS v FROM mins GROUP BY symbol, d)"""


@query("SELECT symbol, d, round(o, 4) AS o, round(h, 4) AS h, round(l, 4) AS l, round(c, 4) AS c, v FROM md", _DAILY)
def minutes_to_days(spark, sf_dir):
    return G.days_of(Z.minute_bars(ticks(spark, sf_dir))).withColumns({x: F.round(x, 4) for x in "ohlc"})


@query("SELECT symbol, d, round(CASE WHEN day(d) % 2 = 0 THEN c ELSE o END, 4) AS c, CASE WHEN day(d) % 2 = 0 THEN v ELSE v + 1 END AS v FROM md", _DAILY)
def merge_today(spark, sf_dir):
    """A daily bar of the opening price and other volume on odd dates more, on even dates less than the minutes have."""
    minutes = G.days_of(Z.minute_bars(ticks(spark, sf_dir)))
    daily = minutes.withColumns({"c": F.col("o"), "v": F.when(F.day("d") % 2 == 0, F.col("v") - 1).otherwise(F.col("v") + 1)})
    return G.merge_today(daily, minutes).select("symbol", "d", F.round("c", 4).alias("c"), "v")


def _versions(spark, sf_dir):
    """A store that ends 30 days before the bars do, and a delivery that begins 30 days after they do, in which S1's first half is adjusted and the volume of S2 revised."""
    own = bars(spark, sf_dir)
    span = own.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    rows = own.join(F.broadcast(span))  # one row
    half = F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int"))
    factor = F.when((F.col("symbol") == "S1") & (F.col("d") < half), 0.79).otherwise(1.0)
    old = rows.where(F.col("d") <= F.date_sub("last", 30)).select(*own.columns)
    new = rows.where(F.col("d") >= F.date_add("first", 30)).withColumns({x: F.col(x) * factor for x in "ohlc"} | {"v": F.when(F.col("symbol") == "S2", F.col("v") + 100).otherwise(F.col("v"))})
    return old, new.select(*own.columns)


_VERSIONS = BARS_SQL + """,
sp AS (SELECT min(d) AS first, max(d) AS last, min(d) + CAST(floor((max(d) - min(d)) / 2) AS int) AS half FROM bars),
old AS (SELECT bars.* FROM bars, sp WHERE d <= last - 30),
f AS (SELECT bars.*, CASE WHEN symbol = 'S1' AND d < half THEN 0.79::double ELSE 1.0::double END AS k FROM bars, sp WHERE d >= first + 30),
new AS (SELECT symbol, d, o * k AS o, h * k AS h, l * k AS l, c * k AS c, CASE WHEN symbol = 'S2' THEN v + 100 ELSE v END AS v FROM f)"""


@query(
    """SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.d, a.d) AS d, round(coalesce(b.c, a.c), 6) AS c, coalesce(b.v, a.v) AS v,
    CASE WHEN b.d IS NULL THEN 'kept' WHEN a.d IS NULL THEN 'added' WHEN a.o = b.o AND a.h = b.h AND a.l = b.l AND a.c = b.c AND a.v = b.v THEN 'same' ELSE 'changed' END AS status
    FROM old a FULL JOIN new b ON a.symbol = b.symbol AND a.d = b.d""",
    _VERSIONS,
)
def bar_upsert(spark, sf_dir):
    return G.upsert(*_versions(spark, sf_dir)).select("symbol", "d", r6("c").alias("c"), "v", "status")


@query(
    """SELECT symbol, d, round(ratio, 6) AS ratio FROM (SELECT a.symbol, a.d, b.c / nullif(a.c, 0) AS ratio, round(abs(b.c / nullif(a.c, 0) - 1), 9) AS off FROM old a JOIN new b ON a.symbol = b.symbol AND a.d = b.d
      WHERE a.d < (SELECT max(d) FROM new n WHERE n.symbol = a.symbol)) WHERE off > 0.005 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY off DESC, d) = 1""",
    _VERSIONS,
)
def retro_adjustment(spark, sf_dir):
    return G.readjusted(*_versions(spark, sf_dir)).withColumn("ratio", r6("ratio"))


@query("WITH q AS (SELECT s.symbol, d.d FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT CAST(date_trunc('month', d) AS date) AS d FROM bars) d) SELECT q.symbol, q.d, b.c AS close FROM q ASOF LEFT JOIN bars b ON q.symbol = b.symbol AND q.d >= b.d", BARS_SQL)
def close_asof(spark, sf_dir):
    own = bars(spark, sf_dir)
    months = own.select(F.trunc("d", "month").alias("d")).distinct()
    asked = own.select("symbol").distinct().join(F.broadcast(months))  # symbols by months: a small table asked for
    return G.close_asof(asked, own)


@query("SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) > 2280)", BARS_SQL)
def missing_symbols(spark, sf_dir):
    own = bars(spark, sf_dir)
    have = own.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 2280")
    return G.missing(own.select("symbol").distinct(), have)


@query(
    """SELECT symbol, d, est, total FROM (SELECT symbol, d, est, total FROM (
        SELECT symbol, d, true AS est, total + 1 AS total, 0 AS age FROM sess UNION ALL SELECT symbol, d, day(d) % 2 = 1, total, 1 FROM sess)
      QUALIFY row_number() OVER (PARTITION BY symbol, d ORDER BY est, age) = 1) QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) <= 20""",
    LEVELS_SQL,
)
def zone_store_put(spark, sf_dir):
    own = Z.sessions(ticks(spark, sf_dir)).select("symbol", "d", "total")
    stored = own.withColumns({"est": F.lit(True), "total": F.col("total") + 1})
    return G.put_sessions(stored, own.withColumn("est", F.day("d") % 2 == 1), 20).select("symbol", "d", "est", "total")


@query(
    """WITH a AS (SELECT symbol, d, sec, round(price, 3) AS price, vol, side, acc, row_number() OVER (PARTITION BY symbol, d, sec, round(price, 3), vol ORDER BY acc, side) AS n FROM ticks),
    b0 AS (SELECT symbol, d, sec, round(CASE WHEN vol = 700 THEN price + 0.05::double ELSE price END, 3) AS price, vol, CASE WHEN vol = 300 THEN 'PB' ELSE side END AS side, acc FROM ticks),
    b AS (SELECT *, row_number() OVER (PARTITION BY symbol, d, sec, price, vol ORDER BY acc, side) AS n FROM b0)
    SELECT concat_ws('/', a.side, coalesce(b.side, '-')) AS pair, count(*) AS n FROM a LEFT JOIN b ON a.symbol = b.symbol AND a.d = b.d AND a.sec = b.sec AND a.price = b.price AND a.vol = b.vol AND a.n = b.n GROUP BY 1""",
    TICKS_SQL,
)
def source_reconciliation(spark, sf_dir):
    left = ticks(spark, sf_dir)
    # the other source has another price for some sizes, and another side for one
    price = F.when(F.col("vol") == 700, F.col("price") + 0.05).otherwise(F.col("price"))
    right = left.withColumns({"price": price, "side": F.when(F.col("vol") == 300, "PB").otherwise(F.col("side"))})
    return G.bag_match(left, right)


@query("SELECT s.symbol, s.d, round(abs(s.total - m.v) / m.v, 6) AS off FROM (SELECT symbol, d, CAST(sum(vol) AS bigint) AS total FROM once GROUP BY symbol, d) s JOIN md m ON s.symbol = m.symbol AND s.d = m.d WHERE m.v > 0 AND abs(s.total - m.v) / m.v > 0.02", _DAILY + "," + _HOLED[len(TICKS_SQL) + 1 :])
def volume_cross_check(spark, sf_dir):
    once = G.first_of_each(_holed(spark, sf_dir), "arrival")
    daily = G.days_of(Z.minute_bars(ticks(spark, sf_dir)))
    return G.volume_check(Z.sessions(once), daily).withColumn("off", r6("off"))


@query(
    """WITH f AS (SELECT symbol, d, direction, CASE direction WHEN 'up' THEN vah ELSE val END AS level FROM brk WHERE direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, d ORDER BY w) = 1)
    SELECT d, count(*) AS n, CASE WHEN count(*) > 6 THEN printf('%d alerts: %d up, %d down', count(*), count(*) FILTER (direction = 'up'), count(*) FILTER (direction = 'down'))
      ELSE string_agg(printf('%s %s %.2f', symbol, direction, level), '; ' ORDER BY printf('%s %s %.2f', symbol, direction, level)) END AS body FROM f GROUP BY d""",
    SLID_SQL,
)
def alert_payloads(spark, sf_dir):
    """One text for each session's alerts, each by its shortest window."""
    first = F.row_number().over(Window.partitionBy("symbol", "d").orderBy("w"))
    return G.payloads(break_alerts(spark, sf_dir).withColumn("__r", first).where("__r = 1"))


# -- studies -----------------------------------------------------------------------------------------

_NET = FRAME_SQL + """,
net AS (
  SELECT *, year(d) AS year, lead(c, 10) OVER w * (1 - 0.0015::double - 0.001::double) / (lead(o) OVER w * (1 + 0.0015::double)) - 1 AS net10,
         lead(c, 11) OVER w * (1 - 0.0015::double - 0.001::double) / (lead(o) OVER w * (1 + 0.0015::double)) - 1 AS net11, ln(lead(c, 20) OVER w / c) AS f20
  FROM vola WINDOW w AS (PARTITION BY symbol ORDER BY d)
)"""


@query("SELECT symbol, d, round(net10, 6) AS net10, round(net11, 6) AS net11 FROM net", _NET)
def trade_net_returns(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", r6(V.net_return(10)).alias("net10"), r6(V.net_return(11)).alias("net11"))


_BUCKETS = """WITH b AS (SELECT CASE WHEN r20 <= -0.05 THEN 'down' WHEN r20 <= 0.05 THEN 'flat' ELSE 'up' END AS bucket, year, f20 AS ret FROM net WHERE r20 IS NOT NULL AND f20 IS NOT NULL),
    base AS (SELECT year, avg(ret) AS base FROM b GROUP BY year),
    by_ AS (SELECT b.bucket, b.year, avg(ret) AS m, any_value(base) AS base FROM b JOIN base ON b.year = base.year GROUP BY b.bucket, b.year),
    w AS (SELECT bucket, count(*) FILTER (m > base) AS beats, count(*) AS years FROM by_ GROUP BY bucket)"""


def _buckets(spark, sf_dir):
    rows = X.with_labels(X.with_returns(bars(spark, sf_dir))).where("r20 IS NOT NULL AND fr20 IS NOT NULL")
    bucket = F.when(F.col("r20") <= -0.05, "down").when(F.col("r20") <= 0.05, "flat").otherwise("up")
    return rows.select(bucket.alias("bucket"), F.year("d").alias("year"), F.col("fr20").alias("ret"))


@query(
    f"""{_BUCKETS} SELECT s.bucket, n, round(mean, 6) AS mean, round(win, 6) AS win, round(std, 6) AS std, beats, years FROM (
      SELECT bucket, count(*) AS n, avg(ret) AS mean, avg((ret > 0)::int) AS win, stddev_samp(ret) AS std FROM b GROUP BY bucket HAVING count(*) >= 200) s JOIN w ON w.bucket = s.bucket
    UNION ALL SELECT 'all', count(*), round(avg(ret), 6), round(avg((ret > 0)::int), 6), round(stddev_samp(ret), 6), NULL, NULL FROM b""",
    _NET,
)
def bucket_study(spark, sf_dir):
    return V.bucket_study(_buckets(spark, sf_dir)).withColumns({c: r6(c) for c in ("mean", "win", "std")})


@query(f"{_BUCKETS} SELECT year, round(stddev_samp(ret) FILTER (bucket = 'down'), 6) AS down, round(stddev_samp(ret) FILTER (bucket = 'flat'), 6) AS flat, round(stddev_samp(ret) FILTER (bucket = 'up'), 6) AS up FROM b GROUP BY year", _NET)
def deviation_pivot(spark, sf_dir):
    return _buckets(spark, sf_dir).groupBy("year").pivot("bucket", ["down", "flat", "up"]).agg(F.round(F.stddev_samp("ret"), 6))


def _with_shares(spark, sf_dir, made):
    """Rows made of bars, of days with a regime, with p5 and p10, the share of rises of the pool as of the year; 0.5 without one."""
    own = once(bars(spark, sf_dir))  # read for rows and regimes
    rows = made(own)
    targets, frame = cones._scored(spark, sf_dir, own=own)
    shares = targets.select("symbol", "d", F.col("up5").alias("p5"), F.col("up10").alias("p10"))
    rows = rows.join(frame.where("vol IS NOT NULL").select("symbol", "d"), ["symbol", "d"], "left_semi").join(shares, ["symbol", "d"], "left")
    return rows.fillna({"p5": 0.5, "p10": 0.5})


@query(
    """WITH lb AS (SELECT k.symbol, k.d, l.h, CASE l.h WHEN 5 THEN b.f5 ELSE b.f10 END > 0 AS up, coalesce(CASE l.h WHEN 5 THEN t.up5 ELSE t.up10 END, 0.5) AS p
      FROM keyed k JOIN lab b ON b.symbol = k.symbol AND b.d = k.d LEFT JOIN ytarget t ON t.symbol = k.symbol AND t.d = k.d, (VALUES (5), (10)) AS l(h)
      WHERE known AND CASE l.h WHEN 5 THEN b.f5 ELSE b.f10 END IS NOT NULL),
    kn AS (SELECT h, y, count(*) AS n_train, avg(up::int) AS base FROM lb, (SELECT DISTINCT year(d) AS y FROM lb) WHERE d < make_date(y, 1, 1) - 35 GROUP BY h, y HAVING count(*) >= 1000)
    SELECT lb.h, year(lb.d) AS year, n_train, count(*) AS n_test, round(avg(up::int), 6) AS up_rate, round(avg((p - up::int) ** 2), 6) AS brier_freq,
           round(avg((base - up::int) ** 2), 6) AS brier_global, round(avg((0.5 - up::int) ** 2), 6) AS brier_half
    FROM lb JOIN kn ON kn.h = lb.h AND kn.y = year(lb.d) GROUP BY ALL""",
    cones._YEARS + """,
lab AS (SELECT symbol, d, ln(lead(c, 5) OVER w / c) AS f5, ln(lead(c, 10) OVER w / c) AS f10 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))""",
)
def direction_baselines(spark, sf_dir):
    """What a model of the direction has to beat: pools' shares, the mean of the past and one half."""
    out = V.baselines(_with_shares(spark, sf_dir, X.with_labels), (5, 10))
    return out.select("h", "year", "n_train", "n_test", *[r6(c).alias(c) for c in ("up_rate", "brier_freq", "brier_global", "brier_half")])


def _direction(spark, sf_dir):
    return V.walk_forward(_with_shares(spark, sf_dir, lambda own: D.matrix(own, INDEX)), D.COLUMNS, (5, 10))


@query()
def walk_forward_direction(spark, sf_dir):
    """Rows only: boosted trees have no SQL. Both horizons, every year that has a thousand rows to learn from."""
    return _direction(spark, sf_dir)


@query()
def direction_gate(spark, sf_dir):
    """Rows only, as what it judges is. The last year is not full."""
    results = _direction(spark, sf_dir)
    last = results.agg(F.max("year").alias("last"))
    return V.direction_gate(results.join(F.broadcast(last), F.col("year") < F.col("last")))  # one row


@query(
    """SELECT symbol, d, direction, n FROM (SELECT symbol, d, CASE WHEN net10 > 0.05 THEN 'up' WHEN net10 < -0.05 THEN 'down' END AS direction, count(*) OVER (PARTITION BY d) AS n FROM net) WHERE direction IS NOT NULL""",
    _NET,
)
def large_moves(spark, sf_dir):
    from pyspark.sql import Window

    rows = bars(spark, sf_dir).withColumn("net", V.net_return(10)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("d")))
    return rows.withColumn("direction", F.when(F.col("net") > 0.05, "up").when(F.col("net") < -0.05, "down")).where("direction IS NOT NULL").select("symbol", "d", "direction", "n")


