"""Queries of the feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import r6
from ..operators import features as X
from ..sources.market import BARS_SQL, INDEX, bars
from .registry import query

#: Bars with returns and volatility.
FRAME_SQL = BARS_SQL + """,
ret AS (
  SELECT *, row_number() OVER w AS i, lag(c) OVER w AS c1,
         ln(c / lag(c, 1) OVER w) AS r1, ln(c / lag(c, 5) OVER w) AS r5, ln(c / lag(c, 10) OVER w) AS r10, ln(c / lag(c, 20) OVER w) AS r20
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)
),
vola AS (
  SELECT *, CASE WHEN count(r1) OVER w = 20 THEN stddev_samp(r1) OVER w END AS vol20
  FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
)"""


def frame(spark, sf_dir):
    return X.with_volatility(X.with_returns(bars(spark, sf_dir)))


@query("SELECT * FROM bars", BARS_SQL)
def bars_from_trades(spark, sf_dir):
    return bars(spark, sf_dir)


@query("SELECT d, row_number() OVER (ORDER BY d) AS session FROM (SELECT DISTINCT d FROM bars)", BARS_SQL)
def calendar(spark, sf_dir):
    """All dates with any bar, numbered. One row per session: the single-partition window sees only those."""
    from pyspark.sql import Window

    return bars(spark, sf_dir).select("d").distinct().withColumn("session", F.row_number().over(Window.orderBy("d")))


@query("SELECT symbol, min(d) AS first_d, max(d) AS last_d, count(*) AS n FROM bars GROUP BY symbol", BARS_SQL)
def bar_span(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, d, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r10, 6) AS r10, round(r20, 6) AS r20 FROM ret", FRAME_SQL)
def log_returns(spark, sf_dir):
    return X.with_returns(bars(spark, sf_dir)).select("symbol", "d", *[r6(f"r{k}").alias(f"r{k}") for k in X.RETURNS])


@query("SELECT symbol, d, round(vol20, 6) AS vol20 FROM vola", FRAME_SQL)
def volatility20(spark, sf_dir):
    return frame(spark, sf_dir).select("symbol", "d", r6("vol20").alias("vol20"))


@query(
    """SELECT symbol, d, round(CASE WHEN n = 250 AND vol20 IS NOT NULL THEN len(list_filter(past, lambda x: x < vol20)) / 250 END, 6) AS vol20_rank
    FROM (SELECT *, count(vol20) OVER w AS n, list(vol20) FILTER (WHERE vol20 IS NOT NULL) OVER w AS past
          FROM (SELECT symbol, d, round(vol20, 12) AS vol20 FROM vola)
          WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))""",
    FRAME_SQL,
)
def volatility_rank(spark, sf_dir):
    base = frame(spark, sf_dir).withColumn("vol20", F.round("vol20", 12))
    return X.with_rank(base).select("symbol", "d", r6("vol20_rank").alias("vol20_rank"))


@query(
    """SELECT symbol, d, round(CASE WHEN n = 249 AND vol20 IS NOT NULL THEN len(list_filter(past, lambda x: x < vol20)) / 249 END, 6) AS vol20_rank249
    FROM (SELECT *, count(vol20) OVER w AS n, list(vol20) FILTER (WHERE vol20 IS NOT NULL) OVER w AS past
          FROM (SELECT symbol, d, round(vol20, 12) AS vol20 FROM vola)
          WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 249 PRECEDING AND 1 PRECEDING))""",
    FRAME_SQL,
)
def volatility_rank_research(spark, sf_dir):
    """The variant that counts today's value into a window of 250."""
    base = frame(spark, sf_dir).withColumn("vol20", F.round("vol20", 12))
    return X.with_rank(base, 249, "vol20_rank249").select("symbol", "d", r6("vol20_rank249").alias("vol20_rank249"))


@query("SELECT symbol, d, round(r5 / nullif(vol20 * sqrt(5.0), 0), 6) AS z5, round(r10 / nullif(vol20 * sqrt(10.0), 0), 6) AS z10, round(r20 / nullif(vol20 * sqrt(20.0), 0), 6) AS z20 FROM vola", FRAME_SQL)
def return_scores(spark, sf_dir):
    return X.with_scores(frame(spark, sf_dir)).select("symbol", "d", *[r6(f"z{k}").alias(f"z{k}") for k in X.HORIZONS])


@query(
    """SELECT symbol, d, round(CASE WHEN n = 20 THEN (c - lo) / nullif(hi - lo, 0) END, 6) AS don20_pos
    FROM (SELECT *, count(*) OVER w AS n, min(l) OVER w AS lo, max(h) OVER w AS hi FROM bars
          WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    BARS_SQL,
)
def donchian_position(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", r6(X.donchian()).alias("don20_pos"))


@query(
    """SELECT symbol, d, round(CASE WHEN count(*) OVER w = 60 THEN c / max(c) OVER w - 1 END, 6) AS dd_from_high60
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    BARS_SQL,
)
def drawdown60(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", r6(X.drawdown()).alias("dd_from_high60"))


VOLUME_SQL = FRAME_SQL + """,
vr AS (
  SELECT *, CASE WHEN count(*) OVER w = 20 THEN v / nullif(avg(v) OVER w, 0) END AS vol_ratio,
         CASE WHEN count(*) OVER w = 20 THEN (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) END AS vol_z20,
         CASE WHEN count(*) OVER w = 20 THEN sum(CASE WHEN c > c1 THEN v ELSE 0 END) OVER w / nullif(sum(v) OVER w, 0) END AS upvol_share
  FROM vola WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
),
volume AS (
  SELECT *, coalesce(CASE WHEN count(vol_ratio) OVER w = 3 THEN max(round(vol_ratio, 9)) OVER w END >= 2, false) AS spike3
  FROM vr WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
)"""


@query("SELECT symbol, d, round(vol_ratio, 6) AS vol_ratio, round(vol_z20, 6) AS vol_z20, spike3, round(upvol_share, 6) AS upvol_share FROM volume", VOLUME_SQL)
def volume_features(spark, sf_dir):
    return X.with_volume(bars(spark, sf_dir)).select("symbol", "d", r6("vol_ratio").alias("vol_ratio"), r6("vol_z20").alias("vol_z20"), "spike3", r6("upvol_share").alias("upvol_share"))


@query(
    """SELECT symbol, d, up AS hit_ceiling, down AS hit_floor, CASE WHEN count(*) OVER w = 5 THEN CAST(sum(up::int) OVER w AS bigint) END AS n_ceiling5
    FROM (SELECT *, coalesce(c / c1 - 1 >= 0.065, false) AS up, coalesce(c / c1 - 1 <= -0.065, false) AS down FROM ret)
    WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    FRAME_SQL,
)
def limit_days(spark, sf_dir):
    return X.with_limits(bars(spark, sf_dir)).select("symbol", "d", "hit_ceiling", "hit_floor", "n_ceiling5")


@query("SELECT symbol, d, round(o / c1 - 1, 6) AS gap, coalesce(abs(o / c1 - 1) > 0.01, false) AS gap_big FROM ret", FRAME_SQL)
def opening_gaps(spark, sf_dir):
    return X.with_gap(bars(spark, sf_dir)).select("symbol", "d", r6("gap").alias("gap"), "gap_big")


CLIMAX_SQL = FRAME_SQL + """,
clim AS (
  SELECT *, coalesce(c / c1 - 1 >= 0.065 AND c > o
       AND abs(c - o) >= 2 * CASE WHEN count(*) OVER b = 10 THEN avg(abs(c - o)) OVER b END
       AND (c - l) / nullif(h - l, 0) >= 0.8
       AND v >= 2 * CASE WHEN count(*) OVER p = 20 THEN avg(v) OVER p END
       AND c > CASE WHEN count(*) OVER p = 20 THEN max(c) OVER p END, false) AS climax
  FROM vola
  WINDOW b AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
         p AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
)"""


@query("SELECT symbol, d, climax, bool_or(climax) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS climax3 FROM clim", CLIMAX_SQL)
def buying_climax(spark, sf_dir):
    return X.with_climax(bars(spark, sf_dir)).select("symbol", "d", "climax", "climax3")


@query(
    """WITH ix AS (SELECT d, r5, r20, vol20 FROM vola WHERE symbol = 'S0')
    SELECT a.symbol, a.d,
           round(last_value(b.r5 IGNORE NULLS) OVER w, 6) AS idx_r5,
           round(last_value(b.r20 IGNORE NULLS) OVER w, 6) AS idx_r20,
           round(last_value(b.vol20 IGNORE NULLS) OVER w, 6) AS idx_vol20
    FROM bars a LEFT JOIN ix b ON a.d = b.d
    WINDOW w AS (PARTITION BY a.symbol ORDER BY a.d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    FRAME_SQL,
)
def index_join_ffill(spark, sf_dir):
    own = bars(spark, sf_dir)
    index = X.index_columns(own.where(F.col("symbol") == INDEX))
    return X.join_index(own, index).select("symbol", "d", *[r6(c).alias(c) for c in ("idx_r5", "idx_r20", "idx_vol20")])


@query(
    """SELECT symbol, d, round(f5, 6) AS fr5, round(f10, 6) AS fr10, round(f20, 6) AS fr20, f5 > 0 AS y5, f10 > 0 AS y10, f20 > 0 AS y20
    FROM (SELECT *, ln(lead(c, 5) OVER w / c) AS f5, ln(lead(c, 10) OVER w / c) AS f10, ln(lead(c, 20) OVER w / c) AS f20
          FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))""",
    BARS_SQL,
)
def forward_labels(spark, sf_dir):
    out = X.with_labels(bars(spark, sf_dir))
    return out.select("symbol", "d", *[r6(f"fr{k}").alias(f"fr{k}") for k in X.HORIZONS], *[f"y{k}" for k in X.HORIZONS])


@query(
    """SELECT symbol, d, step, round(ln(x / c), 6) AS cum
    FROM (SELECT symbol, d, c, unnest(nxt) AS x, generate_subscripts(nxt, 1) AS step
          FROM (SELECT symbol, d, c, list(c) OVER w AS nxt FROM bars
                WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
          WHERE len(nxt) = 20)""",
    BARS_SQL,
)
def forward_paths(spark, sf_dir):
    out = X.with_path(bars(spark, sf_dir)).where("path is not null")
    return out.select("symbol", "d", F.posexplode("path").alias("step", "cum")).select("symbol", "d", (F.col("step") + 1).cast("long").alias("step"), r6("cum").alias("cum"))


@query("SELECT symbol, d, CAST(isodow(d) - 1 AS bigint) AS dow FROM bars", BARS_SQL)
def day_of_week(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", F.weekday("d").cast("long").alias("dow"))


@query(
    """SELECT symbol, d, round(CASE WHEN count(g) OVER w = 20 THEN sqrt(greatest(avg(g) OVER w, 0.0)) END, 6) AS gk20
    FROM (SELECT symbol, d, 0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2) AS g FROM bars)
    WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    BARS_SQL,
)
def garman_klass20(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "d", r6(X.garman_klass()).alias("gk20"))


@query("SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 60)", BARS_SQL)
def long_histories(spark, sf_dir):
    return X.long_enough(bars(spark, sf_dir))


@query(
    """SELECT symbol, d, round(vol20, 6) AS vol20, round(r20, 6) AS r20, climax
    FROM clim QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 11""",
    CLIMAX_SQL,
)
def active_window(spark, sf_dir):
    """The last 11 rows of each symbol of the whole feature frame, in which an event still counts."""
    from pyspark.sql import Window

    own = bars(spark, sf_dir)
    out = X.feature_frame(own, own.where(F.col("symbol") == INDEX))
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    return out.withColumn("age", F.row_number().over(late)).where("age <= 11").select("symbol", "d", r6("vol20").alias("vol20"), r6("r20").alias("r20"), "climax")
