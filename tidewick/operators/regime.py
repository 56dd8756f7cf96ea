"""Regimes of a symbol's day, historical pools, probability cones and their calibration."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Axes, cuts, horizons, quantiles, levels and limits are part of what is computed.
VALUES = {"vol": ("low", "mid", "high"), "upvol": ("low", "mid", "high"), "st": ("up", "down"), "spike": ("yes", "no"), "climax": ("yes", "no"), "gap": ("yes", "no")}
AXES = tuple(VALUES)
#: A pool needs so many rows; with fewer, axes are dropped from the last one on.
MIN_POOL = 200
HORIZONS = (5, 10, 20)
QUANTILES = (5, 10, 25, 50, 75, 90, 95)
STEPS, BLOCK = 20, 5
#: Days before a year on which pools stop learning for it.
PURGE = 35
#: No day moves farther than the exchange's limit.
CLIP = math.log(1.07)
#: Level -> the quantiles that bound it.
LEVELS = {50: (25, 75), 80: (10, 90), 90: (5, 95)}
GAMMA, SCALE_LOW, SCALE_HIGH, WINDOW = 0.05, 0.5, 3.0, 250


def regime_columns() -> dict[str, Column]:
    """The six axes; all null where rank, share or trend is not known yet. A value on a cut belongs below it."""

    def three(c: str, low: float, high: float) -> Column:
        return F.when(F.col(c) <= low, "low").when(F.col(c) <= high, "mid").otherwise("high")

    def yes(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit(False)), "yes").otherwise("no")

    known = F.col("vol20_rank").isNotNull() & F.col("upvol_share").isNotNull() & F.col("st_up").isNotNull()
    axes = {
        "vol": three("vol20_rank", 0.33, 0.67),
        "upvol": three("upvol_share", 0.40, 0.60),
        "st": F.when(F.col("st_up"), "up").otherwise("down"),
        "spike": yes("spike3"),
        "climax": yes("climax3"),
        "gap": yes("gap_big"),
    }
    return {k: F.when(known, v) for k, v in axes.items()}


def pool_rows(frame: DataFrame) -> DataFrame:
    """Rows that a pool may hold: regime and all forward steps known. steps: log returns of each session by vol20."""
    return with_steps(frame.where(F.col("vol").isNotNull()))


def with_steps(frame: DataFrame) -> DataFrame:
    """Rows of frame whose forward path is known, with its steps."""
    before = F.concat(F.array(F.lit(0.0)), F.slice("path", 1, STEPS - 1))
    steps = F.zip_with("path", before, lambda x, y: (x - y) / F.col("vol20"))
    return frame.where(F.col("path").isNotNull() & (F.col("vol20") > 0)).withColumn("steps", steps)


def learned(frame: DataFrame) -> DataFrame:
    """symbol, d, known, steps and the axes: pool_rows() of a frame (symbol, d, known, c, vol20 and the axes) that has closes and no paths.

    One pass over a symbol's bars makes the paths; a frame that is dealt by symbol is not shuffled for it.
    """
    import numpy as np
    import pyarrow as pa

    own = frame.select("symbol", "d", "known", "c", "vol20", *AXES)
    schema = T.StructType([own.schema[c] for c in ("symbol", "d", "known")]).add("steps", T.ArrayType(T.DoubleType()))
    for axis in AXES:
        schema = schema.add(axis, T.StringType())

    def stepped(table: pa.Table) -> pa.Table:
        table = table.sort_by("d")
        n = max(len(table) - STEPS, 0)
        close, vol = (table[c].to_numpy() for c in ("c", "vol20"))
        later = np.lib.stride_tricks.sliding_window_view(close, STEPS)[1:] if n else np.empty((0, STEPS))
        able = (vol[:n] > 0) & table["vol"].is_valid().to_numpy()[:n] & ~np.isnan(later).any(axis=1)
        path = np.log(later[able] / close[:n][able, None])
        steps = np.diff(path, axis=1, prepend=0.0) / vol[:n][able, None]
        kept = table.slice(0, n).filter(pa.array(able)).drop_columns(["c", "vol20"])
        ends = pa.array(np.arange(len(steps) + 1, dtype=np.int32) * STEPS)
        return kept.append_column("steps", pa.ListArray.from_arrays(ends, pa.array(steps.ravel()))).select(schema.names)

    return own.groupBy("symbol").applyInArrow(stepped, schema)


def pool_counts(rows: DataFrame) -> DataFrame:
    """Pools under every prefix of the axes by one ROLLUP: level (axes dropped), n and the share of rows up after each horizon.

    A key column is null where its axis is dropped; the axes themselves are never null in rows.
    """
    ups = [F.avg((F.col("path")[h - 1] > 0).cast("double")).alias(f"up{h}") for h in HORIZONS]
    dropped = sum((F.grouping(a).cast("int") for a in AXES[1:]), F.grouping(AXES[0]).cast("int"))
    return rows.rollup(*AXES).agg(F.count(F.lit(1)).alias("n"), dropped.alias("level"), *ups)


def prefix(level: Column) -> Column:
    """The key's first axes as one string, `level` of them dropped."""
    return F.array_join(F.slice(F.array(*[F.coalesce(F.col(a), F.lit("")) for a in AXES]), F.lit(1), F.lit(len(AXES)) - level), "|")


def every_axis() -> Column:
    """prefix() of level 0."""
    return F.concat_ws("|", *[F.coalesce(F.col(a), F.lit("")) for a in AXES])


def pool_for(keys: DataFrame, counts: DataFrame, least: int = MIN_POOL) -> DataFrame:
    """keys with the longest prefix whose pool holds `least` rows: level, n, pool (its name) and up5, up10, up20.

    Each key is matched with its seven prefixes; the global pool is taken at any size. The pools' counts are a
    few hundred rows: as many as the axes have values, not as the data.
    """
    ups = [f"up{h}" for h in HORIZONS]
    pools = F.broadcast(counts.select(prefix(F.col("level")).alias("pool"), "level", "n", *ups))
    tried = keys.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(len(AXES)))))
    tried = tried.withColumn("__p", prefix(F.col("__l")))
    met = tried.join(pools, (F.col("__p") == F.col("pool")) & (F.col("__l") == F.col("level"))).where((F.col("n") >= least) | (F.col("level") == len(AXES)))
    columns = [c for c in keys.columns]
    return met.groupBy(*columns).agg(F.min_by(F.struct("level", "n", "pool", *ups), "level").alias("__b")).select(*columns, "__b.*")


def draw(seed: Column, path: Column, block: Column, n: Column, salt: int) -> Column:
    """A number below n that only depends on its arguments, by integer arithmetic of 31 bits."""
    mixed = (seed * 1103515 + path * 7919 + block * 104729 + salt * 15485863) % 2147483647
    return ((mixed * 48271) % 2147483647) % n


def seed_of(symbol: Column, day: Column) -> Column:
    """The first 8 hex digits of sha1('symbol|day') as a number."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", symbol, day.cast("string"))), 1, 8), 16, 10).cast("long")


def bootstrap(targets: DataFrame, pool: DataFrame, paths: int) -> DataFrame:
    """target columns, path and cum: simulated cumulative log returns, by blocks of history.

    targets: id, seed, vol20, pool, n. pool: pool, row (0 to n - 1), steps. Every path is four blocks,
    each a run of 5 steps of a row drawn from the pool, scaled by the day's volatility and clipped. The
    draws join with the pool by (pool, row), so a pool is never copied to a target.
    """
    blocks = STEPS // BLOCK
    drawn = targets.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    drawn = drawn.withColumns(
        {
            "row": draw(F.col("seed"), F.col("path"), F.col("block"), F.col("n"), 1),
            "start": draw(F.col("seed"), F.col("path"), F.col("block"), F.lit(STEPS - BLOCK + 1), 2).cast("int"),
        }
    )
    met = drawn.join(pool, ["pool", "row"])
    piece = F.transform(F.slice("steps", F.col("start") + 1, BLOCK), lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x * F.col("vol20"))))
    out = met.groupBy("id", "path").agg(F.array_sort(F.collect_list(F.struct("block", piece.alias("x")))).alias("b"))
    flat = F.flatten(F.transform("b", lambda s: s["x"]))
    cum = F.aggregate(flat, F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.element_at(F.reverse(a), F.when(F.size(a) > 0, 1)), F.lit(0.0)) + x))
    return out.select("id", "path", cum.alias("cum"))


def quantiles(simulated: DataFrame) -> DataFrame:
    """id, h and one column q5 .. q95: exact percentiles of the simulated returns at each horizon."""
    rows = simulated.select("id", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col("cum")[h - 1].alias("x")) for h in HORIZONS])).alias("z"))
    rows = rows.groupBy("id", "z.h").agg(F.percentile("z.x", F.array(*[F.lit(q / 100) for q in QUANTILES])).alias("q"))
    return rows.select("id", "h", *[F.col("q")[i].alias(f"q{q}") for i, q in enumerate(QUANTILES)])


def touch_first(simulated: DataFrame, up: float = 1.05, down: float = 0.95, within: int = 10) -> DataFrame:
    """id and the share of paths that reach `up` before `down` within so many sessions."""

    def first(hit) -> Column:
        at = F.array_position(F.transform(F.slice("cum", 1, within), hit), True)
        return F.when(at == 0, within + 1).otherwise(at)

    gained = first(lambda x: x >= math.log(up)) < first(lambda x: x <= math.log(down))
    return simulated.groupBy("id").agg(F.avg(gained.cast("double")).alias("touch_up"))


def scenarios(simulated: DataFrame, rounds: int = 15) -> DataFrame:
    """id, name (A the heavier), weight, path: two typical courses of each id's paths, by two means on their shape.

    The first centres are the paths of least and greatest end, so the result depends on the paths alone.
    """
    import numpy as np
    import pandas as pd

    def two(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("path")["cum"].to_numpy())
        centre = x[[x[:, -1].argmin(), x[:, -1].argmax()]].copy()
        for _ in range(rounds):
            own = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            for j in (0, 1):
                if (own == j).any():
                    centre[j] = x[own == j].mean(0)
        weight = np.array([(own == j).mean() for j in (0, 1)])
        order = np.argsort(-weight, kind="stable")
        return pd.DataFrame({"id": frame["id"].iloc[0], "name": ["A", "B"], "weight": weight[order], "path": [list(centre[j]) for j in order]})

    return simulated.groupBy("id").applyInPandas(two, "id string, name string, weight double, path array<double>")


def widen(cone: DataFrame, scale: DataFrame) -> DataFrame:
    """cone (h, q5 .. q95) with each level's quantiles moved from the median by that (h, level)'s scale s."""
    wide = scale.groupBy("h").pivot("level", list(LEVELS)).agg(F.first("s"))
    rows = cone.join(F.broadcast(wide), "h", "left")  # one row for each horizon
    moved = {}
    for level, pair in LEVELS.items():
        for q in pair:
            moved[f"q{q}"] = F.col("q50") + F.coalesce(F.col(f"`{level}`"), F.lit(1.0)) * (F.col(f"q{q}") - F.col("q50"))
    return rows.withColumns(moved).drop(*[str(x) for x in LEVELS])


def beside(cone: DataFrame, real: DataFrame | None) -> DataFrame:
    """Cones with the return that came (ret); without real they carry it themselves, null where it is not known yet. A symbol that is null meets nothing."""
    return cone.where("ret IS NOT NULL AND symbol IS NOT NULL") if real is None else cone.join(real, ["symbol", "d", "h"])


def hits(cone: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """d, h, level and hit: the share of symbols whose realised return lies within the level's quantiles. For real see beside()."""
    rows = beside(cone, real)
    tests = F.array(*[F.struct(F.lit(v).alias("level"), F.col("ret").between(F.col(f"q{a}"), F.col(f"q{b}")).cast("double").alias("hit")) for v, (a, b) in LEVELS.items()])
    return rows.select("d", "h", F.explode(tests).alias("t")).groupBy("d", "h", "t.level").agg(F.avg("t.hit").alias("hit"))


def calibrate(daily: DataFrame) -> DataFrame:
    """h, level, s and hits: widths adapted to daily hit rates, in the order of days.

    A miss widens and a hit narrows; the scale is rounded at every step. One fold for each (h, level),
    over one number a day.
    """
    lists = daily.groupBy("h", "level").agg(F.array_sort(F.collect_list(F.struct("d", "hit"))).alias("days"))
    step = lambda s, x: F.round(F.greatest(F.lit(SCALE_LOW), F.least(F.lit(SCALE_HIGH), s * F.exp(GAMMA * (F.col("level") / 100.0 - x["hit"])))), 4)
    rates = F.transform("days", lambda x: F.round(x["hit"], 4))
    return lists.select("h", "level", F.aggregate("days", F.lit(1.0), step).alias("s"), F.slice(rates, F.greatest(F.size(rates) - WINDOW + 1, F.lit(1)), WINDOW).alias("hits"))


def verdicts(state: DataFrame, level: int = 80, last: int = 60, least: int = 20) -> DataFrame:
    """h, n, recent and verdict on the last hits of one level: pending, narrow, wide or ok."""
    rows = state.where(F.col("level") == level).withColumn("tail", F.slice("hits", F.greatest(F.size("hits") - last + 1, F.lit(1)), last))
    mean = F.aggregate("tail", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("tail"), F.lit(0))
    word = F.when(F.size("hits") < least, "pending").when(mean < 0.74, "narrow").when(mean > 0.86, "wide").otherwise("ok")
    return rows.select("h", F.size("hits").cast("long").alias("n"), mean.alias("recent"), word.alias("verdict"))


def next_row(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """pool, level, row, steps: the pools of all prefixes with their rows numbered; wanted (pool, level) names those that are asked for.

    Rows are numbered within a symbol, then by the counts of the symbols before it, so a window sees one
    symbol's rows, or one row a symbol.
    """
    every = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(AXES))))).withColumn("pool", prefix(F.col("level")))
    keys = [c for c in ("asof", "pool", "level") if c in every.columns]
    if wanted is not None:
        every = every.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")  # values of six axes; else a task would get all rows of a prefix
    return numbered_pools(every, keys)


def numbered_pools(every: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, steps: rows of each key numbered from 0 in the order of (symbol, d)."""
    order = Window.partitionBy(*keys).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    before = every.groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    own = Window.partitionBy(*keys, "symbol").orderBy("d")
    every = every.withColumn("__row", F.row_number().over(own) - 1).join(before, [*keys, "symbol"])
    return every.select(*keys, (F.col("__before") + F.col("__row")).cast("long").alias("row"), "steps")


def yearly(rows: DataFrame, years: list[int], purge: int = PURGE) -> DataFrame:
    """rows with `asof`: once for each of the years that may learn from them, which begin at least `purge` days later."""
    first = F.array(*[F.lit(y) for y in years])
    return rows.withColumn("asof", F.explode(first)).where(F.col("d") < F.date_sub(F.make_date("asof", F.lit(1), F.lit(1)), purge))


def risen(rows: DataFrame, h: int) -> Column:
    """Whether a price is up after h bars, of rows with their path or with returns fr{h}."""
    return (F.col("path")[h - 1] if "path" in rows.columns else F.col(f"fr{h}")) > 0


def yearly_counts(rows: DataFrame, years: list[int], purge: int = PURGE) -> DataFrame:
    """pool_counts of the pools as of each of the years (see yearly).

    A row counts once, in the first year that may learn from it; later years add up a number for each pool and year.
    """
    ups = [f"up{h}" for h in HORIZONS]
    gains = [F.sum(risen(rows, h).cast("long")).alias(f"up{h}") for h in HORIZONS]
    every = F.array(*[F.lit(y) for y in sorted(years)]).cast("array<int>")
    first = F.get(F.filter(every, lambda y: F.col("d") < F.date_sub(F.make_date(y, F.lit(1), F.lit(1)), purge)), F.lit(0))
    added = rows.withColumn("asof", first).where("asof IS NOT NULL").groupBy("asof", *AXES).agg(F.count(F.lit(1)).alias("n"), *gains)
    added = prefixed(added)  # values of six axes, by year
    until = added.withColumn("asof", F.explode(F.filter(every, lambda y: y >= F.col("asof"))))
    sums = until.groupBy("asof", "pool", "level").agg(*[F.sum(c).alias(c) for c in ("n", *ups)])
    return sums.select("asof", "pool", "level", "n", *[(F.col(c) / F.col("n")).alias(c) for c in ups])


def yearly_pool(keys: DataFrame, counts: DataFrame, least: int = MIN_POOL) -> DataFrame:
    """keys (with asof and axes) with the longest prefix whose pool as of then holds `least` rows; the global one at any size.

    It is chosen for each time and each values of the axes, of which there are few, so keys take one lookup and are neither copied nor shuffled.
    """
    ups = [f"up{h}" for h in HORIZONS]
    tried = [("|".join(full), level, "|".join(full[: len(AXES) - level])) for full in itertools.product(*VALUES.values()) for level in range(len(AXES) + 1)]
    met = counts.join(F.broadcast(keys.sparkSession.createDataFrame(tried, "__f string, level int, pool string")), ["level", "pool"])  # values of six axes
    met = met.where((F.col("n") >= least) | (F.col("level") == len(AXES))).groupBy(F.col("asof").alias("__y"), "__f")
    own = met.agg(F.min_by(F.struct("level", "n", "pool", *ups), "level").alias("__b"))
    out = keys.join(F.broadcast(own), (F.col("asof") == F.col("__y")) & (every_axis() == F.col("__f")), "left")  # values of six axes, by time
    return out.select(*[keys[c] for c in keys.columns], "__b.*")


#: Rows of a slice of a pool about, groups of a target's paths, and targets that meet a slice in one task about.
SLICE, GROUPS, TARGETS = 2048, 4, 1024
#: Rows of the largest pool that one task holds whole, least number of targets for which a pool is copied, targets and groups that are drawn at a time.
WHOLE, LEAST_TARGETS, BATCH, CHUNK = 1 << 22, 1 << 14, 1 << 13, 512
#: The moves that a touch is of, and within how many sessions.
UP, DOWN, TOUCH = math.log(1.05), math.log(0.95), 10


def prefixed(rows: DataFrame) -> DataFrame:
    """rows once for each prefix of their axes: level and pool."""
    return rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(AXES))))).withColumn("pool", prefix(F.col("level")))


def asked_for(members: DataFrame, keys: list[str], pools: list[tuple], schema: str) -> DataFrame:
    """members of the pools (the keys, and what goes with them, as in schema; the last is the time until which the pool's targets know rows), once for each of theirs.

    Members with axes meet, by all six, the pools under their prefixes: a row is copied only to pools that are asked for, by targets that know it.
    """
    session = members.sparkSession
    schema += ", __last int"
    if set(keys) <= set(members.columns):
        return members.join(F.broadcast(session.createDataFrame(pools, schema)), keys).where(F.col("known") <= F.col("__last")).drop("__last")
    every = [(full, [p for p in pools if "|".join(full[: len(AXES) - p[1]]) == p[0]]) for full in itertools.product(*VALUES.values())]
    table = session.createDataFrame([("|".join(full), own) for full, own in every if own], f"__full string, __pools array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")
    met = members.join(F.broadcast(table), every_axis() == F.col("__full"))  # values of six axes
    own = F.filter("__pools", lambda p: F.col("known") <= p["__last"])
    return met.select("symbol", "d", "known", "steps", F.explode(own).alias("__p")).select("symbol", "d", "known", "steps", "__p.*").drop("__last")


def copies(targets: int, rows: int) -> int:
    """How many tasks share a pool of so many rows: their copies are most of what cones shuffle."""
    return -(-targets // max(LEAST_TARGETS, 2 * rows))


def slices_of(n: Column) -> Column:
    return F.ceil(n / SLICE).cast("long")


def doubled_slices_of(n: Column) -> Column:
    """The least power of two of slices of at most SLICE rows: pools that grow from day to day change it seldom."""
    full = F.floor((n - 1) / SLICE)
    return F.when(full < 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(full))).cast("long"))


def growing_counts(rows: DataFrame, first: int, last: int) -> DataFrame:
    """pool_counts of the pools as of each of the sessions first to last (asof), by what each session adds.

    rows: known, the session on which a row's steps are known. A row counts once, on that session (or the
    first one), so the rows are never copied to the sessions; running sums see one number a pool and session.
    """
    ups = [f"up{h}" for h in HORIZONS]
    gains = [F.sum(risen(rows, h).cast("long")).alias(f"up{h}") for h in HORIZONS]
    added = rows.where(F.col("known") <= last).withColumn("asof", F.greatest(F.col("known"), F.lit(first)))
    added = prefixed(added.groupBy(*AXES, "asof").agg(F.count(F.lit(1)).alias("n"), *gains))  # values of six axes, by session
    added = added.groupBy("pool", "level", "asof").agg(*[F.sum(c).alias(c) for c in ("n", *ups)])
    pool = Window.partitionBy("pool", "level").orderBy("asof")
    until = F.coalesce(F.lead("asof").over(pool) - 1, F.lit(last))
    sums = added.select("pool", "level", "asof", until.alias("__until"), *[F.sum(c).over(pool).alias(c) for c in ("n", *ups)])
    return sums.select("pool", "level", "n", *[(F.col(c) / F.col("n")).alias(c) for c in ups], F.explode(F.sequence("asof", "__until")).alias("asof"))


def until_year(asof: Column, purge: int = PURGE) -> Column:
    """The last day, as a number, of what the pools of a year may learn from."""
    return F.unix_date(F.date_sub(F.make_date(asof, F.lit(1), F.lit(1)), purge)) - 1


def cones(targets: DataFrame, members: DataFrame, paths: int, horizons: tuple[int, ...] = HORIZONS, touch: bool = False, grown: bool = False) -> DataFrame:
    """id, h and q5 .. q95: exact percentiles of what blocks of history, drawn at random, give after each horizon.

    targets: id, seed, vol20, n, until and the keys of a pool (pool, and level where members go by it); members:
    those keys or the six axes, symbol, d, known, steps. A target draws from the rows of its pool known until then, n of them;
    a pool is held once for the targets of all times. Such a pool is dealt by a hash of (symbol, d) into slices
    of some 2,048 rows, and the paths of a target into GROUPS groups, each of which draws all its blocks from
    one slice that the target's seed chooses. Every path is whole blocks of five steps, as long as the
    farthest horizon asks for; its numbers depend on the seed alone. paths is a multiple of GROUPS.

    One task holds a pool and gives the quantiles of its targets, so that paths are never shuffled. A pool is
    copied once for every twice as many targets as it has rows, so copies grow as targets do. What is wanted
    beside a cone goes through as part of id, for a join of the cones would shuffle them all. Pools of
    more than WHOLE rows go by slices: a task holds one slice and some 1,000 targets, and the
    paths of a target meet by its id.

    grown: rows of a slice are in the order of (known, symbol, d), not (symbol, d), and numbers of slices are
    powers of two.

    touch: adds p_touch, the share of paths that rise by 5 % before they fall by 5 %, within 10 sessions.
    """
    keys = [c for c in ("pool", "level") if c in targets.columns]
    kept = ["id", "p_touch"] if touch else ["id"]
    targets = targets.select("id", "seed", "vol20", "n", "until", *keys).withColumn("__slices", (doubled_slices_of if grown else slices_of)(F.col("n")))
    load = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__t"), F.max("n").alias("__n"), F.max("until").cast("int").alias("__last")).collect()  # values of six axes
    whole = [(*(r[k] for k in keys), i, copies(r["__t"], r["__n"]), r["__last"]) for i, r in enumerate(load) if r["__n"] <= WHOLE]
    large = [(*(r[k] for k in keys), r["__last"]) for r in load if r["__n"] > WHOLE]
    session, named = targets.sparkSession, ", ".join(f"{k} {targets.schema[k].dataType.simpleString()}" for k in keys)
    units = f"{named}, __u int, __salts int"
    out = _whole(targets.join(F.broadcast(session.createDataFrame([w[:-1] for w in whole], units)), keys), asked_for(members, keys, whole, units), paths, horizons, touch, grown)
    if large:
        some = F.broadcast(session.createDataFrame([p[:-1] for p in large], named))
        out = out.unionByName(_sliced(targets.join(some, keys), asked_for(members, keys, large, named), keys, paths, horizons, touch, grown))
    each = [F.struct(F.lit(h).alias("h"), *[F.get(f"x{h}", F.lit(i)).alias(f"q{q}") for i, q in enumerate(QUANTILES)]) for h in horizons]
    return out.select(*kept, F.explode(F.array(*each)).alias("z")).select(*kept, "z.*")


def _place(paths: int, q: int) -> tuple[int, int, float]:
    """The two places in sorted paths between which a percentile lies, and the part of the second."""
    place = (paths - 1) * q / 100
    return int(place), min(int(place) + 1, paths - 1), place - int(place)


#: The modulus and the multiplier of draw(), and how many places a block may begin at: a power of two.
PRIME, MULTIPLIER, STARTS = 2147483647, 48271, STEPS - BLOCK + 1


def _picked(seed, path, block: int, n, salt: int):
    """draw() of arrays."""
    return (seed * 1103515 + path * 7919 + block * 104729 + salt * 15485863) % PRIME * MULTIPLIER % PRIME % n


def _mixed(of_seed, of_path):
    """draw() before the last modulus: sums of what a seed and what a path give, each below PRIME."""
    import numpy as np

    total = of_seed + of_path
    return np.minimum(total.view(np.uint64), (total - PRIME).view(np.uint64)).view(np.int64)  # unsigned, what is below zero is large


class _Blocks:
    """Rows of steps in an order, with the sum and the greatest size of each five steps in a row: most blocks need no clipping."""

    def __init__(self, steps, order=None):
        import numpy as np

        rows = len(steps) if order is None else len(order)
        self.steps, self.order = steps.reshape(-1), None if order is None else order.astype(np.int64, copy=False)
        self.sums, self.most = np.empty((rows, STARTS)), np.empty((rows, STARTS), np.float32)
        for low in range(0, rows, 1 << 14):
            x = steps[low : low + (1 << 14)] if order is None else steps[order[low : low + (1 << 14)]]
            total, size = x[:, :STARTS].copy(), np.abs(x)
            most = size[:, :STARTS].copy()
            for j in range(1, BLOCK):
                total += x[:, j : j + STARTS]
                np.maximum(most, size[:, j : j + STARTS], out=most)
            self.sums[low : low + len(x)], self.most[low : low + len(x)] = total, most
        self.sums, self.most = self.sums.reshape(-1), self.most.reshape(-1)

    def moved(self, at, vol):
        """What the blocks (row * STARTS + start) move a price by, each step times vol and clipped."""
        import numpy as np

        out = np.take(self.sums, at)
        out *= vol
        far = np.flatnonzero(np.take(self.most, at) > (CLIP * (1 - 1e-6) / vol).astype(np.float32))  # a little more than has to be
        if len(far):
            place, own = at.reshape(-1)[far], vol[far // at.shape[1], 0]
            x = np.zeros(len(far))
            for step in self.within(place):
                x += np.clip(step * own, -CLIP, CLIP)
            out.reshape(-1)[far] = x
        return out

    def within(self, at):
        """The five steps of the blocks, one after the other."""
        import numpy as np

        row = at // STARTS
        first = (row if self.order is None else np.take(self.order, row)) * STEPS + at % STARTS
        for j in range(BLOCK):
            yield np.take(self.steps, first + j)


def _walk(pool: _Blocks, first, rows, seed, vol, group, paths: int, horizons: tuple[int, ...], touch: bool):
    """{h: returns of the paths of each group} and how many of them touched. A group draws from rows first:first + rows of the pool."""
    import numpy as np

    every = np.arange(GROUPS)[:, None] + GROUPS * np.arange(paths // GROUPS)
    own = np.take(np.arange(GROUPS), group[:, 0])
    of_seed = seed * 1103515 % PRIME * MULTIPLIER % PRIME
    total, out = np.zeros((len(group), paths // GROUPS)), {}
    seen = [np.full(total.shape, TOUCH + 1) for _ in (UP, DOWN)] if touch else []
    for block in range(max(horizons) // BLOCK):
        row, start = (_mixed(of_seed, np.take(_picked(0, every, block, PRIME, salt), own, axis=0)) for salt in (1, 2))
        at = row % rows
        at += first
        at *= STARTS
        at += start & (STARTS - 1)
        if touch:
            x = np.zeros(total.shape)
            for j, step in enumerate(pool.within(at)):
                x += np.clip(step * vol, -CLIP, CLIP)
                if block * BLOCK + j < TOUCH:
                    for when, there in zip(seen, (total + x >= UP, total + x <= DOWN)):
                        when[there & (when > block * BLOCK + j)] = block * BLOCK + j
        else:
            x = pool.moved(at, vol)
        total = total + x
        if (block + 1) * BLOCK in horizons:
            out[(block + 1) * BLOCK] = total
    return out, (seen[0] < seen[1]).sum(axis=1) if touch else None


def _deals(until, slices, grown: bool) -> list:
    """Places of the targets for which a pool is dealt at once: those of one time or, as later rows of a slice come last when grown, of one number of slices."""
    import numpy as np

    by = slices if grown else until
    order = np.argsort(by, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(by[order])) + 1)


def _whole(asked: DataFrame, own: DataFrame, paths: int, horizons: tuple[int, ...], touch: bool, grown: bool) -> DataFrame:
    """id, x{h} (the quantiles) and p_touch of targets that meet their whole pool in one task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    met = ["__u", "__salt"]
    order = ["known", "symbol", "d"] if grown else ["symbol", "d"]
    asked = asked.select("id", "seed", "vol20", "until", "__slices", "__u", F.pmod(F.xxhash64("id"), "__salts").cast("int").alias("__salt"))
    own = own.select("symbol", "d", "known", "steps", seed_of(F.col("symbol"), F.col("d")).alias("__hash"), "__u", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"))
    schema = T.StructType([asked.schema["id"], *[T.StructField(f"x{h}", T.ArrayType(T.DoubleType())) for h in horizons]])
    if touch:
        schema = schema.add("p_touch", T.DoubleType())
    places = [_place(paths, q) for q in QUANTILES]

    def drawn(left: pa.Table, right: pa.Table) -> pa.Table:
        steps = right["steps"].combine_chunks().flatten().to_numpy().reshape(-1, STEPS)
        sorted_ = pc.sort_indices(right.select(order), sort_keys=[(c, "ascending") for c in order]).to_numpy()
        known, hashes = (right[c].to_numpy()[sorted_] for c in ("known", "__hash"))
        pool = None
        seed, vol, until, slices = (left[c].to_numpy() for c in ("seed", "vol20", "until", "__slices"))
        found = {h: np.empty((len(left), len(places))) for h in horizons}
        touched = np.zeros(len(left))
        far = int(max(known.max(initial=0), until.max(initial=0))) + 1
        for asked_now in _deals(until, slices, grown):
            n_slices = slices[asked_now[0]]  # one deal of the pool at a time
            there = np.flatnonzero(known <= until[asked_now].max())
            slice_ = hashes[there] % n_slices
            by_slice = np.argsort(slice_, kind="stable")
            del pool  # before the next one is there
            pool = _Blocks(steps, sorted_[there[by_slice]])
            edges = np.searchsorted(slice_[by_slice], np.arange(n_slices + 1))
            place = slice_[by_slice] * far + known[there[by_slice]] if grown else None  # ascending
            for low in range(0, len(asked_now), BATCH):
                some = asked_now[low : low + BATCH]
                target, group = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(GROUPS), indexing="ij"))
                chosen = _picked(seed[some][target], group, 0, n_slices, 3)
                sizes = (np.searchsorted(place, chosen * far + until[some][target], side="right") if grown else edges[chosen + 1]) - edges[chosen]
                at = np.argsort(chosen, kind="stable")  # groups of near slices are drawn together
                ends = {h: np.empty((len(some), GROUPS, paths // GROUPS)) for h in horizons}
                for k in range(0, len(at), CHUNK):
                    t, g, c, m = (x[at[k : k + CHUNK]] for x in (target, group, chosen, sizes))
                    out, hit = _walk(pool, edges[c][:, None], m[:, None], seed[some][t][:, None], vol[some][t][:, None], g[:, None], paths, horizons, touch)
                    for h in horizons:
                        ends[h][t, g] = out[h]
                    if touch:
                        np.add.at(touched, some[t], hit)
                for h in horizons:
                    x = np.sort(ends[h].reshape(len(some), paths), axis=1)
                    for i, (a, b, part) in enumerate(places):
                        found[h][some, i] = x[:, a] * (1 - part) + x[:, b] * part
        bounds = pa.array(np.arange(len(left) + 1, dtype=np.int32) * len(places))
        share = {"p_touch": pa.array(touched / paths)} if touch else {}
        return pa.table({"id": left["id"], **{f"x{h}": pa.ListArray.from_arrays(bounds, pa.array(found[h].ravel())) for h in horizons}, **share})

    return asked.groupBy(*met).cogroup(own.groupBy(*met)).applyInArrow(drawn, schema)


def _sliced(targets: DataFrame, members: DataFrame, keys: list[str], paths: int, horizons: tuple[int, ...], touch: bool, grown: bool) -> DataFrame:
    """_whole() of pools that are too large for one task: slices meet the groups that draw from them, once for each thousand targets."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    order = ["known", "symbol", "d"] if grown else ["symbol", "d"]
    keys = keys if grown else [*keys, "until"]
    load = targets.groupBy(*keys, "__slices").agg(F.count(F.lit(1)).alias("__t"))
    load = F.broadcast(load.select(*[F.col(k).alias(k) for k in (*keys, "__slices")], F.ceil(GROUPS * F.col("__t") / (F.col("__slices") * TARGETS)).alias("__salts")))  # values of six axes, by time
    own = members.join(load, [k for k in keys if k != "until"])
    own = own if grown else own.where(F.col("known") <= F.col("until"))
    own = own.withColumn("__slice", seed_of(F.col("symbol"), F.col("d")) % F.col("__slices"))
    own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1)))
    asked = targets.join(load, [*keys, "__slices"]).withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    asked = asked.withColumn("__slice", draw(F.col("seed"), F.col("__g"), F.lit(0), F.col("__slices"), 3)).withColumn("__salt", F.pmod(F.xxhash64("id"), "__salts"))
    met = [*keys, "__slices", "__slice", "__salt"]
    extra = ["until"] if grown else []

    def drawn(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.select(order), sort_keys=[(c, "ascending") for c in order]))
        steps = right["steps"].combine_chunks().flatten().to_numpy().reshape(-1, STEPS)
        seed, vol, group = (left[c].to_numpy()[:, None] for c in ("seed", "vol20", "__g"))
        rows = np.searchsorted(right["known"].to_numpy(), left["until"].to_numpy(), side="right")[:, None] if grown else len(steps)
        out, hit = _walk(_Blocks(steps), 0, rows, seed, vol, group, paths, horizons, touch)
        ends = pa.array(np.arange(len(left) + 1, dtype=np.int32) * (paths // GROUPS))
        gained = {"touched": pa.array(hit)} if touch else {}
        return pa.table({"id": left["id"], **{f"x{h}": pa.ListArray.from_arrays(ends, pa.array(out[h].ravel())) for h in horizons}, **gained})

    schema = T.StructType([targets.schema["id"], *[T.StructField(f"x{h}", T.ArrayType(T.DoubleType())) for h in horizons]])
    if touch:
        schema = schema.add("touched", T.LongType())
    some = asked.select(*met, "id", "seed", "vol20", "__g", *extra).groupBy(*met).cogroup(own.select(*met, "symbol", "d", "known", "steps").groupBy(*met))
    some = some.applyInArrow(drawn, schema)
    share = [(F.sum("touched") / paths).alias("p_touch")] if touch else []
    every = some.groupBy("id").agg(*[F.sort_array(F.flatten(F.collect_list(f"x{h}"))).alias(f"x{h}") for h in horizons], *share)
    at = lambda h, a, b, part: F.get(f"x{h}", F.lit(a)) * (1 - part) + F.get(f"x{h}", F.lit(b)) * part
    return every.select("id", *[F.array(*[at(h, *_place(paths, q)) for q in QUANTILES]).alias(f"x{h}") for h in horizons], *(["p_touch"] if touch else []))


def daily_counts(cone: DataFrame, real: DataFrame | None, calendar: DataFrame) -> DataFrame:
    """session, d, h, level, cell, n: of each day's cones, how many (n) catch their return from which scale (cell) on.

    Whether a cone catches its return depends on the scale by one number, the least scale that does, so a
    day is a short table of counts by that number in steps of 0.0001, to which scales are rounded: none is needed
    beyond the least and the greatest scale, so there are 25,002 of them at most. A cone goes to its day as three numbers.
    calendar: d, session. For real see beside().
    """
    import numpy as np
    import pyarrow as pa

    least, most = round(SCALE_LOW * 10000), round(SCALE_HIGH * 10000) + 1
    gap = F.col("ret") - F.col("q50")
    needed = {v: F.when(gap >= 0, gap / F.nullif(F.col(f"q{b}") - F.col("q50"), F.lit(0.0))).otherwise(gap / F.nullif(F.col(f"q{a}") - F.col("q50"), F.lit(0.0))) for v, (a, b) in LEVELS.items()}
    cells = {v: F.ceil(F.least(F.coalesce(r, F.lit(9.0)), F.lit(9.0)) * 10000) for v, r in needed.items()}
    rows = beside(cone, real).select("d", "h", *[F.least(F.greatest(x, F.lit(least)), F.lit(most)).cast("int").alias(f"c{v}") for v, x in cells.items()])

    def counted(table: pa.Table) -> pa.Table:
        found = [np.unique(table[f"c{v}"].to_numpy(), return_counts=True) for v in LEVELS]
        lists = [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]
        return pa.table([*[pa.array([table[c][0].as_py()] * len(found), table.schema.field(c).type) for c in ("d", "h")], pa.array(list(LEVELS), pa.int32()), *lists], ["d", "h", "level", "cell", "n"])

    days = rows.groupBy("d", "h").applyInArrow(counted, f"d {rows.schema['d'].dataType.simpleString()}, h int, level int, cell array<int>, n array<int>")
    return days.join(F.broadcast(calendar), "d").select("session", "d", "h", "level", "cell", "n")  # sessions


def daily_cells(cone: DataFrame, real: DataFrame | None, calendar: DataFrame) -> DataFrame:
    """session, d, h, level, cells: daily_counts() as one array of cell and n."""
    cells = F.arrays_zip("cell", "n").cast("array<struct<cell:bigint,n:bigint>>")
    return daily_counts(cone, real, calendar).select("session", "d", "h", "level", cells.alias("cells"))


class Scale:
    """The scale of one (h, level) from day to day: it learns what a day's cones caught h sessions later.

    due: (session, hit) of the days whose returns are not known yet, at most h; hits: the last WINDOW
    that are; session: the last day that was seen, at or before which nothing counts again.
    """

    def __init__(self, h: int, level: int, s: float = 1.0, session: int = -1, due: list | None = None, hits: list | None = None):
        self.h, self.level, self.s, self.session, self.due, self.hits = h, level, s, session, list(due or []), list(hits or [])

    def day(self, session: int, cells: list[tuple[int, int]]) -> tuple[float, float | None] | None:
        """(scale in force, share caught) of the day's cones; None for a day that was seen, no share for one without returns."""
        return self.seen(session, (lambda edge: sum(n for cell, n in cells if cell <= edge) / sum(n for _, n in cells)) if cells else None)

    def seen(self, session: int, share: Callable[[int], float] | None) -> tuple[float, float | None] | None:
        """day() of cones of which `share` tells how many need a cell up to an edge."""
        if session <= self.session:
            return None
        self.session = session
        while self.due and self.due[0][0] <= session:
            hit = self.due.pop(0)[1]
            self.s = float(round(min(SCALE_HIGH, max(SCALE_LOW, self.s * math.exp(GAMMA * (self.level / 100 - hit)))), 4))
            self.hits = [*self.hits, round(hit, 4)][-WINDOW:]
        if share is None:
            return self.s, None
        hit = share(round(self.s * 10000))
        self.due.append((session + self.h, hit))
        return self.s, hit


def sequential(cone: DataFrame, real: DataFrame | None, calendar: DataFrame, issued: DataFrame | None = None) -> DataFrame:
    """d, h, level, s, hit: the scale in force when each day's cones were issued, and the share that they then caught.

    issued: session, d, h, level of further days, whose returns may not be known yet: they have a scale and no share.

    A day's share is known h sessions after it and moves the scale only then, before that day's cones are
    issued. The fold over days of one (h, level) sees the short tables of daily_counts(), as arrays.
    """
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("session")
        scale = Scale(table["h"][0].as_py(), table["level"][0].as_py())
        s, hit = [], []
        for session, cell, n in zip(table["session"].to_pylist(), table["cell"], table["n"], strict=True):
            if not cell.is_valid:
                own = None
            else:
                cells, counts = cell.values.to_numpy(), n.values.to_numpy()
                own = lambda edge, cells=cells, counts=counts: int(counts[cells <= edge].sum()) / int(counts.sum())
            now = scale.seen(session, own)
            s.append(now[0])
            hit.append(now[1])
        return pa.table({"d": table["d"], "h": table["h"].cast(pa.int32()), "level": table["level"].cast(pa.int32()), "s": pa.array(s, pa.float64()), "hit": pa.array(hit, pa.float64())})

    days = daily_counts(cone, real, calendar)
    if issued is not None:
        days = days.join(issued, ["session", "d", "h", "level"], "full")
    return days.groupBy("h", "level").applyInArrow(fold, "d date, h int, level int, s double, hit double")


def least_widths(rows: DataFrame, grid: list[float]) -> DataFrame:
    """rows (ret, q5 .. q95) once for each level, with k: the place of the least width of the grid at which the level's quantiles catch ret, len(grid) where none does.

    What a width catches a greater one does too. The place comes from the width that is needed; as that is
    rounded, the places beside it are tried as well.
    """
    low, step = grid[0], grid[1] - grid[0]
    gap = F.col("ret") - F.col("q50")
    levels = []
    for v, (a, b) in LEVELS.items():
        down, up = F.col(f"q{a}") - F.col("q50"), F.col(f"q{b}") - F.col("q50")
        needed = F.coalesce(gap / F.nullif(F.when(gap >= 0, up).otherwise(down), F.lit(0.0)), F.when(gap == 0, F.lit(low)).otherwise(F.lit(grid[-1] + 9)))
        about = F.greatest(F.least(F.floor((needed - low) / step), F.lit(len(grid))), F.lit(0)).cast("int")
        levels.append(F.struct(F.lit(v).alias("level"), down.alias("down"), up.alias("up"), about.alias("about")))
    rows = rows.select("*", F.explode(F.array(*levels)).alias("__t")).select(*rows.columns, "__t.*")
    widths = F.array(*[F.lit(x) for x in grid])

    def caught(k: Column) -> Column:
        s = F.get(widths, k)
        return F.col("ret").between(F.col("q50") + s * F.col("down"), F.col("q50") + s * F.col("up"))

    near = [F.when((F.col("about") + j >= 0) & caught(F.col("about") + j), F.col("about") + j) for j in (-1, 0, 1, 2)]
    return rows.withColumn("k", F.coalesce(*near, F.lit(len(grid)))).drop("down", "up", "about")


def width_grid(low: float, high: float, step: float) -> list[float]:
    return [round(low + k * step, 2) for k in range(round((high - low) / step) + 1)]


def cover_by_width(rows: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """keys, level, s, cov: the share of returns that a level's quantiles catch at each width of the grid. A row is counted once, at its least width."""
    counts = least_widths(rows, grid).groupBy(*keys, "level", "k").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy(*keys, "level").agg(F.collect_list(F.struct("k", "n")).alias("c"), F.sum("n").alias("all"))
    each = own.select(*keys, "level", "c", "all", F.posexplode(F.array(*[F.lit(x) for x in grid])).alias("at", "s"))
    until = F.aggregate("c", F.lit(0).cast("long"), lambda t, x: t + F.when(x["k"] <= F.col("at"), x["n"]).otherwise(0))
    return each.select(*keys, "level", "s", (until / F.col("all")).alias("cov"))


def fit_scale(cone: DataFrame, real: DataFrame | None = None, low: float = 0.8, high: float = 3.0, step: float = 0.05) -> DataFrame:
    """h, level, scale: the least width of a grid that covers a level's share of returns, the greatest one where none does."""
    cover = cover_by_width(beside(cone, real), ["h"], width_grid(low, high, step))
    return cover.groupBy("h", "level").agg(F.coalesce(F.min(F.when(F.col("cov") >= F.col("level") / 100, F.col("s"))), F.lit(high)).alias("scale"))


def forecast_items(rows: DataFrame, p_min: float, n_min: int) -> DataFrame:
    """Items of symbols and sessions: price, change, pool, shares of rises, cone at 10 sessions, and both kinds of alert.

    rows: symbol, d, price, before, level, n, up5, up10, base10, q10, q25, q50, q90 (log returns) and events, the codes that give an alert (null: none); all
    from level on are null for a symbol without a regime, whose item is not ok.
    """
    at = lambda q: F.round(F.col("price") * F.exp(f"q{q}"), 4).alias(f"q{q}")
    by_share = (F.col("up10") >= p_min) & (F.col("n") >= n_min) & (F.col("q25") > 0)
    return rows.select(
        "symbol",
        "d",
        F.round("price", 4).alias("price"),
        F.round(100 * (F.col("price") / F.nullif(F.col("before"), F.lit(0.0)) - 1), 2).alias("change_pct"),
        F.col("n").isNotNull().alias("ok"),
        "level",
        "n",
        F.round("up5", 3).alias("p5"),
        F.round("up10", 3).alias("p10"),
        F.round("base10", 3).alias("base10"),
        at(10),
        at(25),
        at(50),
        at(90),
        F.coalesce(by_share, F.lit(False)).alias("alert_p10"),
        F.col("events").isNotNull().alias("alert_event"),
        F.coalesce("events", F.lit("")).alias("alert_events"),
    )
