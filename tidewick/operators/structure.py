"""Market structure: swings, breaks, gaps of fair value, order blocks; climaxes and ranges.

Everything but the levels in force is a window or a join bounded by the row number within a symbol.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_symbol, ahead, back, roll, true

FVG_MIN, FVG_LIFE = 0.5, 20
DISPLACEMENT, DISPLACED_WITHIN, LIFE = 1.5, 3, 60
FIRST_BLOCK = 20


def numbered(bars: DataFrame) -> DataFrame:
    """bars with t: the row number within the symbol, from 0."""
    return bars.withColumn("t", F.row_number().over(by_symbol()) - 1)


def with_swings(rows: DataFrame) -> DataFrame:
    """rows (numbered) with __high and __low: whether the bar is a swing of that kind (see swings)."""
    high = (F.col("h") > F.greatest(back("h", 1), back("h", 2))) & (F.col("h") >= F.greatest(ahead("h", 1), ahead("h", 2)))
    low = (F.col("l") < F.least(back("l", 1), back("l", 2))) & (F.col("l") <= F.least(ahead("l", 1), ahead("l", 2)))
    full = (F.col("t") >= 2) & ahead("h", 2).isNotNull()
    return rows.withColumns({"__high": true(full & high), "__low": true(full & low)})


def swings(bars: DataFrame) -> DataFrame:
    """symbol, d, t, p, up, label: highs above the two bars before and not below the two after (lows likewise), known two bars later.

    A high is HH or LH, a low LL or HL by the swing of its kind before; the first is HH or LL.
    """
    rows = with_swings(numbered(bars))
    rows = rows.select("symbol", "d", "t", F.explode(F.array_compact(F.array(
        F.when(F.col("__high"), F.struct(F.col("h").alias("p"), F.lit(True).alias("up"))),
        F.when(F.col("__low"), F.struct(F.col("l").alias("p"), F.lit(False).alias("up"))),
    ))).alias("s")).select("symbol", "d", "t", "s.p", "s.up")
    last = F.lag("p").over(Window.partitionBy("symbol", "up").orderBy("t"))
    label = F.when(F.col("up"), F.when(last.isNull() | (F.col("p") > last), "HH").otherwise("LH")).otherwise(F.when(last.isNull() | (F.col("p") < last), "LL").otherwise("HL"))
    return rows.withColumn("label", label)


def breaks(bars: DataFrame) -> DataFrame:
    """symbol, s, t, p, up, label: the first close beyond a swing that no newer swing of its kind replaced.

    A swing at s is in force from s + 2 until the next swing of its kind is. The break is the first bar
    within that span that closes beyond it. The first break of all, and every one along the last
    break's direction, is BOS; one against it is CHoCH. Of two at one bar the upward one comes first.
    """
    rows = numbered(bars)
    marks = swings(bars).select("symbol", F.col("t").alias("s"), (F.col("t") + 2).alias("t"), "p", "up")
    found = []
    for up in (True, False):
        own = marks.where(F.col("up") == up).select("symbol", "t", F.struct("s", "p").alias("__at"))
        met = rows.join(own, ["symbol", "t"], "left").withColumn("__at", F.last("__at", ignorenulls=True).over(by_symbol()))
        beyond = F.col("c") > F.col("__at.p") if up else F.col("c") < F.col("__at.p")
        found.append(met.where(beyond).groupBy("symbol", "__at.s", "__at.p").agg(F.min("t").alias("t")).withColumn("up", F.lit(up)))
    first = found[0].unionByName(found[1])
    last = F.lag("up").over(Window.partitionBy("symbol").orderBy("t", F.desc("up")))
    return first.withColumn("label", F.when(last.isNull() | (last == F.col("up")), "BOS").otherwise("CHoCH")).select("symbol", "s", "t", "p", "up", "label")


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """symbol, t (middle bar), end, lo, hi, up: three bars of which the outer two leave a gap of half an ATR, and when it is filled.

    bars needs atr. Unfilled gaps end 20 bars later, or at the last bar.
    """
    rows = numbered(bars)
    up = ahead("l", 2) - F.col("h") >= FVG_MIN * F.col("atr")
    down = F.col("l") - ahead("h", 2) >= FVG_MIN * F.col("atr")
    rows = rows.withColumns({"__up": up, "__down": down, "__l2": ahead("l", 2), "__h2": ahead("h", 2), "__last": F.max("t").over(Window.partitionBy("symbol"))})
    gaps = rows.where(F.col("__up") | F.col("__down")).select(
        "symbol", "t", "__last", F.col("__up").alias("up"),
        F.when(F.col("__up"), F.col("h")).otherwise(F.col("__h2")).alias("lo"), F.when(F.col("__up"), F.col("__l2")).otherwise(F.col("l")).alias("hi"),
    )
    later = gaps.withColumn("at", F.explode(F.when(F.col("t") + 3 <= F.col("__last"), F.sequence(F.col("t") + 3, F.least(F.col("t") + 2 + FVG_LIFE, F.col("__last")))).otherwise(F.array())))
    prices = numbered(bars).select("symbol", F.col("t").alias("at"), F.col("h").alias("bh"), F.col("l").alias("bl"))
    filled = later.join(prices, ["symbol", "at"]).where(F.when(F.col("up"), F.col("bl") <= F.col("lo")).otherwise(F.col("bh") >= F.col("hi")))
    first = filled.groupBy("symbol", "t").agg(F.min("at").alias("filled"))
    out = gaps.join(first, ["symbol", "t"], "left")
    return out.select("symbol", (F.col("t") + 1).alias("t"), F.coalesce("filled", F.least(F.col("t") + 2 + FVG_LIFE, F.col("__last"))).alias("end"), "lo", "hi", "up")


def levels_in_force(bars: DataFrame) -> DataFrame:
    """symbol, t, high, low: the swing prices that are in force and unbroken at the end of each bar."""
    return with_levels(numbered(bars)).select("symbol", "t", "high", "low")


def with_levels(rows: DataFrame) -> DataFrame:
    """rows (numbered) with high and low, as levels_in_force gives them, by windows over a symbol alone.

    The last swing that is two bars old is in force; it is broken if the last close beyond the level of its own
    bar came since. A symbol that is null has no levels.
    """
    rows = with_swings(rows)
    known = by_symbol().rowsBetween(Window.unboundedPreceding, -2)
    kinds = (("high", "h", 1), ("low", "l", -1))
    rows = rows.withColumns({f"__{n}_at": F.last(F.when(F.col(f"__{n}"), F.struct("t", F.col(p).alias("p"))), ignorenulls=True).over(known) for n, p, _ in kinds})
    rows = rows.withColumns({f"__{n}_beyond": F.max(F.when(s * (F.col("c") - F.col(f"__{n}_at.p")) > 0, F.col("t"))).over(by_symbol()) for n, _, s in kinds})
    alive = {n: F.col("symbol").isNotNull() & (F.col(f"__{n}_beyond").isNull() | (F.col(f"__{n}_beyond") < F.col(f"__{n}_at.t") + 2)) for n, _, _ in kinds}
    rows = rows.withColumns({n: F.when(alive[n], F.col(f"__{n}_at.p")) for n in alive})
    return rows.drop(*[f"__{n}{x}" for n in alive for x in ("", "_at", "_beyond")])


def order_blocks(bars: DataFrame, broken: bool = False) -> DataFrame:
    """symbol, k, m, lo, hi, bull, touch: the last opposite bar before a move that breaks the structure.

    bars needs atr. Bar k is opposite to the move and the next one along it; within three bars the close
    moves 1.5 ATR away (at m, when the block is known) and, up to there, beyond the level in force at k.
    touch: the first return to the block within 60 bars of m after prices had left it. broken: adds what breakers()
    finds. All is windows over a symbol and arrays of its next bars, so bars are dealt once.
    """
    rows, found = with_levels(numbered(bars.where("symbol IS NOT NULL"))), {}
    for bull in (True, False):
        s = 1 if bull else -1
        level = F.col("high" if bull else "low")
        own = (s * (F.col("c") - F.col("o")) < 0) & (s * (ahead("c", 1) - ahead("o", 1)) > 0) & (F.col("t") >= FIRST_BLOCK)
        m = F.lit(None).cast("int")
        for j in range(DISPLACED_WITHIN, 0, -1):
            broke = F.lit(False)
            for i in range(1, j + 1):
                broke = broke | true(s * (ahead("c", i) - level) > 0)
            far = true(s * (ahead("c", j) - F.col("c")) >= DISPLACEMENT * F.col("atr"))
            m = F.when(far & broke, F.col("t") + j).otherwise(m)
        found[str(bull)] = F.when(true(own), m)
    bar = F.struct("t", "h", "l", "c", *[F.col(x) for x in found])
    held = rows.withColumns(found).groupBy("symbol", F.expr(f"t div {STRETCH}").alias("stretch")).agg(F.sort_array(F.collect_list(bar)).alias("own"))
    order = Window.partitionBy("symbol").orderBy("stretch")
    bare = lambda x: F.transform(x, lambda b: F.struct(b["t"].alias("t"), b["h"].alias("h"), b["l"].alias("l"), b["c"].alias("c")))
    near = F.concat(F.col("own"), *[F.coalesce(F.lead("own", i).over(order), F.slice("own", 1, 0)) for i in ((1, 2) if broken else (1,))])  # LIFE, and twice as much, is less than that
    held = held.withColumn("near", near).select("symbol", bare("near").alias("near"), F.explode(F.filter("own", lambda b: b["True"].isNotNull() | b["False"].isNotNull())).alias("b"))
    kinds = [F.when(F.col(f"b.{x}").isNotNull(), F.struct(F.col(f"b.{x}").alias("m"), F.lit(x == "True").alias("bull"))) for x in found]
    blocks = held.select("symbol", "near", F.col("b.t").alias("k"), F.col("b.l").alias("lo"), F.col("b.h").alias("hi"), F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("*", "x.*")

    def first(start: Column, since: Column, meets: Callable[[Column], Column]) -> Column:
        return F.get(F.filter("near", lambda b: (b["t"] > start) & (b["t"] <= since + LIFE) & meets(b)), F.lit(0))["t"]

    def then(found: Column, more: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(found), more), F.lit(0))  # found is looked for once, not for each bar of the next search

    away = lambda b: F.when(F.col("bull"), b["l"] > F.col("hi")).otherwise(b["h"] < F.col("lo"))
    m, low = F.col("m"), F.col("lo")
    columns = ["symbol", "k", "m", "lo", "hi", "bull", then(first(m, m, away), lambda left: first(left, m, lambda b: ~away(b))).alias("touch")]
    if not broken:
        return blocks.select(*columns)
    closed = F.when(F.col("bull"), first(m, m, lambda b: b["c"] < low))
    back_at = lambda at: then(first(at, at, lambda b: b["h"] < low), lambda left: first(left, at, lambda b: b["h"] >= low))
    return blocks.select(*columns, then(closed, lambda at: F.struct(at.alias("brk_close"), back_at(at).alias("brk"))).alias("broke")).select("*", "broke.*").drop("broke")


#: Bars of one stretch, as searches for a first bar read them.
STRETCH = 64


def stretches(bars: DataFrame) -> DataFrame:
    """symbol, stretch, own: the bars (t, h, l, c) of each stretch of 64, in order. One row a stretch: what a search joins."""
    own = F.sort_array(F.collect_list(F.struct("t", "h", "l", "c")))
    return numbered(bars).groupBy("symbol", F.expr(f"t div {STRETCH}").alias("stretch")).agg(own.alias("own"))


def first_bar(points: DataFrame, held: DataFrame, start: Column, end: Column, meets: Callable[[Column], Column], name: str) -> DataFrame:
    """points with `name`: the first bar t of their symbol with start < t <= end that meets the condition, null where none does.

    Each point meets the few stretches that its span touches, not every bar in it; the earliest hit of
    them is kept. Points are told apart by all their columns.
    """
    spans = points.withColumns({"__s": start, "__e": end})
    touched = F.when(F.col("__s") < F.col("__e"), F.sequence(F.expr(f"(__s + 1) div {STRETCH}"), F.expr(f"__e div {STRETCH}")))
    near = spans.withColumn("stretch", F.explode_outer(touched)).join(held, ["symbol", "stretch"], "left")
    hit = F.get(F.filter("own", lambda b: (b["t"] > F.col("__s")) & (b["t"] <= F.col("__e")) & meets(b)), F.lit(0))["t"]
    return near.groupBy(*points.columns).agg(F.min(hit).alias(name))


def breakers(blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """blocks (symbol, k, m, lo, hi, bull, touch) with brk_close and brk, both null for downward blocks.

    brk_close: the first of 60 bars after m that closes below an upward block. brk: the first bar after
    that, within 60, which is back at the block's low once a bar has been wholly below it. The second
    search begins where the first one ended.
    """
    held = stretches(bars)
    up = blocks.where("bull")
    low = F.col("lo")
    up = first_bar(up, held, F.col("m"), F.col("m") + LIFE, lambda b: b["c"] < low, "brk_close")
    up = first_bar(up, held, F.col("brk_close"), F.col("brk_close") + LIFE, lambda b: b["h"] < low, "__away")
    up = first_bar(up, held, F.col("__away"), F.col("brk_close") + LIFE, lambda b: b["h"] >= low, "brk").drop("__away")
    none = F.lit(None).cast("int")
    return up.unionByName(blocks.where("NOT bull").withColumns({"brk_close": none, "brk": none}))


#: A day's change from which it counts as a limit day.
LIMIT = 0.065


def climax(selling: bool, roll=roll) -> Column:
    """Twice the mean volume after a move of 10 % in 15 bars, on a wide bar (1.5 ATR) or a limit day, of the move's colour or nearly without body. Needs atr."""
    s = 1 if selling else -1
    body, spread, volume = F.col("c") - F.col("o"), F.col("h") - F.col("l"), roll(F.avg, "v", 20, 1)
    slim = F.abs(body) <= 0.2 * F.greatest(spread, F.lit(1e-9))
    loud = (F.col("v") >= 2.0 * volume) & (volume > 0) & F.col("atr").isNotNull()
    limit = F.col("c") <= back("c") * (1 - LIMIT) if selling else F.col("c") >= back("c") * (1 + LIMIT)
    return loud & (s * (F.col("c") / back("c", 15) - 1) <= -0.10) & ((s * body <= 0) | slim) & (limit | (spread >= 1.5 * F.col("atr")))


def climaxes(bars: DataFrame) -> DataFrame:
    """symbol, d, kind: selling (sc) and buying (bc) climaxes. bars needs atr."""
    rows = bars.withColumns({"__sc": true(climax(True)), "__bc": true(climax(False))})
    rows = rows.withColumn("kind", F.explode(F.array_compact(F.array(F.when(F.col("__sc"), "sc"), F.when(F.col("__bc"), "bc")))))
    return rows.select("symbol", "d", "kind")


def with_range(rows: DataFrame, win: int = 20, prior: int = 40) -> DataFrame:
    """rows (numbered) with lo, hi and slope of the last 20 bars, and ranging: whether they are a sideways range after a fall.

    It is 6 to 35 % high, both edges are touched twice, and there is hardly any slope.
    """
    recent = by_symbol().rowsBetween(1 - win, 0)
    rows = rows.withColumns({"hi": roll(F.max, "h", win), "lo": roll(F.min, "l", win), "__before": roll(F.max, "c", prior, win), "__h": F.collect_list("h").over(recent), "__l": F.collect_list("l").over(recent)})
    band = 0.15 * (F.col("hi") - F.col("lo"))
    rows = rows.withColumn("slope", F.regr_slope("c", "t").over(recent) / roll(F.avg, "c", win))
    ranging = (
        (F.col("hi") / F.col("lo") - 1).between(0.06, 0.35)
        & (F.col("__before") >= 1.10 * F.col("hi"))
        & (F.size(F.filter("__h", lambda x: x >= F.col("hi") - band)) >= 2)
        & (F.size(F.filter("__l", lambda x: x <= F.col("lo") + band)) >= 2)
        & (F.abs("slope") <= 0.004)
    )
    return rows.withColumn("ranging", true(ranging)).drop("__before", "__h", "__l")


def ranges(bars: DataFrame) -> DataFrame:
    """symbol, d, lo, hi, slope of the bars at which a sideways range (see with_range) is complete."""
    return with_range(numbered(bars)).where("ranging").select("symbol", "d", "lo", "hi", "slope")


def reversals(bars: DataFrame, least: int = 2, look: int = 10, life: int = 20) -> DataFrame:
    """symbol, s, t, p, up: runs of two or more bars of one colour that reach a 10-bar extreme, undone by a later close.

    The run from s ends at e, known a bar later; it is undone by the first close, at most 20 bars after
    e, beyond its first open p. A newer such run replaces an older one.
    """
    out = []
    for up in (True, False):
        rows = numbered(bars).withColumn("same", F.col("c") < F.col("o") if up else F.col("c") > F.col("o"))
        rows = rows.withColumn("run", F.sum(F.when(F.col("same").eqNullSafe(F.lag("same").over(by_symbol())), 0).otherwise(1)).over(by_symbol()))
        extreme = F.min("l").over(by_symbol().rowsBetween(1 - look, 0)) if up else F.max("h").over(by_symbol().rowsBetween(1 - look, 0))
        rows = rows.withColumn("ext", extreme)
        runs = rows.where("same").groupBy("symbol", "run").agg(
            F.min("t").alias("s"), F.max("t").alias("e"), F.min_by("o", "t").alias("p"), (F.min("l") if up else F.max("h")).alias("own"), F.max_by("ext", "t").alias("ext")
        )
        reach = F.col("own") <= F.col("ext") if up else F.col("own") >= F.col("ext")
        runs = runs.where((F.col("e") - F.col("s") + 1 >= least) & reach)
        ends = numbered(bars).groupBy("symbol").agg(F.max("t").alias("last"))
        runs = runs.join(ends, "symbol").where(F.col("e") < F.col("last"))
        runs = runs.withColumn("until", F.least(F.col("e") + life, F.coalesce(F.lead("e").over(Window.partitionBy("symbol").orderBy("s")), F.col("last")), F.col("last")))
        later = runs.withColumn("at", F.explode(F.sequence(F.col("e") + 1, F.greatest("until", F.col("e") + 1)))).where(F.col("at") <= F.col("until"))
        met = later.join(numbered(bars).select("symbol", F.col("t").alias("at"), "c"), ["symbol", "at"]).where(F.col("c") > F.col("p") if up else F.col("c") < F.col("p"))
        out.append(met.groupBy("symbol", "s", "p").agg(F.min("at").alias("t")).select("symbol", "s", "t", "p", F.lit(up).alias("up")))
    return out[0].unionByName(out[1])


def calculated(bars: DataFrame, n: int = 400, least: int = 60) -> DataFrame:
    """The last n bars of symbols that have at least `least`."""
    late = Window.partitionBy("symbol").orderBy(F.desc("d"))
    rows = bars.withColumns({"__late": F.row_number().over(late), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return rows.where((F.col("__late") <= n) & (F.col("__n") >= least)).drop("__late", "__n")


def _start(rows: DataFrame, span: int) -> DataFrame:
    return rows.groupBy("symbol").agg(F.greatest(F.max("t") + 1 - span, F.lit(0)).alias("s0"))


def chart(bars: DataFrame, span: int = 120) -> DataFrame:
    """symbol, i, d, o, h, l, c, high, low: the last bars, numbered from 0, with the swings of the calculated ones."""
    own = calculated(bars)
    rows = numbered(own)
    marks = swings(own).groupBy("symbol", "t").agg(F.max(F.when(F.col("up"), F.col("p"))).alias("high"), F.max(F.when(~F.col("up"), F.col("p"))).alias("low"))
    rows = rows.join(_start(rows, span), "symbol").where("t >= s0").join(marks, ["symbol", "t"], "left")
    return rows.withColumn("i", (F.col("t") - F.col("s0")).cast("int"))


def chart_breaks(bars: DataFrame, span: int = 120) -> DataFrame:
    """Breaks of the calculated bars whose swing is on the chart, by the chart's numbers."""
    own = calculated(bars)
    rows = breaks(own).join(_start(numbered(own), span), "symbol").where("s >= s0")
    return rows.withColumns({x: (F.col(x) - F.col("s0")).cast("int") for x in ("s", "t")})


def relative_strength(bars: DataFrame, index: DataFrame, n: int = 20) -> DataFrame:
    """symbol, d, rs{n}: the change over n bars against the index's between the same two dates; only where it has both."""
    rows = bars.select("symbol", "d", "c", back("c", n).alias("c0"), back("d", n).alias("d0"))
    now, then = index.select("d", F.col("c").alias("i")), index.select(F.col("d").alias("d0"), F.col("c").alias("i0"))
    rows = rows.join(F.broadcast(now), "d").join(F.broadcast(then), "d0")  # sessions of one symbol
    return rows.select("symbol", "d", (F.col("c") / F.col("c0") / (F.col("i") / F.col("i0")) - 1).alias(f"rs{n}"))
