"""Phases of accumulation and distribution: what windows can tell of a bar, and an automaton over a symbol's bars.

All that looks back a fixed number of bars is a column. What is left remembers: a climax that waits for its
rally, the range that follows, breaks of its edges and what came after them. The automaton keeps
running numbers of those, never bars, so its state is a short row that any later run goes on from.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import back, by_symbol, true
from . import structure, trend

#: Of the state's layout; a row of another one is an error.
VERSION = 1

# Limits of the rules, and the direction and priority (the smallest first) of each event.
MIN_BARS = 40
TOLERANCE, EXIT_BARS, MIN_AGE, MAX_AGE, TOUCH = 0.03, 2, 20, 120, 0.15
RALLY_BARS, RALLY = 8, 0.05
ST_VOLUME, ST_NEAR, ST_QUIET, ST_APART, ST_MOST = 0.7, 0.03, 0.8, 5, 3
SPRING_BREAKS = (0.01, 0.03, 0.06)
SPRING_VOLUME, SPRING_CLOSE, SPRING_BACK = 0.7, 0.5, 3
TEST_BARS, TEST_VOLUME, TEST_SPREAD, TEST_CLOSE = (2, 10), 0.5, 0.6, 0.5
STRONG_BODY, STRONG_VOLUME, STRONG_CLOSE = 1.5, 1.5, 0.7
BACKUP_BARS, BACKUP_DEPTH, BACKUP_VOLUME, BACKUP_BAND = (2, 20), 0.35, 0.8, 0.02
TREND_BARS = 60
UT_VOLUME, UT_CLOSE, UTAD_BREAK, UT_APART = 1.5, 0.3, 0.05, 3
ABSORB_VOLUME, ABSORB_RATIO, QUIET_SPREAD = 2.0, 0.5, 0.7
STOP_RANGES = 0.5
EVENTS = {
    "sc": ("buy", 6), "ar": ("watch", 90), "st": ("watch", 80), "spring3": ("buy", 1), "spring2": ("exit", 14), "spring1": ("watch", 51),
    "test": ("buy", 2), "sos": ("buy", 4), "lps": ("buy", 3), "bu": ("buy", 5), "ut": ("watch", 60), "bc": ("exit", 12), "utad": ("exit", 11),
    "sow": ("exit", 10), "lpsy": ("exit", 13), "er_absorb": ("label", 95), "no_demand": ("label", 96),
}


def signs(bars: DataFrame) -> DataFrame:
    """bars numbered by t, with what windows tell of each: atr, av, sc, bc, rlo, rhi, floor, ceil, absorb, tired, drying."""
    rows = structure.with_range(structure.numbered(trend.atr(bars, 14).withColumnRenamed("value", "atr")))
    av = F.avg("v").over(by_symbol().rowsBetween(-20, -1))
    rows = rows.withColumns({"av": av, "__sc": structure.climax(True), "__bc": structure.climax(False), "ok": true((F.col("atr") > 0) & (av > 0) & (F.col("h") > F.col("l")) & (F.col("t") >= MIN_BARS))})
    ratio, body = F.col("v") / F.col("av"), F.abs(F.col("c") - F.col("o"))
    absorb = (ratio >= ABSORB_VOLUME) & (body / F.col("atr") / ratio < ABSORB_RATIO)
    tired = (F.col("c") > F.col("o")) & (F.col("v") < back("v", 1)) & (F.col("v") < back("v", 2)) & (F.col("h") - F.col("l") < QUIET_SPREAD * F.col("atr")) & (back("c", 1) > back("c", 4))
    return rows.select(
        "symbol", "d", "t", "o", "h", "l", "c", "v", "atr", "av", "ok",
        true(F.col("__sc")).alias("sc"), true(F.col("__bc")).alias("bc"),
        F.when(F.col("ranging"), F.col("lo")).alias("rlo"), F.when(F.col("ranging"), F.col("hi")).alias("rhi"),
        true(F.col("c") <= back("c") * (1 - structure.LIMIT)).alias("floor"), true(F.col("c") >= back("c") * (1 + structure.LIMIT)).alias("ceil"),
        (F.col("ok") & true(absorb)).alias("absorb"), (F.col("ok") & true(tired)).alias("tired"),
        true((F.col("v") < back("v", 1)) & (back("v", 1) < back("v", 2))).alias("drying"),
    )


@dataclass
class Run:
    """Numbers of the bars since some bar: how many, their extremes and summed volume."""

    n: int = 0
    low: float = 0.0
    high: float = 0.0
    most: float = 0.0
    widest: float = 0.0
    volume: float = 0.0

    def add(self, b) -> None:
        self.low = min(self.low, b.l) if self.n else b.l
        self.high = max(self.high, b.h) if self.n else b.h
        self.most, self.widest = max(self.most, b.v), max(self.widest, b.h - b.l)
        self.volume += b.v
        self.n += 1


@dataclass
class Zone:
    """A trading range, or the climax that may become one."""

    up: bool  # of accumulation
    start: int
    lo: float
    hi: float
    phase: str = "A"
    climax_volume: float = 0.0
    climax_spread: float = 0.0
    rally: float | None = None  # the extreme since the climax, where and when
    rally_at: int | None = None
    rally_day: str | None = None
    tests: list[int] = field(default_factory=list)
    spring_at: int | None = None
    spring_low: float = 0.0
    spring_kind: str = ""
    spring: Run = field(default_factory=Run)
    tested: bool = False
    broke_at: int | None = None
    broke: Run = field(default_factory=Run)
    strong_at: int | None = None
    strong_volume: float = 0.0
    peak: float = 0.0
    since: Run = field(default_factory=Run)  # after the peak (accumulation) or the sign of weakness
    backed_up: bool = False  # by a last point of support
    bu_at: int | None = None
    last_thrust: int | None = None
    failed: bool = False
    touched_hi: int = 0
    touched_lo: int = 0
    outside: int = 0


@dataclass
class Trend:
    """What a range left behind: the edges to watch, and since when."""

    down: bool
    start: int
    lo: float
    hi: float
    held: float


@dataclass
class State:
    t: int = -1
    day: str | None = None
    waiting: Zone | None = None
    zone: Zone | None = None
    trend: Trend | None = None
    last: str | None = None
    last_day: str | None = None

    @property
    def phase(self) -> str:
        if self.zone is not None:
            return self.zone.phase if self.zone.up else "PP"
        return "-" if self.trend is None else ("E-" if self.trend.down else "E")

    def dump(self) -> str:
        return json.dumps({"version": VERSION, **asdict(self)})

    @staticmethod
    def load(text: str) -> State:
        raw = json.loads(text)
        if raw.pop("version", None) != VERSION:
            raise ValueError("a state of another version")

        def zone(x: dict | None) -> Zone | None:
            return x and Zone(**{k: Run(**v) if isinstance(v, dict) else v for k, v in x.items()})

        return State(**{**raw, "waiting": zone(raw["waiting"]), "zone": zone(raw["zone"]), "trend": raw["trend"] and Trend(**raw["trend"])})


class Automaton:
    """Steps of one symbol. `found` gets (t, at, day, id, vol_ratio, lo, hi, stop, target, target_ext)."""

    def __init__(self, state: State):
        self.state, self.found = state, []

    def step(self, b) -> None:
        s = self.state
        s.t = b.t
        s.day = str(b.d)
        if s.waiting is not None:
            _rallied(s.waiting, b)
        if s.zone is not None and s.zone.broke_at is not None:
            s.zone.broke.add(b)
        if b.ok:
            if b.absorb:
                self._emit(b, "er_absorb")
            if b.tired:
                self._emit(b, "no_demand")
            if s.waiting is not None:
                self._await(b, s.waiting)
            elif s.zone is None:
                self._outside(b)
            else:
                self._inside(b, s.zone)
        if s.zone is not None and s.zone.strong_at is not None and s.zone.strong_at < b.t:
            _after_strength(s.zone, b)

    def _emit(self, b, name: str, zone: Zone | None = None, stop: float | None = None, aim: bool = False, at: tuple | None = None, ratio: float | None = None) -> None:
        t, day = at or (b.t, b.d)
        height = zone.hi - zone.lo if aim else 0.0
        target, far = (round(zone.hi + height, 4), round(zone.hi + height * max(1.0, (b.t - zone.start) / 20), 4)) if aim else (None, None)
        edges = (zone.lo, zone.hi) if zone is not None else (None, None)
        self.found.append((t, b.t, day, name, b.v / b.av if ratio is None else ratio, *edges, None if stop is None else round(stop - STOP_RANGES * b.atr, 4), target, far))
        if EVENTS[name][0] != "label":
            self.state.last, self.state.last_day = name, str(day)

    # -- a climax and its rally --------------------------------------------------------------------

    def _await(self, b, zone: Zone) -> None:
        s = self.state
        if b.c < zone.lo * (1 - TOLERANCE) if zone.up else b.c > zone.hi * (1 + TOLERANCE):
            s.waiting = None
        elif b.t - zone.start >= RALLY_BARS:
            s.waiting = None
            if zone.rally >= zone.lo * (1 + RALLY) if zone.up else zone.rally <= zone.hi * (1 - RALLY):
                zone.lo, zone.hi = (zone.lo, zone.rally) if zone.up else (zone.rally, zone.hi)
                s.zone, s.trend = zone, None
                self._emit(b, "ar", zone, at=(zone.rally_at, zone.rally_day))

    # -- no range ----------------------------------------------------------------------------------

    def _outside(self, b) -> None:
        s, m = self.state, self.state.trend
        if m is not None and (b.t - m.start > TREND_BARS or (b.c > m.hi if m.down else b.c < m.lo)):
            s.trend = None
        if b.sc:
            s.trend = None
            s.waiting = Zone(True, b.t, b.l, b.h, climax_volume=b.v, climax_spread=b.h - b.l)
            self._emit(b, "sc", stop=b.l)
            return
        m = s.trend
        if m is not None and not m.down and b.c < m.held and _strong(b, False, any_colour=True):
            self._emit(b, "sow")
            s.trend = None
        if b.bc:
            s.waiting = Zone(False, b.t, b.l, b.h, climax_volume=b.v, climax_spread=b.h - b.l)
            self._emit(b, "bc")
        elif b.rlo is not None:
            s.zone, s.trend = Zone(True, b.t, b.rlo, b.rhi, phase="B"), None

    # -- in a range --------------------------------------------------------------------------------

    def _inside(self, b, z: Zone) -> None:
        age = b.t - z.start
        old = age >= MIN_AGE
        rise = old and b.c > z.hi and _strong(b, True)
        fall = old and b.c < z.lo and _strong(b, False)
        if z.up:
            if rise and z.strong_at is None:
                z.strong_at, z.strong_volume, z.phase, z.peak, z.since = b.t, b.v, "D", b.h, Run()
                self._emit(b, "sos", z, stop=z.hi, aim=True)
            elif b.c < z.lo and b.sc:
                self._close(b, z, "down")
                self._outside(b)
                return
            elif fall and not z.failed:
                z.failed = True
                self._emit(b, "sow", z)
        elif fall:
            z.strong_at, z.strong_volume, z.phase, z.since = b.t, b.v, "D", Run()
            self._emit(b, "sow", z)
        above, below = b.c > z.hi * (1 + TOLERANCE), b.c < z.lo * (1 - TOLERANCE)
        onward = z.strong_at is not None and (above if z.up else below)
        z.outside = z.outside + 1 if (above or below) and not onward else 0
        done = z.strong_at is not None and b.t - z.strong_at >= BACKUP_BARS[1]
        if done or age > MAX_AGE or z.outside >= EXIT_BARS:
            way = ("up" if z.up else "down") if done else "age" if age > MAX_AGE else "up" if above else "down"
            self._close(b, z, way)
            if not done:
                self._outside(b)
            return
        edge = TOUCH * (z.hi - z.lo)
        z.touched_hi += b.h >= z.hi - edge
        z.touched_lo += b.l <= z.lo + edge
        self._secondary(b, z)
        if z.strong_at is not None:
            self._backup(b, z) if z.up else self._last_supply(b, z)
        elif z.up:
            self._spring(b, z)
        else:
            self._thrust_up(b, z)

    def _close(self, b, z: Zone, way: str) -> None:
        s = self.state
        s.zone = s.trend = None
        if z.up and way == "up":
            s.trend = Trend(False, b.t, z.lo, z.hi, z.since.low if z.backed_up else z.lo)
        elif not z.up and way == "down":
            s.trend = Trend(True, b.t, z.lo, z.hi, z.hi)

    def _secondary(self, b, z: Zone) -> None:
        """A secondary test: back at the climax with less of everything."""
        near = b.l <= z.lo * (1 + ST_NEAR) and b.c >= z.lo if z.up else b.h >= z.hi * (1 - ST_NEAR) and b.c <= z.hi
        if near and z.phase in ("A", "B") and len(z.tests) < ST_MOST and (z.rally_at is None or b.t > z.rally_at):
            quiet = b.v < ST_VOLUME * z.climax_volume and b.h - b.l < z.climax_spread if z.climax_volume else b.v / b.av <= ST_QUIET
            if quiet and (not z.tests or b.t - z.tests[-1] >= ST_APART):
                z.tests.append(b.t)
                z.phase = "B"
                self._emit(b, "st", z)
        if z.up and z.phase == "A" and min(z.touched_hi, z.touched_lo) >= 2:
            z.phase = "B"

    def _spring(self, b, z: Zone) -> None:
        old = b.t - z.start >= MIN_AGE
        inside = b.c > z.lo
        if not inside and z.broke_at is None:
            z.broke_at, z.broke = b.t, Run()
            z.broke.add(b)
        back_ = inside and (b.l < z.lo or z.broke_at is not None and b.t - z.broke_at <= SPRING_BACK)
        if back_ and old and (z.spring_at is None or b.t - z.spring_at > TEST_BARS[1]):
            run = z.broke
            if z.broke_at is None:
                run = Run()
                run.add(b)
            deep = (z.lo - run.low) / z.lo
            if deep <= SPRING_BREAKS[2]:
                calm = run.most <= SPRING_VOLUME * b.av and _place(b) >= SPRING_CLOSE
                z.spring_kind = "spring3" if deep < SPRING_BREAKS[0] and calm else "spring2" if deep < SPRING_BREAKS[1] else "spring1"
                z.spring_at, z.spring_low, z.spring, z.tested, z.phase = b.t, run.low, run, False, "C"
                self._emit(b, z.spring_kind, z, stop=run.low, aim=True, ratio=run.most / b.av)
        if inside:
            z.broke_at, z.broke = None, Run()
        if z.spring_at is not None and not z.tested and z.spring_kind != "spring3" and TEST_BARS[0] <= b.t - z.spring_at <= TEST_BARS[1]:
            held = z.spring_low <= b.l <= z.lo * (1 + ST_NEAR)
            if held and b.v < TEST_VOLUME * z.spring.most and b.h - b.l <= TEST_SPREAD * z.spring.widest and _place(b) >= TEST_CLOSE:
                z.tested = True
                self._emit(b, "test", z, stop=z.spring_low, aim=True)
        if b.h > z.hi > b.c and b.v / b.av >= UT_VOLUME and _place(b) < UT_CLOSE:
            self._emit(b, "ut", z)

    def _backup(self, b, z: Zone) -> None:
        """After a sign of strength: the last support, or a return to the broken edge."""
        k, pull = b.t - z.strong_at, z.since
        first, last = BACKUP_BARS
        if first <= k <= last and pull.n and b.c > b.o and b.c > pull.high:
            held = pull.low >= z.hi - BACKUP_DEPTH * (z.hi - z.lo)
            if held and pull.most < z.strong_volume and pull.volume / pull.n <= BACKUP_VOLUME * b.av:
                z.backed_up = True
                self._emit(b, "lps", z, stop=pull.low, aim=True)
                self._close(b, z, "up")
                return
        if z.bu_at is None and first <= k <= last and b.drying and b.v <= b.av and abs(b.l - z.hi) <= BACKUP_BAND * z.hi:
            z.bu_at = b.t
            self._emit(b, "bu", z, stop=z.hi * (1 - BACKUP_BAND), aim=True)

    def _thrust_up(self, b, z: Zone) -> None:
        if b.h > z.hi > b.c and b.v >= b.av and (z.last_thrust is None or b.t - z.last_thrust >= UT_APART):
            z.last_thrust = b.t
            late = b.t - z.start >= MIN_AGE and (b.h - z.hi) / z.hi <= UTAD_BREAK
            self._emit(b, "utad" if late else "ut", z)
            z.phase = "C" if late else z.phase

    def _last_supply(self, b, z: Zone) -> None:
        roof, run = z.lo * (1 + BACKUP_BAND), z.since
        first, last = BACKUP_BARS
        if first <= b.t - z.strong_at <= last and b.c < b.o and b.h <= roof and run.n and run.high <= roof and run.volume / run.n <= BACKUP_VOLUME * b.av:
            self._emit(b, "lpsy", z)
            self._close(b, z, "down")


def _place(b) -> float:
    return (b.c - b.l) / (b.h - b.l)


def _strong(b, up: bool, any_colour: bool = False) -> bool:
    """A bar along the way with volume, a wide body (or at the limit) and a close near its end."""
    along, limit, place = (b.c > b.o, b.ceil, _place(b) >= STRONG_CLOSE) if up else (b.c < b.o, b.floor, _place(b) <= 1 - STRONG_CLOSE)
    return (along or any_colour) and place and b.v / b.av >= STRONG_VOLUME and (limit or abs(b.c - b.o) >= STRONG_BODY * b.atr)


def _rallied(z: Zone, b) -> None:
    """The first extreme against the climax, of every bar since, judged or not."""
    price = b.h if z.up else b.l
    if z.rally is None or (price > z.rally if z.up else price < z.rally):
        z.rally, z.rally_at, z.rally_day = price, b.t, str(b.d)


def _after_strength(z: Zone, b) -> None:
    """What a bar adds to the run after a sign of strength or weakness, once it is judged."""
    if z.up and b.h > z.peak:
        z.peak, z.since = b.h, Run()
    else:
        z.since.add(b)


_OUT = "symbol string, t int, at int, d date, id string, vol_ratio double, lo double, hi double, stop double, target double, target_ext double, state string"


def walk(rows: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Events of all symbols (id is set) and one row a symbol with its last state, which a later walk goes on from.

    rows: what signs() gives. states: symbol and state of an earlier walk, whose bars (t) are passed over.
    A symbol of fewer than MIN_BARS bars has a state and no events. One pass over a symbol in order, in
    the task that holds it; what it carries from bar to bar does not grow.
    """

    def run(frame: pd.DataFrame, before: str | None) -> pd.DataFrame:
        machine = Automaton(State.load(before) if before else State())
        frame = frame[frame["t"] > machine.state.t].sort_values("t")
        frame = frame.astype(object).where(frame.notna(), None)
        for b in frame.itertuples(index=False):
            machine.step(b)
        out = pd.DataFrame(machine.found, columns=["t", "at", "d", "id", "vol_ratio", "lo", "hi", "stop", "target", "target_ext"], dtype=object)
        out.loc[len(out)] = [None, machine.state.t, machine.state.day, None, None, None, None, None, None, None]
        out["state"] = [None] * (len(out) - 1) + [machine.state.dump()]
        out["d"] = pd.to_datetime(out["d"]).dt.date
        return out

    def alone(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _named(run(frame, None), key)

    def after(key: tuple, frame: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        return _named(run(frame, old["state"].iloc[0] if len(old) else None), key)

    grouped = rows.groupBy("symbol")
    if states is None:
        return grouped.applyInPandas(alone, _OUT)
    return grouped.cogroup(states.select("symbol", "state").groupBy("symbol")).applyInPandas(after, _OUT)


def _named(out: pd.DataFrame, key: tuple) -> pd.DataFrame:
    out.insert(0, "symbol", key[0])
    return out


def events(walked: DataFrame) -> DataFrame:
    return walked.where("id IS NOT NULL").drop("state")


def _meta(name: str, at: int):
    return F.create_map(*[x for k, v in EVENTS.items() for x in (F.lit(k), F.lit(v[at]))])[F.col(name)]


def signals(walked: DataFrame) -> DataFrame:
    """symbol, rank, id, direction, priority, at, d: what was found at each symbol's last bar, labels apart, the most reliable first."""
    last = F.max(F.when(F.col("state").isNotNull(), F.col("at"))).over(Window.partitionBy("symbol"))  # a join would walk twice
    own = events(walked.where("symbol IS NOT NULL").withColumn("__last", last)).where(F.col("at") == F.col("__last"))
    own = own.withColumns({"direction": _meta("id", 0), "priority": _meta("id", 1)}).where("direction <> 'label'")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("priority", "t"))
    return own.select("symbol", rank.alias("rank"), "id", "direction", "priority", "at", "d")


def board(walked: DataFrame) -> DataFrame:
    """symbol, d, phase, lo, hi, age, last_event, last_event_date of each symbol's last bar."""
    raw = "version int, t int, zone struct<up: boolean, start: int, lo: double, hi: double, phase: string>, trend struct<down: boolean, start: int, lo: double, hi: double>, last string, last_day string"
    s = walked.where("state IS NOT NULL").withColumn("s", F.from_json("state", raw))
    phase = F.when(F.col("s.zone").isNotNull(), F.when(F.col("s.zone.up"), F.col("s.zone.phase")).otherwise("PP")).when(F.col("s.trend").isNull(), "-").when(F.col("s.trend.down"), "E-").otherwise("E")
    return s.select(
        "symbol", "d", phase.alias("phase"), F.coalesce("s.zone.lo", "s.trend.lo").alias("lo"), F.coalesce("s.zone.hi", "s.trend.hi").alias("hi"),
        (F.col("s.t") - F.col("s.zone.start")).alias("age"), F.col("s.last").alias("last_event"), F.to_date("s.last_day").alias("last_event_date"),
    )
