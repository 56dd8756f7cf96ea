"""The phase automaton against a plain form that looks back at all bars, and its resumption from a stored state."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace as Bar

import pytest

from tidewick.operators import phases


def mean(x):
    return sum(x) / len(x)


def look_back(bars):
    """[(t, at, id)] of one symbol; every rule reads the bars it is about."""
    n = len(bars)
    tr = [b.h - b.l if not i else max(b.h - b.l, abs(b.h - bars[i - 1].c), abs(b.l - bars[i - 1].c)) for i, b in enumerate(bars)]
    atr = [None] * n
    for i in range(13, n):
        atr[i] = mean(tr[:14]) if i == 13 else (atr[i - 1] * 13 + tr[i]) / 14
    av = [mean([x.v for x in bars[max(0, i - 20) : i]]) if i else 0 for i in range(n)]
    place = lambda b: (b.c - b.l) / (b.h - b.l)
    out = []
    zone = waiting = after = None

    def climax(i, selling):
        b, s = bars[i], 1 if selling else -1
        limit = b.c <= bars[i - 1].c * 0.935 if selling else b.c >= bars[i - 1].c * 1.065
        coloured = s * (b.c - b.o) <= 0 or abs(b.c - b.o) <= 0.2 * (b.h - b.l)
        return b.v >= 2 * av[i] and s * (b.c / bars[i - 15].c - 1) <= -0.10 and coloured and (limit or b.h - b.l >= 1.5 * atr[i])

    def sideways(i):
        if i < 59:
            return None
        w, x = bars[i - 19 : i + 1], range(20)
        hi, lo = max(b.h for b in w), min(b.l for b in w)
        slope = sum((k - 9.5) * b.c for k, b in zip(x, w)) / sum((k - 9.5) ** 2 for k in x) / mean([b.c for b in w])
        band = 0.15 * (hi - lo)
        touches = sum(b.h >= hi - band for b in w) >= 2 and sum(b.l <= lo + band for b in w) >= 2
        fell = max(b.c for b in bars[i - 59 : i - 19]) >= 1.1 * hi
        return (lo, hi) if 0.06 <= hi / lo - 1 <= 0.35 and fell and touches and abs(slope) <= 0.004 else None

    def strong(i, up, coloured=True):
        b = bars[i]
        limit = b.c >= bars[i - 1].c * 1.065 if up else b.c <= bars[i - 1].c * 0.935
        way = (b.c > b.o if up else b.c < b.o) or not coloured
        return way and b.v / av[i] >= 1.5 and (place(b) >= 0.7 if up else place(b) <= 1 - 0.7) and (limit or abs(b.c - b.o) >= 1.5 * atr[i])

    def new(up, i, lo, hi, climax_at=None):
        return {"up": up, "start": i, "lo": lo, "hi": hi, "phase": "A" if climax_at is not None else "B", "climax": climax_at, "rally": None, "st": [], "spring": None, "tested": False, "break": None, "strong": None, "bu": False, "ut": None, "failed": False, "hits": [0, 0], "out": 0}

    def close(i, z, way, held=None):
        if z["up"] and way == "up":
            return {"down": False, "start": i, "lo": z["lo"], "hi": z["hi"], "held": z["lo"] if held is None else held}
        return {"down": True, "start": i, "lo": z["lo"], "hi": z["hi"], "held": None} if not z["up"] and way == "down" else None

    for i in range(40, n):
        b = bars[i]
        if not atr[i] or av[i] <= 0 or b.h <= b.l:
            continue
        vr, body = b.v / av[i], abs(b.c - b.o)
        if vr >= 2 and body / atr[i] / vr < 0.5:
            out.append((i, i, "er_absorb"))
        if b.c > b.o and b.v < min(bars[i - 1].v, bars[i - 2].v) and b.h - b.l < 0.7 * atr[i] and bars[i - 1].c > bars[i - 4].c:
            out.append((i, i, "no_demand"))
        if waiting:
            z, k = waiting, i - waiting["start"]
            if (b.c < z["lo"] * 0.97) if z["up"] else (b.c > z["hi"] * 1.03):
                waiting = None
            elif k >= 8:
                waiting, own = None, range(z["start"] + 1, i + 1)
                at = max(own, key=lambda t: bars[t].h) if z["up"] else min(own, key=lambda t: bars[t].l)
                if bars[at].h >= z["lo"] * 1.05 if z["up"] else bars[at].l <= z["hi"] * 0.95:
                    z["hi" if z["up"] else "lo"] = bars[at].h if z["up"] else bars[at].l
                    z["rally"], zone, after = at, z, None
                    out.append((at, i, "ar"))
            continue
        free = zone is None
        if zone:
            z, age, up = zone, i - zone["start"], zone["up"]
            lo, hi = z["lo"], z["hi"]
            rise, fall = age >= 20 and b.c > hi and strong(i, True), age >= 20 and b.c < lo and strong(i, False)
            if up and rise and z["strong"] is None:
                z["strong"], z["phase"] = i, "D"
                out.append((i, i, "sos"))
            elif up and b.c < lo and climax(i, True):
                after, zone, free = close(i, z, "down"), None, True
            elif up and fall and not z["failed"]:
                z["failed"] = True
                out.append((i, i, "sow"))
            elif not up and fall:
                z["strong"], z["phase"] = i, "D"
                out.append((i, i, "sow"))
        if zone:
            above, below = b.c > hi * 1.03, b.c < lo * 0.97
            onward = z["strong"] is not None and (above if up else below)
            z["out"] = z["out"] + 1 if (above or below) and not onward else 0
            done = z["strong"] is not None and i - z["strong"] >= 20
            if done or age > 120 or z["out"] >= 2:
                way = ("up" if up else "down") if done else "age" if age > 120 else "up" if above else "down"
                after, zone, free = close(i, z, way), None, not done
                if done:
                    continue
        if zone:
            edge = 0.15 * (hi - lo)
            z["hits"][0] += b.h >= hi - edge
            z["hits"][1] += b.l <= lo + edge
            near = (b.l <= lo * 1.03 and b.c >= lo) if up else (b.h >= hi * 0.97 and b.c <= hi)
            if near and z["phase"] in "AB" and len(z["st"]) < 3 and (z["rally"] is None or i > z["rally"]):
                top = None if z["climax"] is None else bars[z["climax"]]
                quiet = vr <= 0.8 if top is None else b.v < 0.7 * top.v and b.h - b.l < top.h - top.l
                if quiet and (not z["st"] or i - z["st"][-1] >= 5):
                    z["st"].append(i)
                    z["phase"] = "B"
                    out.append((i, i, "st"))
            if up and z["phase"] == "A" and min(z["hits"]) >= 2:
                z["phase"] = "B"
            if up and z["strong"] is None:
                returned = b.l < lo < b.c
                if b.c <= lo:
                    z["break"] = i if z["break"] is None else z["break"]
                elif z["break"] is not None and i - z["break"] <= 3:
                    returned = True
                if returned and age >= 20 and (z["spring"] is None or i - z["spring"][0] > 10):
                    w = bars[i if z["break"] is None else z["break"] : i + 1]
                    low, most, widest = min(x.l for x in w), max(x.v for x in w), max(x.h - x.l for x in w)
                    deep = (lo - low) / lo
                    if deep <= 0.06:
                        kind = "spring3" if deep < 0.01 and most <= 0.7 * av[i] and place(b) >= 0.5 else "spring2" if deep < 0.03 else "spring1"
                        z["spring"], z["tested"], z["phase"] = (i, low, most, widest, kind), False, "C"
                        out.append((i, i, kind))
                if b.c > lo:
                    z["break"] = None
                if z["spring"] and not z["tested"] and z["spring"][4] != "spring3" and 2 <= i - z["spring"][0] <= 10:
                    _, low, most, widest, _ = z["spring"]
                    if low <= b.l <= lo * 1.03 and b.v < 0.5 * most and b.h - b.l <= 0.6 * widest and place(b) >= 0.5:
                        z["tested"] = True
                        out.append((i, i, "test"))
                if b.h > hi > b.c and vr >= 1.5 and place(b) < 0.3:
                    out.append((i, i, "ut"))
            elif up:
                k, seg = i - z["strong"], bars[z["strong"] : i]
                pull = seg[max(range(len(seg)), key=lambda t: seg[t].h) + 1 :] if seg else []
                if 2 <= k <= 20 and pull and min(x.l for x in pull) >= hi - 0.35 * (hi - lo) and max(x.v for x in pull) < seg[0].v and mean([x.v for x in pull]) <= 0.8 * av[i] and b.c > max(b.o, max(x.h for x in pull)):
                    out.append((i, i, "lps"))
                    after, zone = close(i, z, "up", min(x.l for x in pull)), None
                elif not z["bu"] and 2 <= k <= 20 and abs(b.l - hi) <= 0.02 * hi and b.v < bars[i - 1].v < bars[i - 2].v and vr <= 1:
                    z["bu"] = True
                    out.append((i, i, "bu"))
            elif z["strong"] is None:
                if b.h > hi > b.c and vr >= 1 and (z["ut"] is None or i - z["ut"] >= 3):
                    late = age >= 20 and (b.h - hi) / hi <= 0.05
                    z["ut"], z["phase"] = i, "C" if late else z["phase"]
                    out.append((i, i, "utad" if late else "ut"))
            else:
                seg = bars[z["strong"] + 1 : i]
                if 2 <= i - z["strong"] <= 20 and b.c < b.o and b.h <= lo * 1.02 and seg and max(x.h for x in seg) <= lo * 1.02 and mean([x.v for x in seg]) <= 0.8 * av[i]:
                    out.append((i, i, "lpsy"))
                    after, zone = close(i, z, "down"), None
            continue
        if free:
            if after and (i - after["start"] > 60 or (b.c > after["hi"] if after["down"] else b.c < after["lo"])):
                after = None
            if climax(i, True):
                after, waiting = None, new(True, i, b.l, b.h, i)
                out.append((i, i, "sc"))
                continue
            if after and not after["down"] and b.c < after["held"] and strong(i, False, coloured=False):
                out.append((i, i, "sow"))
                after = None
            if climax(i, False):
                waiting = new(False, i, b.l, b.h, i)
                out.append((i, i, "bc"))
                continue
            edges = sideways(i)
            if edges:
                zone, after = new(True, i, *edges), None
    return out


def market(seed: int, n: int) -> list[Bar]:
    """Bars that fall or rise hard, lie sideways, break out and come back, loud and quiet."""
    rnd = random.Random(seed)
    out, c = [], 50.0
    mood, left, centre = 0.0, 0, c
    for k in range(n):
        if not left:
            mood, left, centre = rnd.choice((-0.012, 0.012, 0.0, 0.0, 0.0)), rnd.randint(12, 60), c
        left -= 1
        loud = rnd.random() < 0.12
        drift = mood if mood else 0.3 * (centre / c - 1)
        move = drift + rnd.gauss(0, 0.035 if loud else 0.012)
        o = c * (1 + rnd.gauss(0, 0.003))
        c = max(1.0, o * (1 + max(-0.07, min(0.07, move))))
        reach = abs(rnd.gauss(0, 0.008))
        h, low = max(o, c) * (1 + reach * rnd.random()), min(o, c) * (1 - reach * rnd.random())
        v = int(1000 * (1.0 + 3 * rnd.random() if loud else 0.3 + rnd.random()))
        if rnd.random() < 0.005:
            o = h = low = c  # a bar that is not judged
        out.append(Bar(d=dt.date(2015, 1, 1) + dt.timedelta(days=k), o=round(o, 4), h=round(max(h, o, c), 4), l=round(min(low, o, c), 4), c=round(c, 4), v=v))
    return out


@pytest.fixture(scope="module")
def markets():
    return {f"M{k}": market(k, 420 if k % 4 else 39 + k % 3) for k in range(160)}


@pytest.fixture(scope="module")
def signs(spark, markets):
    rows = [(s, b.d, b.o, b.h, b.l, b.c, b.v) for s, bars in markets.items() for b in bars]
    bars = spark.createDataFrame(rows, "symbol string, d date, o double, h double, l double, c double, v long")
    return phases.signs(bars).persist()


def found(walked):
    out = {}
    for r in phases.events(walked).collect():
        out.setdefault(r["symbol"], []).append((r["t"], r["at"], r["id"]))
    return {s: sorted(x) for s, x in out.items()}


def test_equal_to_looking_back(markets, signs):
    want = {s: sorted(x) for s, bars in markets.items() if (x := look_back(bars))}
    assert {e for x in want.values() for _, _, e in x} == set(phases.EVENTS)  # every kind is met
    assert found(phases.walk(signs)) == want


def test_resumed_from_a_stored_state(spark, signs):
    """Walked in three parts, each from the state that the last one left, the events are the same."""
    whole = phases.walk(signs)
    states, parts = None, {}
    for a, b in ((0, 97), (97, 251), (251, 10_000)):
        part = phases.walk(signs.where(f"t < {b}"), states)  # bars before a are passed over
        for s, x in found(part).items():
            parts.setdefault(s, []).extend(x)
        states = spark.createDataFrame(part.where("state IS NOT NULL").select("symbol", "state").collect(), "symbol string, state string")
    assert {s: sorted(x) for s, x in parts.items()} == found(whole)
    last = {r["symbol"]: r["state"] for r in whole.where("state IS NOT NULL").collect()}
    assert {r["symbol"]: r["state"] for r in states.collect()} == last
    with pytest.raises(ValueError, match="version"):
        phases.State.load('{"version": 0}')


def test_signals_and_board(signs):
    walked = phases.walk(signs).persist()
    last = {r["symbol"]: r["at"] for r in walked.where("state IS NOT NULL").collect()}
    want = sorted((e["symbol"], e["id"]) for e in phases.events(walked).collect() if e["at"] == last[e["symbol"]] and phases.EVENTS[e["id"]][0] != "label")
    got = phases.signals(walked).collect()
    assert sorted((r["symbol"], r["id"]) for r in got) == want
    for a, b in zip(got, got[1:]):
        assert a["symbol"] != b["symbol"] or (a["rank"] < b["rank"] and a["priority"] <= b["priority"])
    board = phases.board(walked).collect()
    assert len(board) == len(last) and {r["phase"] for r in board} <= {"A", "B", "C", "D", "E", "E-", "PP", "-"}
    assert all(r["lo"] < r["hi"] for r in board if r["lo"] is not None)
