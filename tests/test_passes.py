"""Queries whose frame is walked once: what they give, and what their plans hold."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewick.functions.rolling import Together, roll
from tidewick.operators import conditional, features, flow, phases, regime, reports, structure, trend, zones


def test_new_whale_pairs_are_those_of_two_rankings_and_levels_are_sorted_once(spark):
    deal = random.Random(7)
    rows = [(f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(k), round(30 + deal.randrange(40) * 0.05, 3), *[deal.choice([0, 0, 100, 300]) for _ in range(5)]) for s in range(12) for k in range(8) for _ in range(5)]
    levels = spark.createDataFrame(rows, "symbol string, d date, price double, buy long, sell long, x long, big_buy long, big_sell long")
    newest = levels.groupBy("symbol").agg({"d": "max"}).withColumnRenamed("max(d)", "d")
    older = levels.join(newest, ["symbol", "d"], "left_anti")
    want = []
    for w in (2, 4):
        now, before = (reports.whale_pairs(zones.top_levels(zones.recent(x, w)), 1.0) for x in (levels, older))
        had = {r["symbol"] for r in before.collect()}
        want += [(r["symbol"], w, r["buy_p"], r["sell_p"]) for r in now.collect() if r["symbol"] not in had]
    out = reports.new_whale_pairs(levels, (2, 4), 1.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Window [") == 1
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) != []


def test_blocks_are_found_without_a_join_and_are_those_of_searches(spark):
    deal = random.Random(11)
    rows, day = [], dt.date(2022, 1, 1)
    for s in range(4):
        c = 20.0
        for k in range(400):
            o, c = c, round(c * (1 + deal.uniform(-0.04, 0.04)), 4)
            rows.append((f"S{s}" if s else None, day + dt.timedelta(k), o, max(o, c) * 1.005, min(o, c) * 0.995, c, 1000, 0.4))
    bars = spark.createDataFrame(rows, "symbol string, d date, o double, h double, l double, c double, v long, atr double")
    out = structure.order_blocks(bars, broken=True)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    listed = lambda x: sorted(map(repr, (tuple(r) for r in x.select("symbol", "k", "m", "lo", "hi", "bull", "touch", "brk_close", "brk").collect())))
    got = listed(out)
    assert got == listed(structure.breakers(structure.order_blocks(bars), bars)) and len(got) > 20 and not any(x.startswith("(None") for x in got)
    assert any(not x.endswith("None)") for x in got)


def test_a_walk_is_walked_once_for_its_signals(spark):
    walked = spark.createDataFrame([], "symbol string, t int, at int, d date, id string, vol_ratio double, lo double, hi double, stop double, target double, target_ext double, state string")
    assert "Join" not in phases.signals(walked)._jdf.queryExecution().analyzed().toString()


def test_chains_of_all_passes_are_found_without_a_join(spark):
    def beat(start, n, gap, vol):
        return [("A", dt.date(2024, 1, 2), start + k * gap, "B", vol, 30.0 + k) for k in range(n)]

    rows = [(s, d, i, *x) for i, (s, d, *x) in enumerate(beat(1000, 8, 400, 700) + beat(20000, 7, 60, 900) + beat(20010, 3, 350, 900) + beat(40000, 9, 100, 800))]
    orders = spark.createDataFrame(rows, "symbol string, d date, i long, sec int, side string, vol long, price double")
    out = flow.chains(orders)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r["size"], r["rule"], r["n"], r["first"], r["last"]) for r in out.collect())
    assert (700, 0, 8, 1000, 3800) in found and (800, 0, 9, 40000, 40800) in found and len(found) == len({r[0] for r in found})


def test_pools_of_years_count_a_row_once(spark):
    deal = random.Random(3)
    axes = ", ".join(f"{a} string" for a in regime.AXES)
    rows = [(dt.date(2018, 1, 1) + dt.timedelta(deal.randrange(1400)), [deal.uniform(-1, 1) for _ in range(regime.STEPS)], deal.choice(["low", "high"]), *["no"] * 5) for _ in range(300)]
    own = spark.createDataFrame(rows, f"d date, path array<double>, {axes}")
    got = {(r["asof"], r["pool"]): (r["n"], r["up5"]) for r in regime.yearly_counts(own, [2021, 2019, 2020]).where("level = 5").collect()}
    for y in (2019, 2020, 2021):
        for vol in ("low", "high"):
            paths = [r[1] for r in rows if r[0] < dt.date(y, 1, 1) - dt.timedelta(35) and r[2] == vol]
            assert got[y, vol] == (len(paths), sum(p[4] > 0 for p in paths) / len(paths))


def test_values_made_in_one_pass_are_those_of_windows(spark):
    deal = random.Random(5)
    rows = [(f"S{s}", dt.date(2020, 1, 1) + dt.timedelta(k), 1.0, 2.0, 0.5, round(deal.uniform(1, 3), 2), deal.randrange(9), None if k in (0, 47) else round(deal.uniform(0, 1), 1)) for s in range(2) for k in range(90)]
    own = spark.createDataFrame([*rows, ("short", *rows[0][1:])], "symbol string, d date, o double, h double, l double, c double, v long, x double")
    asked = [(F.avg, "v", 20, 0), (F.sum, "x", 12, 1), (F.max, "c", 20, 1), (F.min, F.abs(F.col("c") - 2), 30, 3), (F.max, "c", 3, 0)]
    together = Together()
    for a in asked:
        together(*a)
    assert len(together.windows()) == 4  # a short window stays a window
    out = trend.columns(own, ranked={"x": 25}, together=together).join(features.with_rank(own.withColumnRenamed("x", "vol20"), 25).select("symbol", "d", "vol20_rank"), ["symbol", "d"])
    out = out.join(own.select("symbol", "d", "x").withColumnRenamed("x", "__x"), ["symbol", "d"])
    got = out.select("x_rank", "vol20_rank", *[together(*a).alias(f"a{i}") for i, a in enumerate(asked)], *[roll(*a).alias(f"b{i}") for i, a in enumerate(asked)]).collect()
    assert len(got) == 181 and sum(r["x_rank"] is not None for r in got) > 20
    for r in got:
        assert r["x_rank"] == r["vol20_rank"] and all(r[f"a{i}"] == r[f"b{i}"] for i in range(len(asked)))


def test_bars_of_events_are_flagged_without_a_join(spark):
    bars = spark.createDataFrame([], "symbol string, d date, o double, h double, l double, c double, v long")
    assert "Join" not in conditional.flags(bars)._jdf.queryExecution().analyzed().toString()
