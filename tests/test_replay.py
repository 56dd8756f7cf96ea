"""The replay of several sessions against runs of one day, and the scale that it carries."""

from __future__ import annotations

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import ledger, regime
from tidewick.plans import cones

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_scale_is_carried(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(16)]
    closes = spark.createDataFrame([(s, d, 10.0) for s in ("A", "B") for d in days], "symbol string, d date, c double")
    width = {5: -0.3, 10: -0.2, 25: -0.1, 50: 0.0, 75: 0.1, 90: 0.2, 95: 0.3}
    cone = spark.createDataFrame([(s, d, 10, *width.values()) for s in ("A", "B") for d in days], "symbol string, d date, h int, " + ", ".join(f"q{q} double" for q in regime.QUANTILES))
    got = {r["d"]: (r["s50"], r["s80"]) for r in cones._carried(closes, cone, ledger.sessions(closes), 2).collect()}
    assert sorted(got) == days[1:]
    s50 = s80 = 1.0
    for k, d in enumerate(days[1:]):
        if k >= 10:  # the first replayed session is ten sessions back: all its cones caught what came
            s50, s80 = round(s50 * math.exp(0.05 * -0.5), 4), round(s80 * math.exp(0.05 * -0.2), 4)
        assert got[d] == (s50, s80)


def test_growing_counts(spark):
    axes = ", ".join(f"{a} string" for a in regime.AXES)
    row = lambda known, up, vol: (known, [up] * 20, vol, "low", "up", "no", "no", "no")
    rows = spark.createDataFrame([row(3, 1.0, "low"), row(5, -1.0, "low"), row(5, 1.0, "high"), row(7, 1.0, "low"), row(9, 1.0, "low")], f"known int, path array<double>, {axes}")
    counts = regime.growing_counts(rows, 4, 8)
    every = {r["asof"]: (r["n"], round(r["up5"], 6)) for r in counts.where("level = 6").collect()}
    assert every == {4: (1, 1.0), 5: (3, 0.666667), 6: (3, 0.666667), 7: (4, 0.75), 8: (4, 0.75)}
    high = {r["asof"]: r["n"] for r in counts.where("level = 5 AND pool = 'high'").collect()}
    assert high == {5: 1, 6: 1, 7: 1, 8: 1}


def test_doubled_slices(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2048, 2049, 4096, 4097, 8192, 8193)], "n long").select(regime.doubled_slices_of(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == [1, 1, 2, 2, 4, 4, 8]


def test_replay_equals_one_day_runs(spark, monkeypatch):
    many = cones._forecasts(spark, SF, 8).drop("s50", "s80").collect()
    day = sorted({r["d"] for r in many})[3]
    own = cones.bars
    monkeypatch.setattr(cones, "bars", lambda spark, sf_dir: own(spark, sf_dir).where(F.col("d") <= F.lit(day)))
    one = {r["symbol"]: r.asDict() for r in cones._forecasts(spark, SF, 1).collect()}
    some = {r["symbol"]: r.asDict() for r in many if r["d"] == day}
    assert one and set(one) == set(some) and any(r["ok"] for r in one.values())
    for symbol, r in one.items():
        for k, v in r.items():
            assert some[symbol][k] == (pytest.approx(v, abs=1.1e-4) if isinstance(v, float) else v), (symbol, k)


def test_a_forecast_walks_the_trades_once(spark, monkeypatch):
    own, calls = cones.bars, []
    monkeypatch.setattr(cones, "bars", lambda spark, sf_dir: calls.append(1) or own(spark, sf_dir))
    cones._forecasts(spark, SF, 8)
    assert len(calls) == 1


def test_a_pool_is_dealt_once_for_all_sessions_with_its_number_of_slices():
    until, slices = np.array([5, 3, 4, 5, 3]), np.array([4, 2, 2, 4, 2])
    assert sorted(sorted(x.tolist()) for x in regime._deals(until, slices, True)) == [[0, 3], [1, 2, 4]]
    assert sorted(sorted(x.tolist()) for x in regime._deals(until, slices, False)) == [[0, 3], [1, 4], [2]]
