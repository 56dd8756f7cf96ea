"""What cones that are scored read, hold and shuffle, and the numbers of their shortcuts against plain ones."""

from __future__ import annotations

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick import catalogue
from tidewick.operators import conditional, regime
from tidewick.plans import cones, occasions

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_blocks_are_those_of_single_steps():
    deal = np.random.default_rng(3)
    steps, order = deal.standard_t(3, (50, regime.STEPS)), deal.permutation(50).astype(np.uint64)
    seed, vol, group = deal.integers(0, 1 << 32, 6)[:, None], np.linspace(0.005, 0.05, 6)[:, None], np.array([0, 1, 2, 3, 0, 1])[:, None]
    first, rows = np.array([0, 10, 0, 20, 30, 5])[:, None], np.array([10, 40, 50, 30, 20, 7])[:, None]
    out, _ = regime._walk(regime._Blocks(steps, order), first, rows, seed, vol, group, 40, (5, 20), False)
    for k in range(6):
        for j in range(10):
            total, path = 0.0, int(group[k, 0]) + regime.GROUPS * j
            for block in range(4):
                draw = lambda n, salt: (int(seed[k, 0]) * 1103515 + path * 7919 + block * 104729 + salt * 15485863) % 2147483647 * 48271 % 2147483647 % n
                row, start = int(order[int(first[k, 0]) + draw(int(rows[k, 0]), 1)]), draw(16, 2)
                total += sum(max(-regime.CLIP, min(regime.CLIP, steps[row, start + i] * vol[k, 0])) for i in range(5))
                if block == 0:
                    assert out[5][k, j] == pytest.approx(total, abs=1e-12)
            assert out[20][k, j] == pytest.approx(total, abs=1e-12)


def test_members_that_no_target_knows_are_not_copied(spark):
    axes = ", ".join(f"{a} string" for a in regime.AXES)
    rows = spark.createDataFrame([("A", dt.date(2020, 1, k + 1), k, [0.5] * regime.STEPS, "low", *["no"] * 5) for k in range(8)], f"symbol string, d date, known int, steps array<double>, {axes}")
    rows = rows.withColumns({"upvol": F.lit("mid"), "st": F.lit("up")})
    pools = [("low|mid|up|no|no|no", 0, 1, 1, 6), ("low", 5, 2, 1, 2)]
    out = regime.asked_for(rows, ["pool", "level"], pools, "pool string, level int, __u int, __salts int").groupBy("level").count()
    assert {r["level"]: r["count"] for r in out.collect()} == {0: 7, 5: 3}


def test_the_frame_that_is_held_has_no_paths(spark):
    targets, rows = cones._scored(spark, SF)
    assert "path" not in rows.columns
    plan = regime.learned(rows.withColumn("known", F.unix_date("d")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_learned_steps_are_those_of_paths(spark):
    frame = cones.keyed(spark, SF).withColumn("known", F.unix_date("d"))
    listed = lambda x: sorted((r["symbol"], r["d"], [round(s, 9) for s in r["steps"]], r["vol"], r["gap"]) for r in x.collect())
    assert listed(regime.learned(frame)) == listed(regime.pool_rows(frame)) != []


@pytest.mark.parametrize("name", ["backtest_by_year", "history_by_day", "event_cone_scales"])
def test_trades_are_walked_once(spark, monkeypatch, name):
    calls, own = [], cones.bars
    walked = lambda spark, sf_dir: calls.append(1) or own(spark, sf_dir)
    for module in (cones, occasions):
        monkeypatch.setattr(module, "bars", walked)
    catalogue.QUERIES[name](spark, SF)
    assert len(calls) == 1


def _cone(spark, rows):
    q = lambda w: [w * x for x in (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)]
    return spark.createDataFrame([(s, dt.date(2020, 1, 1 + d), 5, *q(w), r) for s, d, w, r in rows], "symbol string, d date, h int, " + ", ".join(f"q{x} double" for x in regime.QUANTILES) + ", ret double")


def test_a_cone_is_counted_once_for_all_widths(spark):
    deal = np.random.default_rng(5)
    rows = [(f"S{k}", k % 3, float(w), float(r)) for k, (w, r) in enumerate(zip(deal.choice([0.0, 0.5, 1.0], 300), deal.choice([-0.9, -0.3, -0.16, -0.1, 0.0, 0.08, 0.2, 0.24, 0.31, 0.9], 300)))]
    grid, cone = regime.width_grid(0.8, 3.0, 0.05), _cone(spark, rows)
    least = regime.least_widths(cone, grid)
    assert least.count() == 3 * len(rows)
    cover = {(r["level"], r["s"]): r["cov"] for r in regime.cover_by_width(cone, ["h"], grid).collect()}
    for level, (a, b) in regime.LEVELS.items():
        lo, hi = ({5: -0.3, 10: -0.2, 25: -0.1, 75: 0.1, 90: 0.2, 95: 0.3}[x] for x in (a, b))
        for s in grid:
            assert cover[level, s] == sum(s * (w * lo) <= r <= s * (w * hi) for _, _, w, r in rows) / len(rows), (level, s)
    scales = conditional.event_scales(cone.withColumn("code", F.lit("sc")))
    assert {r["level"]: round(cover[r["level"], r["scale"]], 9) for r in scales.collect()} == {r["level"]: round(r["cov_after"], 9) for r in scales.collect()}


def test_cells_are_no_more_than_scales_can_tell_apart(spark):
    cone = _cone(spark, [(f"S{k}", 0, 1.0, (k - 500) / 1000) for k in range(1000)])
    calendar = spark.createDataFrame([(dt.date(2020, 1, 1), 1)], "d date, session int")
    for r in regime.daily_cells(cone, None, calendar).collect():
        cells = {c["cell"]: c["n"] for c in r["cells"]}
        assert min(cells) == 5000 and max(cells) <= 30001 and sum(cells.values()) == 1000
        a, b = {50: (-0.1, 0.1), 80: (-0.2, 0.2), 90: (-0.3, 0.3)}[r["level"]]
        for s in (0.5, 0.8123, 1.0, 2.9999, 3.0):
            assert sum(n for c, n in cells.items() if c <= round(s * 10000)) == sum(s * a - 1e-9 <= (k - 500) / 1000 <= s * b + 1e-9 for k in range(1000)), (r["level"], s)
    assert math.isclose(regime.sequential(cone, None, calendar).where("level = 80").first()["hit"], 0.401)


def test_pools_are_looked_up_once(spark):
    targets, _ = cones._scored(spark, SF)
    plan = targets._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Join") == 1


def test_rows_and_regimes_share_one_walk(spark, monkeypatch):
    from tidewick.plans import studies

    calls, own = [], cones.bars
    for module in (cones, studies):
        monkeypatch.setattr(module, "bars", lambda spark, sf_dir: calls.append(1) or own(spark, sf_dir))
    studies.direction_baselines(spark, SF)
    assert len(calls) == 1


def test_trees_get_no_flag_that_no_row_has(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from tidewick.operators import evaluate

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=4 * k) for k in range(180)]
    rows = [(d, k % 3 == 0, 0.5, float(k % 6), None if k % 7 == 0 else 1.0 * k) for k, d in enumerate(days)]
    sizes, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, train: (sizes.append(train.first()["features"].size), fit(self, train))[1])
    out = evaluate.walk_forward(spark.createDataFrame(rows, "d date, y5 boolean, p5 double, f double, g double"), ("f", "g"), (5,), least=10, rounds=2)
    assert out.count() == len(sizes) == 1 and sizes == [3]  # f, g, and whether g is missing
