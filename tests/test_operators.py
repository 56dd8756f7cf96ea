"""Operators on small planted tables with results worked out by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewick.operators import events, features, flow, ingest, patterns, regime, structure, trend, zones

DAY0 = dt.date(2024, 1, 1)
BARS = "symbol string, d date, o double, h double, l double, c double, v long"
TICKS = "symbol string, d date, sec int, price double, vol long, side string, acc long"


def bars(spark, rows, symbol="A"):
    return spark.createDataFrame([(symbol, DAY0 + dt.timedelta(days=i), *map(float, r[:4]), int(r[4])) for i, r in enumerate(rows)], BARS)


def ticks(spark, rows, symbol="A", d=DAY0):
    acc, out = 0, []
    for sec, price, vol, side in rows:
        acc += vol
        out.append((symbol, d, sec, float(price), vol, side, acc))
    return spark.createDataFrame(out, TICKS)


def walk(n, seed=3, p=30.0):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        o, p = p, p * (1 + rnd.gauss(0, 0.02))
        out.append((o, max(o, p) * 1.01, min(o, p) * 0.99, p, int(1e5 * (1 + rnd.random()))))
    return out


FLAT = [(10, 10.05, 9.95, 10, 1000)] * 25


@pytest.mark.parametrize(("last", "hit"), [((10, 10.4, 9.9, 10.3, 2000), True), ((10.5, 10.6, 10.3, 10.4, 3000), False), ((10, 10.4, 9.9, 10.29, 3000), False), ((10, 10.6, 9.9, 10.5, 1999), False)])
def test_volume_spike(spark, last, hit):
    out = events.volume_spike(bars(spark, [*FLAT, last])).collect()
    assert len(out) == hit
    if hit:
        assert out[0]["ratio"] == 2.0


def test_volume_spike_needs_twenty_bars(spark):
    last = (10, 10.4, 9.9, 10.3, 2000)
    assert events.volume_spike(bars(spark, [*FLAT[:19], last])).count() == 0
    assert events.volume_spike(bars(spark, [*FLAT[:20], last])).count() == 1


def test_keep_first_counts_from_the_last_kept(spark):
    rows = bars(spark, [(1, 1, 1, 1, 1)] * 14).withColumn("hit", F.dayofmonth("d").isin(1, 4, 7, 8, 13))
    assert sorted(r["d"].day for r in events.keep_first(rows, "hit").collect()) == [1, 7, 13]


def test_the_past_does_not_see_the_future(spark):
    rows = walk(320)
    changed = rows[:300] + [(o * 3, h * 3, lo * 3, c * 3, v * 5) for o, h, lo, c, v in rows[300:]]
    out = []
    for r in (rows, changed):
        own = bars(spark, r)
        frame = features.feature_frame(own, own).drop("path", *[f"{x}{k}" for x in ("fr", "y") for k in (5, 10, 20)])
        frame = frame.withColumns({"red": events.red_volume_demand(), "gap_fill": events.gap_fill_demand()})
        st = trend.supertrend(own).select("d", "up", "line")
        out.append(frame.join(st, "d", "left").where(F.col("d") < DAY0 + dt.timedelta(days=279)).orderBy("d").collect())
    assert out[0] == out[1]


def test_path_ends_with_the_forward_return(spark):
    own = features.with_path(features.with_labels(bars(spark, walk(60)))).orderBy("d").collect()
    assert all(abs(r["path"][19] - r["fr20"]) < 1e-12 for r in own[:40])
    assert all(r["path"] is None and r["fr20"] is None for r in own[40:])


def test_gap_fill_demand(spark):
    rows = [(30, 30.1, 29.9, 30, 1000)] * 70 + [(30 - 0.4 * i, 30.1 - 0.4 * i, 29.5 - 0.4 * i, 29.6 - 0.4 * i, 1000) for i in range(10)]
    c = rows[-1][3]
    rows += [(c * 0.98, c * 0.985, c * 0.96, c * 0.97, 1000), (c * 0.975, c * 0.995, c * 0.97, c * 0.99, 1000)]
    out = bars(spark, rows).withColumn("e", events.gap_fill_demand()).orderBy("d").collect()
    assert out[-1]["e"] and not any(r["e"] for r in out[:-1])


PLANTED = {
    "bull_engulfing": [(10, 10.1, 9.4, 9.5, 1), (9.4, 10.6, 9.3, 10.5, 1)],
    "bear_engulfing": [(9.5, 10.1, 9.4, 10, 1), (10.1, 10.2, 9.2, 9.3, 1)],
    "morning_star": [(10, 10.1, 8.9, 9, 1), (8.9, 9.0, 8.7, 8.8, 1), (8.9, 9.9, 8.8, 9.8, 1)],
    "hammer_confirm": [(10, 10.02, 9.0, 9.95, 1), (10, 10.5, 9.9, 10.4, 1)],
    "piercing": [(10, 10.1, 8.9, 9, 1), (8.9, 9.8, 8.8, 9.7, 1)],
    "dark_cloud": [(9, 10.1, 8.9, 10, 1), (10.1, 10.2, 9.2, 9.3, 1)],
    "three_white_soldiers": [(9, 10.1, 8.95, 10, 1), (9.5, 10.6, 9.45, 10.5, 1), (10, 11.1, 9.95, 11, 1)],
    "three_black_crows": [(11, 11.05, 9.9, 10, 1), (10.5, 10.55, 9.4, 9.5, 1), (10, 10.05, 8.9, 9, 1)],
    "falling_three_methods": [(12, 12.1, 9.9, 10, 1), (10.2, 10.7, 10.1, 10.6, 1), (10.4, 10.9, 10.3, 10.8, 1), (10.6, 11.1, 10.5, 11, 1), (10.9, 11, 9.4, 9.5, 1)],
}


@pytest.mark.parametrize("name", PLANTED)
def test_planted_pattern(spark, name):
    base = [(10, 10.6, 9.6, 10.4, 1), (10.4, 10.6, 9.6, 10, 1)] * 8
    out = patterns.detect(bars(spark, base + PLANTED[name])).where(F.col("d") == DAY0 + dt.timedelta(days=len(base + PLANTED[name]) - 1))
    assert name in [r["pattern"] for r in out.collect()]


def test_orders(spark):
    rows = [(1, 10, v, "PB") for v in (500, 100, 100, 500, 700, 2000, 1100)] + [(1, 10, 3000, "PS")]
    assert sorted(r["vol"] for r in zones.orders(ticks(spark, rows)).collect()) == [3000, 5000]


def test_a_sweep_is_large_as_a_whole(spark):
    rows = [(5, 37.6, 9000, "PB"), (6, 37.6, 10600, "PS"), (6, 37.65, 9400, "PS")]
    out = {r["price"]: (r["buy"], r["sell"], r["x"], r["big_buy"], r["big_sell"]) for r in zones.levels(ticks(spark, rows)).collect()}
    assert out == {37.6: (10600, 9000, 0, 10600, 0), 37.65: (9400, 0, 0, 9400, 0)}


def test_orders_of_different_seconds_are_not_a_sweep(spark):
    rows = [(6, 37.6, 10600, "PS"), (7, 37.65, 9400, "PS")]
    assert all(r["big_buy"] == 0 for r in zones.levels(ticks(spark, rows)).collect())


def test_value_area(spark):
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate([1, 5, 50, 10, 30, 2])], "symbol string, bin int, total long")
    out = zones.value_area(rows).first()
    assert (out["poc"], out["val_bin"], out["vah_bin"]) == (2, 2, 4)


def test_minutes_keep_their_volume(spark):
    rows = [("A", DAY0, 33300 + 60 * i, 10.0, 10.2, 9.9, 10.1 + 0.05 * (i % 2), 1003) for i in range(5)]
    minutes = spark.createDataFrame(rows, "symbol string, d date, sec int, o double, h double, l double, c double, v long")
    out = zones.estimate_levels(minutes).agg(F.sum("buy") + F.sum("sell") + F.sum("x")).first()[0]
    assert out == 5 * 1003


def noise(seed=1, n=120):
    rnd = random.Random(seed)
    return [(33300 + 37 * i, 20.0, rnd.choice((100, 200, 300, 400)), rnd.choice(("PB", "PS"))) for i in range(n)]


def chains_of(spark, extra):
    rows = sorted(noise() + extra)
    return flow.chains(flow.active_orders(ticks(spark, rows))).collect()


def test_noise_has_no_chain(spark):
    assert chains_of(spark, []) == []


def test_a_steady_beat_is_a_chain(spark):
    out = chains_of(spark, [(33305 + 100 * i, 20.0, 1800, "PS") for i in range(12)])
    assert [(r["side"], r["size"], r["n"]) for r in out] == [("B", 1800, 12)] and out[0]["cv"] < 1e-9


def test_a_missed_beat_is_forgiven(spark):
    out = chains_of(spark, [(33305 + 100 * i, 20.0, 1800, "PS") for i in range(10) if i != 4])
    assert [(r["n"], r["missed"]) for r in out] == [(9, 1)]


@pytest.mark.parametrize(("n", "found"), [(6, 1), (5, 0)])
def test_chains_need_six_orders(spark, n, found):
    assert len(chains_of(spark, [(33305 + 100 * i, 20.0, 1800, "PS") for i in range(n)])) == found


def test_baskets_need_five_symbols(spark):
    def rows(n, sec):
        return spark.createDataFrame([(f"S{i}", DAY0, 1, sec, "B", 10_000, 20.0) for i in range(n)], "symbol string, d date, i long, sec int, side string, vol long, price double")

    assert flow.baskets(rows(4, 40000), 100_000).count() == 0
    assert flow.baskets(rows(5, 40000), 100_000).count() == 1
    assert flow.baskets(rows(5, 13 * 3600), 100_000).count() == 0


@pytest.mark.parametrize(("accs", "gap", "accepted"), [([100, 200, 300], 0, True), ([100, 200, 350], 50, False), ([100, 200, 250], -50, False)])
def test_shortfall(spark, accs, gap, accepted):
    rows = spark.createDataFrame([("A", DAY0, 1, 10.0, 100, "PS", a) for a in accs], TICKS)
    out = ingest.shortfall(rows).first()
    assert (out["gap"], out["accepted"]) == (gap, accepted)


def test_upsert_and_again(spark):
    old = bars(spark, [(1, 1, 1, 1, 10), (2, 2, 2, 2, 20)])
    new = bars(spark, [(1, 1, 1, 1, 10), (2, 2, 2, 2, 21), (3, 3, 3, 3, 30)])
    assert sorted(r["status"] for r in ingest.upsert(old, new).collect()) == ["added", "changed", "same"]
    assert {r["status"] for r in ingest.upsert(new, new).collect()} == {"same"}


def test_conformal_scale(spark):
    def scale(hit, n):
        rows = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), 10, 80, hit) for i in range(n)], "d date, h int, level int, hit double")
        return regime.calibrate(rows).first()

    assert scale(0.6, 30)["s"] > 1
    long = scale(1.0, 300)
    assert long["s"] == 0.5 and len(long["hits"]) == 250
    assert regime.verdicts(spark.createDataFrame([(10, 80, [0.6] * 60)], "h int, level int, hits array<double>")).first()["verdict"] == "narrow"


def test_bootstrap_clips_and_repeats(spark):
    import math

    pool = spark.createDataFrame([("p", i, [5.0] * 20) for i in range(3)], "pool string, row long, steps array<double>")
    target = spark.createDataFrame([("A", 77, 1.0, "p", 3)], "id string, seed long, vol20 double, pool string, n long")
    out = [r["cum"] for r in regime.bootstrap(target, pool, 8).orderBy("path").collect()]
    assert out == [r["cum"] for r in regime.bootstrap(target, pool, 8).orderBy("path").collect()]
    assert len(out) == 8 and all(abs(c[4] - 5 * math.log(1.07)) < 1e-9 and len(c) == 20 for c in out)


def test_swings_and_gap(spark):
    rows = [(1, h, h - 1, h - 0.5, 1) for h in (1, 2, 5, 3, 2, 1, 1)]
    out = structure.swings(bars(spark, rows)).where("up").collect()
    assert [(r["t"], r["p"], r["label"]) for r in out] == [(2, 5.0, "HH")]
    gap = [(9, 9.5, 8.5, 9, 1)] * 2 + [(9, 10, 9, 9.9, 1), (10.2, 11.5, 10.1, 11.4, 1), (11.2, 12, 11, 11.9, 1), (11.5, 12, 11.2, 11.5, 1), (11, 11.2, 9.8, 10, 1)]
    own = bars(spark, gap).withColumn("atr", F.lit(1.0))
    assert [(r["t"], r["end"], r["lo"], r["hi"]) for r in structure.fair_value_gaps(own).where("lo = 10").collect()] == [(3, 6, 10.0, 11.0)]


def test_live_candles(spark, tmp_path):
    from tidewick.streaming import live

    schema = "symbol string, ts timestamp, acc long, price double, vol long, side string"
    t0 = dt.datetime(2024, 1, 1, 9, 15)
    rows = [("A", t0 + dt.timedelta(minutes=i), i, 10.0 + i, 100, "PS" if i % 2 else "PB") for i in range(40)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = live.live_candles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("append").format("memory").queryName("candles").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.sql("SELECT * FROM candles ORDER BY start").collect()
    assert out and (out[0]["o"], out[0]["c"], out[0]["buy"], out[0]["sell"]) == (10.0, 14.0, 200, 300)


def test_direction_gate(spark):
    from tidewick.operators import evaluate

    rows = [(5, y, 0.2, 0.25, 0.6, 0.5) for y in range(5)] + [(10, y, 0.2 if y < 3 else 0.3, 0.25, 0.6, 0.5) for y in range(5)]
    out = {r["h"]: r["enabled"] for r in evaluate.direction_gate(spark.createDataFrame(rows, "h int, year int, brier double, brier_freq double, accuracy double, up_rate double")).collect()}
    assert out == {5: True, 10: False}


def test_baselines_by_hand(spark):
    """Three guesses for each year: the pool's share, the mean of what was known 35 days before, one half."""
    import datetime as dt

    from tidewick.operators import evaluate

    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(days=k), k % 3 == 0 if k < 600 else None, k % 2 == 0, (k % 5) / 4 if k % 7 else None, 0.25) for k in range(900)]
    frame = spark.createDataFrame(rows, "d date, y5 boolean, y10 boolean, p5 double, p10 double")
    got = {(r["h"], r["year"]): r for r in evaluate.baselines(frame, (5, 10), least=300).collect()}
    for h, y, p in ((5, 1, 3), (10, 2, 4)):
        for year in (2020, 2021, 2022):
            past = [r[y] for r in rows if r[y] is not None and r[0] < dt.date(year, 1, 1) - dt.timedelta(days=35)]
            own = [(float(r[y]), 0.5 if r[p] is None else r[p]) for r in rows if r[y] is not None and r[0].year == year]
            if len(past) < 300 or not own:
                assert (h, year) not in got
                continue
            r, base, n = got[h, year], sum(past) / len(past), len(own)
            want = (sum(x for x, _ in own) / n, sum((q - x) ** 2 for x, q in own) / n, sum((base - x) ** 2 for x, _ in own) / n, 0.25)
            assert (r["n_train"], r["n_test"]) == (len(past), n)
            assert all(abs(r[c] - w) < 1e-12 for c, w in zip(("up_rate", "brier_freq", "brier_global", "brier_half"), want))
