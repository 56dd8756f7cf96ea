"""Readers, sinks, settings and streams by small files, and the newer operators by hand-made rows."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import math

from pyspark.sql import functions as F

from tidewick.operators import evaluate, flow, ingest, regime
from tidewick.sources import files
from tidewick.streaming import live

D = dt.date


def test_bars_come_from_parallel_arrays_and_go_by_year(spark, tmp_path):
    payload = {"symbol": "A", "t": [1704153600, 1735776000], "o": [1.0, 2.0], "h": [2.0, 3.0], "l": [0.5, 1.5], "c": [1.5, None], "v": [10, 20]}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    rows = files.read_bars_json(spark, str(tmp_path / "a.json")).collect()
    assert [(r["symbol"], r["c"], r["v"]) for r in rows] == [("A", 1.5, 10)]  # the bar without a close is gone
    schema = "symbol string, d date, c double"
    out = str(tmp_path / "bars")
    files.write_bars(spark.createDataFrame([("A", D(2023, 5, 1), 1.0), ("A", D(2024, 5, 1), 2.0)], schema), out)
    files.write_bars(spark.createDataFrame([("A", D(2024, 6, 1), 3.0)], schema), out)
    assert sorted(r["c"] for r in spark.read.parquet(out).collect()) == [1.0, 3.0]  # only the year at hand was replaced


def test_ticks_take_symbol_and_day_from_their_path(spark, tmp_path):
    (tmp_path / "2024-01-02").mkdir()
    with gzip.open(tmp_path / "2024-01-02" / "ABC.json.gz", "wt") as f:
        f.write(json.dumps({"time": "09:15:01", "price": "10.5", "vol": "300", "side": "PS", "acc": "300"}) + "\n")
    r = files.read_ticks_json(spark, str(tmp_path / "2024-01-02")).first()
    assert (r["symbol"], r["d"], r["sec"], r["price"]) == ("ABC", D(2024, 1, 2), 9 * 3600 + 15 * 60 + 1, "10.5")


def test_watchlist_documents_and_settings(spark, tmp_path):
    items = [{"symbol": " abc ", "exchange": "X"}, {"symbol": "off", "enabled": False}, {"symbol": " "}]
    (tmp_path / "w.json").write_text(json.dumps({"items": items}))
    assert [r["symbol"] for r in files.read_watchlist(spark, str(tmp_path / "w.json")).collect()] == ["ABC"]
    files.write_documents(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first().asDict() == {"a": 1, "b": "x"}
    s = files.Settings().overlaid({"p_min": 0.7, "nonsense": 1}, {"p_min": None, "max_bins": 30})
    assert (s.p_min, s.max_bins, s.va_pct) == (0.7, 30, 0.70)


def _run(spark, stream, tmp_path, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_alerts_gives_each_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 15)
    schema = "symbol string, d date, ts timestamp"
    spark.createDataFrame([("A", D(2024, 1, 1), t), ("A", D(2024, 1, 1), t + dt.timedelta(minutes=5)), ("B", D(2024, 1, 1), t)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = _run(spark, live.alerts_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "once")
    assert sorted(r["symbol"] for r in out) == ["A", "B"]


def test_stream_of_order_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 9)
    schema = "symbol string, ts timestamp, side string, vol long"
    rows = [("A", t + dt.timedelta(minutes=m), "PS", 100) for m in (0, 5, 9, 40, 200)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = _run(spark, live.order_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "runs")
    assert sorted(r["n"] for r in out) == [1, 3]  # the last one is still open


def test_a_bar_of_today_is_settled_at_half_past_three(spark):
    own = spark.createDataFrame([("A", D(2024, 1, 1)), ("A", D(2024, 1, 2))], "symbol string, d date")
    at = lambda clock: ingest.drop_unsettled(own, F.to_timestamp(F.lit(f"2024-01-02 {clock}"))).count()
    assert (at("15:29:59"), at("15:30:00")) == (1, 2)


def test_a_scale_learns_of_a_day_only_when_its_horizon_is_over(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    flat = dict(q5=-0.02, q10=-0.01, q25=-0.005, q50=0.0, q75=0.005, q90=0.01, q95=0.02)
    cone = spark.createDataFrame([("A", d, 5, *flat.values()) for d in days], "symbol string, d date, h int, " + ", ".join(f"{k} double" for k in flat))
    real = spark.createDataFrame([("A", d, 5, 0.015) for d in days], "symbol string, d date, h int, ret double")
    calendar = spark.createDataFrame(list(zip(days, range(12))), "d date, session int")
    out = regime.sequential(cone, real, calendar).where("level = 80").orderBy("d").collect()
    s, expected = 1.0, []
    for i in range(12):
        if i >= 5:  # the miss of five sessions before
            s = round(s * math.exp(0.05 * 0.8), 4)
        expected.append(s)
    assert [round(r["s"], 4) for r in out] == expected and all(r["hit"] == 0.0 for r in out)


def test_rows_of_a_pool_are_numbered_over_symbols(spark):
    rows = [("p", s, D(2024, 1, i), [float(i)]) for s, n in (("B", 3), ("A", 2)) for i in range(1, n + 1)]
    out = regime.numbered_pools(spark.createDataFrame(rows, "pool string, symbol string, d date, steps array<double>"), ["pool"])
    assert [(r["row"], r["steps"][0]) for r in out.orderBy("row").collect()] == [(0, 1.0), (1, 2.0), (2, 1.0), (3, 2.0), (4, 3.0)]


def test_what_chains_and_large_orders_have_in_common_counts_once(spark):
    days = spark.createDataFrame([("A", D(2024, 1, 1), 5000.0, 1000.0)], "symbol string, d date, whale_buy double, whale_sell double")
    found = spark.createDataFrame([("A", D(2024, 1, 1), "B", 100, [10.0, 50.0])], "symbol string, d date, side string, size long, prices array<double>")
    members = spark.createDataFrame([("A", D(2024, 1, 1), "S", 5000.0, True), ("A", D(2024, 1, 1), "B", 400.0, False)], "symbol string, d date, side string, val double, in_basket boolean")
    r = flow.combined(days, found, members, 2000.0).first()
    # chains 1000 + 5000, of which 5000 is large already; the basket's large sale of 5000 does not count
    assert (r["whale"], r["algo"], r["bk"], r["comb"]) == (4000.0, 6000.0, -5000.0, 4000.0 + 1000.0 + 5000.0)


def test_event_statistics_leave_out_the_hard_year(spark):
    rows = [("x", y, net, 0.01) for y, net in ((2020, 0.05), (2021, -0.30), (2022, 0.03)) for _ in range(5)]
    r = evaluate.event_stats(spark.createDataFrame(rows, "code string, year int, net double, base double"), F.lit(2021), F.lit(2021)).first()
    assert abs(r["excess_outside"] - 0.03) < 1e-12 and abs(r["before"] - 0.04) < 1e-12 and abs(r["after"] + 0.145) < 1e-12
    assert (r["years_won"], r["years"]) == (2, 3)
