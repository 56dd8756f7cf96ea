"""Cones of pools that one task holds whole against those that go by slices, and what is shuffled."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewick import catalogue
from tidewick.operators import ledger, regime


@pytest.fixture(scope="module")
def tables(spark):
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int") % 500)
    members = spark.range(6000).select(F.lit("a").alias("pool"), F.lit(0).alias("level"), F.format_string("S%d", F.floor(F.col("id") / 500)).alias("symbol"), day.alias("d"), F.unix_date(day).alias("known"),
        F.transform(F.sequence(F.lit(1), F.lit(regime.STEPS)), lambda j: (F.pmod(F.xxhash64("id", j), F.lit(2001)) - 1000) / 500.0).alias("steps"))
    sizes = members.groupBy().agg(*[F.count_if(F.col("known") <= F.unix_date(F.lit(dt.date(2020, 1, 1))) + k).alias(f"n{k}") for k in (200, 450)]).collect()[0]
    target = spark.range(40).select(F.struct(F.format_string("T%d", "id").alias("symbol"), "id").alias("id"), (F.col("id") * 7919 + 13).alias("seed"), F.lit(0.02).alias("vol20"), F.when(F.col("id") % 2 == 0, 200).otherwise(450).alias("k"))
    targets = target.withColumns({"until": F.unix_date(F.lit(dt.date(2020, 1, 1))) + F.col("k"), "n": F.when(F.col("k") == 200, sizes["n200"]).otherwise(sizes["n450"]).cast("long"), "pool": F.lit("a"), "level": F.lit(0)})
    assert regime.SLICE < sizes["n200"] < 2 * regime.SLICE < sizes["n450"]
    return targets.drop("k"), members


@pytest.mark.parametrize("grown", [False, True])
def test_whole_pools_give_what_slices_give(tables, monkeypatch, grown):
    rows = lambda: sorted(tuple(r) for r in regime.cones(*tables, 40, touch=True, grown=grown).collect())
    whole = rows()
    monkeypatch.setattr(regime, "LEAST_TARGETS", 16)
    monkeypatch.setattr(regime, "BATCH", 7)
    assert rows() == whole
    monkeypatch.setattr(regime, "WHOLE", 100)
    assert rows() == whole and len(whole) == 40 * 3


def test_paths_are_not_shuffled(tables):
    plan = regime.cones(*tables, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # targets and pools


def test_rows_of_unwanted_prefixes_stay_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with sizes that Spark does not know
    axes = ", ".join(f"{a} string" for a in regime.AXES)
    rows = spark.createDataFrame([("A", dt.date(2020, 1, k + 1), [0.5] * regime.STEPS, "low" if k % 2 else "high", *["no"] * 5) for k in range(8)], f"symbol string, d date, steps array<double>, {axes}")
    wanted = spark.createDataFrame([("low", 5)], "pool string, level int")
    out = regime.next_row(rows, wanted.unionByName(wanted))
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan.splitlines())
        assert sorted(r["row"] for r in out.collect()) == [0, 1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_pool_is_copied_for_twice_its_rows():
    assert [regime.copies(t, 80_000) for t in (1, 90_000, 160_000, 160_001)] == [1, 1, 1, 2]
    assert regime.copies(regime.LEAST_TARGETS + 1, 10) == 2


@pytest.mark.parametrize("name", ["scored_cones", "cone_hits", "pinball_loss", "coverage_by_level", "scale_fit", "maturity_ledger"])
def test_cones_are_not_shuffled_for_what_came(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and ("ret" in line or "symbol" in line) and "Inner" in line for line in plan.split("FlatMapCoGroupsInArrow")[0].splitlines())


def test_returns_over_sessions_are_those_of_a_join_with_closes(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    bars = spark.createDataFrame([(f"S{s}", day(k), 20.0 + (k * 7 + s * 3) % 11) for s in range(4) for k in range(40) if (k + s) % 6], "symbol string, d date, c double")
    calendar = ledger.sessions(bars)
    quantiles = [F.lit((q - 50) / 200.0).alias(f"q{q}") for q in regime.QUANTILES]
    horizon = F.explode(F.array(*[F.lit(h) for h in regime.HORIZONS])).alias("h")
    cones = bars.select("symbol", "d", horizon, *quantiles)
    rows = ledger.session_returns(bars, calendar, regime.HORIZONS)
    ret = F.coalesce(*[F.when(F.col("h") == h, F.col(f"sr{h}")) for h in regime.HORIZONS]).alias("ret")
    carried = ledger.matured(rows.select("symbol", "d", *[f"sr{h}" for h in regime.HORIZONS], horizon, *quantiles).select("*", ret), None, calendar, 1, 40)
    listed = lambda x: sorted(tuple(r) for r in x.select("d", "h", "level", "n", "hit", "scored_on").collect())
    assert listed(carried) == listed(ledger.matured(cones, bars, calendar, 1, 40))
    assert listed(ledger.between(carried, calendar, 12, 20)) == listed(ledger.matured(cones, bars, calendar, 12, 20)) != []
