"""The settle gate on a stream against the batch gate, with late and missing voters, replays and restarts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewick.operators import ingest
from tidewick.streaming import calibration, settle

SCHEMA = "symbol string, d date, sec int, arrived timestamp"
LEAST = 5
AUCTION = 14 * 3600 + 45 * 60


def bar(symbol, day, sec, after=30):
    d = dt.date(2024, 3, day)
    return symbol, d, sec, dt.datetime.combine(d, dt.time()) + dt.timedelta(seconds=sec + after)


def session(day, symbols, lacking=()):
    out = [bar(s, day, 36000 + 60 * k) for s in symbols for k in range(LEAST)]
    return out + [bar(s, day, AUCTION, 30 + i) for i, s in enumerate(symbols) if s not in lacking]


TEN = [f"S{k}" for k in range(10)]
DAYS = {
    # all settle one after another: closed by the ninth; the tenth comes too late, a thin symbol has no vote
    4: session(4, TEN) + [bar("THIN", 4, AUCTION)],
    # three of ten lack: the deadline closes; one of them comes an hour after it
    5: session(5, TEN, ("S1", "S2", "S3")) + [bar("S1", 5, AUCTION, 7200)],
    # two lack, one of them comes within the deadline: closed by it
    6: session(6, TEN, ("S1", "S2")) + [bar("S2", 6, AUCTION, 900)],
    # thin symbols only: no vote, no row
    7: [bar("THIN", 7, AUCTION), bar("THIN", 7, 36000)],
    # the clock moves on
    8: session(8, TEN[:2]),
}


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", calibration.STATE_STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_closings(spark, store, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("bars", "closed", "state"))
    second = sorted(DAYS[5], key=lambda r: r[3])
    half = len(second) // 2
    parts = [DAYS[4], second[:half], second[half - 4 :] + second[half : half + 9], DAYS[6] + DAYS[7], DAYS[8]]  # bars come twice
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = settle.closings(stream, LEAST).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()  # the next one goes on from the checkpoint
    closed = spark.read.parquet(out)
    rows = {r["d"].day: r for r in closed.collect()}
    assert closed.count() == len(rows) and sorted(rows) == [4, 5, 6, 8]
    assert [(rows[k]["voters"], rows[k]["lacking"], rows[k]["wait"]) for k in (4, 5, 6, 8)] == [(10, 1, False), (10, 3, True), (10, 1, False), (2, 0, False)]
    at = lambda day, sec: dt.datetime(2024, 3, day) + dt.timedelta(seconds=sec)
    assert [rows[k]["closed_at"] for k in (4, 5, 6)] == [at(4, AUCTION + 38), at(5, settle.DEADLINE), at(6, AUCTION + 900)]

    # the batch gate over what had come by the closing says the same
    bars = settle.routed(spark.read.parquet(source), closed)
    batch = ingest.quorum(ingest.settled(bars.where("NOT is_late").dropDuplicates(["symbol", "d", "sec"])), LEAST)
    assert sorted(map(tuple, batch.collect())) == sorted((r["d"], r["voters"], r["lacking"], r["wait"]) for r in rows.values())

    # late bars are routed, and no other
    late = {(r["symbol"], r["d"].day) for r in bars.where("is_late").collect()}
    assert late == {("S9", 4), ("S1", 5)}


def test_routed_stream(spark, tmp_path):
    source, out = str(tmp_path / "bars"), str(tmp_path / "out")
    spark.createDataFrame(DAYS[4], SCHEMA).write.parquet(source)
    closed = spark.createDataFrame([(dt.date(2024, 3, 4), dt.datetime(2024, 3, 4, 14, 45, 38))], "d date, closed_at timestamp")
    stream = settle.routed(spark.readStream.schema(SCHEMA).parquet(source), closed)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == len(DAYS[4]) and got.where(F.col("is_late")).select("symbol").collect() == [("S9",)]


def test_empty_stream(spark, store, tmp_path):
    source, out = str(tmp_path / "bars"), str(tmp_path / "out")
    spark.createDataFrame([("S", None, 1, None), (None, dt.date(2024, 3, 4), 1, dt.datetime(2024, 3, 4))], SCHEMA).write.parquet(source)
    query = settle.closings(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("memory").queryName("none_closed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("none_closed").count() == 0
