"""The stream of scales against the batch fold, over restarts and replays."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidewick.operators import regime
from tidewick.streaming import calibration


@pytest.fixture
def days(spark):
    """Cells of 60 sessions for all horizons and levels, as daily_cells gives them."""
    rnd = random.Random(4)
    rows = []
    for session in range(1, 61):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=session)
        for h in regime.HORIZONS:
            for level in regime.LEVELS:
                cells = [(rnd.randint(0, 25000), rnd.randint(1, 4)) for _ in range(rnd.randint(1, 9))]
                rows.append((session, d, h, level, cells))
    return rows


SCHEMA = "session int, d date, h int, level int, cells array<struct<cell: bigint, n: bigint>>"


def folded(rows):
    scales = {(h, level): regime.Scale(h, level) for h in regime.HORIZONS for level in regime.LEVELS}
    return sorted((d, h, level, *scales[h, level].day(session, cells)) for session, d, h, level, cells in sorted(rows))


def test_stream_equals_fold_over_restarts_and_replays(spark, days, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", calibration.STATE_STORE)
    try:
        source, out = str(tmp_path / "days"), str(tmp_path / "out")
        for part in ([r for r in days if r[0] <= 25], [r for r in days if 20 < r[0] <= 40], [r for r in days if r[0] > 40]):  # five sessions come twice
            spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            query = calibration.calibrated(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(out)
            query.awaitTermination()  # the next one goes on from the checkpoint
        got = sorted((r["d"], r["h"], r["level"], r["s"], r["hit"]) for r in spark.read.parquet(out).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == folded(days)


def test_scale_by_hand():
    scale = regime.Scale(5, 80)
    assert scale.day(1, [(9000, 1), (12000, 1)]) == (1.0, 0.5)
    assert all(scale.day(k, [(9000, 1)])[0] == 1.0 for k in (2, 3, 4, 5))
    s, _ = scale.day(6, [(9000, 1)])  # the first day's share is known now
    assert s == 1.0151 and scale.hits == [0.5] and scale.day(6, [(1, 1)]) is None
    assert len(scale.due) == 5
