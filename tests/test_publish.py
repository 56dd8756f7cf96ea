"""The ledger of scored cones and the publish step: repeated, late and changed input."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

from pyspark.sql import functions as F

from tidewick.operators import ledger
from tidewick.streaming import publish

DAY = [dt.date(2021, 3, 1) + dt.timedelta(days=k) for k in range(30)]


def test_ledger_scores_each_key_once(spark, tmp_path):
    rnd = random.Random(3)
    close = {(s, d): 10 * math.exp(rnd.gauss(0, 0.05)) for s in "ABC" for d in DAY if rnd.random() > 0.1}
    bars = spark.createDataFrame([(s, d, c) for (s, d), c in close.items()], "symbol string, d date, c double")
    cones = {(s, d, h): [-0.1, -0.06, -0.02, 0.0, 0.02, 0.06, 0.1] for (s, d) in close for h in (5, 10)}
    quantiles = "q5 double, q10 double, q25 double, q50 double, q75 double, q90 double, q95 double"
    issued = spark.createDataFrame([(s, d, h, *q) for (s, d, h), q in cones.items()], f"symbol string, d date, h int, {quantiles}")
    calendar = ledger.sessions(bars)
    path = str(tmp_path / "ledger")
    ledger.append(ledger.matured(issued, bars, calendar, 1, 20), path)
    ledger.append(ledger.matured(issued, bars, calendar, 12, 30), path)  # nine sessions again
    ledger.append(ledger.matured(issued, bars, calendar, 1, 30), path)  # all of them
    rows = spark.read.parquet(path).collect()
    keys = [(r["d"], r["h"], r["level"]) for r in rows]
    assert len(keys) == len(set(keys))
    want = {}
    for (s, d, h), q in cones.items():
        k = DAY.index(d) + h
        if k < 30 and (s, DAY[k]) in close:
            ret = math.log(close[s, DAY[k]] / close[s, d])
            for level, (a, b) in {50: (2, 4), 80: (1, 5), 90: (0, 6)}.items():
                want.setdefault((d, h, level), []).append(q[a] <= ret <= q[b])
    assert {(r["d"], r["h"], r["level"]): (r["n"], round(r["hit"], 9)) for r in rows} == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
    # what was scored stays, whatever a later run would say
    other = ledger.matured(issued.withColumn("q90", F.lit(9.0)), bars, calendar, 1, 30)
    again = ledger.merged(spark.read.parquet(path), other).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def files(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_publish_step(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "published")
    step = publish.publisher(store, out, lambda rows: rows.groupBy("d").agg(F.count(F.lit(1)).alias("symbols"), F.sum("total").alias("total")))
    frame = lambda *rows: spark.createDataFrame(rows, "symbol string, d date, est boolean, total long")
    read = lambda: {r["d"]: (r["symbols"], r["total"]) for r in spark.read.parquet(out).collect()}
    first = frame(("A", DAY[0], False, 5), ("B", DAY[0], False, 7), ("A", DAY[1], True, 3))
    step(first, 0)
    assert read() == {DAY[0]: (2, 12), DAY[1]: (1, 3)}
    before = files(out)
    step(first, 0)  # a replay
    assert files(out) == before
    step(frame(("C", DAY[0], False, 1)), 1)  # a late symbol
    assert read() == {DAY[0]: (3, 13), DAY[1]: (1, 3)}
    after = files(out)
    assert {f for f in before if "2021-03-02" in f} == {f for f in after if "2021-03-02" in f}  # the other day's files stay
    step(frame(("A", DAY[0], True, 99)), 2)  # an estimate of what is real
    assert files(out) == after
    step(frame(("A", DAY[1], False, 4)), 3)  # what is real replaces an estimate
    assert read() == {DAY[0]: (3, 13), DAY[1]: (1, 4)}
    step(frame(), 4)
    assert read()[DAY[1]] == (1, 4)


def test_publish_from_a_stream(spark, tmp_path):
    source, store, out = (str(tmp_path / x) for x in ("in", "store", "published"))
    schema = "symbol string, d date, est boolean, total long"
    step = publish.publisher(store, out, lambda rows: rows.groupBy("d").agg(F.sum("total").alias("total")))
    for part in ([("A", DAY[0], False, 5)], [("B", DAY[0], False, 6), ("A", DAY[1], False, 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r["d"]: r["total"] for r in spark.read.parquet(out).collect()} == {DAY[0]: 11, DAY[1]: 2}
