"""Operators on embeddings against brute force: ties, repeated rows, nulls, odd lengths, hot labels."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewick.llm import hard_negatives, vector_codes  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, source string, v string"


def table(seed: int, n: int, width: int = 16):
    """Clustered vectors with equal ones, one label of a third of the rows, and rows that take no part."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, width))
    rows = []
    for i in range(n):
        label = int(rnd.integers(0, 9)) if i % 3 else 4
        v = [float(np.float32(x)) for x in centres[label % 6] / 3 + rnd.normal(size=width) / 4]
        if i % 10 == 7:
            v = rows[-1][1] or v  # equal vectors: ties
        rows.append((i, v, label, "s", "x"))
    rows += [(n, None, 1, None, None), (n + 1, [None, *[0.5] * (width - 1)], 1, None, None), (n + 2, [float("nan")] * width, 2, None, None)]
    rows += [(n + 3, [float("inf"), *[0.0] * (width - 1)], 2, None, None), (n + 4, [0.25] * width, None, None, None), (n + 5, [], 3, None, None), (n + 6, [0.5], 3, None, None)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.fixture
def written(spark, tmp_path):
    def write(rows, parts=5):
        spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)

    return write


def triples(rows):
    return [(r[0], r[2], r[1]) for r in rows]


def test_op11_equals_brute_force(spark, written, monkeypatch):
    rows = table(1, 700)
    padded = [(i, n, v if v is None or not brute.usable(v) else v + [0.0] * (16 - len(v))) for i, n, v in triples(rows)]
    want = brute.negatives(padded)
    assert len(want) > 100
    path = written(rows)
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, path).collect())) == want
    # many tiles, blocks and scans give the same
    monkeypatch.setattr(hard_negatives, "TILE", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    rows_ = spark.read.parquet(f"{path}/embeddings.parquet").where(hard_negatives.finite(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows_ = rows_.select("vec_id", label.alias("label"), hard_negatives.scaled(F.col("embedding"), 256).alias("v"))
    assert sorted(map(tuple, hard_negatives.mine(rows_, F.col("vec_id") % 100 == 0, per_scan=2).collect())) == want


def test_op11_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    v = np.floor(256 * (rnd.normal(size=(3000, 16)) / 4)).astype(np.int64)
    books = hard_negatives.fit_books(v[:1000])
    codes, norms = hard_negatives._encode(v, books)
    tile = {"ids": np.arange(3000), "labels": np.arange(3000) % 7, "codes": codes.tobytes(), "norms": norms, "v": v.ravel()}
    pairs = hard_negatives._Pairs(tile, v[:40], books)
    exact = v[:40] @ v.T
    assert (pairs.least <= exact).all() and (exact <= pairs.most).all()
    floor = np.partition(pairs.least, -5, axis=1)[:, -5]
    assert (pairs.most >= floor[:, None]).mean() < 0.2


def test_op11_repeated_rows_and_ids(spark, written):
    rows = table(2, 300)
    path = written(rows)
    once = sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, path).collect()))
    path = written(rows * 3 + [(None, [0.5] * 16, 4, None, None)] * 4, 7)
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, path).collect())) == once


def test_op11_all_equal(spark, written):
    rows = [(i, [0.5] * 8, i % 2, None, None) for i in range(1, 210)]
    got = sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, written(rows)).collect()))
    assert got == brute.negatives(triples(rows))  # no score lies below nine tenths of itself


@pytest.mark.parametrize("seed,n", [(1, 600), (2, 9), (3, 40)])
def test_op13_equals_brute_force(spark, written, seed, n):
    rows = table(seed, n)
    rows += rows[:3] + [(None, [0.125] * 16, None, None, None)] * 2
    got = sorted(map(tuple, vector_codes.op13_vector_codes(spark, written(rows)).collect()), key=str)
    assert got == brute.vector_codes(triples(rows))


def test_op13_ties_go_to_the_lower_entry(spark, written):
    """Integer grids are full of equal distances."""
    rnd = random.Random(7)
    rows = [(i, [rnd.randint(-2, 2) / 4096 for _ in range(16)], i % 3, None, None) for i in range(400)]
    got = sorted(map(tuple, vector_codes.op13_vector_codes(spark, written(rows)).collect()), key=str)
    assert got == brute.vector_codes(triples(rows))


def test_op13_bounds_save_distances():
    """Pruning is real: after some rounds most entries are passed over, and none wrongly."""
    rnd = np.random.default_rng(5)
    v = np.floor(4096 * (rnd.integers(0, 4, size=(2000, 8, 1)) + rnd.normal(size=(2000, 8, 4)) / 9)).astype(np.int64)
    book = v[:16].transpose(1, 0, 2).copy()
    code, upper, lower = np.zeros((2000, 8), np.uint8), np.full((2000, 8), np.inf, np.float32), np.zeros((2000, 8, 16), np.float32)
    moved = np.zeros((8, 16))
    for _ in range(5):
        error = vector_codes.reassign(v, code, upper, lower, book, moved)
        all_ = ((v[:, :, None] - book[None]) ** 2).sum(axis=3)
        assert (code == all_.argmin(axis=2)).all() and (error == all_.min(axis=2)).all()
        assert (lower <= np.sqrt(all_)).all() and (upper >= np.sqrt(error)).all()
        new = book.copy()
        for m in range(8):
            for k in range(16):
                if (code[:, m] == k).any():
                    new[m, k] = v[code[:, m] == k, m].sum(axis=0) // (code[:, m] == k).sum()
        moved, book = np.sqrt(((new - book) ** 2).sum(axis=2)) * (1 + 1e-12), new
    assert (lower > upper[:, :, None]).mean() > 0.5
