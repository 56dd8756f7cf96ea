"""Vector code compression: codebooks for each part of a vector, by Elkan's form of Lloyd's rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, fresh, stored
from .vectors import embeddings, finite, lists, matrix, scaled

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: What a row carries from round to round: its integer components, the entry of each part, an upper bound of the
#: distance to it and a lower bound of the distance to every entry.
_STATE = "vec_id long, label {label}, v array<long>, code binary, upper array<float>, lower array<float>"


def _up(x: np.ndarray) -> np.ndarray:
    """x as 32-bit numbers that are not smaller, with room for the rounding that led to x."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """x as 32-bit numbers that are not larger and not below zero."""
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to the row of entries beside it."""
    d = v - entries
    return np.einsum("ij,ij->i", d, d)


def reassign(v: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Assigns rows of v (n, parts, size) to the nearest entries of book (parts, entries, size); returns the squared distances.

    code (n, parts), upper (n, parts) and lower (n, parts, entries) are changed in place. The bounds
    first shift by how far each entry moved. An entry is passed over only if a bound shows that it is
    strictly farther than the present one: its lower bound, or half the distance between the two
    entries, is above the upper bound. All others get their exact integer distance, and the smallest
    (distance, index) wins, so ties are never left to rounding.
    """
    n, parts, _ = v.shape
    entries = book.shape[1]
    upper[:] = _up(upper.astype(float) + moved[np.arange(parts), code])
    lower[:] = _down(lower.astype(float) - moved)
    error = np.empty((n, parts), np.int64)
    for m in range(parts):
        own = code[:, m].astype(np.int64)
        error[:, m] = squared(v[:, m], book[m, own])
        exact = np.sqrt(error[:, m].astype(float))
        upper[:, m] = np.minimum(upper[:, m], _up(exact))
        lower[np.arange(n), m, own] = np.maximum(lower[np.arange(n), m, own], _down(exact))
        between = book[m][:, None] - book[m][None]
        half = _down(np.sqrt(np.einsum("ijk,ijk->ij", between, between).astype(float)) / 2)
        open_ = (lower[:, m] <= upper[:, m, None]) & (half[own] <= upper[:, m, None])
        open_[np.arange(n), own] = False
        row, entry = np.nonzero(open_)
        if not len(row):
            continue
        d = squared(v[row, m], book[m, entry])
        lower[row, m, entry] = np.maximum(lower[row, m, entry], _down(np.sqrt(d.astype(float))))
        far = np.full((n, entries), np.iinfo(np.int64).max)
        far[row, entry] = d
        far[np.arange(n), own] = error[:, m]
        best = far.argmin(axis=1)  # the first of equal ones
        code[:, m] = best
        error[:, m] = far[np.arange(n), best]
        upper[:, m] = _up(np.sqrt(error[:, m].astype(float)))
    return error


def _advance(state: DataFrame, book: np.ndarray, moved: np.ndarray, schema: str) -> DataFrame:
    """state after one assignment to book, with the row's error."""
    parts, entries, size = book.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = matrix(batch["v"], parts * size)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, parts).copy()
            upper = matrix(batch["upper"], parts).astype(np.float32)
            lower = matrix(batch["lower"], parts * entries).astype(np.float32).reshape(n, parts, entries)
            error = reassign(v.reshape(n, parts, size), code, upper, lower, book, moved)
            columns = [batch["vec_id"], batch["label"], batch["v"], pa.array([x.tobytes() for x in code], pa.binary())]
            columns += [lists(upper, pa.float32()), lists(lower.reshape(n, -1), pa.float32()), pa.array(error.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "code", "upper", "lower", "error"])

    return state.mapInArrow(step, schema + ", error long")


def _sums(state: DataFrame, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each entry (parts, entries) and the sums of their components (parts, entries, size).

    Each task sums what it reads and sends parts * entries * size numbers; so does the driver get.
    """
    parts, entries, size = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            v = matrix(batch["v"], parts * size).reshape(-1, parts, size)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            for m in range(parts):
                count[m] += np.bincount(code[:, m], minlength=entries)
                np.add.at(total[m], code[:, m], v[:, m])
        if count.any():
            flat = np.concatenate([count.ravel(), total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])

    both = np.zeros(parts * entries * (1 + size), np.int64)
    for r in state.select("v", "code").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        both[r["at"]] = r["n"]
    return both[: parts * entries].reshape(parts, entries), both[parts * entries :].reshape(shape)


def train_codes(df: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(stored rows with vec_id, label, code and error; codebooks of shape (parts, entries, size)).

    df has vec_id, label and a vector. Rows whose vector is null or holds a null or non-finite
    component are dropped. Vectors shorter than the longest, made a multiple of PARTS, count as
    ending in zeros. The first entries are the parts of the ENTRIES smallest vec_ids (null ids last,
    repeated ids by their components); with fewer rows the codebooks are shorter. An empty table gives
    no rows and empty codebooks. Exact for components below 2**28 in size after scaling.

    A round is one pass over the rows where they lie: it reads the last round's rows and bounds from
    the shared folder, writes the new ones there and sums the parts of each entry within the task.
    Only those sums, of a fixed number, are shuffled and reach the driver. Two rounds' rows lie in the
    folder at most, so a lost executor costs the tasks of one round.
    """
    spark = df.sparkSession
    label = df.schema["label"].dataType.simpleString()
    schema = _STATE.format(label=label)
    kept = df.where(finite(F.col(vector))).select(F.col("vec_id").cast("long"), "label", scaled(F.col(vector), SCALE).alias("v"))
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    size = -(-width // PARTS)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.zeros((len(first), PARTS * size), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    book = start.reshape(len(first), PARTS, size).transpose(1, 0, 2).copy()
    if not len(first):
        return spark.createDataFrame([], f"vec_id long, label {label}, code binary, error long"), book
    entries = book.shape[1]
    state = kept.select(
        "*",
        F.lit(bytes(PARTS)).alias("code"),
        F.array_repeat(F.lit(float("inf")).cast("float"), PARTS).alias("upper"),
        F.array_repeat(F.lit(0).cast("float"), PARTS * entries).alias("lower"),
    )
    moved, before = np.zeros((PARTS, entries)), None
    for _ in range(rounds):
        state = stored(_advance(state.drop("error"), book, moved, schema))
        if before is not None:
            free(before)
        before = state
        count, total = _sums(state, book.shape)
        new = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], book)
        moved = np.sqrt(((new - book).astype(float) ** 2).sum(axis=2)) * (1 + 1e-12)
        book = new
    out = stored(_advance(state.drop("error"), book, moved, schema).select("vec_id", "label", "code", "error"))
    if before is not None:
        free(before)
    return out, book


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of the same label; null labels belong together.

    Sums are combined before the shuffle. Labels of more than one row in 1,024 are few and come by
    broadcast; rows of the others are shuffled to their label, none of which has more rows than that.
    """
    label, total, heavy = fresh(coded, "l", "label_error", "heavy")
    sums = stored(coded.groupBy(F.col("label").alias(label)).agg(F.sum("error").alias(total), F.count(F.lit(1)).alias(heavy)))
    bound = max(8, (sums.agg(F.sum(heavy)).first()[0] or 0) // 1024)
    same = F.col("label").eqNullSafe(F.col(label))
    few, rest = (sums.where(x).drop(heavy) for x in (F.col(heavy) > bound, F.col(heavy) <= bound))
    hot = coded.join(F.broadcast(few), same).drop(label)
    return hot.unionByName(coded.join(F.broadcast(few.select(label)), same, "left_anti").join(rest, same).drop(label))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, book = train_codes(embeddings(spark, sf_dir))
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
