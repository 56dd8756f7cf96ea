"""Hard negatives: product-quantised scores with rigorous residual bounds, integer reranking of what the bounds leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import embeddings, finite, lists, matrix, scaled

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: The quantiser: components of a part, entries of its codebook, rows it is fitted on (those of the least hashes), rounds.
PART, ENTRIES, SAMPLE, ROUNDS = 2, 256, 8192, 8
#: Rows of a tile of the index, anchors of a block, and anchors that one scan may broadcast.
TILE, BLOCK, BROADCAST = 8192, 256, 65536


def fit_books(sample: np.ndarray) -> np.ndarray:
    """Integer codebooks (parts, entries, PART) by Lloyd's rounds on a sample of integer vectors.

    They decide how tight the bounds are, never what is found.
    """
    n, width = sample.shape
    books = np.zeros((width // PART, min(ENTRIES, max(n, 1)), PART), np.int64)
    for m in range(width // PART):
        x = sample[:, m * PART : (m + 1) * PART].astype(float)
        book = np.unique(x, axis=0)
        book = book[np.linspace(0, len(book) - 1, books.shape[1]).astype(int)] if len(book) else np.zeros((1, PART))
        for _ in range(ROUNDS):
            own = _nearest(x, book)
            count = np.bincount(own, minlength=len(book))
            total = np.stack([np.bincount(own, x[:, j], len(book)) for j in range(PART)], axis=1)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
        books[m] = np.rint(book)
    return books


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)


def _encode(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and the norms of the residuals, rounded up."""
    codes = np.empty((len(v), len(books)), np.uint8)
    rest = v.copy()
    for m, book in enumerate(books):
        part = slice(m * PART, (m + 1) * PART)
        codes[:, m] = _nearest(v[:, part].astype(float), book.astype(float))
        rest[:, part] -= book[codes[:, m]]
    return codes, np.sqrt((rest.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9


_TILE = "ids array<long>, labels array<long>, codes binary, norms array<double>, v array<long>"


def build_index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Tiles of up to TILE rows of (vec_id, label, v): their ids, labels, codes, residual norms and vectors."""
    width = books.shape[0] * PART

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            codes, norms = _encode(v, books)
            one = [lists(x.reshape(1, -1), k) for x, k in ((ids, pa.int64()), (labels, pa.int64()))]
            one += [pa.array([codes.tobytes()], pa.binary()), lists(norms.reshape(1, -1), pa.float64()), lists(v.reshape(1, -1), pa.int64())]
            return pa.RecordBatch.from_arrays(one, names=["ids", "labels", "codes", "norms", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                b = batch.slice(at, TILE)
                held.append((b["vec_id"].to_numpy(), b["label"].to_numpy(), matrix(b["v"], width)))
                if sum(len(x[0]) for x in held) >= TILE // 2:
                    yield tile(held)
                    held = []
        if held:
            yield tile(held)

    return rows.mapInArrow(tiles, _TILE)


class _Pairs:
    """A tile against a block of anchors: bounds of all scores from the codes, exact scores where asked."""

    def __init__(self, tile: dict, anchors: np.ndarray, books: np.ndarray):
        self.ids, self.labels = (np.asarray(tile[k]) for k in ("ids", "labels"))
        n = len(self.ids)
        self.v = np.asarray(tile["v"]).reshape(n, -1)
        codes = np.frombuffer(tile["codes"], np.uint8).reshape(n, len(books))
        self.anchors = anchors
        score = np.zeros((n, len(anchors)), np.int64)
        for m, book in enumerate(books):
            score += (book @ anchors[:, m * PART : (m + 1) * PART].T)[codes[:, m]]
        reach = np.ceil(np.asarray(tile["norms"])[:, None] * (np.sqrt((anchors.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9))).astype(np.int64)
        self.least, self.most = np.ascontiguousarray((score - reach).T), np.ascontiguousarray((score + reach).T)

    def exact(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return self.v[rows] @ self.anchors[anchor]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k different (score, id) by falling score, then rising id."""
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    new = np.ones(len(score), bool)
    new[1:] = (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    return score[new][:k], ids[new][:k]


def _floor_of(least: np.ndarray, k: int) -> float:
    """A score that k of these rows surely reach."""
    return np.partition(least, len(least) - k)[len(least) - k] if len(least) >= k else -np.inf


_EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _positives(pairs: _Pairs, a: int, anchor_id: int, label: int, have: tuple) -> tuple:
    """The best POSITIVES rows of the anchor's label, of a tile and of what the task had."""
    rows = np.flatnonzero((pairs.labels == label) & (pairs.ids != anchor_id))
    floor = have[0][-1] if len(have[0]) >= POSITIVES else -np.inf
    if len(np.unique(pairs.ids[rows])) == len(rows):
        floor = max(floor, _floor_of(pairs.least[a, rows], POSITIVES))
    rows = rows[pairs.most[a, rows] >= floor]
    return _best(np.concatenate([have[0], pairs.exact(a, rows)]), np.concatenate([have[1], pairs.ids[rows]]), POSITIVES)


def _negatives(pairs: _Pairs, a: int, label: int, lows: np.ndarray, highs: np.ndarray, have: list[tuple]) -> list[tuple]:
    """The best NEGATIVES rows of other labels within each window, of a tile and of what the task had.

    A row is scored exactly if for some window its bounds meet the window and reach what ten rows
    surely have; a row that repeats an id only weakens the latter to what was scored before.
    """
    least, most, other = pairs.least[a], pairs.most[a], pairs.labels != label
    once = len(np.unique(pairs.ids)) == len(pairs.ids)
    wanted = np.zeros(len(other), bool)
    for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
        floor = have[w][0][-1] if len(have[w][0]) >= NEGATIVES else low
        inside = other & (least <= high) & (most >= max(low, floor))
        if once:
            floor = max(floor, _floor_of(least[inside & (least >= low) & (most <= high)], NEGATIVES))
        wanted |= inside & (most >= floor)
    rows = np.flatnonzero(wanted)
    score = pairs.exact(a, rows)
    out = []
    for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
        fit = (score >= low) & (score <= high)
        out.append(_best(np.concatenate([have[w][0], score[fit]]), np.concatenate([have[w][1], pairs.ids[rows[fit]]]), NEGATIVES))
    return out


def _meet(index: DataFrame, blocks: DataFrame, n_blocks: int, per_scan: int) -> Iterator[DataFrame]:
    """Every tile beside every block of anchors, in scans that each broadcast a bounded number of anchors."""
    for at in range(0, n_blocks, per_scan):
        last = min(at + per_scan, n_blocks) - 1
        part = blocks.where(F.col("block").between(at, last))
        yield index.withColumn("block", F.explode(F.sequence(F.lit(at), F.lit(last)))).join(F.broadcast(part), "block")


def _unioned(parts: Iterator[DataFrame]) -> DataFrame:
    """The rows of all scans; each is written before the next one runs."""
    out = None
    for part in parts:
        part = stored(part)
        out = part if out is None else out.unionByName(part)
    return out


def mine(rows: DataFrame, queries: Column, books: np.ndarray | None = None, per_scan: int = BROADCAST // BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (see the contract of op11).

    rows has vec_id, label (longs) and v (array of longs); rows for which `queries` holds are anchors.
    Rows without an id, a label or a vector take no part. Scores are by falling integer inner product,
    ties by rising vec_id; a vec_id is never its own positive, and rows that repeat an id count once for
    each score. An anchor id with several vectors or labels is as many anchors. Shorter vectors end in
    zeros. An anchor without positives, or without rows in the window, gives no rows, and an empty table
    none at all. Exact while inner products fit into 64 bits.

    The index holds all rows, in tiles that never leave their task; each scan of it meets a broadcast
    of at most per_scan blocks of anchors. A task keeps the best rows of each anchor, so what is
    shuffled is a few rows for each task and anchor, whatever labels or ids weigh. The first scan
    finds positives, whose scores set the windows of the second.
    """
    rows = stored(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // PART) * PART
    if books is None:
        sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        books = fit_books(matrix(sample, width) if len(sample) else np.zeros((0, width), np.int64))
    index = stored(build_index(rows, books))
    anchors = stored(rows.where(queries).distinct())
    n_blocks = max(-(-anchors.count() // BLOCK), 1)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n_blocks)).cast("int"))
    blocks = stored(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "v"))).alias("anchors")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for pair in (r for batch in batches for r in _each(batch)):
            anchors, vectors = _block(pair, width)
            pairs = _Pairs(pair, vectors, books)
            for a, x in enumerate(anchors):
                key = pair["block"], a
                best[key] = _positives(pairs, a, x["vec_id"], x["label"], best.get(key, _EMPTY))
        flat = [(*key, s, i) for key, b in best.items() for s, i in zip(*b, strict=True)]
        yield from _rows(flat, ["block", "a", "score", "id"])

    each = Window.partitionBy("block", "a").orderBy(F.desc("score"), "id")
    positives = (
        _unioned(p.mapInArrow(found, "block int, a int, score long, id long") for p in _meet(index, blocks, n_blocks, per_scan))
        .withColumn("rank", F.dense_rank().over(each))
        .where(F.col("rank") <= POSITIVES)
        .distinct()
    )
    windows = positives.groupBy("block").agg(F.collect_list(F.struct("a", "rank", "id", "score")).alias("positives"))
    blocks = stored(blocks.join(windows, "block"))

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        about: dict[tuple, tuple] = {}
        for pair in (r for batch in batches for r in _each(batch)):
            anchors, vectors = _block(pair, width)
            pairs = _Pairs(pair, vectors, books)
            own: dict[int, list] = {}
            for p in pair["positives"]:
                own.setdefault(p["a"], []).append((p["rank"], p["id"], p["score"]))
            for a, ps in own.items():
                key = pair["block"], a
                scores = np.array([s for _, _, s in ps])
                have = best.get(key) or [_EMPTY] * len(ps)
                about[key] = anchors[a]["vec_id"], ps
                best[key] = _negatives(pairs, a, anchors[a]["label"], -(-LOW * scores // 100), HIGH * scores // 100, have)
        flat = [
            (*key, about[key][0], p, i, ps, s)
            for key, bests in best.items()
            for (_, p, ps), b in zip(about[key][1], bests, strict=True)
            for s, i in zip(*b, strict=True)
        ]
        yield from _rows(flat, ["block", "a", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    schema = "block int, a int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    each = Window.partitionBy("block", "a", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return (
        _unioned(p.mapInArrow(mined, schema) for p in _meet(index, blocks, n_blocks, per_scan))
        .withColumn("rank", F.dense_rank().over(each))
        .where(F.col("rank") <= NEGATIVES)
        .distinct()
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, their lists of numbers as arrays."""
    for i in range(batch.num_rows):
        yield {
            name: column[i].values.to_numpy() if name in ("ids", "labels", "norms", "v") else column[i].as_py()
            for name, column in zip(batch.schema.names, batch.columns, strict=True)
        }


def _block(pair: dict, width: int) -> tuple[list[dict], np.ndarray]:
    out = np.zeros((len(pair["anchors"]), width), np.int64)
    for i, x in enumerate(pair["anchors"]):
        out[i, : len(x["v"])] = x["v"]
    return pair["anchors"], out


def _rows(flat: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if flat:
        kinds = [pa.int32() if n in ("block", "a") else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], names=names)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = (F.col("label").cast("long") + 1) % 10
    rows = (
        embeddings(spark, sf_dir)
        .where(finite(F.col("embedding")))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label").cast("long")).alias("label"),
            scaled(F.col("embedding"), SCALE).alias("v"),
        )
    )
    return mine(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
