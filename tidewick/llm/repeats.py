"""Search for repeated windows of a corpus, which the two substring operators share.

A window is `win` consecutive symbols (words or bytes) of one document. Suffixes are followed from
content-chosen anchors (see common.anchors) only: equal windows have equal anchors at equal offsets,
so it is enough to compare, anchor by anchor, the runs of windows around them. A run is a range of
window starts; its key, a prefix that all its windows share, deals runs to groups; its class is the
runs that are equal as a whole.

Members of a class are settled by counts, whatever their number. Then one run of each class is left,
and only where a group has several classes. A group that fits into memory is opened there: its
windows are sorted and equal ones found (subtree). A larger one is dealt again by longer prefixes:
its runs are cut into narrower slices, whose windows share more symbols, down to single windows.

Two runs count as equal when the 64-bit hashes both of their key and of the whole run are equal, two
windows when those of key and window are. No hash is linear in its symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, SPACE, Hashes, anchors, free, mixed, small_batches, stored, word_ids, word_symbols, words_of

#: Bytes of text that are worked on at once; longer documents are cut into overlapping parts.
BUFFER = 1 << 19
#: Runs of a group that is opened in memory, and of all groups that one task opens together, about.
GROUP_RUNS = 4096
TASK_RUNS = 20_000


@dataclass(frozen=True)
class Kind:
    """What a symbol is, and the lengths that go with it."""

    words: bool
    win: int
    gram: int  # symbols of an anchor, the first prefix
    widths: tuple[int, ...]  # of the slices by which runs are cut, ending with 1

    def symbols(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of some texts and the bounds of each text."""
        if not self.words:
            sizes = np.array([len(r) for r in raws], np.int64)
            return np.frombuffer(b"".join(raws), np.uint8), np.r_[0, np.cumsum(sizes)]
        data, first, last, bounds = split(raws)
        return word_symbols(data, first, last), bounds

    def body(self, text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """What the windows that start in lo:hi cover, of each range."""
        first, end = lo, hi + (self.win - 1)
        if self.words:
            a, b = words_of(np.frombuffer(text, np.uint8))
            first, end = a[lo], b[end - 1]
        return [text[x:y] for x, y in zip(first.tolist(), end.tolist(), strict=True)]


def split(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, first and last-plus-one byte of their words, and the words of each text."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    first, last = words_of(data)
    return data, first, last, np.searchsorted(first, np.r_[0, np.cumsum([len(r) + 1 for r in raws])])


def raw(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def batched(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BUFFER bytes together, a longer one alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BUFFER:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def _parts(texts: list[bytes], kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Symbols, bounds, the text of each bound and where in it a part starts: parts share all but one symbol of a window."""
    for i, j in batched(texts):
        if j - i > 1 or len(texts[i]) <= 2 * BUFFER:
            yield *kind.symbols(texts[i:j]), np.arange(i, j), 0
            continue
        text, step = texts[i], BUFFER
        if kind.words:
            first, last = words_of(np.frombuffer(text, np.uint8))
            step = max(BUFFER // 8, kind.win)
        n = len(first) if kind.words else len(text)
        for a in range(0, n - kind.win + 1, step):
            b = min(a + step + kind.win - 1, n)
            part = text[first[a] : last[b - 1]] if kind.words else text[a:b]
            yield *kind.symbols([part]), np.array([i]), a


_ROWS = "key long, u long, doc_id long, h long, at int, lo int, hi int"


def _runs(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """The runs around the anchors of each document (doc_id, h, text)."""
    for batch in batches:
        for symbols, bounds, own, base in _parts([raw(t) for t in batch.column(2)], kind):
            if len(symbols) < kind.win:
                continue
            hashes = Hashes(symbols, kind.win)
            g, doc, at, far, near = anchors(hashes.grams(kind.gram), bounds, kind.win, kind.gram)
            if not len(g):
                continue
            lo, hi = at - far, at - near + 1
            u = mixed(hashes.ranges(lo, hi - 1 + kind.win, kind.win) + (far * 65536 + near).astype(np.uint64))
            move = bounds[doc] - base
            row = pa.array(own[doc])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(u.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), *(pa.array((x - move).astype(np.int32)) for x in (at, lo, hi))],
                ["key", "u", "doc_id", "h", "at", "lo", "hi"],
            )


def _bodies(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """What runs of documents (doc_id, h, text, runs) cover."""
    for batch in batches:
        held = batch.column(3)
        flat = held.flatten()
        at, lo, hi = (flat.field(k).to_numpy() for k in ("at", "lo", "hi"))
        sizes = held.value_lengths().to_numpy()
        ends = np.r_[0, np.cumsum(sizes)]
        body = [b for i, t in enumerate(batch.column(2)) for b in kind.body(raw(t), lo[ends[i] : ends[i + 1]], hi[ends[i] : ends[i + 1]])]
        row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        yield pa.RecordBatch.from_arrays(
            [flat.field("key"), flat.field("n"), batch.column(0).take(row), batch.column(1).take(row), pa.array(at), pa.array(lo), pa.array(hi), pa.array(body, pa.binary())],
            ["key", "n", "doc_id", "h", "at", "lo", "hi", "body"],
        )


def _slices(batches: Iterator[pa.RecordBatch], kind: Kind, width: int) -> Iterator[pa.RecordBatch]:
    """Runs with their bodies, cut into slices of `width` window starts, at equal offsets from the anchor."""
    for batch in batches:
        bodies = batch.column(7).to_pylist()
        for i, j in batched(bodies):
            symbols, bounds = kind.symbols(bodies[i:j])
            at, lo, hi = (batch.column(k).to_numpy()[i:j].astype(np.int64) for k in (4, 5, 6))
            q0, q1 = (at - hi + 1) // width, (at - lo) // width
            n = q1 - q0 + 1
            pick = np.repeat(np.arange(j - i), n)
            q = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n) + q0[pick]
            a = at[pick]
            x, y = np.maximum(lo[pick], a - (q + 1) * width + 1), np.minimum(hi[pick], a - q * width + 1)
            move = bounds[:-1][pick] - lo[pick]  # of a place in the document, to its place in the buffer
            hashes = Hashes(symbols, kind.win)
            # what all windows of a whole slice have in common is the new key
            core = a - q * width + move
            key = mixed(hashes.ranges(core, core + kind.win - width + 1, kind.win - width + 1) + mixed(q.astype(np.uint64)))
            u = mixed(hashes.ranges(x + move, y - 1 + kind.win + move, kind.win) + ((a - x) * 65536 + (a - y)).astype(np.uint64))
            row = pa.array(i + pick)
            for s in range(0, len(pick), 1 << 14):
                e = slice(s, s + (1 << 14))
                body = [b for r, v, w in zip(pick[e].tolist(), (x - lo[pick])[e], (y - lo[pick])[e], strict=True) for b in kind.body(bodies[i + r], np.array([v]), np.array([w]))]
                own = row.slice(s, 1 << 14)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[e].view(np.int64)), pa.array(u[e].view(np.int64)), batch.column(2).take(own), batch.column(3).take(own), *(pa.array(v[e].astype(np.int32)) for v in (a, x, y)), pa.array(body, pa.binary())],
                    ["key", "u", "doc_id", "h", "at", "lo", "hi", "body"],
                )


def _ranks(ids: np.ndarray, win: int) -> np.ndarray:
    """The rank of every suffix to the depth of `win` symbols, by those of its halves: equal for equal windows."""
    rank, size, at = {1: ids.astype(np.int64)}, 1, 1
    while 2 * size <= win:
        rank[2 * size] = _joined(rank[size], rank[size], size)
        size *= 2
    out, at = rank[size], size
    for part in sorted(rank, reverse=True):
        while at + part <= win:
            out, at = _joined(out, rank[part], at), at + part
    return out


def _joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    n = max(len(b) - by, 0)
    return np.unique(a[:n] * (int(b.max(initial=0)) + 1) + b[by:][:n], return_inverse=True)[1]


def _subtrees(table: pa.Table, kind: Kind, first_stays: bool) -> pa.Table:
    """Ranges of the windows to remove, of some whole groups of runs: nodes of the depth of a window with several leaves."""
    key, at, lo, hi = (table.column(c).to_numpy() for c in ("key", "at", "lo", "hi"))
    at, lo, hi = (x.astype(np.int64) for x in (at, lo, hi))
    bodies = table.column("body").to_pylist()
    n = hi - lo
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    if kind.words:
        data, first, last, bounds = split(bodies)
        window = _ranks(word_ids(data, first, last)[0], kind.win)[bounds[:-1][run] + step].astype(np.uint64)
    else:
        symbols, bounds = kind.symbols(bodies)
        window = Hashes(symbols, kind.win).grams(kind.win)[bounds[:-1][run] + step]
    # equal windows lie equally far from the anchor of one group
    node = mixed(window + mixed(key[run].view(np.uint64) + (at - lo)[run].astype(np.uint64) - step.astype(np.uint64)))
    order = np.argsort(node, kind="stable")
    node, group = node[order], key[run][order]
    start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (group[1:] != group[:-1])]) if len(node) else np.zeros(0, np.int64)
    leaves = np.diff(np.r_[start, len(node)])
    gone = np.zeros(len(node), bool)
    if first_stays and len(start):
        place = _places(table)[run][order]
        gone[order] = place > np.repeat(np.minimum.reduceat(place, start), leaves)
    elif len(start):
        gone[order] = np.repeat(leaves > 1, leaves)
    edge = np.r_[True, (gone[1:] != gone[:-1]) | (run[1:] != run[:-1])] if len(gone) else np.zeros(0, bool)
    a = np.flatnonzero(edge)
    b = np.r_[a[1:], len(gone)]
    a, b = a[gone[a]] if len(a) else a, b[gone[a]] if len(a) else b
    own = pa.array(run[a])
    x = lo[run[a]] + step[a]
    return pa.table({"doc_id": table.column("doc_id").take(own), "h": table.column("h").take(own), "lo": pa.array(x.astype(np.int32)), "hi": pa.array((x + b - a).astype(np.int32))})


def _places(table: pa.Table) -> np.ndarray:
    """The rank of each run by doc_id (none last), hash of the text and place, equal for equal ones."""
    doc = table.column("doc_id")
    parts = [doc.is_null().to_numpy().astype(np.int64), doc.fill_null(0).to_numpy(), table.column("h").to_numpy(), table.column("at").to_numpy().astype(np.int64)]
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(order), bool)
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _place() -> Column:
    """Where a run is, in the order of occurrence."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "lo")


def _settled(rows: DataFrame) -> DataFrame:
    """Rows of which another has the key, with n (rows of the key), several (its classes are), copies of the class and whether the row stays.

    Rows are shuffled once, by key, and classes lie within. A key of more than a HEAVY-th of all rows,
    of which there are fewer than HEAVY, is dealt by class instead and counts as having several; a class
    as large as that is settled by map-side combined counts, which are broadcast, and its rows stay apart.
    """
    total = rows.count()
    found = rows.agg(F.expr(f"approx_top_k(key, {HEAVY}, {8 * HEAVY})").alias("top")).first()["top"]
    heavy = [x["item"] for x in found if x["count"] > max(1, total // HEAVY)]  # a frequent-items summary of fixed size has them all
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)
    rows = rows.withColumn("place", _place())
    classes = rows.where(is_heavy).groupBy(F.col("key").alias("k"), F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("f"))
    large = F.broadcast(classes.where(F.col("c") > max(1, total // HEAVY)))
    apart = F.xxhash64("key", "u", F.when(F.col("c").isNotNull(), F.xxhash64("place")))
    dealt = rows.join(large, (F.col("key") == F.col("k")) & (F.col("u") == F.col("v")), "left").withColumn("deal", F.when(is_heavy, apart).otherwise(F.col("key")))
    same = Window.partitionBy("deal", "key", "u")
    dealt = dealt.withColumns({"copies": F.count(F.lit(1)).over(same), "first": F.min("place").over(same)})
    group = Window.partitionBy("deal", "key")
    dealt = dealt.withColumns({"n": F.count(F.lit(1)).over(group), "several": F.min("u").over(group) != F.max("u").over(group)})
    dealt = dealt.withColumns(
        {
            "n": F.when(is_heavy, F.lit(total)).otherwise(F.col("n")),
            "several": is_heavy | F.col("several"),
            "copies": F.coalesce("c", "copies"),
            "stays": F.col("place") == F.coalesce("f", "first"),
        }
    )
    return stored(dealt.where("n > 1").drop("place", "first", "deal", "k", "v", "c", "f"))


def _folded(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with one row for all that are alike in doc_id and h, and those that stand for several; docs as they are if there are none.

    Both aggregates are combined before the shuffle, so a document that a third of the rows hold costs a row a task.
    """
    alike = docs.groupBy("doc_id", "h")
    if alike.count().where("count > 1").isEmpty():
        return docs, None
    folded = stored(alike.agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n")))
    return folded.select("doc_id", "h", "text"), folded.where("n > 1")


def repeated(docs: DataFrame, kind: Kind, first_stays: bool) -> DataFrame:
    """doc_id, h, lo, hi: ranges of starts of the windows to remove.

    docs has doc_id, h (a hash of the text) and text; rows alike in both are searched as one document,
    however many there are. With first_stays a window stays in the document of the smallest doc_id (none:
    after all others), then h, then start; otherwise every window that starts at two places goes, and so
    do all of a document that several rows hold.
    """
    small_batches(docs.sparkSession)
    docs, again = _folded(docs)
    found = []
    if again is not None and not first_stays:
        size = F.size(F.filter(F.split("text", SPACE), lambda w: w != "")) if kind.words else F.octet_length("text")
        whole = again.select("doc_id", "h", F.lit(0).alias("lo"), (size - (kind.win - 1)).cast("int").alias("hi"))
        found.append(whole.where("hi > 0"))
    rows = stored(docs.mapInArrow(partial(_runs, kind=kind), _ROWS))
    for width in (*kind.widths, 0):
        met = _settled(rows)
        free(rows)
        copies = met.where("copies > 1 AND NOT stays" if first_stays else "copies > 1")
        found.append(stored(copies.select("doc_id", "h", "lo", "hi")))
        left = met.where("several AND stays")
        if "body" not in met.columns:
            left = left.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "n", "at", "lo", "hi")).alias("runs"))
            left = with_lists(docs, left, "runs", "inner").mapInArrow(partial(_bodies, kind=kind), _ROWS.replace("u long", "n long") + ", body binary")
        else:
            left = left.select("key", "n", "doc_id", "h", "at", "lo", "hi", "body")
        left = stored(left)
        free(met)
        tasks = max(1, left.count() // TASK_RUNS)
        small = left.where(F.col("n") <= GROUP_RUNS).groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
        small = small.applyInArrow(lambda groups: _subtrees(groups, kind, first_stays), "doc_id long, h long, lo int, hi int")
        found.append(stored(small))
        deep = left.where(F.col("n") > GROUP_RUNS)
        if not width or deep.isEmpty():
            break
        rows = stored(deep.mapInArrow(partial(_slices, kind=kind, width=width), _ROWS + ", body binary"))
        free(left)
    free(left)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_lists(docs: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """docs (doc_id, h, text) with the list of each document."""
    lists = lists.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), name)
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), how).select("doc_id", "h", "text", name)


def with_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, h, text) with the ranges of each document, null where there are none."""
    lists = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return with_lists(docs, lists, "ranges", "left")


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def covered(ranges: pa.ListArray, bounds: np.ndarray, win: int) -> np.ndarray:
    """Which symbols of some texts are covered by windows that start in the ranges of each text."""
    flat, sizes = ranges.flatten(), ranges.value_lengths().fill_null(0).to_numpy()
    move = np.repeat(bounds[:-1], sizes)
    n = int(bounds[-1])
    change = np.bincount(flat.field("lo").to_numpy() + move, minlength=n + 1) - np.bincount(flat.field("hi").to_numpy() - 1 + win + move, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each text's symbols are marked."""
    total = np.r_[0, np.cumsum(mask)]
    return total[bounds[1:]] - total[bounds[:-1]]
