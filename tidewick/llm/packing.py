"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, small_batches

#: Context sizes. A document goes to the least one that it fits; whole blocks of the largest one are cut off longer documents first.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that a task packs together; what fills no window stays for the next ones.
GROUP_TOKENS = 1 << 20
#: Tokens of a step: as many as in eight of the largest windows.
STEP_TOKENS = 8 * TIERS[0]


@cache
def byte_bpe(path: str | None = None):
    """text -> ids of the byte-level BPE of byte_bpe_50k.json, the end-of-text mark in a text included.

    tiktoken gives the same ids by the same ranks in less time, but its pattern search gives up on very
    long runs of white space; such texts go to the tokenizers library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})

    @cache
    def plain() -> Tokenizer:  # loaded where it is needed only, as each holds the vocabulary once more
        return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return plain().encode(text, add_special_tokens=False).ids

    return encode


@dataclass
class Piece:
    """Some consecutive ids of a document."""

    doc: int  # its number among the documents at hand
    start: int
    length: int


@dataclass
class Packed:
    """Windows of piece lists, each full or the last ones, and pieces that are left."""

    windows: list[tuple[int, list[Piece]]] = field(default_factory=list)  # tier, pieces
    left: list[Piece] = field(default_factory=list)


class Shelves:
    """Pieces by length, of the tiers up to one."""

    def __init__(self, pieces: list[Piece]):
        self.by: dict[int, list[Piece]] = {}
        self.count = np.zeros(TIERS[0] + 1, np.int64)
        for p in pieces:
            self.put(p)

    def put(self, piece: Piece) -> None:
        self.by.setdefault(piece.length, []).append(piece)
        self.count[piece.length] += 1

    def take(self, least: int, most: int) -> Piece | None:
        """The longest piece of least to most tokens."""
        fits = np.flatnonzero(self.count[least : most + 1])
        if not len(fits):
            return None
        n = least + int(fits[-1])
        self.count[n] -= 1
        return self.by[n].pop()


def routed(doc: int, n: int) -> list[Piece]:
    """A document of n tokens as whole blocks of the largest tier and what is left."""
    long = TIERS[0]
    return [Piece(doc, at, min(long, n - at)) for at in range(0, n, long)]


def fill(pieces: list[Piece]) -> Packed:
    """Packs each tier, the longest first, in windows of its own length.

    A window starts with the longest piece of its tier; its gap takes the longest pieces of shorter
    tiers that fit and then the first part of one that does not, so a full window has no padding. A
    window that shorter pieces cannot fill is not closed: its pieces are left.
    """
    shelves, out = Shelves(pieces), Packed()
    for tier, below in zip(TIERS, (*TIERS[1:], 0), strict=True):
        while (piece := shelves.take(below + 1, tier)) is not None:
            window, gap = [piece], tier - piece.length
            while gap and (piece := shelves.take(1, min(gap, below or tier))) is not None:
                window.append(piece)
                gap -= piece.length
            if gap and (piece := shelves.take(gap + 1, below or tier)) is not None:
                window.append(Piece(piece.doc, piece.start, gap))
                shelves.put(Piece(piece.doc, piece.start + gap, piece.length - gap))
                gap = 0
            if gap:
                out.left += window
            else:
                out.windows.append((tier, window))
    return out


def close(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Pieces in a row, cut into windows of the tiers, then of ever smaller powers of two: none is padded."""
    windows, todo, size = [], list(reversed(pieces)), TIERS[0]
    total = sum(p.length for p in pieces)
    while total:
        while size > total:
            size //= 2
        window, gap = [], size
        while gap:
            p = todo.pop()
            if p.length > gap:
                todo.append(Piece(p.doc, p.start + gap, p.length - gap))
                p = Piece(p.doc, p.start, gap)
            window.append(p)
            gap -= p.length
        windows.append((size, window))
        total -= size
    return windows


def dealt(windows: list[tuple[int, list[Piece]]]) -> list[int]:
    """The step of each window: by cost of attention, to and fro over as many steps as their tokens make, so that steps cost alike."""
    steps = max(1, -(-sum(n for n, _ in windows) // STEP_TOKENS))
    cost = np.array([sum(p.length**2 for p in own) for _, own in windows])
    rank = np.empty(len(windows), np.int64)
    rank[np.argsort(-cost, kind="stable")] = np.arange(len(windows))
    turn, place = rank // steps, rank % steps
    return np.where(turn % 2 == 0, place, steps - 1 - place).tolist()


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"


def _pack(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    encode, base = byte_bpe(path), TaskContext.get().partitionId() << 32
    ids: list[np.ndarray] = []
    names: list[int | None] = []
    left: list[Piece] = []
    size = sequence = step = 0

    def rows(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
        nonlocal sequence, step
        of = dealt(windows)
        out = []
        for k, (tier, window) in enumerate(windows):
            at = 0
            for p in window:
                crc = zlib.crc32(ids[p.doc][p.start : p.start + p.length])
                out.append((names[p.doc], p.start, p.length, crc, len(ids[p.doc]), base + sequence + k, at, tier, base + step + of[k]))
                at += p.length
        sequence, step = sequence + len(windows), step + max(of, default=-1) + 1
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
            left += routed(len(ids), len(own))
            ids.append(own)
            names.append(doc_id)
            size += len(own)
            if size >= GROUP_TOKENS:
                found = fill(left)
                if found.windows:
                    yield rows(found.windows)
                # only documents with pieces left are kept
                kept = sorted({p.doc for p in found.left})
                move = {d: i for i, d in enumerate(kept)}
                ids, names = [ids[d] for d in kept], [names[d] for d in kept]
                left = [Piece(move[p.doc], p.start, p.length) for p in found.left]
                size = 0
    found = fill(left)
    windows = found.windows + close(found.left)
    if windows:
        yield rows(windows)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of the token ids of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    Every document is encoded whole, whatever its length, and followed by END_ID; it is routed to a tier,
    and every task packs its documents tier by tier, GROUP_TOKENS at a time, with nothing shuffled. Only
    windows that are full are sequences; what is left at the end of a task is cut into powers of two,
    so that no sequence is padded. sequence_id and step_id are unique over all tasks. Null and empty
    texts are END_ID alone; null ids and repeated rows are documents like others; an empty table gives
    no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_pack, path=path), _PACKED)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
