"""SentencePiece encoding and decoding with forward states shared along the trie of a batch's words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches
from .repeats import raw

MARK = "▁"
#: Bytes of text whose distinct words are sorted into one trie, about, and bytes of words and ids that a worker keeps.
BUFFER = 1 << 22
KEPT_BYTES = 1 << 26
#: Bytes of a word above which it is walked alone.
LONG = 4096


class Pieces:
    """Vocabulary of a sentencepiece model and the search for a word's pieces.

    In a BPE model the pieces of a word are those that merging by rank gives. Ranks make every
    adjacent pair of them stable: merged alone, the pair's text gives the pair again; and only one
    sequence has that property. So the best path has the shape of a Viterbi search: the state at each
    place is the one piece that ends there and is stable after the state where it begins.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in ids]
        self.rank = {self.text[i]: (-model.get_score(i), i) for i in ids if not special[i]}
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.chars = np.unique(np.frombuffer("".join(self.rank).encode("utf-32-le"), np.uint32))
        # trie of the pieces read backwards: its edges (node and character), where they lead, and the piece that ends there
        nodes, of, ends = {"": 0}, {}, [-1]
        for piece, (_, i) in self.rank.items():
            for k in range(len(piece) - 1, -1, -1):
                tail = piece[k:]
                if tail not in nodes:
                    nodes[tail] = len(ends)
                    of[nodes[tail[1:]], tail[0]] = nodes[tail]
                    ends.append(-1)
            ends[nodes[piece]] = i
        code = {chr(c): k for k, c in enumerate(self.chars.tolist())}
        edges = sorted((n * (len(code) + 1) + code[c], to) for (n, c), to in of.items())
        self.edge, self.leads = np.array([e for e, _ in edges]), np.array([to for _, to in edges])
        self.ends = np.array(ends)
        #: Pairs of pieces met so far, sorted, and whether they are stable.
        self.pair, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        self._split()
        self.kept: dict[bytes, np.ndarray] = {}
        self.kept_bytes = 0

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Pieces by merging: the adjacent pair of the best rank first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > stop:
            best = min(((self.rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _split(self) -> None:
        """The two pieces whose merge completes each piece, its place in the order of merges, and the pairs that merge to a piece.

        A piece that merging never gives (or a single character) is its own halves; whole tells which
        pieces merging gives from their own text.
        """
        order = sorted(self.rank, key=lambda x: (len(x) > 1, self.rank[x]))
        n = len(self.text)
        self.turn, self.half = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        self.whole = np.zeros(n, bool)
        ids, pairs = {p: i for p, (_, i) in self.rank.items()}, []
        for turn, piece in enumerate(order):
            i = ids[piece]
            self.turn[i], self.half[i] = turn, i
            pairs += [(ids[piece[:k]] * n + ids[piece[k:]], turn) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            parts = self.merged(piece, stop=2)
            self.whole[i] = len(piece) == 1 or (len(parts) == 2 and "".join(parts) == piece and all(p in ids for p in parts))
            if len(parts) == 2 and self.whole[i]:
                self.half[i] = ids[parts[0]], ids[parts[1]]
        pairs.sort()
        self.meet, self.meets = np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair as it is.

        left -1 is the start of a word or a character out of the vocabulary, which merges with nothing.
        Otherwise the merges of both pieces are undone, latest first: at no time may what then meets at
        the border have merged before what was undone last.
        """
        n = len(self.text)
        good = self.whole[right] & ((left < 0) | self.whole[np.maximum(left, 0)])
        open_ = np.flatnonzero(good & (left >= 0))
        a, b = left[open_].copy(), right[open_].copy()
        limit = np.full(len(open_), len(self.turn) + 1)
        while len(open_):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.meet, key), len(self.meet) - 1)
            bad = (self.meet[at] == key) & (self.meets[at] < limit)
            good[open_[bad]] = False
            more_a, more_b = self.half[a, 1] != a, self.half[b, 0] != b
            go = ~bad & (more_a | more_b)
            open_, a, b, more_a, more_b = open_[go], a[go], b[go], more_a[go], more_b[go]
            undo_a = more_a & (~more_b | (self.turn[a] > self.turn[b]))
            # of equal merges the leftmost is first
            limit = np.where(undo_a, self.turn[a], self.turn[b] + 1)
            a, b = np.where(undo_a, self.half[a, 1], a), np.where(undo_a, b, self.half[b, 0])
        return good

    def all_stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the pairs are stable; each pair is judged once in the life of a worker."""
        key = (left + 1) * len(self.text) + right
        at = np.searchsorted(self.pair, key)
        new = np.unique(key[self.pair[np.minimum(at, len(self.pair) - 1)] != key] if len(self.pair) else key)
        if len(new):
            n = len(self.text)
            good = self.stable(new // n - 1, new % n)
            to = np.searchsorted(self.pair, new)
            self.pair, self.good = np.insert(self.pair, to, new), np.insert(self.good, to, good)
            at = np.searchsorted(self.pair, key)
        return self.good[at]

    def paths(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of sorted distinct words (UTF-8, whose order is that of characters; marks as spaces), by a walk down their trie, all its nodes of one depth at a time.

        A node's state is the piece that ends there (-1: none, or a character out of the vocabulary)
        and where that begins. A prefix that words have in common is one node, whose state they share.
        """
        text, size = characters(words)
        code = np.minimum(np.searchsorted(self.chars, text), len(self.chars) - 1)
        code = np.where(self.chars[code] == text, code, len(self.chars))
        off = np.cumsum(size) - size
        states = off + np.arange(len(words))  # one place more than characters
        state, begin = np.full(len(text) + len(words), -1, np.int64), np.zeros(len(text) + len(words), np.int64)
        alike = np.zeros(len(words), bool)  # with the word before, so far
        alike[1:] = True
        alive = np.arange(len(words))
        for depth in range(1, int(size.max(initial=0)) + 1):
            alive = alive[size[alive] >= depth]
            alike[alive] &= size[alive - 1] >= depth
            both = alive[alike[alive]]
            alike[both] = text[off[both] + depth - 1] == text[off[both - 1] + depth - 1]
            own = ~alike[alive]
            found, since = self._nodes(alive[own], depth, code, off, states, state)
            node = np.cumsum(own) - 1
            state[states[alive] + depth], begin[states[alive] + depth] = found[node], since[node]
        return self._back(text, off, size, states, state, begin)

    def _nodes(self, word: np.ndarray, depth: int, code: np.ndarray, off: np.ndarray, states: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states of nodes of one depth, each given by a word below it: the longest piece that is stable after the state where it begins."""
        found, since = np.full(len(word), -1), np.full(len(word), depth - 1)
        at, left, ends = np.zeros(len(word), np.int64), np.arange(len(word)), []
        for begins in range(depth - 1, -1, -1):
            key = at * (len(self.chars) + 1) + code[off[word[left]] + begins]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[edge] == key
            at, left = self.leads[edge[on]], left[on]
            if not len(left):
                break
            whole = self.ends[at] >= 0
            ends.append((begins, left[whole], self.ends[at[whole]]))
        for begins, node, piece in reversed(ends):
            open_ = found[node] < 0
            node, piece = node[open_], piece[open_]
            if len(node):
                good = self.all_stable(state[states[word[node]] + begins], piece)
                found[node[good]], since[node[good]] = piece[good], begins
        return found, since

    def _back(self, text: np.ndarray, off: np.ndarray, size: np.ndarray, states: np.ndarray, state: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """The ids of each word, from its last state back to the start."""
        steps, at, left = [], size.copy(), np.flatnonzero(size)
        count = np.zeros(len(size), np.int64)
        while len(left):
            here = states[left] + at[left]
            since = begin[here]
            steps.append((left, state[here], since))
            count[left] += 1
            at[left] = since
            left = left[since > 0]
        place = np.cumsum(count)
        flat, char = np.zeros(int(count.sum()), np.int32), np.zeros(int(count.sum()), np.int64)
        for left, piece, since in steps:
            place[left] -= 1
            flat[place[left]], char[place[left]] = piece, off[left] + since
        flat, n = self._bytes(flat, text[char])
        end = np.cumsum(np.bincount(np.repeat(np.arange(len(size)), count), n, len(size))).astype(np.int64).tolist()
        return [flat[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)] if end else []

    def _bytes(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with those of the bytes of each character that is no piece (-1; first: its code point), and how many each became."""
        out = ids < 0
        n = np.ones(len(ids), np.int64)
        if not self.bytes:
            return np.where(out, self.unknown, ids).astype(np.int32), n
        chars = first[out].astype("<u4")
        n[out] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        flat = np.repeat(ids, n)
        raw_bytes = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        flat[flat < 0] = np.array([self.bytes[b] for b in range(256)], np.int32)[raw_bytes]
        return flat, n

    def path(self, word: bytes) -> np.ndarray:
        """The same for one long word, character by character."""
        text, _ = characters([word])
        word = text.tobytes().decode("utf-32-le", "surrogatepass")
        edges, good = dict(zip(self.edge.tolist(), self.leads.tolist(), strict=True)), dict(zip(self.pair.tolist(), self.good.tolist(), strict=True))
        code, ends, n = {chr(c): k for k, c in enumerate(self.chars.tolist())}, self.ends.tolist(), len(self.text)
        state, begin = [-1], [0]
        for end in range(len(word)):
            at, node, met = end, edges.get(code.get(word[end], -1)), []
            while node is not None:
                if ends[node] >= 0:
                    met.append((at, ends[node]))
                if not at:
                    break
                at -= 1
                node = edges.get(node * (len(code) + 1) + code.get(word[at], len(code)))
            for at, piece in reversed(met):
                key = (state[at] + 1) * n + piece
                if key not in good:
                    good[key] = bool(self.stable(np.array([state[at]]), np.array([piece]))[0])
                if good[key]:
                    break
            else:
                at, piece = end, -1
            state.append(piece)
            begin.append(at)
        out, end = [], len(word)
        while end:
            out.append(state[end])
            end = begin[end]
        out = np.array(out[::-1], np.int32)
        size = np.array([len(self.text[i]) if i >= 0 else 1 for i in out.tolist()], np.int64)
        return self._bytes(out, text[np.cumsum(size) - size])[0]

    def _out_of_vocabulary(self, word: str, ids: np.ndarray) -> np.ndarray:
        """ids with those of the bytes of each character that is no piece."""
        new, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                new.append(i)
                at += len(self.text[i])
            else:
                new += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                at += 1
        return np.array(new, np.int32)

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each distinct word. New words are encoded in sorted order and kept."""
        kept = self.kept
        new = sorted([w for w in words if w not in kept])
        short = [w for w in new if len(w) <= LONG]
        found = dict(zip(short, self.paths(short), strict=True))
        if len(short) < len(new):
            found.update((w, self.path(w)) for w in new if len(w) > LONG)
        out = [kept[w] if w in kept else found[w] for w in words]
        size = sum(map(len, new)) + 4 * sum(map(len, found.values())) + 256 * len(new)
        if self.kept_bytes + size > KEPT_BYTES:
            kept.clear()
            self.kept_bytes = 0
        if size <= KEPT_BYTES:
            kept.update(found)
            self.kept_bytes += size
        return out


def characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of joined words, with marks for spaces, and the length of each word."""
    joined = b"".join(words)
    begins = np.r_[0, np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)]
    text = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    text[text == 32] = ord(MARK)
    return text, np.diff(begins[np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]])


@cache
def pieces_of(path: str | None) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(path)


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches in turn, about BUFFER bytes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BUFFER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _encode(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    pieces, mark = pieces_of(path), MARK.encode()
    for batch in buffers(batches):
        texts = [b" " + t.replace(mark, b" ") if t else b"" for t in map(raw, batch.column(1))]
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        # a word begins with its marks
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        kind, of = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(np.r_[start, len(data)].astype(of)), pa.py_buffer(data)]).dictionary_encode()
        ids = pieces.ids(words.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        word = words.indices.to_numpy()
        n = size[word]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[word] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        total = np.r_[0, ends][np.searchsorted(start, bounds)]
        lists = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat[at], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path)
    words = [t.replace(MARK, " ").encode() for t in pieces.text]
    for byte, i in pieces.bytes.items():
        words[i] = bytes([byte])
    table = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    for batch in batches:
        texts = []
        for ids in batch.column(1):
            ids = ids.values.to_numpy()
            n = size[ids]
            end = np.cumsum(n)
            at = np.repeat(start[ids] - end + n, n) + np.arange(end[-1] if len(end) else 0)
            texts.append(table[at[1:]].tobytes().decode("utf-8", "replace"))  # the first byte is the first mark
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each text: the ids that the sentencepiece library gives.

    Null and empty texts have no ids; equal texts have equal ids, repeated rows included; a mark in a
    text counts as a space; an empty table gives no rows; other columns are not read. Whole texts are
    encoded, whatever their length. Nothing is shuffled, and a worker keeps words and ids of
    KEPT_BYTES at most.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with text. Marks become spaces, byte pieces their bytes, and the first mark goes."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, ids array<int>, text string")


def op6_sentencepieces(spark, sf_dir: str) -> DataFrame:
    out = decode(encode(documents(spark, sf_dir)))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"),
    )
