"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A task tokenises its documents, cuts overlong ones into full windows, and packs what is left by best fit decreasing:
a segment tree over remaining capacities finds the tightest open window. A block of pieces is packed on its own, so
memory is bounded and no shuffle is needed; a block loses at most the padding of its last few windows.

Defined cases: a null text counts as empty (its only id is the end id); a null doc_id is kept; repeated rows are packed
once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import slices, span_hashes

WINDOW = 2048
END_ID = 1
#: Pieces and ids that are packed together at most.
BLOCK_PIECES, BLOCK_IDS = 1 << 15, 1 << 22
#: Words whose ids a worker remembers.
KNOWN_WORDS = 1 << 19
#: Sequences of one task: its number, then 33 bits.
TASK_BITS = 33

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES = "sequence_id long, ids array<int>, n_ids int, doc_ids array<long>, starts array<long>, lengths array<int>"

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 0
#: Code points below this are stable under NFC, and only one of them has a longer lower case.
_SIMPLE_END = 0x300


class Tables:
    """Class and lower case of each 16-bit code; odd ones send their text to the tokenizer itself."""

    def __init__(self) -> None:
        self.kind = np.full(1 << 16, _OTHER, np.uint8)
        self.odd = np.ones(1 << 16, bool)
        self.lower = np.arange(1 << 16, dtype=np.uint16)
        for c in range(_SIMPLE_END):
            category, low = unicodedata.category(chr(c)), chr(c).lower()
            self.kind[c] = {"L": _LETTER, "N": _NUMBER}.get(category[0], _OTHER)
            self.odd[c] = len(low) > 1 or category == "Cc" or category == "Zs"
            self.lower[c] = ord(low[0])
        for c in (0x09, 0x0A, 0x0D, 0x20):
            self.kind[c], self.odd[c] = _SPACE, False


class Encoder:
    """Ids of whole texts. Each distinct word is tokenised once and remembered; unusual texts go through the library whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.tables = Tables()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.at = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.int32)
        self.used = 0

    def learn(self, hashes: list[int], words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a word that the tokenizer cuts otherwise
            each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            ids, ends = np.array([i for x in each for i in x], np.int32), np.cumsum([len(x) for x in each])
        n = len(self.known)
        if n + len(words) > len(self.at):
            grow = max(n + len(words), 2 * len(self.at))
            self.at, self.count = np.resize(self.at, grow), np.resize(self.count, grow)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(ids), 2 * len(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        starts = np.concatenate([[0], ends[:-1]])
        self.at[n : n + len(words)] = self.used + starts
        self.count[n : n + len(words)] = ends - starts
        self.used += len(ids)
        self.known.update(zip(hashes, range(n, n + len(words)), strict=True))

    def boundaries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words: a run of letters, one number, or a run of others; 's 't 're 've 'm 'll 'd."""
        kind = self.tables.kind[codes]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        marks = np.flatnonzero((codes == ord("'")) & cut[:-1])
        marks = marks[marks + 1 < len(codes)]
        marks = marks[kind[marks + 1] == _LETTER]
        if len(marks):
            one, two = codes[marks + 1], codes[np.minimum(marks + 2, len(codes) - 1)]
            is_in = lambda x, chars: np.isin(x, [ord(c) for c in chars])
            long = (is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            long &= marks + 2 < len(codes)
            length = np.where(is_in(one, "stmd"), 1, np.where(long, 2, 0))
            marks, length = marks[length > 0], length[length > 0]
            cut[marks + 1] = False
            cut[marks + 1 + length] = True
        edges = np.flatnonzero(cut)
        full = kind[edges[:-1]] != _SPACE
        return edges[:-1][full], edges[1:][full]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        coded = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
        gap = np.array([0x0A], np.uint16)
        codes = np.concatenate([x for c in coded for x in (c, gap)]) if coded else gap
        first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
        odd = np.unique(np.searchsorted(first, np.flatnonzero(self.tables.odd[codes]), "right") - 1)
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
            codes[first[i] : first[i + 1]] = 0x0A
        codes = self.tables.lower[codes]
        starts, ends = self.boundaries(codes)
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        unique, where, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        keys = unique.tolist()
        index = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(index < 0)
        if len(new):
            words = [codes[s:e].tobytes().decode("utf-16-le") for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            index[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.learn([keys[i] for i in new.tolist()], words)
        word = index[inverse]
        count = self.count[word]
        after = np.cumsum(count)
        ids = self.pool[np.repeat(self.at[word] - after + count, count) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.concatenate([[0], after])[np.searchsorted(starts, first)]
        return [ids[bounds[i] : bounds[i + 1]] if x is None else x for i, x in enumerate(out)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Capacities:
    """A segment tree over remaining capacities: which of them some open window has."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if not self.open[capacity]:
            self._count(capacity, 1)
        self.open[capacity].append(window)

    def take_tightest(self, least: int) -> tuple[int, int] | None:
        """The open window with the smallest capacity of at least ``least``, which is taken out."""
        tree, i = self.tree, least + self.size
        while not tree[i]:
            while i & 1:  # a right child: go up
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i >= 2 * self.size:
                return None
        while i < self.size:
            i *= 2
            if not tree[i]:
                i += 1
        capacity = i - self.size
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self._count(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window and the offset in it of each piece; the longest go first, ties in the given order."""
    tree, n = Capacities(window), 0
    windows, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        found = tree.take_tightest(size)
        if found is None:
            found, n = (window, n), n + 1
        capacity, windows[i] = found
        offsets[i] = window - capacity
        if capacity > size:
            tree.put(capacity - size, windows[i])
    return windows, offsets


def _packed(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[list[tuple]]:
    """Blocks of (doc_id, start, ids, doc_tokens, sequence_id, offset)."""
    coder, sequence = encoder(path), (TaskContext.get().partitionId() << TASK_BITS) if TaskContext.get() else 0
    tail = np.array([end_id], np.int32)
    block: list[tuple] = []
    whole: list[tuple] = []
    held = 0

    def flush() -> list[tuple]:
        nonlocal sequence
        block.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        windows, offsets = best_fit_decreasing([len(x[2]) for x in block], window)
        out = whole + [(*x, sequence + w, o) for x, w, o in zip(block, windows, offsets, strict=True)]
        sequence += max(windows, default=-1) + 1
        block.clear()
        whole.clear()
        return out

    for batch in slices(batches):
        names = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for name, ids in zip(names, coder.encode(texts), strict=True):
            ids = np.concatenate([ids, tail])
            held += len(ids)
            for start in range(0, len(ids), window):
                piece = ids[start : start + window]
                if len(piece) == window:
                    whole.append((name, start, piece, len(ids), sequence, 0))
                    sequence += 1
                else:
                    block.append((name, start, piece, len(ids)))
        if len(block) >= BLOCK_PIECES or held >= BLOCK_IDS:
            yield flush()
            held = 0
    if block or whole:
        yield flush()


def pack_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence, and the CRC of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _packed(batches, tokenizer, window, end_id):
            yield pa.record_batch(
                {
                    "doc_id": pa.array([x[0] for x in block], pa.int64()),
                    "start": pa.array([x[1] for x in block], pa.int64()),
                    "length": pa.array([len(x[2]) for x in block], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x[2].astype("<u4").tobytes()) for x in block], pa.int64()),
                    "doc_tokens": pa.array([x[3] for x in block], pa.int64()),
                    "sequence_id": pa.array([x[4] for x in block], pa.int64()),
                    "offset": pa.array([x[5] for x in block], pa.int64()),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack_sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``window`` ids with padding at the end, and the pieces in it in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _packed(batches, tokenizer, window, end_id):
            block.sort(key=lambda x: (x[4], x[5]))
            first = [i for i, x in enumerate(block) if not i or x[4] != block[i - 1][4]] + [len(block)]
            for chunk in range(0, len(first) - 1, 256):
                groups = [block[a:b] for a, b in zip(first[chunk : chunk + 256], first[chunk + 1 : chunk + 257], strict=False)]
                ids = np.full((len(groups), window), pad_id, np.int32)
                for row, group in zip(ids, groups, strict=True):
                    for x in group:
                        row[x[5] : x[5] + len(x[2])] = x[2]
                yield pa.record_batch(
                    {
                        "sequence_id": pa.array([g[0][4] for g in groups], pa.int64()),
                        "ids": pa.ListArray.from_arrays(np.arange(len(groups) + 1, dtype=np.int32) * window, pa.array(ids.ravel())),
                        "n_ids": pa.array([sum(len(x[2]) for x in g) for g in groups], pa.int32()),
                        "doc_ids": pa.array([[x[0] for x in g] for g in groups], pa.list_(pa.int64())),
                        "starts": pa.array([[x[1] for x in g] for g in groups], pa.list_(pa.int64())),
                        "lengths": pa.array([[len(x[2]) for x in g] for g in groups], pa.list_(pa.int32())),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEQUENCES)
