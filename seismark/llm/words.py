"""Vectorised word splitting and hashing for Arrow batches of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash is a polynomial in an odd base modulo 2**64,
taken from prefix sums over the whole batch, then mixed; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {_BASE: np.ones(1, np.uint64), pow(_BASE, -1, 1 << 64): np.ones(1, np.uint64)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x + np.uint64((salt * _BASE + 0x1234567) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_factors(n: int, salt: int = 0) -> np.ndarray:
    """Unrelated odd factors, so that sums of products tell sequences apart."""
    return mix(np.arange(n, dtype=np.uint64), 1000 + salt) | np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, BATCH_BYTES + 4096), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[s:e]; equal spans have equal hashes, wherever they stand."""
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(codes)), out=prefix[1:])
    inverse = _power(pow(_BASE, -1, 1 << 64), len(codes) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    """hashes of all words in order; first[i]:first[i + 1] are those of text i; data[starts:ends] their bytes."""

    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and its len + 1 offsets into them; a null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    full = ~_BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = full[1:] != full[:-1]
        edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    held = full[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    return Words(span_hashes(data, starts, ends), np.searchsorted(starts, offsets), data, starts, ends)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
