"""Substring dedup by recompression of the word sequence.

A round of recompression names maximal runs of a symbol, then pairs of neighbours whose first symbol falls into the left
and whose second into the right half of the alphabet. Names and halves are hashes of content, so they are the same
everywhere: equal word sequences get equal interior symbols, and each symbol knows the stretch of words that its name
depends on. In every window of ``window`` words the stretch with the least hash that lies within it is its anchor; equal
windows have equal anchors. A window without any is its own anchor.

Spark counts anchors, and only windows whose anchor stands at two places or more are named by their own hash, of which the
first occurrence is found. So the rows that are shuffled are about one in seven words, plus the repeated windows.
Consecutive windows that repeat the same place make one passage, and a passage goes only if its words and those of the place
it repeats have the same 128-bit cryptographic digest; whole texts that repeat are found by SHA-256.

Defined cases: null and empty texts have no words and nothing is removed; very long texts are searched whole, and ties
between places go to the smaller doc_id, then the earlier start; a null doc_id comes before all others; rows that share a
doc_id are one document's versions: equal ones are judged alike, and of different ones only what has the same words at its
source is removed, so words that stand nowhere else stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import mix, odd_factors, signed, slices, span_hashes, split_words

WINDOW = 20
#: Rounds of recompression; with two, a name depends on about nine words.
ROUNDS = 2
#: Ids up to this many are broadcast to pick their texts.
MAX_BROADCAST_IDS = 2_000_000


class Symbols:
    """Symbols of a batch: name, and the words [low, high) that the name depends on; document's edges count as words."""

    def __init__(self, names: np.ndarray, first: np.ndarray) -> None:
        self.name = names
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.first = first
        self.low = np.arange(len(names))
        self.high = self.low + 1

    def _before(self) -> np.ndarray:
        """Lower end of what the symbol before depends on."""
        low = np.empty_like(self.low)
        low[1:] = self.low[:-1]
        edge = np.ones(len(low), bool)
        edge[1:] = self.doc[1:] != self.doc[:-1]
        low[edge] = self.first[self.doc[edge]] - 1
        return low

    def _after(self) -> np.ndarray:
        high = np.empty_like(self.high)
        high[:-1] = self.high[1:]
        edge = np.ones(len(high), bool)
        edge[:-1] = self.doc[1:] != self.doc[:-1]
        high[edge] = self.first[self.doc[edge] + 1] + 1
        return high

    def name_runs(self) -> None:
        starts = np.ones(len(self.name), bool)
        starts[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(self.name)) - 1
        low, high = self._before()[first], self._after()[last]
        length = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        self.name = np.where(length > 1, mix(name * np.uint64(3) + length, 7), name)
        self.low, self.high, self.doc = low, high, self.doc[first]

    def name_pairs(self, level: int) -> None:
        right = (mix(self.name, 20 + level) & np.uint64(1)).astype(bool)
        paired = np.zeros(len(self.name), bool)
        paired[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(len(self.name), bool)
        second[1:] = paired[:-1]
        low = np.where(right & ~second, self._before(), self.low)
        high = np.where(~right & ~paired, self._after(), self.high)
        at = np.flatnonzero(paired)
        name = self.name.copy()
        factors = odd_factors(2, level)
        name[at] = mix(self.name[at] * factors[0] + self.name[at + 1] * factors[1], 8)
        high[at] = self.high[at + 1]
        stay = ~second
        self.name, self.low, self.high, self.doc = name[stay], low[stay], high[stay], self.doc[stay]


def window_starts(first: np.ndarray, window: int) -> np.ndarray:
    counts = np.maximum(np.diff(first) - window + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def anchors(names: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of a batch of texts, the anchor of each, and where it stands."""
    starts = window_starts(first, window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    symbols = Symbols(names, first)
    for level in range(rounds):
        symbols.name_runs()
        symbols.name_pairs(level)
    inner = (symbols.low >= first[symbols.doc]) & (symbols.high <= first[symbols.doc + 1]) & (symbols.high - symbols.low <= window)
    low, high = symbols.low[inner], symbols.high[inner]
    keys = mix(span_hashes(names, low, high), 9)
    least = [np.arange(len(keys))]
    while (2 << len(least) - 1) <= window and (2 << len(least) - 1) <= len(keys):
        step = 1 << len(least) - 1
        a, b = least[-1][:-step], least[-1][step:]
        least.append(np.where(keys[a] <= keys[b], a, b))
    a, b = np.searchsorted(low, starts), np.searchsorted(high, starts + window, "right")
    found = b > a
    level = np.zeros(len(starts), np.int64)
    level[found] = np.minimum(np.log2(b[found] - a[found]).astype(np.int64), len(least) - 1)
    best = np.full(len(starts), -1)
    for k, table in enumerate(least):
        here = found & (level == k)
        x, y = table[a[here]], table[b[here] - (1 << k)]
        best[here] = np.where(keys[x] <= keys[y], x, y)
    whole = np.flatnonzero(~found)
    key, at = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    key[found], at[found] = keys[best[found]], low[best[found]]
    key[whole], at[whole] = mix(span_hashes(names, starts[whole], starts[whole] + window), 10), starts[whole]
    return starts, key, at


def _anchor_rows(window: int, rounds: int):
    """(key, doc, n): the distinct anchors of each text and the places at which they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            starts, key, at = anchors(words.hashes, words.first, window, rounds)
            owner = np.searchsorted(words.first, starts, "right") - 1
            place = np.ones(len(key), bool)
            place[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
            order = np.lexsort((at[place], key[place], owner[place]))
            key, at, owner = key[place][order], at[place][order], owner[place][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            apart = new.copy()
            apart[1:] |= at[1:] != at[:-1]
            groups = np.flatnonzero(new)
            n = np.add.reduceat(apart.astype(np.int64), groups) if len(groups) else groups
            docs = batch.column("doc").to_numpy()
            yield pa.record_batch({"key": pa.array(signed(key[groups])), "doc": pa.array(docs[owner[groups]]), "n": pa.array(n, pa.int64())})

    return run


def _window_rows(window: int, rounds: int):
    """(high, low, doc, start) of each text's windows with a repeated anchor; earlier: where the same text has the window first, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            starts, key, _ = anchors(words.hashes, words.first, window, rounds)
            owner = np.searchsorted(words.first, starts, "right") - 1
            lists = batch.column("keys")
            held = np.frombuffer(lists.flatten().cast(pa.int64()).to_numpy().tobytes(), np.uint64)
            counts = lists.value_lengths().to_numpy()
            mark = lambda doc, k: mix(k + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11)
            hit = np.isin(mark(owner, key), mark(np.repeat(np.arange(batch.num_rows), counts), held))
            starts, owner = starts[hit], owner[hit]
            name = span_hashes(words.hashes, starts, starts + window)
            order = np.lexsort((starts, name, owner))
            again = np.zeros(len(name), bool)
            again[1:] = (name[order[1:]] == name[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
            group = np.flatnonzero(~again)[np.cumsum(~again) - 1] if len(name) else order
            earlier = np.full(len(name), -1)
            earlier[order] = np.where(again, starts[order[group]] - words.first[owner[order]], -1)
            check = np.zeros(len(starts), np.uint64)
            for j, factor in enumerate(odd_factors(window, 5)):
                check += (words.hashes[starts + j] ^ np.uint64(0x5851F42D4C957F2D)) * factor
            docs = batch.column("doc").to_numpy()
            yield pa.record_batch(
                {
                    "high": pa.array(signed(name)),
                    "low": pa.array((mix(check, 12) >> np.uint64(33)).astype(np.int32)),
                    "doc": pa.array(docs[owner]),
                    "start": pa.array((starts - words.first[owner]).astype(np.int32)),
                    "earlier": pa.array(earlier.astype(np.int32)),
                }
            )

    return run


_PASSAGES = "doc long, at int, size int, source long, source_at int"


def _passages(window: int):
    """Rows of _PASSAGES from each document's repeated windows (places: start, source, source_at): maximal runs of them, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            doc = np.repeat(batch.column("doc").to_numpy(), lists.value_lengths().to_numpy())
            start, source, at = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            order = np.lexsort((start, at - start, source, doc))
            doc, start, source, at = doc[order], start[order], source[order], at[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(fresh)
            size = np.diff(np.append(first, len(doc))) + window - 1
            yield pa.record_batch({"doc": pa.array(doc[first]), "at": pa.array(start[first], pa.int32()), "size": pa.array(size, pa.int32()), "source": pa.array(source[first]), "source_at": pa.array(at[first], pa.int32())})

    return run


def _digest(words: list[bytes], at: int, size: int) -> bytes:
    return blake2b(b" ".join(words[at : at + size]), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, source_at, size, digest) of the asked stretches (asked: at, size) of each text."""
    for batch in slices(batches):
        rows = []
        for source, text, asked in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            words = (text or "").encode().split()
            rows += [(source, x["at"], x["size"], _digest(words, x["at"], x["size"])) for x in asked if x["at"] + x["size"] <= len(words)]
        source, at, size, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch({"source": pa.array(source, pa.int64()), "source_at": pa.array(at, pa.int32()), "size": pa.array(size, pa.int32()), "digest": pa.array(digest, pa.binary())})


def _kept_rows(window: int):
    """doc_id, the kept words joined by a blank, n_words and n_removed; passages: what repeats, if its digest agrees; whole: all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, removed = [], [], []
            for text, passages, whole in zip(batch.column("text").to_pylist(), batch.column("passages").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words), bool)
                if whole and len(words) >= window:
                    gone[:] = True
                for x in () if whole else passages or ():
                    if x["at"] + x["size"] <= len(words) and x["digest"] == _digest(words, x["at"], x["size"]):
                        gone[x["at"] : x["at"] + x["size"]] = True
                counts.append(len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(np.array(words, object)[~gone].tolist() if removed[-1] else words))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text": pa.array(texts, pa.binary()).cast(pa.string()),
                    "n_words": pa.array(counts, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                }
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the kept words joined by one blank), n_words and n_removed.

    A word goes if a window over it also starts earlier: in a smaller doc_id, or further up in the same document.
    """
    first_id = -(1 << 63)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumns({"doc": F.coalesce("doc_id", F.lit(first_id)), "sum": F.xxhash64("text")})
    named = plain.where("text IS NOT NULL").select("doc", "sum", F.sha2("text", 256).alias("sha"))
    least = named.groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("sha", "least")
    copies = written(named.join(least, "sha").where("doc > least").select("doc", "sum").distinct())
    own = _without(plain, copies)
    rows = own.select("doc", "text").mapInArrow(_anchor_rows(window, rounds), "key long, doc long, n long")
    repeated = rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    hits = written(rows.select("key", "doc").join(repeated, "key").groupBy("doc").agg(F.collect_list("key").alias("keys")))
    searched = _among(own.select("doc", "text"), hits).join(hits, "doc")
    windows = written(searched.select("doc", "text", "keys").mapInArrow(_window_rows(window, rounds), "high long, low int, doc long, start int, earlier int"))
    place = F.struct("doc", "start")
    # windows that a text repeats itself have their source in it; only its first ones meet those of other texts
    fresh = windows.where("earlier < 0")
    firsts = fresh.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", "low", "first")
    later = fresh.join(firsts, ["high", "low"]).where(place != F.col("first")).select("doc", "start", "first")
    later = later.union(windows.where("earlier >= 0").select("doc", "start", F.struct("doc", F.col("earlier").alias("start"))))
    places = later.groupBy("doc").agg(F.collect_list(F.struct("start", F.col("first.doc").alias("source"), F.col("first.start").alias("source_at"))).alias("places"))
    passages = written(places.mapInArrow(_passages(window), _PASSAGES))
    stretch = ["source", "source_at", "size"]
    asked = passages.select(*stretch).distinct().groupBy(F.col("source").alias("doc")).agg(F.collect_list(F.struct(F.col("source_at").alias("at"), "size")).alias("asked"))
    asked = written(asked)
    digests = _among(own.select("doc", "text"), asked).join(asked, "doc").mapInArrow(_digests, "source long, source_at int, size int, digest binary")
    checked = passages.join(digests, stretch).groupBy("doc").agg(F.collect_list(F.struct("at", "size", "digest")).alias("passages"))
    none = F.array().cast("array<struct<at:int,size:int,digest:binary>>")
    checked = written(checked)
    cut = _among(own, checked).join(checked, "doc").select("doc_id", "text", "passages", F.lit(False).alias("whole"))
    whole = _among(plain, copies).select("doc_id", "text", none.alias("passages"), F.lit(True).alias("whole"))
    clean = _without(own, checked).select("doc_id", "text", none.alias("passages"), F.lit(False).alias("whole"))
    schema = "doc_id long, text string, n_words long, n_removed long"
    return cut.mapInArrow(_kept_rows(window), schema).union(whole.union(clean).mapInArrow(_kept_rows(window), schema))


def _marked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are, or are not, among ``ids``: (doc), or (doc, sum) where one of several texts of a doc_id is meant."""
    keys = [c for c in ("doc", "sum") if c in ids.columns]
    ids = ids.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    small = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS // len(keys) ** 2 else ids
    return docs.join(small, [F.col(c) == F.col(f"_{c}") for c in keys], how)


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return _marked(docs, ids, "left_semi")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return _marked(docs, ids, "left_anti")
