"""Removal of repeated byte strings with suffix arrays by induced sorting, in shards that content chooses.

Every window of ``window`` bytes has an anchor, the least hash among its short grams, and neighbouring windows with one
anchor are a piece. Equal windows have equal anchors wherever they stand, so all that can be equal meets under one anchor.
Pieces that stand at several places are repeated as a whole: Spark counts them by digest, before any shuffle of members. What
is left are anchors with different pieces, or pieces that hold theirs twice. One copy of each goes to the shard of its anchor, a task of about ``SHARD`` bytes.

A shard's text is sorted by induction: suffixes are classified by what follows as larger- or smaller-type, the substrings
between leftmost smaller ones are sorted and named, the string of names is sorted the same way, and from the order of those
suffixes all others are induced, bucket by bucket in two linear scans (below the first level, where buckets are as many as
names, by the names up to the next leftmost smaller suffix). The permuted common prefixes with each suffix's predecessor
come from those that cannot be taken over from the position before; windows where ``window`` bytes agree are repeated.

An anchor with more than ``CROWD`` different pieces is not brought together: its windows are anchored again by longer grams,
the last of which is the window itself, so no group outgrows a task and no window is left out.

Defined cases: null and empty texts have no bytes, and texts shorter than the window lose nothing; very long texts are taken
whole; repeated rows are places of their own, so both lose what they share; rows that share a doc_id with different texts,
and rows without one, are told apart by text; all places of a repeat are removed, so ties need no rule; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .substrings import window_starts
from .words import signed, slices, span_hashes, text_bytes

WINDOW = 400
#: Shares of the window that an anchor takes, level by level.
ANCHORS = (0.08, 0.5, 0.8, 1.0)
#: Different pieces of an anchor, and bytes of all pieces, that a task takes.
CROWD, SHARD = 2048, 1 << 21
#: Pieces and ids up to this many are broadcast to pick rows.
MAX_BROADCAST = 500_000
#: Symbols up to which buckets are scanned one by one.
_BUCKETS = 1024


# --- suffix arrays


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For each place the first one at or after it that is set, or the length."""
    at = np.where(flags, np.arange(len(flags)), len(flags))
    return np.minimum.accumulate(at[::-1])[::-1]


def _named(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the strings t[start..end], both included; one that goes on after another has ended is the smaller."""
    pad = int(t.max()) + 1
    bits = pad.bit_length()
    held = 63 // bits
    rank = np.zeros(len(starts), np.int64)
    active, at = np.arange(len(starts)), 0
    while len(active):
        word = np.zeros(len(active), np.int64)
        for k in range(at, at + held):
            place = starts[active] + k
            word = word << bits | np.where(place <= ends[active], t[np.minimum(place, len(t) - 1)], pad)
        order = np.lexsort((word, rank[active])) if at else np.argsort(word, kind="stable")
        active, word = active[order], word[order]
        old = rank[active]
        new = np.ones(len(active), bool)
        new[1:] = (word[1:] != word[:-1]) | (old[1:] != old[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        # ranks are places in the order of all strings, so a group is refined within its own
        fresh = np.ones(len(active), bool)
        fresh[1:] = old[1:] != old[:-1]
        rank[active] = old + first[group] - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        at += held
        several = np.diff(np.append(first, len(active)))[group] > 1
        # one that ended just here is told from those that go on by its padding in the next round
        active = active[several & (starts[active] + at <= ends[active] + 1)]
    return np.unique(rank, return_inverse=True)[1]


def _place(found: np.ndarray, symbols: np.ndarray, pointer: np.ndarray, order: np.ndarray, down: bool) -> None:
    """Puts ``found`` at the pointers of their buckets, in turn, and moves these."""
    by = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=len(pointer))
    rank = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    bucket = symbols[by]
    order[pointer[bucket] - rank if down else pointer[bucket] + rank] = found[by]
    pointer += -counts if down else counts


def _induce(t: np.ndarray, smaller: np.ndarray, least: np.ndarray) -> np.ndarray:
    """All suffixes of t from its sorted leftmost smaller ones: a scan upwards places the larger-type, one downwards the others."""
    sizes = np.bincount(t)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    narrow = t.astype(np.uint16)
    order = np.full(len(t), -1)
    head = begins.copy()
    cuts = np.searchsorted(t[least], np.arange(len(sizes) + 1))

    def larger_before(chunk: np.ndarray) -> None:
        found = chunk[chunk > 0] - 1
        found = found[~smaller[found]]
        if len(found):
            _place(found, narrow[found], head, order, False)

    for c in range(len(sizes)):
        done = begins[c]
        while done < head[c]:
            until = head[c]
            larger_before(order[done:until])
            done = until
        larger_before(least[cuts[c] : cuts[c + 1]])
    tail = ends - 1

    def smaller_before(chunk: np.ndarray) -> None:
        found = chunk[chunk > 0] - 1
        found = found[smaller[found]]
        if len(found):
            _place(found, narrow[found], tail, order, True)

    for c in range(len(sizes) - 1, 0, -1):
        done = ends[c] - 1
        while done > tail[c]:
            until = tail[c]
            smaller_before(order[until + 1 : done + 1][::-1])
            done = until
        smaller_before(order[begins[c] : head[c]][::-1])
    order[0] = len(t) - 1
    return order


def _sorted_suffixes(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, whose last symbol is 0 and stands nowhere else."""
    step = np.diff(t)
    smaller = np.ones(len(t), bool)
    smaller[:-1] = step[_next_true(step != 0)] > 0
    leftmost = np.zeros(len(t), bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    least = np.flatnonzero(leftmost)
    if len(least) > 1:
        names = _named(t, least, np.append(least[1:], least[-1]))
        turn = np.argsort(names) if names.max() + 1 == len(names) else _sorted_suffixes(names)
        rank = np.empty(len(t), np.int64)
        rank[least[turn]] = np.arange(len(turn))
        least = least[turn]
    else:
        rank = np.zeros(len(t), np.int64)
    if int(t.max()) < _BUCKETS:
        return _induce(t, smaller, least)
    after = np.append(_next_true(leftmost)[1:], len(t) - 1)
    return np.lexsort((rank[after], _named(t, np.arange(len(t)), after)))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``t`` (integers from 0) in order."""
    if len(t) < 2:
        return np.arange(len(t))
    return _sorted_suffixes(np.append(t.astype(np.int64) + 1, 0))[1:]


def common_prefixes(data: np.ndarray, rest: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, length) by text position: the suffix that precedes it in ``order``, and the bytes they share, ``rest`` at most.

    Where the bytes in front of both agree, the length is that of the position before, less one; only the others are compared.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    taken = np.zeros(n, bool)
    taken[1:] = (rest[:-1] > 0) & (before[1:] > 0) & (data[:-1] == data[np.maximum(before[1:] - 1, 0)]) & (rest[np.maximum(before[1:] - 1, 0)] > 0)
    words = np.zeros(n + 1, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for k in range(8):
        words[:n] |= padded[k : k + n] << np.uint64(8 * k)
    length = np.zeros(n, np.int64)
    own = np.flatnonzero(~taken & (before >= 0))
    limit = np.minimum(rest[own], rest[before[own]])
    at = 0
    while len(own):
        x = words[np.minimum(own + at, n)] ^ words[np.minimum(before[own] + at, n)]
        same = x == 0
        low = x & (~x + np.uint64(1))
        zeros = np.frexp(low.astype(np.float64))[1] - 1 >> 3
        length[own] = np.minimum(at + np.where(same, 8, zeros), limit)
        at += 8
        on = same & (limit > at)
        own, limit = own[on], limit[on]
    source = np.maximum.accumulate(np.where(taken, 0, np.arange(n)))
    return before, length[source] - (np.arange(n) - source)


def repeated_windows(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of each window that stands at two places or more in different, or the same, ``pieces``."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    rest = first[owner + 1] - 1 - np.arange(len(data))
    t = data.astype(np.int64) + 1
    t[rest == 0] = 0
    before, length = common_prefixes(data, rest, suffix_array(t))
    hit = length >= window
    hit[before[np.flatnonzero(hit)]] = True
    at = np.flatnonzero(hit)
    return owner[at], at - first[owner[at]]


# --- anchors and pieces


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, from running minima within blocks."""
    if size == 1:
        return x
    padded = np.append(x, np.full(-len(x) % size, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, size)
    onwards = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - size + 1], onwards[size - 1 : len(x)])


def _runs(starts: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First indices and sizes of runs of neighbouring starts with one key, ``most`` long at most."""
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    new |= (np.arange(len(starts)) - begin[np.cumsum(new) - 1]) % most == 0 if len(starts) else new
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(starts)))


def _several_anchors(grams: np.ndarray, key: np.ndarray, at: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Whether a piece holds its anchor at two places or more, without which none of its windows can repeat another of them."""
    least = _sliding_least(grams, width)
    reach = ~_sliding_least(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~least, np.full(width - 1, ~np.uint64(0))]), width)
    chosen = np.flatnonzero(reach == grams)
    low, high = np.searchsorted(chosen, at), np.searchsorted(chosen, at + sizes + width - 1)
    piece = np.repeat(np.arange(len(at)), high - low)
    place = chosen[np.arange(len(piece)) - np.repeat(np.cumsum(high - low) - high, high - low)]
    return np.bincount(piece, grams[place] == key[piece], len(at)) > 1


_PIECES = "key long, piece binary, again boolean, doc long, sum long, start int, windows int"


def _piece_rows(window: int, gram: int, ranged: bool):
    """Rows of _PIECES of each text (doc, sum, text); with ``ranged`` only of its windows in ranges (start, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, first = text_bytes(batch.column("text"))
            starts = window_starts(first, window)
            if ranged:
                lists = batch.column("ranges")
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                start, windows = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, first[owner] + start, 1)
                np.add.at(edge, first[owner] + start + windows, -1)
                starts = starts[np.cumsum(edge)[starts] > 0]
            if not len(starts):
                continue
            width = window - gram + 1
            grams = span_hashes(data, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
            key = _sliding_least(grams, width)[starts]
            begin, sizes = _runs(starts, key, window if gram < window else 1)
            at = starts[begin]
            owner = np.searchsorted(first, at, "right") - 1
            view = memoryview(np.ascontiguousarray(data))
            digests = [blake2b(view[a : a + n], digest_size=16).digest() for a, n in zip(at.tolist(), (sizes + window - 1).tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "key": pa.array(signed(key[begin])),
                    "piece": pa.array(digests, pa.binary()),
                    "again": pa.array(_several_anchors(grams, key[begin], at, sizes, width)),
                    "doc": pa.array(batch.column("doc").to_numpy()[owner]),
                    "sum": pa.array(batch.column("sum").to_numpy()[owner]),
                    "start": pa.array((at - first[owner]).astype(np.int32)),
                    "windows": pa.array(sizes.astype(np.int32)),
                }
            )

    return run


def _fetch_rows(window: int):
    """The bytes of the asked pieces of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc, sum_, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "sum", "text", "asked")), strict=True):
                data = text.encode()
                yield pa.record_batch(
                    {
                        "key": pa.array([x["key"] for x in asked], pa.int64()),
                        "doc": pa.array([doc] * len(asked), pa.int64()),
                        "sum": pa.array([sum_] * len(asked), pa.int64()),
                        "start": pa.array([x["start"] for x in asked], pa.int32()),
                        "single": pa.array([x["single"] for x in asked], pa.bool_()),
                        "data": pa.array([data[x["start"] : x["start"] + x["windows"] + window - 1] for x in asked], pa.binary()),
                    }
                )

    return run


_RANGES = "doc long, sum long, start int, windows int"


def _shard_rows(window: int):
    """Rows of _RANGES: the repeated windows of a shard's pieces that stand at one place."""

    def run(shard: pa.Table) -> pa.Table:
        piece, start = repeated_windows(shard.column("data").to_pylist(), window)
        single = shard.column("single").to_numpy()[piece]
        piece, start = piece[single], start[single]
        begin, sizes = _runs(start, piece, 1 << 30)
        piece, start = piece[begin], start[begin]
        doc, sum_, at = (shard.column(c).to_numpy()[piece] for c in ("doc", "sum", "start"))
        return pa.table({"doc": doc, "sum": sum_, "start": (at + start).astype(np.int32), "windows": sizes.astype(np.int32)})

    return run


# --- the whole


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids


def _met(rows: DataFrame, keys: DataFrame, column: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keys`` (column, _n: how many of the rows have it, ...), of which ``total`` are asked for in all.

    Few keys are broadcast. Of many, those with more than a share of ``MAX_BROADCAST`` are, whose number that bounds, so that no key
    in the shuffle has more than that share of the rows.
    """
    if keys.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(keys.drop("_n")), column, how)
    share = max(total // max(MAX_BROADCAST, 1), 1)
    hot = keys.where(F.col("_n") > share).drop("_n")
    cold = keys.where(F.col("_n") <= share).drop("_n")
    names = hot.select(column)
    return rows.join(F.broadcast(hot), column, how).union(rows.join(F.broadcast(names), column, "left_anti").join(cold, column, how))


def repeated_ranges(texts: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """Rows of _RANGES: the windows of ``texts`` (doc, sum, text) that stand at two places or more; none is left out, some stand twice."""
    found, searched = [], texts
    for level, share in enumerate(ANCHORS):
        rows = written(searched.mapInArrow(_piece_rows(window, max(int(window * share), 1), level > 0), _PIECES))
        place = F.struct("doc", "sum", "start", "windows")
        pieces = written(rows.groupBy("piece").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.max("again").alias("again"), F.min(place).alias("place")))
        several = pieces.where("n > 1").select("piece", F.col("n").alias("_n"))
        repeated = several.agg(F.sum("_n").alias("n")).first().n or 0
        found.append(_met(rows, several, "piece", repeated, "left_semi").select("doc", "sum", "start", "windows"))
        kinds = pieces.groupBy("key").agg(F.count("*").alias("_n"), F.min("n").alias("least"), F.max("again").alias("again")).where("(_n > 1 OR again) AND least = 1")
        kinds = written(kinds.select("key", "_n", (F.col("_n") > crowd).alias("crowded")))
        several_kinds = kinds.agg(F.sum("_n").alias("n")).first().n or 0
        met = written(_met(pieces, kinds, "key", several_kinds).select("key", "crowded", (F.col("n") == 1).alias("single"), "place.*"))
        asked = met.where("NOT crowded").groupBy("doc", "sum").agg(F.collect_list(F.struct("key", "start", "windows", "single")).alias("asked"))
        total = met.where("NOT crowded").agg(F.sum(F.col("windows") + window).alias("n")).first().n or 0
        if total:
            held = _among(texts, asked.select("doc", "sum")).join(asked, ["doc", "sum"])
            held = held.mapInArrow(_fetch_rows(window), "key long, doc long, sum long, start int, single boolean, data binary")
            shards = F.pmod(F.xxhash64("key"), F.lit(total // shard + 1))
            found.append(held.groupBy(shards.alias("shard")).applyInArrow(_shard_rows(window), _RANGES))
        again = met.where("crowded").groupBy("doc", "sum").agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
        if not met.where("crowded").limit(1).count():
            break
        searched = _among(texts, again.select("doc", "sum")).join(again, ["doc", "sum"])
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.union(more)
    return ranges


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    return texts.join(_small(ids), ["doc", "sum"], "left_semi")


def _kept_rows(window: int):
    """doc_id, kept (bytes), n_bytes, n_removed and n_spans of each text without its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, sizes, removed, spans = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = (text or "").encode()
                gone = np.zeros(len(data) + 2, bool)
                for x in ranges or ():
                    gone[x["start"] + 1 : x["start"] + x["windows"] + window] = True
                inner = gone[1:-1]
                sizes.append(len(data))
                removed.append(int(inner.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~inner].tobytes() if removed[-1] else data)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "kept": pa.array(kept, pa.binary()),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                }
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (the bytes that stay), n_bytes, n_removed and n_spans."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "sum": F.xxhash64("text")})
    texts = plain.where(F.octet_length("text") >= window).select("doc", "sum", "text")
    ranges = repeated_ranges(texts, window, crowd, shard)
    ranges = written(ranges.groupBy("doc", "sum").agg(F.collect_list(F.struct("start", "windows")).alias("ranges")))
    ids = _small(ranges.select("doc", "sum"))
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    cut = plain.join(ids, ["doc", "sum"], "left_semi").join(ranges, ["doc", "sum"]).select("doc_id", "text", "ranges")
    clean = plain.join(ids, ["doc", "sum"], "left_anti").select("doc_id", "text", F.array().cast("array<struct<start:int,windows:int>>").alias("ranges"))
    return cut.mapInArrow(_kept_rows(window), schema).union(clean.mapInArrow(_kept_rows(window), schema))
