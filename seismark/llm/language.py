"""Language identification with interpolated Kneser-Ney character models.

A text is its words, maximal runs of letters in lower case; a character is predicted from up to four before it, back to the
blank before its word, and each word ends with a blank. Spark counts the words of each language, then their n-grams
and, for lower orders, the distinct characters before an n-gram. Discounts, context sums and back-off weights come from all
n-grams; none is dropped. The estimates become sorted hash arrays, which are broadcast where their size, which is counted
first, is within ``MAX_BROADCAST``; beyond it they stay a table, each order joined to the one below, a distinct word's bits
are the sum over its joined n-grams, and are joined back to the batches of texts that hold the word. Both ways give the same
bits. The language with the lowest cross-entropy per character wins; a text is rejected where that entropy is above what
all but a thousandth of the language's calibration texts reach: a sixteenth of the rows that may be learned from, whose
words are not counted.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null lang or doc_id
are not learned from; without any training text, as in an empty table, all are ``und``; a language without calibration rows
rejects nothing; a very long text is a batch of its own, and only its distinct words are scored; ties go to the language
first in order; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import remainder
from .store import written
from .words import mix, signed, slices, span_hashes

ORDER = 5
#: Bits of cross-entropy that are added to the calibrated limit, and characters after which the score grows no further.
MARGIN, EVIDENCE = 0.5, 40
#: Bytes of text that share one list of distinct words, and ranks that the rejection limits tell apart.
SHARED_BYTES, RANKS = 4 << 20, 100_000
#: One of so many rows that may be learned from calibrates instead.
CALIBRATION = 16
#: Arrays of up to this many values (n-grams times languages and one; 64 MB) are broadcast. Words whose bits a task remembers.
MAX_BROADCAST, REMEMBERED = 4_000_000, 1_000_000
_BLANK = 0x20

_tables: list[np.ndarray] = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter (or a mark on one), and its lower case."""
    if not _tables:
        points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
        _tables.append(np.array([unicodedata.category(c)[0] in "LM" for c in points]))
        _tables.append(np.array([ord(c.lower()[0]) for c in points], np.uint32))
    return _tables[0], _tables[1]


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, starts and ends of their words, and first: words of text i are first[i]:first[i + 1]."""
    is_letter, lower = letters()
    coded = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    gap = np.array([_BLANK], np.uint32)
    codes = np.concatenate([gap, *[x for c in coded for x in (c, gap)]])
    first = np.concatenate([[1], 1 + np.cumsum([len(c) + 1 for c in coded], dtype=np.int64)]).astype(np.int64)
    letter = is_letter[codes]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    return lower[codes], starts, ends, np.searchsorted(starts, first)


def spelled(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as ' word ' one after another; for each predicted place the index into them, and the start of its word."""
    lengths = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(int(lengths.sum())) - begin[word]
    out = np.full(len(word), _BLANK, np.uint32)
    middle = (inside > 0) & (inside < lengths[word] - 1)
    out[middle] = codes[starts[word[middle]] + inside[middle] - 1]
    places = np.flatnonzero(inside > 0)
    return out, places, begin[word[places]]


#: Rows of a text (doc_id to times: the distinct words' places in the batch's list, and how often each stands), of a word in
#: that list (i, hash), and of a word's count in a training language, or outside training (lang, hash, word, n).
_PREPARED = "kind byte, batch long, doc_id long, held_out boolean, lang string, calibrates string, characters long, at binary, times binary, i int, hash long, word string, n long"


def _rows(kind: int, batch: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "byte": pa.int8()}
    out = {"kind": pa.array(np.full(size, kind, np.int8)), "batch": pa.array(np.full(size, batch, np.int64))} | columns
    fields = [x.split() for x in _PREPARED.split(", ")]
    return pa.record_batch({name: out[name] if name in out else pa.nulls(size, types[t]) for name, t in fields})


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _PREPARED, from rows of doc_id, held_out, lang (null outside training), calibrates and text."""
    for number, batch in enumerate(slices(batches, limit=SHARED_BYTES), TaskContext.get().partitionId() << 32):
        n = batch.num_rows
        codes, starts, ends, first = letter_words([t or "" for t in batch.column("text").to_pylist()])
        hashes, one, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        text, distinct = np.repeat(np.arange(n), np.diff(first)), max(1, len(hashes))
        pairs, times = np.unique(text * distinct + inverse, return_counts=True)
        cuts = (4 * np.searchsorted(pairs, np.arange(n + 1) * distinct)).astype(np.int32)
        packed = lambda x, cuts=cuts, n=n: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(x.astype(np.uint32))])
        length = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        characters = length[first[1:]] - length[first[:-1]]
        yield _rows(0, number, n, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang=batch.column("lang"), calibrates=batch.column("calibrates"), characters=pa.array(characters, pa.int64()), at=packed(pairs % distinct), times=packed(times))
        if not len(hashes):
            continue
        yield _rows(1, number, len(hashes), i=pa.array(np.arange(len(hashes)), pa.int32()), hash=pa.array(signed(hashes)))
        langs = batch.column("lang").to_pylist()
        names = list(dict.fromkeys(langs))
        place = {x: i for i, x in enumerate(names)}
        keys, counts = np.unique(inverse * len(names) + np.array([place[x] for x in langs])[text], return_counts=True)
        words = pa.array([codes[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], pa.string())
        at, owner = keys // len(names), keys % len(names)
        yield _rows(2, number, len(keys), lang=pa.array(names, pa.string()).take(pa.array(owner)), hash=pa.array(signed(hashes[at])), word=words.take(pa.array(at)), n=pa.array(counts, pa.int64()))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of batches of lang and text."""
    for batch in slices(batches, limit=SHARED_BYTES):
        codes, starts, ends, first = letter_words([t or "" for t in batch.column("text").to_pylist()])
        if not len(starts):
            continue
        _, one, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        words = pa.array([codes[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], pa.string())
        langs = batch.column("lang").to_pylist()
        names = list(dict.fromkeys(langs))
        place = {x: i for i, x in enumerate(names)}
        text = np.repeat(np.arange(batch.num_rows), np.diff(first))
        keys, counts = np.unique(inverse * len(names) + np.array([place[x] for x in langs])[text], return_counts=True)
        yield pa.record_batch({"lang": pa.array(names, pa.string()).take(pa.array(keys % len(names))), "word": words.take(pa.array(keys // len(names))), "n": pa.array(counts, pa.int64())})


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): all n-grams of ' word ' that end after its first blank, over a batch of words."""
    for batch in slices(batches, "word"):
        langs = batch.column("lang").to_pylist()
        names = list(dict.fromkeys(langs))
        codes, starts, ends, first = letter_words(batch.column("word").to_pylist())
        text, places, begin = spelled(codes, starts, ends)
        lengths = ends - starts + 1
        row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(first)), lengths)
        owner, weight = np.array([names.index(x) for x in langs], np.int64)[row], batch.column("n").to_numpy()[row]
        for k in range(1, ORDER + 1):
            fits = places - begin >= k - 1
            at = places[fits] - k + 1
            keys = mix(span_hashes(text, at, at + k) + owner[fits].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=weight[fits], minlength=len(one)).astype(np.int64)
            grams = [text[a : a + k].tobytes().decode("utf-32-le") for a in at[one].tolist()]
            yield pa.record_batch({"lang": pa.array([names[i] for i in owner[fits][one]], pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(n)})


def _longest_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, gram): for each place of ' word ', the character there with all that predict it."""
    for batch in slices(batches, "word"):
        codes, starts, ends, first = letter_words(batch.column("word").to_pylist())
        text, places, begin = spelled(codes, starts, ends)
        row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(first)), ends - starts + 1)
        at = np.maximum(begin, places - ORDER + 1)
        _, one, inverse = np.unique(span_hashes(text, at, places + 1), return_index=True, return_inverse=True)
        grams = [text[a:b].tobytes().decode("utf-32-le") for a, b in zip(at[one].tolist(), (places[one] + 1).tolist(), strict=True)]
        yield pa.record_batch({"hash": pa.array(batch.column("hash").to_numpy()[row]), "gram": pa.array(grams, pa.string()).take(pa.array(inverse))})


class Order(NamedTuple):
    """Sorted hashes of grams with their discounted probabilities, and of contexts with the weight of the order below, per language."""

    grams: np.ndarray
    probabilities: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


class Model(NamedTuple):
    """All estimates as sorted hash arrays."""

    languages: list[str]
    orders: list[Order]
    #: Probability of a character that was never seen.
    floor: float

    def word_bits(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits that each language needs for each word."""
        text, places, begin = spelled(codes, starts, ends)
        p = np.full((len(places), len(self.languages)), self.floor)
        for k, order in enumerate(self.orders, 1):
            fits = np.flatnonzero(places - begin >= k - 1)
            at, end = places[fits] - k + 1, places[fits]
            backed = p[fits]
            contexts = span_hashes(text, at, end)
            found = np.minimum(np.searchsorted(order.contexts, contexts), len(order.contexts) - 1)
            seen = order.contexts[found] == contexts
            backed[seen] *= order.weights[found[seen]]
            grams = span_hashes(text, at, end + 1)
            found = np.minimum(np.searchsorted(order.grams, grams), len(order.grams) - 1)
            seen = order.grams[found] == grams
            backed[seen] += order.probabilities[found[seen]]
            p[fits] = backed
        bits = -np.log2(p)
        return np.add.reduceat(bits, np.flatnonzero(np.diff(begin, prepend=-1)), axis=0) if len(places) else bits[:0]


class Estimates(NamedTuple):
    """``grams`` has gram, k, and of each language i the discounted probability p{i} and the weight w{i} of the order below."""

    languages: list[str]
    grams: DataFrame
    floor: float


def _folds(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang of rows to learn from, calibrates (lang of rows to calibrate with) and text."""
    fold, part = remainder("doc_id", 3), remainder("doc_id", CALIBRATION)
    held_out = F.coalesce(fold == 1, F.lit(True)).alias("held_out")
    return docs.select("doc_id", held_out, F.when((fold != 1) & (part != 0), F.col("lang")).alias("lang"), F.when((fold != 1) & (part == 0), F.col("lang")).alias("calibrates"), "text")


def _each(n: int, name: str, value) -> list[Column]:
    return [value(i).alias(f"{name}{i}") for i in range(n)]


def _learned(docs: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The languages in order, and, if there are any, (gram, n of each language) of all words of the rows to learn from."""
    words = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]  # one row per language
    if not languages:
        return languages, None
    counted = words.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("gram")
    return languages, written(counted.agg(*_each(len(languages), "n", lambda i: F.sum(F.when(F.col("lang") == languages[i], F.col("n")).otherwise(0)))))


def estimate(wide: DataFrame, languages: list[str]) -> Estimates:
    """Interpolated Kneser-Ney estimates of all grams; those with counts of 0 only back off."""
    every = len(languages)
    each = lambda name, value: _each(every, name, value)
    some = lambda x: F.when(x > 0, 1).otherwise(0)
    wide = wide.withColumn("k", F.length("gram"))
    before = wide.where("k > 1").groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*each("m", lambda i: F.sum(some(F.col(f"n{i}")))))
    raw = (F.col("k") == ORDER) | F.col("gram").startswith(" ")
    counts = wide.join(before, "gram", "left").select(
        "gram", "k", F.expr("substring(gram, 1, k - 1)").alias("context"),
        *each("n", lambda i: F.when(raw | (F.col(f"n{i}") == 0), F.col(f"n{i}")).otherwise(F.greatest(F.coalesce(f"m{i}", F.lit(0)), F.lit(1)))),
    )
    counts = written(counts)
    of_counts = counts.groupBy("k").agg(
        *each("once", lambda i: F.sum((F.col(f"n{i}") == 1).cast("long"))), *each("twice", lambda i: F.sum((F.col(f"n{i}") == 2).cast("long"))), F.sum((F.greatest(*each("n", lambda i: F.col(f"n{i}")), F.lit(0)) > 0).cast("long")).alias("seen")
    ).collect()  # one row per order
    discounts = {(r["k"], i): min(0.95, max(0.1, (r[f"once{i}"] + 0.5) / (r[f"once{i}"] + 2 * r[f"twice{i}"] + 1))) for r in of_counts for i in range(every)}
    alphabet = max(2, next(r["seen"] for r in of_counts if r["k"] == 1) + 1)
    discount = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k in sorted({k for k, _ in discounts}) for x in (k, discounts[k, i])]), F.col("k"))
    contexts = counts.groupBy("context").agg(*each("s", lambda i: F.sum(f"n{i}")), *each("c", lambda i: F.sum(some(F.col(f"n{i}")))))
    grams = counts.join(contexts, "context").select(
        "gram", "k",
        *each("p", lambda i: F.when(F.col(f"n{i}") > 0, F.greatest(F.col(f"n{i}") - discount(i), F.lit(0.0)) / F.col(f"s{i}")).otherwise(0.0)),
        *each("w", lambda i: F.when(F.col(f"s{i}") > 0, discount(i) * F.col(f"c{i}") / F.col(f"s{i}")).otherwise(1.0)),
    )
    return Estimates(languages, written(grams), 1 / alphabet)


def word_bits(words: DataFrame, known: Estimates) -> DataFrame:
    """hash and bits b{i} in each language, one row per distinct word."""
    every = len(known.languages)
    level, longest = None, []
    for k in range(1, ORDER + 1):
        now = known.grams.where(F.col("k") == k)
        if level is not None:
            now = now.join(level, F.expr("substring(gram, 2)") == F.col("_below"))
        lower = lambda i, k=k: F.lit(known.floor) if k == 1 else F.col(f"q{i}")
        now = written(now.select("gram", *_each(every, "q", lambda i, lower=lower: F.col(f"p{i}") + F.col(f"w{i}") * lower(i))))
        longest.append(now if k == ORDER else now.where(F.col("gram").startswith(" ")))
        level = now.withColumnRenamed("gram", "_below")
    table = longest[0]
    for x in longest[1:]:
        table = table.union(x)
    each = words.select("hash", "word").distinct().mapInArrow(_longest_grams, "hash long, gram string")
    return each.join(table, "gram").groupBy("hash").agg(*_each(every, "b", lambda i: F.sum(-F.log2(f"q{i}"))))


def _hashes(strings: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
    return span_hashes(codes, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def arrays(known: Estimates) -> Model:
    """The estimates as sorted hash arrays in the driver's memory; their number is to be checked before."""
    rows, orders = known.grams.toArrow(), []
    lengths = rows["k"].to_numpy()
    for k in range(1, int(lengths.max()) + 1):
        part = rows.filter(pa.array(lengths == k))
        grams = part["gram"].to_pylist()
        p, w = (np.column_stack([part[f"{x}{i}"].to_numpy() for i in range(len(known.languages))]) for x in "pw")
        (gram, at), (context, held) = np.unique(_hashes(grams), return_index=True), np.unique(_hashes([g[:-1] for g in grams]), return_index=True)
        orders.append(Order(gram, p[at], context, w[held]))
    return Model(known.languages, orders, known.floor)


def fit(docs: DataFrame) -> Model | None:
    """The model of a corpus whose n-grams are known to be few."""
    languages, wide = _learned(_folds(docs))
    return arrays(estimate(wide, languages)) if languages else None


_SCORED = "doc_id long, held_out boolean, calibrates string, lang_pred string, score double, bits double, own double"


def _scored(texts: pa.RecordBatch | pa.Table, characters: np.ndarray, total: np.ndarray, languages: list[str]) -> dict[str, pa.Array]:
    """Columns of _SCORED from each text's bits in each language."""
    each, rows = total / np.maximum(characters, 1)[:, None], np.arange(len(total))
    best = each.argmin(1)
    lowest = each[rows, best]
    likely = 1 / np.exp2((lowest[:, None] - each) * np.minimum(characters, EVIDENCE)[:, None]).sum(1)
    own = np.array([languages.index(x) if x in languages else -1 for x in texts.column("calibrates").to_pylist()], np.int64)
    some = characters > 0
    return {
        **{c: texts.column(c) for c in ("doc_id", "held_out", "calibrates")},
        "lang_pred": pa.array([languages[i] if x else "und" for i, x in zip(best.tolist(), some.tolist(), strict=True)], pa.string()),
        "score": pa.array(np.where(some, likely, 0.0)),
        "bits": pa.array(np.where(some, lowest, 0.0)),
        "own": pa.array(each[rows, own], mask=~some | (own < 0)),
    }


def _score_with_arrays(model):
    """Rows of _SCORED from batches of _folds; bits of words are remembered within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        words, held = np.zeros(0, np.uint64), np.zeros((0, len(known.languages)))
        for batch in slices(batches, limit=SHARED_BYTES):
            codes, starts, ends, first = letter_words([t or "" for t in batch.column("text").to_pylist()])
            hashes, one, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
            new = ~np.isin(hashes, words, assume_unique=True)
            if new.any():
                if len(words) > REMEMBERED:
                    words, held, new = words[:0], held[:0], np.ones(len(hashes), bool)
                words, bits = np.concatenate([words, hashes[new]]), known.word_bits(codes, starts[one[new]], ends[one[new]])
                order = np.argsort(words)
                words, held = words[order], np.concatenate([held, bits])[order]
            length = np.concatenate([[0], np.cumsum(ends - starts + 1)])
            total, full = np.zeros((batch.num_rows, len(known.languages))), np.diff(first) > 0
            if full.any():
                total[full] = np.add.reduceat(held[np.searchsorted(words, hashes)][inverse], first[:-1][full], axis=0)
            yield pa.record_batch(_scored(batch, length[first[1:]] - length[first[:-1]], total, known.languages))

    return run


def _score_with_tables(docs: DataFrame, wide: DataFrame, languages: list[str]) -> DataFrame:
    """The same rows by joins: for estimates of any size."""
    every = len(languages)
    prepared = written(docs.mapInArrow(_prepared, _PREPARED))
    texts, listed = prepared.where("kind = 0"), prepared.where("kind = 1").select(F.col("batch").alias("_batch"), "i", "hash")
    words = written(prepared.where("kind = 2").groupBy("hash", "word").agg(F.lit(0).cast("long").alias("n")))
    others = words.select(F.lit(None).cast("string").alias("lang"), "word", "n").mapInArrow(_gram_counts, "lang string, gram string, n long")
    others = others.select("gram", *_each(every, "n", lambda _i: F.lit(0).cast("long")))
    known = estimate(written(wide.union(others).groupBy("gram").agg(*_each(every, "n", lambda i: F.sum(f"n{i}")))), languages)
    bits = listed.join(word_bits(words, known), "hash").drop("hash")

    def score(texts: pa.Table, bits: pa.Table) -> pa.Table:
        table = np.column_stack([bits.column(f"b{i}").to_numpy() for i in range(every)])[np.argsort(bits.column("i").to_numpy())]
        at, times = (texts.column(x).to_pylist() for x in ("at", "times"))
        size = np.array([len(x) // 4 for x in at])
        at, times = (np.frombuffer(b"".join(x), np.uint32) for x in (at, times))
        full, total = size > 0, np.zeros((texts.num_rows, every))
        if full.any():
            total[full] = np.add.reduceat(table[at] * times[:, None], (np.cumsum(size) - size)[full], axis=0)
        return pa.table(_scored(texts, texts.column("characters").to_numpy(), total, languages))

    texts = texts.select("batch", "doc_id", "held_out", "calibrates", "characters", "at", "times")
    return texts.groupBy("batch").cogroup(bits.groupBy("_batch")).applyInArrow(score, _SCORED)


def identify_languages(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits (per character) and rejected."""
    plain = _folds(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    languages, wide = _learned(plain)
    if not languages:
        return plain.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), F.lit(True).alias("rejected"))
    if wide.count() * (len(languages) + 1) <= max_broadcast:
        model = docs.sparkSession.sparkContext.broadcast(arrays(estimate(wide, languages)))
        scored = plain.select("doc_id", "held_out", "calibrates", "text").mapInArrow(_score_with_arrays(model), _SCORED)
    else:
        scored = _score_with_tables(plain, wide, languages)
    scored = written(scored)
    limits = dict(scored.where("own IS NOT NULL").groupBy("calibrates").agg(F.percentile_approx("own", 0.999, RANKS)).collect())  # one row per language
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("lang_pred")) + MARGIN if limits else F.lit(float("inf"))
    return scored.select("doc_id", "held_out", "lang_pred", "score", "bits", F.coalesce((F.col("lang_pred") == "und") | (F.col("bits") > limit), F.lit(False)).alias("rejected"))
