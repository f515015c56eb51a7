"""Whitening, suffix arrays and spelling variants against brute-force versions, and on odd and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.llm import neighbours, pii, queries, spelling, substrings, suffixes, whitening

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ("y", "n", "doc", "sum", "ranges", "key", "piece", "word", "form", "root", "component")


# --- 11 whitening


def fitted(vectors, d):
    sound = [v for v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    y = np.array([[np.floor(64 * x) for x in v] + [0.0] * (d - len(v)) for v in sound])
    return np.unique(y, axis=0)


def test_whitening_on_the_table(spark):
    rows = queries.op11_whitening(spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    d = max(map(len, vectors.values()))
    y = fitted(vectors.values(), d)
    n, total = len(y), y.sum(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(y.T, bias=True)))[::-1]
    assert len(rows) == 16 * len(vectors) and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9
    for r in rows:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        x = [int(np.floor(64 * v)) for v in vectors[r.vec_id]]
        assert r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True))
    w = np.zeros((len(vectors), 16))
    place = {v: i for i, v in enumerate(vectors)}
    for r in rows:
        w[place[r.vec_id], r.component - 1] = r.whitened
    centred = np.floor(64 * np.array(list(vectors.values()))) - total / n
    axes = np.linalg.lstsq(w, centred, rcond=None)[0]  # whitened values span what the components explain
    assert np.allclose(np.linalg.norm(axes, axis=1), np.sqrt(values[:16]), rtol=0.2)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0]), (None, [3.0, -1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf]), (7, []), (8, [1.0, 2.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    found = whitening.whiten(frame).collect()
    y = fitted([v for _, v in rows], 3)
    assert len(y) == 4 and len(found) == 6 * 3 and {r.n for r in found} == {4}
    assert sorted({r.component for r in found}) == [1, 2, 3] and found[0].identity_error < 1e-12
    assert sum(r.vec_id is None for r in found) == 3
    assert sum(r.explained for r in found if r.vec_id == 2) == pytest.approx(1)


def test_whitening_without_variance(spark):
    frame = spark.createDataFrame([(1, [1.0, 5.0]), (2, [1.0, 6.0]), (3, [1.0, 9.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(frame).collect()} == {1}
    assert whitening.whiten(frame.where("vec_id = 1")).collect() == []
    assert whitening.whiten(frame.limit(0)).collect() == []


def test_whitening_of_equal_and_huge_values(spark):
    corners = [(i, [float((i >> k & 1) * 2 - 1) for k in range(3)]) for i in range(8)]  # one root, thrice
    found = whitening.whiten(spark.createDataFrame(corners, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 24 and found[0].identity_error < 1e-12 and all(r.explained == pytest.approx(1 / 3) for r in found)
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 2.0])]
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6 and found[0].identity_error < 1e-6
    assert found[0].deviation is None or found[0].deviation > 2**63


def test_roots_and_polynomials():
    rng = np.random.default_rng(3)
    y = rng.integers(-9, 9, (40, 7))
    y[:, 6] = y[:, 5]
    m = (len(y) * y.T @ y - np.outer(y.sum(0), y.sum(0))).tolist()
    primes = whitening.primes_below(1 << 31, whitening.polynomial_bits(m) // 30 + 1)
    c = whitening.remaindered({p: whitening.polynomial_modulo(m, p).tolist() for p in primes})
    assert c[0] == 0 and c[-1] == 1 and c[-2] == -sum(m[i][i] for i in range(7))
    roots = whitening.greatest_roots(c, 16)
    expected = np.sort(np.linalg.eigvalsh(np.array(m, float)))[::-1][:6]
    assert np.allclose([a / 2**s for a, s, _ in roots], expected, rtol=1e-12)
    for a, s, k in roots:
        axis = whitening.null_space(m, a, s, k)[0]
        assert np.abs(np.array(m, float) @ axis - a / 2**s * axis).max() < 1e-12 * a / 2**s
    assert whitening.primes_below(30, 4) == [29, 23, 19, 17]


# --- 12 suffix arrays


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 50)))
        t = np.tile(t, 3) if trial % 3 == 0 else t
        t = t * 2000 if trial % 5 == 0 else t  # more symbols than buckets are scanned for
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_names_tell_a_string_from_its_beginning_at_a_full_word():
    """With ten bits a symbol six are compared at once: of six symbols and a longer string that begins with them, the longer is the smaller."""
    t = np.array([1] * 6 + [2] * 6 + [511])
    assert suffixes._named(np.tile(t, 2), np.array([0, 13]), np.array([5, 24])).tolist() == [1, 0]


def windows_of(texts, window):
    count = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    return [[i for i in range(len(b) - window + 1) if count[b[i : i + window]] > 1] for b in texts]


def cut(data, starts, window):
    gone = np.zeros(len(data) + 2, bool)
    for i in starts:
        gone[i + 1 : i + window + 1] = True
    kept = bytes(c for c, g in zip(data, gone[1:-1], strict=True) if not g)
    return len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), kept


def test_repeated_windows():
    rng = np.random.default_rng(2)
    for _ in range(80):
        pieces = [bytes(rng.choice([0, 97, 98], int(rng.integers(1, 30))).tolist()) for _ in range(int(rng.integers(1, 6)))]
        found = set(zip(*(x.tolist() for x in suffixes.repeated_windows(pieces, 5)), strict=True))
        assert found == {(p, i) for p, starts in enumerate(windows_of(pieces, 5)) for i in starts}


def test_suffix_dedup_on_the_table(spark):
    rows = queries.op12_suffix_dedup(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    starts = dict(zip(texts, windows_of(texts.values(), 400), strict=True))
    assert any(starts.values())
    for r in rows:
        n, removed, spans, kept = cut(texts[r.doc_id], starts[r.doc_id], 400)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("crowd, broadcast", [(1, 500_000), (2, 500_000), (2048, 500_000), (2048, 3), (2, 0)])
def test_suffix_dedup_of_odd_texts(spark, monkeypatch, crowd, broadcast):
    """Runs, periods, shared ids, repeated rows, passages in many texts; small shards, crowds and broadcasts give the same."""
    monkeypatch.setattr(suffixes, "MAX_BROADCAST", broadcast)
    passage = " ".join(f"p{i * i % 97}" for i in range(30))
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 300), (5, "b" * 90 + "a" * 120), (6, "xyz" * 100), (7, "é" * 70), (None, passage), (None, "no other has this " * 2)]
    rows += [(9, passage + " own"), (9, "unlike all " + word() * 9), (10, word() * 3), (10, word() * 3), (11, "twice the same row, " * 3), (11, "twice the same row, " * 3)]
    rows += [(20 + i, f"{word()} {passage} {word()}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    found = suffixes.remove_repeats(frame, 40, crowd, 300).collect()
    texts = [(t or "").encode() for _, t in rows]
    expected = Counter((i, *cut(b, starts, 40)) for (i, _), b, starts in zip(rows, texts, windows_of(texts, 40), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == expected
    assert suffixes.remove_repeats(frame.limit(0), 40).collect() == []


# --- 13 spelling variants


def counted(rows):
    count = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return count


def grouped(count):
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    sharing = defaultdict(set)
    for w in words:
        for key in [w[:i] + "*" + w[i + 1 :] for i in range(len(w))] + [w[:i] + "*" + w[i:] for i in range(len(w) + 1)]:
            sharing[key].add(w)
    near = defaultdict(set)
    for group in sharing.values():
        for w in group:
            near[w] |= {v for v in group if v != w and (len(v) != len(w) or sum(a != b for a, b in zip(v, w, strict=True)) == 1)}
    found = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 5 * n else None
        found[w] = [form, n, len(near[w]), words.get(form)]
    for w, row in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in found.items()}


def test_spelling_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = grouped(counted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling_variants(spark, "/root/testdata/sf0.01").collect()}
    assert found == expected
    assert sum(row[0] is not None for row in expected.values()) > 100 and any(row[1] != row[0] for row in expected.values() if row[0])


def test_spelling_of_odd_texts(spark):
    long = "ab" * 400
    counts = {"balloon": 900, "baloon": 100, "balon": 3, "bbaloon": 15, "balloons": 20, "galloon": 20, "àéîöûñ": 40, "àéîöû": 9, "àéîöûx": 8, long: 30, long + "a": 6, long[1:]: 5, "ab×cd÷e": 6}
    rows = [(i % 7, " ".join([w.upper() if w.isascii() else w] * n) + " 12") for i, (w, n) in enumerate(counts.items())]
    rows += [(1, None), (2, ""), (None, "Balloon balloon"), (3, "x"), (3, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(frame).collect()}
    assert found == grouped(counted(rows)) and found["bbaloon"][:2] == ("baloon", "balloon")
    assert spelling.group_variants(frame.limit(0)).collect() == []


# --- 4 substring dedup: rows that share an id


def test_substrings_of_shared_ids(spark):
    """A copy of another document's text goes; an unrelated text under the same id, or without one, stays."""
    a, b, c = (" ".join(f"{letter}{i * i % 89}x{i}" for i in range(30)) for letter in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, c), (None, c + " tail"), (8, "new " + c), (9, b + " more")]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = Counter((r.doc_id, r.text) for r in found)
    assert left[(3, a)] == 1 and left[(5, "")] == 1 and left[(5, b)] == 2
    assert left[(None, c)] == 1 and left[(8, "new")] == 1 and left[(9, "more")] == 1


# --- 6 quality classifier: one text for each labelled id


def test_repeated_rows_do_not_widen_the_sample(spark):
    rows = [(i % 6, f"good words here {i % 6}" if i % 2 else f"bad bad bad {i % 6}") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    model = neighbours.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(model.labels) <= 6


# --- 9 personal data


def test_trees_and_threshold_use_all_candidates(spark, monkeypatch):
    """The positive ones come after the first 20,000; splitting the rows otherwise changes nothing; NumPy over all rows gives the same trees."""
    monkeypatch.setattr(pii, "TREES", 4)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 60, (40_000, len(pii.FEATURES))).astype(float)
    x[:, 1] **= 3
    y = (np.arange(len(x)) >= 25_000) & (x[:, 0] > 30)
    x[y, 2] += 60
    frame = spark.createDataFrame([(i, bool(y[i]), r.tolist()) for i, r in enumerate(x)], "order long, label boolean, features array<double>")
    trees, least = pii.fit(frame.repartition(3))
    again, same = pii.fit(frame.repartition(7))
    fold = np.arange(len(x)) % 5 == 0
    whole = pii.Trees(x[~fold], y[~fold].astype(float))
    assert len(trees.trees) == len(again.trees) == len(whole.trees) == pii.TREES and least == same
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for ts in zip(trees.trees, again.trees, whole.trees, strict=True) for a, b, c in zip(*ts, strict=True))
    chosen = fold & (trees.margins(x) >= least)
    assert chosen.any() and y[chosen].mean() >= pii.PRECISION


def test_no_or_only_positive_candidates_give_no_threshold(spark):
    for rows in ([], [(i, True, [1.0] * len(pii.FEATURES)) for i in range(9)], [(i, i % 2 == 0, [1.0] * len(pii.FEATURES)) for i in range(40)]):
        trees, least = pii.fit(spark.createDataFrame(rows, "order long, label boolean, features array<double>"))
        assert trees.trees == [] and np.isinf(least)
