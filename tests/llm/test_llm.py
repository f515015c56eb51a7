"""The corpus operators against brute-force versions, and on nulls, empty texts, repeats, clashing columns and empty tables."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seismark.llm import language, licences, mixing, neardup, neighbours, packing, pii, quality_rules, queries, substrings, topk
from seismark.llm.words import split_words

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 700}x{i % 13}" for i in range(9000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one two", "en", None, 7),
    (4, "one two", "en", None, 7),
    (5, "One TWO", "en", "b", 7),
    (None, "a row without an id", "en", "b", 1),
    (6, LONG, "en", "b", 1),
    (7, LONG + " tail", "en", "a", 1),
    (8, "naïve café 日本 \U0001f600 it's a@b.co", "fr", "é", 1),
    (9, "same same same same same same", "en", "a", 1),
]
CLASHES = ("size", "copies", "score", "target", "base", "added", "key", "doc", "id", "root", "band", "n", "held_out", "kept", "words", "host", "path", "file")


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(text):
    return WORD.findall(text or "")


# --- words


def test_words_and_hashes():
    texts = ["a b  a\tc\x0b", "", None, "a\x1cb é", "c"]
    found = split_words(pa.array(texts))
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert [bytes(found.data[s:e]).decode() for s, e in zip(found.starts, found.ends, strict=True)] == flat
    assert len(set(found.hashes.tolist())) == len(set(flat)) and found.hashes[0] == found.hashes[2]


# --- 1 packing


def check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW


def test_packing(docs, texts):
    rows = packing.pack_pieces(docs, PATH).collect()
    check_pieces(rows, texts)
    assert sum(r.length for r in rows) / packing.WINDOW / len({r.sequence_id for r in rows}) > 0.95


def test_packing_odd(odd, empty):
    once = odd.dropDuplicates(["doc_id"])
    check_pieces(packing.pack_pieces(once, PATH).collect(), {r.doc_id: r.text for r in once.collect()})
    assert packing.pack_pieces(empty, PATH).count() == 0
    sequences = packing.pack_sequences(odd, PATH).collect()
    assert all(len(r.ids) == packing.WINDOW and sum(r.lengths) == r.n_ids for r in sequences)
    assert sum(len(set(r.doc_ids)) for r in sequences) >= 9


def test_encoder_equals_library():
    coder = packing.Encoder(PATH)
    samples = ["it's DON'T we'll I'VE ''s x'", "", "  ", "日本 naïve ÅÉ İx 12,5 <|endoftext|> \x85 á", "they're'd 's're", "l'l 'l 're", "'", LONG]
    assert [x.tolist() for x in coder.encode(samples)] == [x.ids for x in coder.tokenizer.encode_batch(samples, add_special_tokens=False)]


def test_best_fit_takes_tightest_window():
    windows, offsets = packing.best_fit_decreasing([60, 50, 45, 40, 5], 100)
    assert windows == [0, 1, 1, 0, 1] and offsets == [0, 0, 50, 60, 95]


# --- 2 near-duplicates


def shingles(text, k):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, percent=80):
    sets, parent = {i: shingles(t, k) for i, t in texts.items()}, {}

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_components(texts, 4)


def families():
    """Chained near copies of several lengths that share passages."""
    rng = np.random.default_rng(5)
    base, texts = [f"b{i}" for i in range(120)], {}
    for n in range(80):
        w = list(base) if n % 3 else [*base[:60], *[f"o{n}-{i}" for i in range(60)]]
        for i in rng.integers(0, 120, int(rng.integers(0, 9))):
            w[i] = f"r{n}-{i}"
        texts[n] = " ".join(w[: 120 - 3 * (n % 20)])
    return texts


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Buckets of many blocks, of several sizes."""
    texts = families()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, 4, 80).collect()}
    assert got == brute_components(texts, 4)


def test_near_duplicates_that_share_one_large_bucket(spark, monkeypatch):
    """With one band of one row, every pair meets in one bucket at most, and each that meets is compared."""
    texts = families()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    elements, first = neardup.shingle_sets(pa.array(list(texts.values())), 4)
    bucket = neardup.superminhash(elements, np.repeat(np.arange(len(texts)), np.diff(first)), len(texts), 1)[:, 0]
    want = {}
    for x in np.unique(bucket):
        want |= brute_components({i: texts[i] for i in np.flatnonzero(bucket == x).tolist()}, 4)
    assert np.unique(bucket, return_counts=True)[1].max() > 20
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, 4, 80, bands=1, rows=1).collect()} == want


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 62, 300).astype(np.uint64)])
    both = neardup.superminhash(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [900, 900, 3]), 3, 240)
    assert abs((both[0] == both[1]).mean() - 0.5) < 0.12
    assert (both[2] < np.uint64((1 << 64) - 1)).all()


def test_near_duplicates_odd(odd, empty):
    rows = neardup.near_duplicates(odd, shingle=4).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert got[5].component_id == 4 and not got[5].kept and got[7].component_id == 6
    assert got[None].component_id is None and got[None].kept
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "9", "None"]


# --- 3 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
        left, open_ = left - sum(target[s] for s in full), open_ - full
    return target


def test_mixing(spark, docs):
    rows = queries.op3_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.01 * sizes[s] + 5
    assert sorted(rows) == sorted(queries.op3_mixing(spark, SF).collect())


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 3000).astype(float), np.full(3000, 0.37)
    out = mixing.fly(size, p, 2)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert size @ out == pytest.approx(size @ p) and out.sum() == pytest.approx(p.sum())


def test_mixing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    frame = spark.createDataFrame([(i, " ".join("w" * (i % 17)), f"s{i % 2}") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix_units(frame).collect()
    assert len(rows) == 900
    for s in ("s0", "s1"):
        part = [r for r in rows if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in part) - part[0].target) <= 10


def test_mixing_odd(odd, empty):
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() >= 5
    assert {r["size"] for r in mixing.mix_units(odd).where("doc_id <= 3").collect()} == {0}
    assert mixing.mix_sources(empty).count() == 0


# --- 4 substring dedup


def brute_repeats(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(gone), " ".join(a for a, b in zip(w, gone, strict=True) if not b))
    return out


def test_substring_dedup(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts)


def test_substring_dedup_of_runs_and_periods(spark):
    rng = np.random.default_rng(3)
    texts = {0: "a " * 100, 1: "a b " * 60, 2: "x " + "a b " * 30, 3: " ".join(rng.choice(list("abc"), 400)), 4: "z " + "a " * 19, 5: "a " * 20, 6: " ".join(rng.choice(list("ab"), 300)), 7: "q"}
    passage = " ".join(f"p{i}" for i in range(25))
    texts |= {10 + i: f"s{i} {passage} e{i}" for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(frame).collect()}
    assert got == brute_repeats(texts)


def test_substring_dedup_odd(odd, empty):
    rows = substrings.remove_repeats(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and got[1].n_words == 0 and got[1].text == ""
    assert got[7].n_removed == 9000 and got[7].text == "tail"
    assert substrings.remove_repeats(empty).count() == 0


# --- 5 quality rules


def brute_statistics(text):
    w, n = words(text), 0
    counts, covered, seen = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set()
    for i in range(len(w) - 2):
        if counts[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            n += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), n, len(covered)


def statistics(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_quality_rules(docs, texts):
    for r in quality_rules.quality_rules(docs).collect():
        assert statistics(r) == brute_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_frequent_lines(spark):
    body = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    rows = [(i, f"{body('c', 40)}\n{body(i, 80 if i % 2 else 30)}", "h") for i in range(10)] + [(99, f"{body('c', 40)}\n{body(99, 30)}", None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_documents=5, max_share=0.5).collect()}
    assert got[1].removed_words == 40 and got[1].kept and not got[0].kept and got[99].removed_words == 0 and got[99].kept


def test_frequent_lines_leave_the_text(spark):
    rows = [(i, f"own {'y' * (i + 1)}\n\nAlways 1{i % 10} here\nlast {'x' * (i + 1)}", "h") for i in range(8)] + [(0, rows_text, "h") for rows_text in ("always 00 HERE", None)]
    rows += [(7, rows[7][1], "h")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    expected = [t and "\n".join(x for x in t.split("\n") if "lways" not in x) for _, t, _ in rows]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(zip([r[0] for r in rows], expected, strict=True))
    assert sum(r.removed_words for r in got) == 3 * 10


def brute_frequent(docs):
    """(host, line) pairs in more than five documents and more than a hundredth of the host's."""
    held, size = {}, Counter(r.source for r in docs)
    for r in docs:
        for line in r.text.split("\n"):
            held.setdefault((r.source, normal_line(line)), set()).add(r.doc_id)
    return {k for k, ids in held.items() if k[1] and len(ids) > 5 and len(ids) > 0.01 * size[k[0]]}


def normal_line(line):
    return tuple(words(re.sub("[1-9]", "0", line.lower())))


def test_frequent_lines_of_small_hosts(spark):
    """With the limits as they are, on the driver's table of 50 documents a host."""
    docs = spark.read.parquet(f"{os.path.dirname(SF)}/sf0.01/documents.parquet")
    rows = docs.collect()
    frequent = brute_frequent(rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    lost = {r.doc_id: sum(len(words(x)) for x in r.text.split("\n") if (r.source, normal_line(x)) in frequent) for r in rows}
    assert any(lost.values()) and lost == {i: r.removed_words for i, r in got.items()}
    assert all(r.kept == (not r.base_failed and 2 * lost[i] <= r.n_words) for i, r in got.items())


def test_quality_rules_odd(odd, empty):
    rows = quality_rules.quality_rules(odd).collect()
    assert Counter(map(statistics, rows)) == Counter(brute_statistics(r[1]) for r in ODD)
    assert quality_rules.quality_rules(empty).count() == 0


# --- 6 quality classifier


def held_out(i, n, rest):
    return zlib.crc32(str(i).encode()) % n == rest


def test_quality_classifier(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = neighbours.score_quality(docs.select("doc_id", "text"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert np.mean(judged) > 0.85


def test_voting_equals_brute_force():
    rng = np.random.default_rng(4)
    samples = [" ".join(rng.choice(["alpha", "beta", "gam%%ma", "de|lta", "eps"], 30)) for _ in range(60)]
    counts = neighbours.text_counts(pa.array(samples))
    model = neighbours.Model(counts[:40], np.arange(40) % 2, 60, (counts > 0).sum(0))
    vectors, asked = model.project(counts[:40]), model.project(counts[40:])
    for score, v in zip(model.score(counts[40:]), asked, strict=True):
        cosines = vectors @ v
        near = np.argsort(-cosines)[: neighbours.NEIGHBOURS]
        weight = np.maximum(cosines[near].astype(float), 1e-3) ** neighbours.SHARPNESS
        assert score == pytest.approx((weight * (near % 2)).sum() / weight.sum(), abs=1e-3)


def test_quality_classifier_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = neighbours.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2)} == {0.0}
    assert neighbours.score_quality(empty, labels).count() == 0
    assert {r.score for r in neighbours.score_quality(odd, labels.limit(0)).where("doc_id > 3").collect()} == {0.5}


# --- 7 top-k


def brute_top_k(x, every=50, k=5):
    want = []
    for q in (i for i in x if i % every == 0):
        best = sorted((-int(sum(int(a) * int(b) for a, b in zip(x[q], x[c], strict=True))), c) for c in x if c != q)[:k]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return sorted(want)


def test_top_k(spark):
    rng = np.random.default_rng(7)
    vectors = {i: (rng.standard_normal(8) / 3).astype(np.float32).tolist() for i in range(400)}
    vectors |= {i: vectors[0] for i in range(100, 160)}
    odd = [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] * 8), (950, [float("inf")] * 8), (None, vectors[0]), (904, [1.0])]
    frame = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("cell", F.lit("x"))
    x = {i: np.floor(256 * np.array(v, float)).astype(int).tolist() for i, v in (vectors | {904: [1.0] + [0.0] * 7}).items()}
    assert sorted(map(tuple, topk.top_k(frame).collect())) == brute_top_k(x)
    assert topk.top_k(frame.limit(0)).count() == 0
    assert sorted(map(tuple, topk.top_k(frame.where("vec_id IN (0, 3, 50)")).collect())) == brute_top_k({i: x[i] for i in (0, 3, 50)})


def test_top_k_over_many_chunks(spark, monkeypatch):
    """Cells, chunks, blocks of queries, ties and repeated rows."""
    for name, value in {"POINTS": 64, "QUERIES": 8, "LEAF": 16, "SAMPLE": 500, "CELLS": 5}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 5))
    vectors = [(i, np.round(centres[i % 6] + rng.standard_normal(5) / 8, 1).tolist()) for i in range(900)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    x = {i: np.floor(256 * np.array(v)).astype(int).tolist() for i, v in vectors}
    assert sorted(map(tuple, topk.top_k(frame, every=10).collect())) == brute_top_k(x, 10)


def test_top_k_of_large_numbers(spark):
    vectors = [(0, [2.0**22, 1.0]), (1, [2.0**22, 2.0]), (2, [2.0**21, 3.0]), (3, [2.0**22, -1.0]), (50, [2.0**20 + 1, -(2.0**20)])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame).collect())) == brute_top_k({i: [int(256 * y) for y in v] for i, v in vectors})
    assert topk.products(np.array([[2**31, 3]]), np.array([[2**31, 1], [-(2**40), 0]])).tolist() == [[2**62 + 3, -(2**63) + 1]]


def test_cover_tree_invariants():
    rng = np.random.default_rng(8)
    points = np.floor(rng.standard_normal((3000, 6)) * 50 + rng.integers(0, 5, (3000, 1)) * 200).astype(np.int64)
    tree = topk.Tree.unpacked(points, *topk.Tree(points).packed())
    assert sorted(tree.order.tolist()) == list(range(3000))
    for node, below in enumerate(tree.children):
        rows = tree.order[tree.start[node] : tree.end[node]]
        away = np.sqrt(((points[rows] - points[tree.centre[node]]) ** 2).sum(1))
        assert away.max() <= tree.radius[node] + 1e-9
        if below:
            centres = points[[tree.centre[c] for c in below]].astype(float)
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))[np.triu_indices(len(below), 1)]
            assert tree.centre[below[0]] == tree.centre[node] and apart.min() >= max(tree.radius[c] for c in below) - 1e-9
            assert sum(tree.end[c] - tree.start[c] for c in below) == len(rows)


def test_dual_tree_prunes_exactly():
    rng = np.random.default_rng(8)
    points = np.floor(rng.standard_normal((3000, 6)) * 50 + rng.integers(0, 5, (3000, 1)) * 200).astype(np.int64)
    search = topk.Search(points[:200], np.full(200, -np.inf), 6)
    search.walk(points, np.arange(3000), topk.Tree(points))
    exact = -np.sort(-(points[:200] @ points.T), axis=1)[:, :6]
    assert (search.score == exact).all() and ((points[:200, None] * points[search.row]).sum(2) == exact).all()
    assert search.pruned


# --- 8 licences


def test_licences(spark):
    rows = [
        ("a", "h/x/LICENSE", "Released under the MIT License."),
        ("b", "h/x/y/z.txt", "nothing"),
        ("c", "h/q.txt", "nothing"),
        ("d", "h/x/y/k", "foo\nLicensed under CC BY-NC 4.0.\nbar of a body with more words than its header"),
        ("e", None, None),
        ("f", "h/x/y/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("g", "h/x/v", "The licence of words"),
        ("g", "h/x/v", "The licence of words"),
        ("h", "h/x/w/deep/er", ""),
    ]
    got = licences.scan_licences(spark.createDataFrame(rows, "file string, path string, text string").withColumn("depth", F.lit(1))).collect()
    assert len(got) == len(rows)
    assert {(r.file, r.licence, r.via) for r in got} == {
        ("a", "MIT", "file"),
        ("b", "GPL-3.0", "inherited"),
        ("c", None, None),
        ("d", "CC-BY-NC-4.0", "header"),
        ("e", None, None),
        ("f", "GPL-3.0", "file"),
        ("g", "MIT", "inherited"),
        ("h", "MIT", "inherited"),
    }


def test_licences_of_long_files(spark):
    line = "This work is licensed under the GNU General Public License, version 3."
    rows = [("a", "h/x/terms", "\n".join([line] * 200)), ("b", "h/x/y/z", "nothing")]
    got = licences.scan_licences(spark.createDataFrame(rows, "file string, path string, text string")).collect()
    assert {(r.file, r.licence, r.via) for r in got} == {("a", "GPL-3.0", "file"), ("b", "GPL-3.0", "inherited")}


def brute_licences(rows, templates):
    """Licence, similarity and via of each (file, path, text): every window, paragraph and whole text against every template."""
    words = lambda text: re.findall("[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]", text.lower())
    lines = [set(words(x)) for _, _, text in rows for x in (text or "").split("\n") if words(x)]
    wordings = [(name, Counter(words(t))) for name in sorted(templates) for t in templates[name]]
    known = {t for _, c in wordings for t in c}
    idf = lambda t: np.log((1 + len(lines)) / (1 + (sum(t in x for x in lines) if t in known else 0))) + 1
    weigh = lambda c: {t: (1 + np.log(n)) * idf(t) for t, n in c.items()}
    length = lambda w: sum(x * x for x in w.values()) ** 0.5
    weighed = [(name, weigh(c)) for name, c in wordings]

    def best(text):
        own = weigh(Counter(words(text)))
        if not own:
            return (0.0, 0, "")
        return max((round(sum(x * own.get(t, 0) for t, x in w.items()) / length(own) / length(w), 6), -i, name) for i, (name, w) in enumerate(weighed))

    given, header = {}, {}
    for file, path, text in rows:
        each = (text or "").split("\n")
        found = [best("\n".join(each[i : i + n])) for n in (1, 2, 3) for i in range(len(each) - n + 1)]
        found += [best("\n".join(g)) for blank, g in itertools.groupby(each, lambda x: not x.strip(" \t\r")) if not blank]
        line, whole = max(found), best(text or "")
        head, is_named = line if line[0] >= 0.6 else None, bool(re.search(licences.NAMED, path or ""))
        as_file = [x for x in (whole if whole[0] >= 0.75 else None, head if is_named else None) if x] or [x for x in (whole,) if is_named and x[0] >= 0.6]
        header[file] = (max(as_file), "file") if as_file else (head, "header") if head else None
        if as_file and "/" in path:
            directory = path.rsplit("/", 1)[0]
            given[directory] = max(given.get(directory, max(as_file)), max(as_file))
    out = {}
    for file, path, _ in rows:
        got, parts = header[file], (path or "").split("/")[:-1]
        for n in range(len(parts), 0, -1):
            if got is None and "/".join(parts[:n]) in given:
                got = given["/".join(parts[:n])], "inherited"
        out[file] = (got[0][2], got[0][0], got[1]) if got else (None, None, None)
    return out


def licence_rows():
    rng = np.random.default_rng(3)
    prose = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(60)] + ["the", "of", "and", "to", "work", "under", "license", "software"]
    said = [t for texts in licences.TEMPLATES.values() for t in texts]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(prose, rng.integers(0, 14))) for _ in range(rng.integers(0, 8))]
        if i % 3 == 0:
            text = said[int(rng.integers(len(said)))].split(" ")
            cut = int(rng.integers(1, len(text) + 1)) if i % 2 else len(text)
            lines[1:1] = [" ".join(text[:cut]), " ".join(text[cut:])]
        folder = "/".join(["r", *rng.choice(list("abc"), rng.integers(0, 4))])
        rows.append((f"f{i}", f"{folder}/{'LICENSE' if i % 7 == 0 else f'f{i}'}" if i % 11 else None, "\n".join(lines)))
    return rows


def test_licences_equal_brute_force(spark):
    rows = licence_rows()
    got = licences.scan_licences(spark.createDataFrame(rows, "file string, path string, text string")).collect()
    want = brute_licences(rows, licences.TEMPLATES)
    assert {r.via for r in got} == {"file", "header", "inherited", None} and len(got) == len(rows)
    for r in got:
        licence, similarity, via = want[r.file]
        assert (r.licence, r.via) == (licence, via), r
        assert r.similarity == pytest.approx(similarity, abs=2e-6) if similarity is not None else r.similarity is None


def test_licences_of_whole_texts(spark):
    """A licence of 6,000 words under any name, one cut over two lines, and a body without the word licence."""
    whole = " ".join(f"term{i * 7919 % 2003}" for i in range(6000))
    mit = licences.TEMPLATES["MIT"][2].replace(", ", ",\n")
    rows = [
        ("a", "p/terms", "\n".join(whole[i : i + 400] for i in range(0, len(whole), 400)) + "\nand more"),
        ("b", "p/x", "prose"),
        ("c", "q/a", "// This work is licensed under a Creative Commons\n// Attribution 4.0 International License."),
        ("d", "q/b", mit),
        ("e", "s/LICENSE.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "\n".join(f"clause {i} of many words" for i in range(3000))),
        ("f", "s/t/u", "All rights reserved."),
    ]
    templates = licences.TEMPLATES | {"Long": [whole]}
    got = {r.file: (r.licence, r.via) for r in licences.scan_licences(spark.createDataFrame(rows, "file string, path string, text string"), templates).collect()}
    assert got == {"a": ("Long", "file"), "b": ("Long", "inherited"), "c": ("CC-BY-4.0", "file"), "d": ("MIT", "file"), "e": ("GPL-3.0", "file"), "f": ("All rights reserved", "file")}


def test_licences_odd(odd, empty):
    frame = lambda x: x.select("*", F.lit("y").alias("_dir"), F.lit("y").alias("start"), F.lit("y").alias("_parent"))
    got = licences.scan_licences(frame(odd)).collect()
    assert len(got) == len(ODD) and all(r.licence is None for r in got)
    assert licences.scan_licences(frame(empty)).count() == 0


def test_licences_query_finds_all_lines(spark, docs):
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "licensed under the GNU General Public License, version 3.", "All rights reserved": "All rights reserved."}
    got = {r.file: r.licence for r in queries.op8_licences(spark, SF).collect()}
    for r in docs.collect():
        said = {name for name, line in lines.items() if line in r.text}
        assert got[f"documents/{r.doc_id}"] in (said or {None})


# --- 9 personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 * (c > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".") if kind == "ip"), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "a@b.c%d@e.f x@y @z.q a@b.c_d@e.f",
    "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 001.02.3.4 12345.6.7.8",
    "4111 1111 1111 1111 5 4111111111111111 x 4111-1111-1111-1111 41111111111111112222",
    "+1 (555) 123-4567 +44 20 7946 0958. +1234567 +123456789012345678 ++1 555 5555",
    '\U0001f600 é a@b.co 4111 1111 1111 1111 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x',
    "",
    "1" * 3000 + " " + "1." * 2000,
    "a" * 50000,
    "a@" + "b." * 5000 + "c +1" + "(" * 20000,
    " ".join(f"u{i}@x.com" for i in range(400)),
]


def test_personal_data_base_spans(spark, docs, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*PERSONAL, None])], "doc_id long, text string")
    for r in pii.find_spans(rows).select("doc_id", "text", pii.spans_text(F.col("base")).alias("spans")).collect():
        assert r.spans == ",".join(base_spans(r.text))
    for r in queries.op9_pii(docs.sparkSession, SF).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_added_spans_find_planted_secrets(spark):
    """All secrets of a whole table and nothing else, though the trees see neither the word nor the sign before them."""
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    frame = frame.union(spark.createDataFrame([(-1, 'words "8ef5f278dec875d2b96fdf291615913d21aee5ca" and words')], "doc_id long, text string"))
    secrets = re.compile("(?i)token = \"([0-9a-f]{40})\"")
    found, planted, extra = 0, 0, 0
    for r in pii.find_spans(frame).select("doc_id", "text", "added").collect():
        want, got = {m.span(1) for m in secrets.finditer(r.text or "")}, {(x.start, x.end) for x in r.added}
        want |= {(7, 47)} if r.doc_id == -1 else set()
        found, planted, extra = found + len(want & got), planted + len(want), extra + len(got - want)
        assert r.doc_id != -1 or got == {(7, 47)}
    print(planted, found, extra)
    assert planted > 100 and found >= 0.95 * planted and extra <= 0.05 * planted


def test_candidates_have_no_length_limit(spark):
    long = "a" * 300 + "1" * 5000
    text = f"x {long} y {'12 ' * 4000}z {'n' * 100}@{'m' * 400} GB82 WEST 1234 5698 7654 32 end 1234567 8a"
    row = spark.createDataFrame([(text,)], "text string").select(*[pii.matches(F.col("text"), kind, pattern).alias(kind) for kind, pattern in pii.CANDIDATES.items()]).first()
    assert [x.value for x in row.token] == [long]
    assert [x.value for x in row.address] == ["n" * 100 + "@" + "m" * 400]
    assert [x.value for x in row.account] == ["GB82 WEST 1234 5698 7654 32"]
    assert ("12 " * 4000).strip() in [x.value for x in row.number] and "1234567" in [x.value for x in row.number]
    check = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82 WEST 1234 5698 7654 33",)], "v string").select(pii.account_check(F.col("v"))).collect()
    assert [r[0] for r in check] == [True, False]


def test_redaction(spark, odd, empty):
    rows = spark.createDataFrame([(1, "mail a@b.co, call +1 (555) 123-4567!"), (2, None), (3, "\U0001f600 1.2.3.4")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert got == {1: "mail [EMAIL], call [PHONE]!", 2: None, 3: "\U0001f600 [IP]"}
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)
    assert pii.redact(empty).count() == 0


def test_trees_learn_and_become_a_column(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, (800, len(pii.FEATURES))).astype(float)
    y = ((x[:, 0] > 9) & (x[:, 3] < 12)).astype(float)
    trees = pii.Trees(x, y)
    assert ((trees.margins(x) > 0) == (y > 0)).mean() > 0.98
    got = spark.createDataFrame([(r.tolist(),) for r in x[:50]], "f array<double>").select(trees.column(F.col("f")).alias("m")).toPandas()["m"]
    assert np.allclose(got, trees.margins(x[:50]))


# --- 10 language


def test_language(docs):
    rows = language.identify_languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97


def learned(i):
    """Whether the language models learn from a doc_id."""
    return zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) % language.CALIBRATION != 0


def test_kneser_ney_equals_brute_force(spark):
    rows = [(i, t, "xx") for i, t in enumerate(["abc abd bcd", "abab cab", "dab abc abcd", "a b cab", "ddd abcab"] * 4)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    bits = brute_kneser_ney(Counter(w for i, t, _ in rows if learned(i) for w in t.split()))
    for word in ("abc", "a", "zzz", "abcabcabc", "dbz", "cabd"):
        text = np.array([ord(c) for c in word], np.uint32)
        assert model.word_bits(text, np.array([0]), np.array([len(text)]))[0, 0] == pytest.approx(bits(word), rel=1e-12)


def brute_kneser_ney(words):
    """Bits of a word, from the counts of all grams of a language's words."""
    grams = Counter()
    for w, n in words.items():
        for end in range(1, len(w) + 2):
            for k in range(1, min(5, end + 1) + 1):
                grams[f" {w} "[end - k + 1 : end + 1]] += n
    before = Counter(g[1:] for g in grams if len(g) > 1)
    counts = {g: n if len(g) == 5 or g[0] == " " else before[g] or 1 for g, n in grams.items()}
    of = {k: Counter(n for g, n in counts.items() if len(g) == k) for k in range(1, 6)}
    discount = {k: min(0.95, max(0.1, (c[1] + 0.5) / (c[1] + 2 * c[2] + 1))) for k, c in of.items()}
    total, kinds = Counter(), Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1

    def p(gram):
        if not gram:
            return 1 / (sum(of[1].values()) + 1)
        d, context, lower = discount[len(gram)], gram[:-1], p(gram[1:])
        return (max(0, counts.get(gram, 0) - d) + d * kinds[context] * lower) / total[context] if total[context] else lower

    return lambda w: -sum(np.log2(p(f" {w} "[max(0, end - 4) : end + 1])) for end in range(1, len(w) + 2))


def test_language_estimates_use_all_grams(spark):
    """More than 100,000 grams of an order, most of them seen once."""
    chosen = np.random.default_rng(1).integers(0x4E00, 0x4E00 + 5000, (45_000, 5))
    spelt = ["".join(map(chr, x)) for x in chosen.tolist()]
    rows = [(i, " ".join(spelt[i * 100 : i * 100 + 100]), "zz") for i in range(450)]
    bits = brute_kneser_ney(Counter(w for i, t, _ in rows if learned(i) for w in t.split()))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for max_broadcast in (language.MAX_BROADCAST, 0):
        got = {r.doc_id: r.bits for r in language.identify_languages(frame, max_broadcast).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows[::15]:
            assert got[i] == pytest.approx(sum(map(bits, t.split())) / sum(len(w) + 1 for w in t.split()), rel=1e-9)


def test_language_by_tables_equals_arrays(docs):
    one, other = ({r.doc_id: r for r in language.identify_languages(docs, n).collect()} for n in (language.MAX_BROADCAST, 0))
    assert one.keys() == other.keys()
    assert all(x.lang_pred == other[i].lang_pred and x.rejected == other[i].rejected and x.bits == pytest.approx(other[i].bits, rel=1e-9) for i, x in one.items())


def test_language_odd(odd, empty):
    got = {r.doc_id: r for r in language.identify_languages(odd).collect()}
    assert {got[i].lang_pred for i in (1, 2, 3)} == {"und"} and got[4].lang_pred != "und"
    assert language.identify_languages(empty).count() == 0
    assert {r.lang_pred for r in language.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- pipeline


def test_pipeline(spark, docs, odd):
    import corpus_pipeline

    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame.count()
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        assert name == "mixing" or frame.count() <= before
    kept = {r.doc_id for r in frame.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert {i for r in packed.collect() for i in r.doc_ids} == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    quality = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    assert np.mean([i in quality for i, q in labels.items() if q]) > 0.97
    assert corpus_pipeline.pack(spark, corpus_pipeline.mix(spark, corpus_pipeline.redact_personal_data(spark, corpus_pipeline.drop_copies(spark, odd, SF), SF), SF), SF).count() >= 1
