"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text is its byte trigrams, hashed into ``TRIGRAMS`` buckets, and its words that equal the word before, dealt in turn to
``REPEATS`` buckets, as log counts times inverse document frequencies over all documents. The singular vectors of a bounded sample of labelled rows (at most ``SAMPLE``) give the latent space; the labelled
vectors (``SAMPLE`` x ``RANK`` floats, 1 MB) are broadcast. Every document gets its exact cosines with all of them, block by
block, and its nearest ``NEIGHBOURS`` vote with a power of their similarity.

Defined cases: a null or empty text, which has no feature, scores 0; a table without labelled rows gives score 0.5 to all
others; a null doc_id is held out and never learned from; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, split_words, text_bytes

TRIGRAMS, REPEATS = 4096, 256
DIMENSIONS = TRIGRAMS + REPEATS
RANK, SAMPLE, NEIGHBOURS, SHARPNESS = 64, 4096, 25, 12.0
#: Documents whose cosines are computed together.
BLOCK = 512


def remainder(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n; null: null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_counts(texts: pa.Array) -> np.ndarray:
    """Counts of each text's hashed byte trigrams (its ends count as a byte 0) and of its immediately repeated words."""
    data, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for row, a, b in zip(out, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for start in range(a, b, 1 << 20):
            end = min(b, start + (1 << 20))
            codes = np.zeros(end - start + 2, np.uint32)
            codes[1:-1] = data[start:end]
            codes[0] = data[start - 1] if start > a else 0
            codes[-1] = data[end] if end < b else 0
            hashed = ((codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)) >> np.uint32(20)
            row[:TRIGRAMS] += np.bincount(hashed & np.uint32(TRIGRAMS - 1), minlength=TRIGRAMS)
    words = split_words(texts)
    again = np.flatnonzero(words.hashes[1:] == words.hashes[:-1]) + 1
    owner = np.searchsorted(words.first, again, "right") - 1
    inside = again > words.first[owner]
    again, owner = again[inside], owner[inside]
    np.add.at(out, (owner, TRIGRAMS + (again - words.first[owner]) % REPEATS), 1)
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in slices(batches):
        for i in range(0, batch.num_rows, BLOCK):
            total += (text_counts(batch.column("text").slice(i, BLOCK)) > 0).sum(0)
        n += batch.num_rows
    yield pa.record_batch({"bucket": pa.array(range(-1, DIMENSIONS), pa.int32()), "n": pa.array([n, *total.tolist()], pa.int64())})


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each bucket: one row per bucket and task, summed."""
    rows = docs.select("text").mapInArrow(_document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()
    found = np.zeros(DIMENSIONS + 1)
    for bucket, n in rows:
        found[bucket] = n
    return int(found[-1]), found[:-1]


class Model:
    """The latent space and the labelled vectors in it; with ``own`` the counts are weighed in place."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, n: int, frequencies: np.ndarray, own: bool = False) -> None:
        self.idf = np.log((1 + n) / (1 + frequencies)).astype(np.float32) + 0.05
        self.labels = labels.astype(np.float32)
        weighted = self.weigh(counts, counts if own else None)
        rng = np.random.default_rng(6)
        rank = min(RANK, *weighted.shape) if len(weighted) else 0
        basis = np.zeros((DIMENSIONS, 0), np.float32)
        if rank:
            q = weighted.T @ rng.standard_normal((len(weighted), rank + 16)).astype(np.float32)
            for _ in range(3):
                q, _r = np.linalg.qr(weighted.T @ (weighted @ q))
            _u, _s, v = np.linalg.svd(weighted @ q, full_matrices=False)
            basis = (q @ v.T)[:, :rank]
        self.basis = np.ascontiguousarray(basis, np.float32)
        self.vectors = self.unit(weighted @ self.basis)

    def weigh(self, counts: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        weighted = np.log1p(counts, out=out)
        weighted *= self.idf
        norms = [np.linalg.norm(weighted[i : i + BLOCK], axis=1, keepdims=True) for i in range(0, len(weighted), BLOCK)]
        weighted /= np.maximum(np.concatenate(norms) if norms else np.ones((0, 1), np.float32), 1e-12)
        return weighted

    def project(self, counts: np.ndarray) -> np.ndarray:
        return self.unit(self.weigh(counts) @ self.basis)

    @staticmethod
    def unit(latent: np.ndarray) -> np.ndarray:
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        full = counts.any(1)
        if not len(self.labels):
            return np.where(full, 0.5, 0.0)
        cosines = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1).astype(float), 1e-3) ** SHARPNESS
        return np.where(full, (weight * self.labels[near]).sum(1) / weight.sum(1), 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """From labelled rows whose crc32(doc_id) mod 5 is not 0; of more than ``SAMPLE``, those with the least hashes."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(remainder("doc_id", 5) != 0)
    sample = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # one text for each of them, so that repeated rows do not widen the sample
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = text_counts(batch.column("text"))
            owner, bucket = np.nonzero(counts)
            lists = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32), pa.array(bucket.astype(np.int16)))
            sizes = pa.ListArray.from_arrays(lists.offsets, pa.array(counts[owner, bucket]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bucket": lists, "n": sizes})

    found = rows.select("doc_id", "label", "text").mapInArrow(counted, "doc_id long, label int, bucket array<short>, n array<float>").toArrow().sort_by("doc_id")
    counts = np.zeros((len(found), DIMENSIONS), np.float32)
    for row, bucket, n in zip(counts, found["bucket"], found["n"], strict=True):
        row[np.asarray(bucket.values)] = np.asarray(n.values)
    return Model(counts, found["label"].to_numpy(), *document_frequencies(docs), own=True)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` with held_out and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    kept = [c for c in docs.columns if c not in ("score", "held_out")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.value.score(text_counts(batch.column("text").slice(i, BLOCK))) for i in range(0, batch.num_rows, BLOCK)]
            yield batch.append_column("score", pa.array(np.concatenate(scores), pa.float64()))

    rows = docs.select(*kept, F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"))
    schema = rows.withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)
