"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups.

Documents with equal shingle sets form one class first, so copies cost no pairs. Classes meet in the buckets of a band;
in two rounds each tests one partner of another group, and links join groups. Buckets that still hold several groups are
compared in full, block against block inside a task, which returns only the links that join groups: never a row per pair.
Blocks of a bucket hold sets of like size, and blocks whose sizes lie too far apart for a link do not meet. No candidate is
dropped, however large its bucket.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer words than
a shingle has its whole sequence as one; a row without doc_id is linked with nothing and kept; repeated rows get the same
component; rows that share a doc_id but not a text are linked if any of their texts are, and each text of a kept id stays;
very long texts are sets like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .words import mix, odd_factors, signed, slices, split_words

SHINGLE, PERCENT = 5, 80
#: 40 bands of 6 rows: a pair at similarity 0.8 is missed with probability 5e-6.
BANDS, ROWS = 40, 6
#: Rounds with one partner per class; members of a block.
ROUNDS, BLOCK = 2, 512
#: Ids up to this many are broadcast to pick their texts.
MAX_BROADCAST_IDS = 2_000_000

_STEP = np.uint64(48)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and first: those of text i are first[i]:first[i + 1]."""
    words = split_words(texts, lower=True)
    h, first = words.hashes, words.first
    n = max(0, len(h) - k + 1)
    rolled, factors = np.zeros(n, np.uint64), odd_factors(k)
    for j in range(k):
        rolled += h[j : j + n] * factors[j]
    rolled = mix(rolled, 1)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(0xD1B54A32D192ED03) + x, 2)[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """Signatures (n_sets, m) of sets whose elements are given with their owner.

    In step j every element draws the value j + r and the j-th place of its own random permutation of the m slots (a
    Fisher-Yates shuffle); a slot keeps its least value. Values of later steps are larger, so a set stops as soon as all
    its slots are filled: a long text after one step or two. All elements of a batch take a step together.
    """
    empty = np.uint64((1 << 64) - 1)
    out = np.full(n_sets * m, empty, np.uint64)
    owner = owner.astype(np.int64)
    shuffled = None
    for j in range(m):
        drawn = mix(elements, 2 * j + 11)
        place = (j + (mix(elements, 2 * j + 12) >> np.uint64(32)) * np.uint64(m - j) // np.uint64(1 << 32)).astype(np.int64) if j else ((drawn & np.uint64(0xFFFF)) * np.uint64(m) >> np.uint64(16)).astype(np.int64)
        value = (drawn >> np.uint64(16)) | (np.uint64(j) << _STEP)
        if shuffled is None:
            slot = place
        else:
            rows = np.arange(len(elements))
            slot = shuffled[rows, place].astype(np.int64)
            shuffled[rows, place] = shuffled[rows, j]
            shuffled[rows, j] = slot
        np.minimum.at(out, owner * m + slot, value)
        open_sets = (out.reshape(n_sets, m) == empty).any(1)
        stay = open_sets[owner]
        if not stay.any():
            break
        if shuffled is None:
            elements, owner, place = elements[stay], owner[stay], place[stay]
            shuffled = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
            rows = np.arange(len(elements))
            shuffled[rows, place] = 0
            shuffled[rows, 0] = place
        elif stay.mean() < 0.6:
            elements, owner, shuffled = elements[stay], owner[stay], shuffled[stay]
    return out.reshape(n_sets, m)


def _sketches(k: int, bands: int, rows: int):
    factors = odd_factors(rows, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19):
            elements, first = shingle_sets(batch.column("text"), k)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            owner = np.repeat(np.arange(len(full)), sizes[full])
            signature = superminhash(elements, owner, len(full), bands * rows)
            keys = mix((signature.reshape(len(full), bands, rows) * factors).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 3)
            high, low = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if len(full):
                high[full] = np.add.reduceat(mix(elements, 4), first[full])
                low[full] = np.bitwise_xor.reduceat(mix(elements, 5), first[full])
            ends = np.zeros(len(sizes) + 1, np.int32)
            ends[1:] = np.cumsum((sizes > 0) * bands)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "set_high": pa.array(signed(high)),
                    "set_low": pa.array(signed(low)),
                    "bands": pa.ListArray.from_arrays(ends, pa.array(signed(keys.ravel()))),
                }
            )

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_u"), "text_v"):
            left, a = shingle_sets(batch.column("text_u"), k)
            right, b = shingle_sets(batch.column("text_v"), k)
            same = []
            for i in range(batch.num_rows):
                x, y = left[a[i] : a[i + 1]], right[b[i] : b[i + 1]]
                found = np.searchsorted(y, x)
                both = int((y[np.minimum(found, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                same.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"u": batch.column("u"), "v": batch.column("v"), "linked": pa.array(same, pa.bool_())})

    return run


def _shared(sets: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left x right: products of 0/1 columns, 4096 shingles at a time."""
    names, column = np.unique(sets, return_inverse=True)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    common = np.bincount(column, minlength=len(names)) > 1
    column, owner = (np.cumsum(common) - 1)[column[common[column]]], owner[common[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(first) - 1, 4096), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        out += held[left] @ held[right].T
    return out.astype(np.int64)


def _link_blocks(k: int, percent: int):
    """Links between different groups of two blocks of a bucket (or within one): enough to join them, no more."""

    def run(rows: pa.Table) -> pa.Table:
        sets, first = shingle_sets(rows["text"], k)
        size, ids, roots, side = np.diff(first), rows["id"].to_pylist(), rows["root"].to_numpy(), rows["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        both = _shared(sets, first, left, right)
        linked = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (both > 0) & (roots[left][:, None] != roots[right])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        links = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(roots[left[i]])), find(int(roots[right[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[left[i]], ids[right[j]]))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return run


def _picked(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose column is among the distinct ``ids``."""
    ids = ids.withColumnRenamed(ids.columns[0], "_picked")
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(column) == F.col("_picked"), "left_semi")


class _Linker:
    """The links that were found, the pairs that were tested, and the groups that the links make."""

    def __init__(self, texts: DataFrame, k: int, percent: int) -> None:
        self.texts, self.k, self.percent = texts, k, percent
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.groups: DataFrame | None = None

    def open(self, members: DataFrame) -> DataFrame:
        """Members (band, id, size) of buckets with two groups or more; root, lo and hi (two members of different groups), members."""
        grouped = members.withColumn("root", F.col("id"))
        if self.groups is not None:
            grouped = members.join(self.groups, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
        buckets = (
            grouped.groupBy("band")
            .agg(F.min(F.struct("root", "id")).alias("lo"), F.max(F.struct("root", "id")).alias("hi"), F.count("*").alias("members"))
            .where("lo.root <> hi.root")
        )
        return written(grouped.join(buckets, "band"))

    def add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.union(links)
        self.groups = written(components(self.links))

    def test_partners(self, left: DataFrame) -> None:
        """One partner of another group for each id, which it was not tested with before."""
        partner = F.when(F.col("root") == F.col("lo.root"), F.col("hi.id")).otherwise(F.col("lo.id"))
        pairs = left.select("id", partner.alias("other")).select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = written(pairs.groupBy("u").agg(F.min("v").alias("v")))
        needed = written(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
        texts = _picked(self.texts, "doc_id", needed)
        both = (
            pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
            .join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
            .select("u", "v", "text_u", "text_v")
        )
        found = written(both.mapInArrow(_verify(self.k, self.percent), "u long, v long, linked boolean"))
        self.tested = found.select("u", "v") if self.tested is None else self.tested.union(found.select("u", "v"))
        self.add(found.where("linked").select("u", "v"))

    def test_blocks(self, left: DataFrame) -> None:
        """All pairs of different groups in a bucket, within tasks: a member goes to the pairs of its block with each block of like sizes."""
        kind = F.when(F.col("members") > BLOCK, _size_class(F.col("size"), self.percent)).otherwise(0)
        left = left.select("band", "id", "root", kind.alias("_class"))
        counted = left.groupBy("band", "_class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
        blocks = counted.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("_class", "n"))).alias("_blocks"))
        placed = left.join(blocks, "band").withColumn("_own", F.pmod(F.xxhash64("id"), F.try_element_at("_blocks", F.col("_class"))).cast("int"))
        own = F.struct(F.col("_class").alias("c"), F.col("_own").alias("i"))
        every = lambda c: F.coalesce(F.transform(F.sequence(F.lit(0), F.try_element_at("_blocks", c) - 1), lambda i: F.struct(c.alias("c"), i.alias("i"))), F.array())
        same = F.transform(every(F.col("_class")), lambda x: F.struct(F.least(own, x).alias("a"), F.greatest(own, x).alias("b"), F.when(own <= x, 0).otherwise(1).alias("side")))
        above = F.transform(every(F.col("_class") + 1), lambda x: F.struct(own.alias("a"), x.alias("b"), F.lit(0).alias("side")))
        below = F.transform(every(F.col("_class") - 1), lambda x: F.struct(x.alias("a"), own.alias("b"), F.lit(1).alias("side")))
        paired = placed.select("band", "id", "root", F.explode(F.concat(same, above, below)).alias("_pair")).select("band", "_pair.*", "id", "root")
        rows = paired.join(self.texts, F.col("id") == F.col("doc_id")).drop("doc_id")
        self.add(written(rows.groupBy("band", "a", "b").applyInArrow(_link_blocks(self.k, self.percent), "u long, v long")))


def _size_class(size: Column, percent: int) -> Column:
    """Classes of set sizes such that linked sets are in the same class or in neighbouring ones."""
    if percent >= 100:
        return 2 * size
    return F.floor(F.log(size.cast("double")) / np.log(100 / percent) + 1e-9).cast("long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id that links reach) and kept."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>"
    sketches = written(plain.mapInArrow(_sketches(shingle, bands, rows), schema))
    same_set = ["set_high", "set_low", "n_shingles"]
    named = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(named.groupBy(*same_set).agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands")))
    members = classes.select(F.explode("bands").alias("band"), "id", F.col("n_shingles").alias("size"))
    shared = members.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    members = written(members.join(shared, "band"))
    ids = written(members.select("id").distinct())
    linker = _Linker(written(_picked(plain, "doc_id", ids)), shingle, percent)
    for _ in range(ROUNDS):
        linker.test_partners(linker.open(members))
    linker.test_blocks(linker.open(members))
    roots = classes.join(linker.groups, F.col("id") == F.col("node"), "left").select(*same_set, F.coalesce("root", "id").alias("id"))
    found = sketches.drop("bands").join(roots, same_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group; of repeated rows, one."""
    kept = near_duplicates(docs, shingle, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(written(kept), F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id IS NULL"))
