"""Mixing sources to target weights by the cube method.

A source's target over its size, a number t from 0 to 2, is split into whole copies of every document and a fraction
f. Which documents get one copy more is a balanced sample: each starts with probability f, and the flight phase of the
cube method moves these numbers along null-space vectors of the two constraints (words and documents), so that both
totals stay, until nearly all are 0 or 1. Blocks of a source fly in parallel; what they leave undecided flies again in
fewer blocks, and the last few documents of a source are landed by trying their subsets for the nearest word total.

Defined cases: a null text has size 0; sources weigh by code point order with null last; a source without words has
target 0; repeated rows (same doc_id, source and size) are taken or left together; other columns are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import split_words
from .store import written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Documents that one block flies, and those that are landed together.
BLOCK, LANDING = 4096, 14
SEED = 20
#: Source tables up to this many rows are broadcast.
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: str | F.Column) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.coalesce(F.size(split_words(F.col(text) if isinstance(text, str) else text)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to (source, source_size): min(most * size, level * weight), one level for all, so that they add up to share.

    A source is full when the level reaches most * size / weight. With sources in the order of that ratio, the level
    is (share of all - what the full ones take) / (weights of the others), for the shortest prefix of full ones that
    fits. This works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    filled = (
        sizes.withColumn("_weight", weight)
        .withColumn("_ratio", most * F.col("source_size") / F.col("_weight"))
        .withColumn("_full", F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0.0)))
        .withColumn("_level", (share * total - F.col("_full")) / F.col("_rest"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    )
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("_level") * F.col("_weight"), most * F.col("source_size")))
    return filled.withColumn("target", target).drop("_weight", "_ratio", "_full", "_rest", "_level")


def fly(size: np.ndarray, p: np.ndarray, keep: int) -> np.ndarray:
    """The flight phase on documents in the given order, until at most ``keep`` are undecided.

    Three undecided documents at a time: the null vector of their 2 x 3 constraint matrix (words, documents) is a
    cross product of its rows; the step along it ends where a document reaches 0 or 1. Signs alternate by a hash of the
    step, which a given order makes the same again.
    """
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    left = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9]
    flying, rest, step, undecided = left[:3], left[3:][::-1], 0, len(left)
    while len(flying) == 3 and undecided > keep:
        a, b, c = flying
        u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(flying, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(flying, u, strict=True) if x)
        step += 1
        chance = ((step * 0x9E3779B97F4A7C15 + SEED) >> 11 & 0xFFFFF) / 0x100000
        by = up if chance < down / (up + down) else -down
        stay = []
        for i, x in zip(flying, u, strict=True):
            p[i] += by * x
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i], undecided = float(round(p[i])), undecided - 1
            else:
                stay.append(i)
        flying = stay
        while len(flying) < 3 and rest:
            flying.append(rest.pop())
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decides the few documents that are left: the subset whose words are nearest to their expected total, then whose count is."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        subsets = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(subsets @ size[left] - size[left] @ p[left])
        p[left] = subsets[np.lexsort((np.abs(subsets.sum(1) - p[left].sum()), words))[0]]
    return p


def _fly_block(table: pa.Table) -> pa.Table:
    """One block of one source; the only block of a source is landed as well."""
    table = table.sort_by([("_order", "ascending"), ("size", "ascending")])
    size = table["size"].to_numpy() * table["n"].to_numpy().astype(float)
    p, last = table["_p"].to_numpy(), len(table) and table["_blocks"][0].as_py() == 1
    p = fly(size, p, LANDING if last else 2)
    p = land(size, p) if last else p
    return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))


def mix_units(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per distinct (doc_id, source, size) with n, its rows; source_size, target, and copies, how often the mix takes each row."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("_units"))
    targets = written(source_targets(per_source, weights, share, most))
    sources, largest = targets.agg(F.count("*"), F.coalesce(F.max("_units"), F.lit(0))).first()
    named = targets.withColumnRenamed("source", "_source")
    named = F.broadcast(named) if sources <= MAX_BROADCAST_SOURCES else named
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (
        units.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_base", F.floor(times + 1e-12))
        .withColumn("_p", F.greatest(F.lit(0.0), times - F.col("_base")))
        .withColumn("_blocks", F.ceil(F.col("_units") / BLOCK))
        .withColumn("_order", F.xxhash64(F.lit(SEED), "doc_id", "size"))
        .drop("_source", "_units")
    )
    done, level = [], 0
    while True:
        fly_in = state.withColumn("_block", F.pmod(F.xxhash64(F.lit(level), "_order"), F.col("_blocks")))
        flown = written(fly_in.groupBy("source", "_block").applyInArrow(_fly_block, fly_in.schema).drop("_block"))
        undecided = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(flown.where(~undecided))
        largest, level = -(-largest // BLOCK), level + 1
        if largest <= 1:
            break
        largest *= 2
        state = flown.where(undecided).withColumn("_blocks", F.ceil(F.col("_blocks") * 2 / BLOCK))
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("_base") + F.col("_p")).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    units = mix_units(docs, weights, share, most).where("copies > 0")
    units = units.select(*[F.col(c).alias(f"_unit_{c}") for c in ("doc_id", "source", "size", "copies")])
    same = (
        docs["doc_id"].cast("long").eqNullSafe(F.col("_unit_doc_id"))
        & docs["source"].cast("string").eqNullSafe(F.col("_unit_source"))
        & (word_count(docs["text"]) == F.col("_unit_size"))
    )
    taken = docs.join(units, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_unit_copies"))))
    return taken.select(*[docs[c] for c in docs.columns])
