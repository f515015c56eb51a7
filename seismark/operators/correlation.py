"""Cross-correlation, template matching and delay-and-sum beams as array and join expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detection import correlate_templates, sample_blocks
from .series import with_halo


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _demeaned(values: Column) -> Column:
    """The mean is bound once, as the element of an array, instead of once per sample."""
    mean = F.array(_total(values) / F.size(values))
    return F.get(F.transform(mean, lambda m: F.transform(values, lambda x: x - m)), F.lit(0))


def correlate(a: Column, b: Column, shift: int, demean: bool = False, normalize: bool = True) -> Column:
    """Correlation of two arrays, aligned around their middles, for shifts up to ``shift``: sums of a[i + lag] b[i].

    Arrays whose lengths differ by an odd number have no shift 0, so 2 shift values instead of 2 shift + 1. Normalised ones are
    zero where a norm is near zero.
    """
    if demean:
        a, b = _demeaned(a), _demeaned(b)
    norm = F.sqrt(_total(F.transform(a, lambda x: x * x)) * _total(F.transform(b, lambda x: x * x)))
    whole = F.size(a) + F.size(b) - 1
    first = F.floor(whole / 2).cast("int") - F.size(b) + 1 - shift
    lag = lambda k: _total(F.transform(b, lambda x, i: x * F.coalesce(F.when(i + k >= 0, F.get(a, i + k)), F.lit(0.0))))
    lags = F.slice(F.sequence(first, first + 2 * shift), F.lit(1), 2 * shift + whole % 2)
    if not normalize:
        return F.transform(lags, lag)
    return F.transform(lags, lambda k: F.when(norm > 1e-12, lag(k) / norm).otherwise(0.0))


def correlation_peak(values: Column, absolute: bool = True) -> Column:
    """(shift from the middle, value) of the largest value, the first of equal ones."""
    ranked = F.transform(values, lambda x, i: F.struct((F.abs(x) if absolute else x).alias("size"), (-i).alias("first"), x.alias("value")))
    best = F.array_max(ranked)
    return F.struct((-best["first"] - (F.size(values) - 1) / 2).alias("shift"), best["value"].alias("value"))


def match_template(samples: DataFrame, template: DataFrame, length: int) -> DataFrame:
    """(trace, idx, cc): correlation of every full window of a trace with its trace's template (trace, k, t) of ``length`` samples, both demeaned."""
    return correlate_templates(samples, template, ["trace"], [], length=length).select("trace", "idx", "cc")


def peaks(scores: DataFrame, column: str, height: float, distance: int) -> DataFrame:
    """Rows at least ``height`` high that are the highest (the first of equal ones) within ``distance`` samples of their trace."""
    best = lambda rows: F.max(F.struct(F.col(column).alias("v"), (-F.col("idx")).alias("i"))).over(rows)
    near = Window.partitionBy("trace", "_block").orderBy("idx").rangeBetween(-distance, distance)
    halo = with_halo(scores, distance, distance).withColumn("_best", best(near))
    return halo.where(F.col("_own") & (F.col(column) >= height) & (-F.col("_best.i") == F.col("idx"))).select(*scores.columns)


#: Samples of a block of beams, in which all traces of an array meet.
BEAM_BLOCK = 4096


def beam_power(samples: DataFrame, offsets: DataFrame, slowness: list[tuple[float, float]], block: int = BEAM_BLOCK) -> DataFrame:
    """(array, sx, sy, power): mean square of the stack of shifted traces for each slowness (samples per offset unit).

    samples: (array, trace, idx, x); offsets: (trace, dx, dy). The traces of an array meet block by block, each with as many samples
    around as the largest shift asks for, and a block gives a sum and a number for each slowness; at the ends fewer traces count.
    """
    grid = [(float(x), float(y)) for x, y in slowness]
    wide = offsets.agg(F.max(F.abs("dx")), F.max(F.abs("dy"))).first()
    reach = int((wide[0] or 0) * max(abs(x) for x, _ in grid) + (wide[1] or 0) * max(abs(y) for _, y in grid)) + 1
    block = max(block, reach)
    rows = sample_blocks(samples.withColumns({"idx": F.col("idx").cast("long"), "x": F.col("x").cast("double")}), ["array", "trace"], reach, reach, block).join(offsets.select("trace", "dx", "dy"), "trace")
    met = rows.groupBy("array", "_block").agg(F.collect_list(F.struct("_idx", "_x", "dx", "dy")).alias("_traces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = np.zeros((batch.num_rows, len(grid))), np.zeros((batch.num_rows, len(grid)), np.int64)
            for i, (at, traces) in enumerate(zip(batch.column("_block").to_pylist(), batch.column("_traces").to_pylist(), strict=True)):
                held = [(np.array(t["_idx"]), np.array(t["_x"]), t["dx"], t["dy"]) for t in traces]
                low = at * block - (reach if at == 0 else 0)  # shifts before the first sample belong to the first block
                size = (at + 1) * block - low
                for j, (sx, sy) in enumerate(grid):
                    total, number = np.zeros(size), np.zeros(size)
                    for idx, x, dx, dy in held:
                        shift = sx * dx + sy * dy
                        place = idx - int(np.sign(shift) * np.floor(abs(shift) + 0.5)) - low
                        inside = (place >= 0) & (place < size)
                        total += np.bincount(place[inside], x[inside], size)
                        number += np.bincount(place[inside], minlength=size)
                    some = number > 0
                    sums[i, j], counts[i, j] = ((total[some] / number[some]) ** 2).sum(), some.sum()
            take = pa.array(np.repeat(np.arange(batch.num_rows), len(grid)))
            axes = {n: pa.array(np.tile([g[k] for g in grid], batch.num_rows)) for k, n in enumerate(("sx", "sy"))}
            yield pa.record_batch({"array": batch.column("array").take(take)} | axes | {"total": pa.array(sums.ravel()), "n": pa.array(counts.ravel())})

    parts = met.mapInArrow(run, f"array {dict(samples.dtypes)['array']}, sx double, sy double, total double, n long")
    return parts.groupBy("array", "sx", "sy").agg((F.sum("total") / F.sum("n")).alias("power"))
