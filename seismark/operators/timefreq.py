"""Time-frequency representation by Morlet wavelets, and the misfits of two signals in time, in frequency and in both.

A wavelet of scale a fades within a few a, so a block of samples needs neighbours in proportion to the scale: frequencies are
taken octave by octave, each with blocks and margins of its own length, and a block's transform is a product of spectra.
Misfits are plain aggregates of the two signals' amplitudes and of their phase difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detection import sample_blocks
from .series import BLOCK, IDX

#: Scales beyond which the wavelet (below 1e-18 of its peak) no longer counts.
FADED = 9.2


def frequencies(low: float, high: float, count: int) -> np.ndarray:
    """``count`` frequencies from low to high, evenly spaced in their logarithm."""
    return np.logspace(np.log10(low), np.log10(high), count)


def _transform_rows(keys: list[str], chosen: list[tuple[int, float]], w0: float, dt: float, margin: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("_block")[i].as_py()
                idx, x = (np.asarray(batch.column(c)[i].values) for c in ("_idx", "_x"))
                low = max(at * block, int(idx[0]))
                count = min((at + 1) * block - 1, int(idx[-1])) - low + 1
                own = idx[(idx >= low) & (idx < low + count)]
                held = np.zeros(count + 2 * margin)
                inside = (idx >= low - margin) & (idx < low + count + margin)
                held[idx[inside] - low + margin] = x[inside]
                n = 1 << (len(held) + 2 * margin).bit_length()
                spectrum = np.fft.fft(held, n)
                values = []
                for _, scale in chosen:
                    u = (np.arange(-margin, margin + 1) + 0.5) * dt / scale
                    wavelet = np.exp(-1j * w0 * u - u * u / 2) * (pi**-0.25 * dt / scale**0.5)
                    values.append(np.fft.ifft(spectrum * np.fft.fft(wavelet[::-1], n))[2 * margin : 2 * margin + count][own - low])
                w = np.array(values)
                take = pa.array(np.full(w.size, i))
                named = {c: batch.column(c).take(take) for c in keys}
                yield pa.record_batch(
                    named | {"k": pa.array(np.repeat([k for k, _ in chosen], len(own))), IDX: pa.array(np.tile(own, len(chosen))), "re": pa.array(w.real.ravel()), "im": pa.array(w.imag.ravel())}
                )

    return run


def wavelet_transform(samples: DataFrame, keys: list[str], dt: float, low: float, high: float, count: int, w0: float = 6.0, block: int = BLOCK) -> DataFrame:
    """(keys, k, idx, re, im): Morlet transform of (keys, idx, x) at the kth of ``count`` frequencies; missing samples are 0.

    As in the definition that is matched here, the wavelet stands half a sample late.
    """
    scales = list(enumerate((w0 / (2 * pi * frequencies(low, high, count))).tolist()))
    octaves: dict[int, list[tuple[int, float]]] = {}
    for k, scale in scales:
        octaves.setdefault(int(np.floor(np.log2(scale / dt))), []).append((k, scale))
    typed = samples.select(*keys, F.col(IDX).cast("long").alias(IDX), F.col("x").cast("double").alias("x"))
    types = dict(typed.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", k long, {IDX} long, re double, im double"
    parts = []
    for chosen in octaves.values():
        margin = ceil(FADED * max(scale for _, scale in chosen) / dt) + 1
        size = max(block, 2 * margin)
        parts.append(sample_blocks(typed, keys, margin, margin, size).mapInArrow(_transform_rows(keys, chosen, w0, dt, margin, size), schema))
    return reduce(DataFrame.union, parts)


def compared(one: DataFrame, two: DataFrame, reference: bool = True) -> DataFrame:
    """(trace, component, k, idx, a, b, phase, r, other): amplitudes of two transforms and their phase difference over pi.

    r is the amplitude that weighs: the second one's or, without a reference, that with the greater maximum in the trace. Where
    ``other`` is used instead (phase over time, as in the definition that is matched here) it is then that with the lesser one.
    """
    key = ["trace", "component", "k", IDX]
    names = lambda df, re, im: df.select(*key, F.col("re").alias(re), F.col("im").alias(im))
    both = names(one, "_p", "_q").join(names(two, "_r", "_s"), key)
    size = lambda re, im: F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    phase = F.atan2(F.col("_q") * F.col("_r") - F.col("_p") * F.col("_s"), F.col("_p") * F.col("_r") + F.col("_q") * F.col("_s")) / pi
    rows = both.select(*key, size("_p", "_q").alias("a"), size("_r", "_s").alias("b"), phase.alias("phase"))
    if reference:
        return rows.withColumns({"r": F.col("b"), "other": F.col("b")})
    greater = rows.groupBy("trace").agg((F.max("a") > F.max("b")).alias("_first"))
    first = F.col("_first")
    return rows.join(greater, "trace").withColumns({"r": F.when(first, F.col("a")).otherwise(F.col("b")), "other": F.when(first, F.col("b")).otherwise(F.col("a"))}).drop("_first")


#: What the places of a misfit are: all, by time, by frequency, none.
PLACES = {"time_frequency": ["k", IDX], "time": [IDX], "frequency": ["k"], "single": []}


def misfits(pairs: DataFrame, place: str, local: bool = False) -> DataFrame:
    """(trace, component, place..., envelope, phase): misfits of ``compared`` signals, by the greatest weight of a trace or the local one.

    Without a place they are roots of sums of squares, else sums over what is not a place. Places without weight have no local
    envelope misfit.
    """
    columns = ["trace", "component", *PLACES[place]]
    difference, weight = F.col("a") - F.col("b"), F.col("other") if place == "time" else F.col("r")
    turn = weight * F.col("phase")
    if place == "time_frequency":
        rows = pairs.select(*columns, difference.alias("_e"), turn.alias("_p"), F.col("r").alias("_r"), F.col("r").alias("_w"))
    elif place == "single":
        root = lambda x: F.sqrt(F.sum(x * x))
        rows = pairs.groupBy(*columns).agg(root(difference).alias("_e"), root(turn).alias("_p"), root(F.col("r")).alias("_r"), root(weight).alias("_w"))
    else:
        rows = pairs.groupBy(*columns).agg(F.sum(difference).alias("_e"), F.sum(turn).alias("_p"), F.sum("r").alias("_r"), F.sum(weight).alias("_w"))
    if local:
        return rows.select(*columns, F.try_divide("_e", "_r").alias("envelope"), F.coalesce(F.try_divide("_p", "_w"), F.lit(0.0)).alias("phase"))
    most = rows.groupBy("trace").agg(F.max("_r").alias("_most"), F.max("_w").alias("_wmost"))
    return rows.join(most, "trace").select(*columns, F.try_divide("_e", "_most").alias("envelope"), F.try_divide("_p", "_wmost").alias("phase"))


def fits(envelope: Column, phase: Column, best: float = 10.0, power: float = 1.0) -> tuple[Column, Column]:
    """Goodness of fit of envelope and phase misfits: ``best`` where they are 0."""
    return best * F.exp(-F.pow(F.abs(envelope), F.lit(power))), best * (1 - F.pow(F.abs(phase), F.lit(power)))
