"""NumPy kernels on segment arrays, wrapped as Arrow UDFs: each call works on all segments of a batch that are equally long."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detection import sample_blocks
from .series import BLOCK

Kernel = Callable[[np.ndarray], np.ndarray]


def on_segments(*kernels: Kernel) -> Callable[[Column], Column]:
    """One Arrow UDF that runs the kernels one after another on (segments, samples) matrices; null segments stay null."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), index=column.index, dtype=object)
        lengths = column.map(lambda v: -1 if v is None else len(v))
        for length, rows in column.groupby(lengths):
            if length > 0:
                matrix = np.stack([np.asarray(v, float) for v in rows])
                for kernel in kernels:
                    matrix = kernel(matrix)
                out.loc[rows.index] = pd.Series(list(matrix), index=rows.index)
            elif length == 0:
                out.loc[rows.index] = pd.Series([np.zeros(0)] * len(rows), index=rows.index)
        return out

    return run


def butterworth(kind: str, corners: int, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Second-order sections of a digital Butterworth filter: rows b0 b1 b2 1 a1 a2.

    Poles of the analog prototype lie evenly on the left unit half circle; they are moved to the pass band at
    pre-warped corner frequencies and mapped to the z plane by the bilinear transform.
    """
    nyquist = rate / 2
    if kind in ("bandpass", "bandstop") and high is not None and high >= nyquist:
        kind, high = ("highpass", high) if kind == "bandpass" else ("lowpass", low)
    if low is not None and low > nyquist:
        raise ValueError("the low corner lies above the Nyquist frequency")
    warp = lambda f: 2 * rate * np.tan(np.pi * min(f, nyquist * 0.999999) / rate)
    angle = np.pi * (2 * np.arange(1, corners + 1) + corners - 1) / (2 * corners)
    poles = np.exp(1j * angle)
    if kind == "lowpass":
        poles, zeros = poles * warp(high if high is not None else low), np.zeros(0)
    elif kind == "highpass":
        poles, zeros = warp(low if low is not None else high) / poles, np.zeros(corners)
    else:
        a, b = warp(low), warp(high)
        half = poles * (b - a) / 2 if kind == "bandpass" else (b - a) / 2 / poles
        root = np.sqrt(half * half - a * b)
        poles = np.concatenate([half + root, half - root])
        centre = 1j * np.sqrt(a * b)
        zeros = np.zeros(corners) if kind == "bandpass" else np.concatenate([np.full(corners, centre), np.full(corners, -centre)])
    to_z = lambda s: (2 * rate + s) / (2 * rate - s)
    poles, zeros = to_z(poles), np.concatenate([to_z(zeros), -np.ones(len(poles) - len(zeros))])
    reference = {"lowpass": 1.0, "bandstop": 1.0, "highpass": -1.0}.get(kind, 0)
    if kind == "bandpass":
        reference = np.exp(2j * np.arctan(np.sqrt(warp(low) * warp(high)) / (2 * rate)))
    pairs = _pairs(poles), _pairs(zeros)
    sections = []
    for p, z in zip(*pairs, strict=True):
        b, a = np.real(np.poly(z)), np.real(np.poly(p))
        sections.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    out = np.array(sections)
    powers = np.array([1, 1 / reference, 1 / reference**2])
    out[:, :3] /= np.abs((out[:, :3] @ powers) / (out[:, 3:] @ powers))[:, None]
    return out


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Roots in conjugate pairs; real ones two by two."""
    up = sorted(roots[roots.imag > 1e-9], key=lambda r: (round(r.real, 9), r.imag))
    real = sorted(roots[np.abs(roots.imag) <= 1e-9].real)
    pairs = [np.array([r, np.conj(r)]) for r in up]
    mixed = [np.array(real[i : i + 1] + real[-1 - i : len(real) - i]) for i in range(len(real) // 2)]
    return pairs + mixed + ([np.array([real[len(real) // 2]])] if len(real) % 2 else [])


def sections_filter(sections: np.ndarray, zero_phase: bool = False) -> Kernel:
    """Second-order sections over time, all segments at once; zero phase: forward and backward."""

    def once(x: np.ndarray) -> np.ndarray:
        for b0, b1, b2, _, a1, a2 in sections:
            y, s1, s2 = np.empty_like(x), np.zeros(len(x)), np.zeros(len(x))
            for i in range(x.shape[1]):
                y[:, i] = b0 * x[:, i] + s1
                s1, s2 = b1 * x[:, i] - a1 * y[:, i] + s2, b2 * x[:, i] - a2 * y[:, i]
            x = y
        return x

    return lambda x: once(once(x)[:, ::-1])[:, ::-1] if zero_phase else once(x)


#: The share of a filter's response that no longer counts, samples of a piece at least, and of pieces that are run together.
FADED, PIECE, TOGETHER = 1e-18, 1024, 1 << 22


def warm_up(sections: np.ndarray) -> int:
    """Samples after which nothing is left of a filter's start: its slowest pole tells.

    Cascaded sections with like poles fade as a power of n times the pole's power, hence the factor.
    """
    slowest = max(np.abs(np.roots(r)).max() for r in sections[:, 3:])
    return 1 if slowest == 0 else ceil(1.5 * log(FADED) / log(min(slowest, 1 - 1e-9)))


def _in_pieces(rows: list[np.ndarray], kernel: Kernel, warm: int) -> list[np.ndarray]:
    """``kernel`` over arrays of any lengths: pieces that start ``warm`` samples early become the rows of one matrix."""
    size = min(max(PIECE, 2 * warm), max(map(len, rows), default=1))
    out = [np.empty(len(x)) for x in rows]
    asked = [(i, a) for i, x in enumerate(rows) for a in range(0, len(x), size)]
    width = size + warm
    step = max(1, TOGETHER // width)
    for begin in range(0, len(asked), step):
        part = asked[begin : begin + step]
        matrix = np.zeros((len(part), width))
        for row, (i, a) in zip(matrix, part, strict=True):
            held = rows[i][max(0, a - warm) : a + size]
            row[max(0, warm - a) : max(0, warm - a) + len(held)] = held
        matrix = kernel(matrix)
        for row, (i, a) in zip(matrix, part, strict=True):
            out[i][a : a + size] = row[warm : warm + min(size, len(rows[i]) - a)]
    return out


def filter_blocks(df: DataFrame, sections: np.ndarray, zero_phase: bool = False, block: int = BLOCK) -> DataFrame:
    """(trace, idx, y): second-order sections over traces (trace, idx, x) of any length; zero phase: forwards, then backwards.

    A block starts with zero state some samples early, at most as many as ``warm_up`` tells, so every block gives what the whole
    trace would give, and no task holds more than a block and its margin. Blocks of an Arrow batch run together, in pieces.
    """
    forwards = _swept(df.select("trace", "idx", "x"), sections, block, False)
    return _swept(forwards.withColumnRenamed("y", "x"), sections, block, True) if zero_phase else forwards


def _swept(df: DataFrame, sections: np.ndarray, block: int, backwards: bool) -> DataFrame:
    warm, kernel, turn = warm_up(sections), sections_filter(sections), -1 if backwards else 1
    block = max(block, 2 * warm)
    typed = df.withColumns({"idx": F.col("idx").cast("long"), "x": F.col("x").cast("double")})
    blocks = sample_blocks(typed, ["trace"], 0 if backwards else warm, warm if backwards else 0, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, x = ([np.asarray(row.values) for row in batch.column(c)] for c in ("_idx", "_x"))
            y = [v[::turn] for v in _in_pieces([v[::turn] for v in x], kernel, warm)]
            own = [i // block == at for i, at in zip(idx, batch.column("_block").to_pylist(), strict=True)]
            take = pa.array(np.repeat(np.arange(batch.num_rows), [o.sum() for o in own]))
            join = lambda parts: np.concatenate([p[o] for p, o in zip(parts, own, strict=True)]) if parts else np.zeros(0)
            yield pa.record_batch({"trace": batch.column("trace").take(take), "idx": pa.array(join(idx), pa.int64()), "y": pa.array(join(y))})

    return blocks.mapInArrow(run, f"trace {dict(df.dtypes)['trace']}, idx long, y double")


def chebyshev_lowpass(corner: float, rate: float, ripple: float = 1.0, stop: float = 96.0, most: int = 12) -> np.ndarray:
    """Sections of a low pass whose stop band, ``stop`` decibels down, begins at ``corner``; its pass band is narrowed until the order is ``most``.

    Poles and zeros of the inverse Chebyshev prototype follow from its order; the bilinear transform maps them.
    """
    gain = np.arccosh(np.sqrt((10 ** (stop / 10) - 1) / (10 ** (ripple / 10) - 1)))
    edge = np.tan(np.pi * corner / rate)
    share = order = None
    while order is None or order > most:
        share = 0.99 * (share or 1.0)
        passed = np.tan(np.pi * corner * share / rate)
        order = ceil(gain / np.arccosh(edge / passed))
    natural = passed * np.cosh(gain / order)
    m = np.arange(-order + 1, order, 2)
    zeros = 1j / np.sin(m[m != 0] * np.pi / (2 * order))
    spread = np.arcsinh(np.sqrt(10 ** (stop / 10) - 1)) / order
    circle = -np.exp(1j * np.pi * m / (2 * order))
    poles = 1 / (np.sinh(spread) * circle.real + 1j * np.cosh(spread) * circle.imag)
    to_z = lambda s: (1 + s * natural) / (1 - s * natural)
    poles, zeros = to_z(poles), np.concatenate([to_z(zeros), -np.ones(len(poles) - len(zeros))])
    out = np.array([np.concatenate([np.pad(np.real(np.poly(q)), (0, 3 - len(q) - 1)) for q in (z, p)]) for p, z in zip(_pairs(poles), _pairs(zeros), strict=True)])
    out[:, :3] *= (out[:, 3:].sum(1) / out[:, :3].sum(1))[:, None]
    return out


#: The greatest factor of a decimation in one step, with which the filter is still sound.
MOST_DECIMATION = 16


def decimate(df: DataFrame, factor: int, rate: float, block: int = BLOCK) -> DataFrame:
    """(trace, idx, y): every ``factor``th sample, numbered anew, after a low pass that stops at half of the new rate."""
    if factor > MOST_DECIMATION:
        raise ValueError(f"decimate in steps of at most {MOST_DECIMATION}")
    low = filter_blocks(df, chebyshev_lowpass(0.5 * rate / factor, rate), block=block) if factor > 1 else df.withColumnRenamed("x", "y")
    return low.where(F.col("idx") % factor == 0).withColumn("idx", F.floor(F.col("idx") / factor))


def _analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(_analytic(x))


def instantaneous_frequency(rate: float) -> Kernel:
    def run(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < 2:
            return np.full_like(x, np.nan)
        a = _analytic(x)
        change = np.gradient(a, 1 / rate, axis=1)
        return (a.real * change.imag - a.imag * change.real) / (2 * np.pi * np.maximum(np.abs(a) ** 2, 1e-30))

    return run


def instantaneous_bandwidth(rate: float) -> Kernel:
    """Size of the envelope's change over the envelope; central differences, edges repeated."""

    def run(x: np.ndarray) -> np.ndarray:
        a = np.pad(envelope(x), ((0, 0), (1, 1)), mode="edge")
        return np.abs(a[:, 2:] - a[:, :-2]) * rate / (4 * np.pi * np.maximum(a[:, 1:-1], 1e-30))

    return run


def centroid(x: np.ndarray) -> np.ndarray:
    """The share of a segment after which half of the area below the envelope is reached; one figure each, NaN below 3 samples.

    As in the definition that is matched here, the part of a sample is taken as (half - sample) / area before it.
    """
    n = x.shape[1]
    if n < 3:
        return np.full((len(x), 1), np.nan)
    area = np.cumsum(envelope(x), 1)
    half = area[:, -1:] / 2
    k = np.argmax(area[:, 1 : n - 1] >= half, 1)[:, None] + 1  # from the second sample on, as the definition scans
    before, at = np.take_along_axis(area, k - 1, 1), np.take_along_axis(area, k, 1)
    found = at >= half
    return np.where(found, (k + 1 + (half - (at - before)) / before) / n, 0.0)


def polynomial_detrend(order: int) -> Kernel:
    def run(x: np.ndarray) -> np.ndarray:
        basis = np.polynomial.chebyshev.chebvander(np.linspace(-1, 1, x.shape[1]), order)
        return x - (basis @ np.linalg.lstsq(basis, x.T, rcond=None)[0]).T

    return run


def fourier_resample(factor: float, window: bool = True) -> Kernel:
    """To a rate that is ``factor`` times lower: the spectrum is interpolated linearly at the new length's frequencies.

    The new length is cut to an integer; frequencies above the old ones take the last bin. With ``window`` a raised cosine
    over the spectrum, centred on frequency 0, dampens its upper end.
    """

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        npts = max(1, int(n / factor))
        spectrum = np.fft.rfft(x)
        if window:
            spectrum = spectrum * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n // 2 + 1) + n // 2) / n))
        at = np.minimum(np.arange(npts // 2 + 1) * n / (factor * npts), n // 2)
        low = np.minimum(at.astype(int), max(n // 2 - 1, 0))
        out = spectrum[:, low] + (at - low) * (spectrum[:, np.minimum(low + 1, n // 2)] - spectrum[:, low])
        out[:, 0] = out[:, 0].real
        if npts % 2 == 0:
            out[:, -1] = out[:, -1].real
        return np.fft.irfft(out, npts) * npts / n

    return run


def power_density(rate: float) -> Kernel:
    """One-sided periodogram after demeaning and a 10 % cosine taper at each end; 0 for a single sample."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n < 2:
            return np.zeros_like(x)
        ramp = max(1, n // 10)
        window = np.ones(n)
        window[:ramp] = 0.5 * (1 - np.cos(np.pi * np.arange(ramp) / ramp))
        window[-ramp:] = window[:ramp][::-1]
        power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window)) ** 2 / (rate * (window**2).sum())
        power[:, 1 : (n + 1) // 2] *= 2
        return power

    return run


def octave_densities(rate: float, nfft: int, overlap: int, width: float = 1.0, step: float = 0.125) -> Kernel:
    """Decibels of squared acceleration by octaves of period, from segments of velocity.

    Windows of ``nfft`` samples lose their least-squares line, get cosine ends of a tenth each and their periodograms are
    averaged. A bin is the mean of the decibels of all periods within ``width`` octaves around its centre; centres go from the
    shortest period up in steps of ``step`` octaves. Segments shorter than a window, and bins without a period, give NaN.
    """
    f = rate * np.arange(1, nfft // 2 + 1) / nfft
    centres = octave_centres(rate, nfft, step)
    half, slack = 2 ** (width / 2), 1e-9
    inside = (1 / f >= centres[:, None] / half * (1 - slack)) & (1 / f <= centres[:, None] * half * (1 + slack))
    flank = int(nfft * 0.1 + 0.5)
    window = np.ones(nfft)
    if flank > 1:
        window[:flank] = 0.5 * (1 - np.cos(np.pi * np.arange(flank) / (flank - 1)))
        window[-flank:] = window[:flank][::-1]

    def run(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < nfft:
            return np.full((len(x), len(centres)), np.nan)
        total, count = np.zeros((len(x), len(f))), 0
        line = polynomial_detrend(1)
        for at in range(0, x.shape[1] - nfft + 1, nfft - overlap):
            total += np.abs(np.fft.rfft(line(x[:, at : at + nfft]) * window)[:, 1:]) ** 2
            count += 1
        density = total / count / (rate * (window**2).sum()) * np.where(np.arange(1, len(f) + 1) * 2 == nfft, 1, 2)
        db = 10 * np.log10(np.maximum(density * (2 * np.pi * f) ** 2, np.finfo(float).tiny))
        with np.errstate(invalid="ignore"):
            return db @ inside.T / np.where(inside.sum(1), inside.sum(1), np.nan)

    return run


def octave_centres(rate: float, nfft: int, step: float = 0.125) -> np.ndarray:
    """Periods from the shortest to the longest of a window, in steps of octaves."""
    shortest, longest = 2 / rate if nfft % 2 == 0 else nfft / (rate * (nfft // 2)), nfft / rate
    return shortest * 2 ** (step * np.arange(int(np.ceil(np.log2(longest / shortest) / step - 1e-9)) + 1))


def konno_ohmachi(frequencies: np.ndarray, bandwidth: float = 40.0) -> Kernel:
    """Log-frequency smoothing of spectra, each window normalised."""

    def run(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            z = bandwidth * np.log10(frequencies[None, :] / frequencies[:, None])
            weight = (np.sin(z) / z) ** 4
        weight[~np.isfinite(weight)] = 0
        weight[frequencies[:, None] == frequencies[None, :]] = 1
        weight[1:, frequencies == 0] = 0
        return x @ (weight / weight.sum(1, keepdims=True)).T

    return run


def deconvolve(poles: list[complex], zeros: list[complex], gain: float, rate: float, water_level: float = 60.0) -> Kernel:
    """Divides a pole-zero response out of the spectrum; amplitudes below the water level (dB under the largest) are lifted to it."""

    def run(x: np.ndarray) -> np.ndarray:
        n = 1 << int(np.ceil(np.log2(2 * x.shape[1])))
        s = 2j * np.pi * np.fft.rfftfreq(n, 1 / rate)
        response = gain * np.prod([s - z for z in zeros], axis=0) / np.prod([s - p for p in poles], axis=0)
        size = np.abs(response)
        floor = size.max() * 10 ** (-water_level / 20)
        lifted = np.where((size < floor) & (size > 0), response * floor / np.maximum(size, 1e-300), response)
        inverse = np.where(np.abs(lifted) > 0, 1 / np.where(np.abs(lifted) > 0, lifted, 1), 0)
        return np.fft.irfft(np.fft.rfft(x - x.mean(1, keepdims=True), n) * inverse, n)[:, : x.shape[1]]

    return run


def with_phasors(x: np.ndarray) -> np.ndarray:
    """The samples, then the cosines and the sines of their instantaneous phases."""
    a = _analytic(x)
    a = a / np.maximum(np.abs(a), 1e-30)
    return np.concatenate([x, a.real, a.imag], 1)


def band_energies(rate: float, lowest: float, bands: int, frames: int) -> Kernel:
    """Energy in half-octave bands from ``lowest`` up, in equal frames: frames x bands, flattened."""

    def run(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < frames:
            return np.zeros((len(x), frames * bands))
        parts = x[:, : x.shape[1] // frames * frames].reshape(len(x), frames, -1)
        power = np.abs(np.fft.rfft(parts * np.hanning(parts.shape[2]))) ** 2
        f = np.fft.rfftfreq(parts.shape[2], 1 / rate)
        edges = lowest * 2 ** (np.arange(bands + 1) / 2)
        return np.stack([power[:, :, (f >= a) & (f < b)].sum(2) for a, b in zip(edges, edges[1:], strict=False)], 2).reshape(len(x), -1)

    return run


def bands_held(rate: float, lowest: float, bands: int, length: int) -> list[int]:
    """The bands of ``band_energies`` that hold a frequency of a frame of ``length`` samples."""
    f = np.fft.rfftfreq(length, 1 / rate)
    edges = lowest * 2 ** (np.arange(bands + 1) / 2)
    return [i for i in range(bands) if ((f >= edges[i]) & (f < edges[i + 1])).any()]
