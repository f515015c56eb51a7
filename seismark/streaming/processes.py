"""Running processes on packets of samples: state per trace carries over from one micro-batch to the next.

A packet stream is rows of (trace, t, x); rows of a micro-batch are worked on in time order. Rows that are not later than the
last one of their trace are dropped as late, and a gap of more than ``max_gap`` resets the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "last long, numbers array<double>"
Process = Callable[[np.ndarray, list[float]], tuple[np.ndarray, list[float]]]


def scale(factor: float) -> Process:
    return lambda x, state: (x * factor, state)


def offset(shift: float) -> Process:
    return lambda x, state: (x + shift, state)


def integrate(dt: float) -> Process:
    """Running sum of rectangles."""

    def run(x: np.ndarray, state: list[float]) -> tuple[np.ndarray, list[float]]:
        y = np.cumsum(x * dt) + (state[0] if state else 0.0)
        return y, [float(y[-1])]

    return run


def differentiate(dt: float) -> Process:
    """Backward difference, 0 first."""

    def run(x: np.ndarray, state: list[float]) -> tuple[np.ndarray, list[float]]:
        before = np.concatenate([state or x[:1], x[:-1]])
        return (x - before) / dt, [float(x[-1])]

    return run


def boxcar(width: int) -> Process:
    """Mean of the last width + 1 samples; what was never there counts as 0."""

    def run(x: np.ndarray, state: list[float]) -> tuple[np.ndarray, list[float]]:
        history = np.concatenate([np.zeros(width - len(state)), state, x])
        sums = np.concatenate([[0.0], np.cumsum(history)])
        return (sums[width + 1 :] - sums[: -width - 1]) / (width + 1), history[-width:].tolist()

    return run


def dominant_period(dt: float, width: int) -> Process:
    """2 pi times the root of squares over squared slopes of the last ``width`` samples; the state holds both."""

    def run(x: np.ndarray, state: list[float]) -> tuple[np.ndarray, list[float]]:
        old_x, old_v = np.asarray(state[: len(state) // 2]), np.asarray(state[len(state) // 2 :])
        v = np.diff(x, prepend=old_x[-1] if len(old_x) else x[0]) / dt
        xs, vs = np.concatenate([old_x, x]), np.concatenate([old_v, v])

        def sums(values: np.ndarray) -> np.ndarray:
            padded = np.concatenate([np.zeros(width), values**2])
            return np.lib.stride_tricks.sliding_window_view(padded, width)[1:].sum(1)[-len(x) :]

        slopes = sums(vs)
        y = np.where(slopes > 1e-20, 2 * np.pi * np.sqrt(sums(xs) / np.maximum(slopes, 1e-20)), 0.0)
        return y, [*xs[-width:].tolist(), *vs[-width:].tolist()]

    return run


def kurtosis(dt: float, window: float) -> Process:
    """Recursive kurtosis from exponential first, second and fourth moments."""
    c1 = dt / window
    a1 = 1 - c1
    c2, bias = (1 - a1 * a1) / 2, -3 * c1 - 3

    def run(x: np.ndarray, state: list[float]) -> tuple[np.ndarray, list[float]]:
        mu1, mu2, k4 = state or (0.0, 1.0, 0.0)
        out = np.empty(len(x))
        for i, value in enumerate(x):
            r = (value - mu1) ** 2 / mu2
            mu2 = a1 * mu2 + c2 * (value - mu1) ** 2
            mu1 = a1 * mu1 + c1 * value
            k4 = (1 + c1 - 2 * c1 * r) * k4 + c1 * r * r
            out[i] = k4 + bias
        return out, [mu1, mu2, k4]

    return run


def run_process(packets: DataFrame, process: Process, max_gap: int | None = None) -> DataFrame:
    """A stream of (trace, t, y)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "x"], kind="stable", ignore_index=True)
        last, numbers = state.get if state.exists else (None, [])
        numbers = list(numbers or [])
        if last is not None:
            rows = rows[rows["t"] > last].reset_index(drop=True)
        if not len(rows):
            return
        steps = np.diff(rows["t"].to_numpy(), prepend=rows["t"].iloc[0] if last is None else last)
        cuts = np.flatnonzero(steps > max_gap) if max_gap is not None else np.zeros(0, int)
        y = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if a in cuts:
                numbers = []
            if b > a:
                part, numbers = process(rows["x"].to_numpy(float)[a:b], numbers)
                y.append(part)
        state.update((int(rows["t"].iloc[-1]), [float(v) for v in numbers]))
        yield pd.DataFrame({"trace": key[0], "t": rows["t"], "y": np.concatenate(y)})

    return packets.groupBy("trace").applyInPandasWithState(step, "trace long, t long, y double", STATE, "append", "NoTimeout")


def finish(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, into ``folder``, and reads the result."""
    done = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_counts(packets: DataFrame, width: str, delay: str) -> DataFrame:
    """Event-time windows behind a watermark: (trace, start, n, mean)."""
    timed = packets.withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)
    out = timed.groupBy("trace", F.window("at", width)).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return out.select("trace", F.unix_micros("window.start").alias("start"), "n", "mean")


def sessions(packets: DataFrame, gap: str) -> DataFrame:
    """(trace, first, n) of runs without a pause of ``gap``; on a batch or, with a watermark, a stream."""
    timed = packets.withColumn("at", F.timestamp_micros("t"))
    return timed.groupBy("trace", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("trace", F.unix_micros("session_window.start").alias("first"), "n")
