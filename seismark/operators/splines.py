"""Splines of traces of any length: interpolation, integration and trends.

The equations of a spline are banded and diagonally dominant, so what a sample does to a coefficient fades by a fixed factor from
knot to knot (0.27 for interpolating cubics, 0.54 for least squares). A block of a trace therefore solves its own equations over
the block and a margin of so many knots that the rest is below the last bit; only the true ends of a trace have the end
conditions, and no block waits for another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detection import sample_blocks
from .series import IDX, TRACE, running

#: Knots of a block, and of its margins: interpolation, least squares.
KNOTS, MARGIN, FIT_MARGIN = 256, 40, 96


def _basis(knots: np.ndarray, order: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the order + 1 B-splines that are not 0 at each x, and the number of the first of them."""
    at = np.clip(np.searchsorted(knots, x, "right") - 1, order, len(knots) - order - 2)
    values = np.ones((len(x), 1))
    for d in range(1, order + 1):
        left = knots[at[:, None] + np.arange(1 - d, 1)]
        right = knots[at[:, None] + np.arange(1, d + 1)]
        share = values / (right - left)
        new = np.zeros((len(x), d + 1))
        new[:, :-1] += share * (right - x[:, None])
        new[:, 1:] += share * (x[:, None] - left)
        values = new
    return at - order, values


class Spline:
    """The spline of an order with given inner knots that passes through points, or comes nearest to them in squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, inner: np.ndarray, order: int) -> None:
        self.order, self.knots = order, np.concatenate([np.full(order + 1, x[0]), inner, np.full(order + 1, x[-1])])
        count = len(self.knots) - order - 1
        first, values = _basis(self.knots, order, x)
        columns = first[:, None] + np.arange(order + 1)
        if count == len(x):
            system, right = np.zeros((count, count)), y
            system[np.arange(count)[:, None], columns] = values
        else:
            system, right = np.zeros((count, count)), np.zeros(count)
            for i in range(order + 1):
                right += np.bincount(columns[:, i], values[:, i] * y, count)
                for j in range(order + 1):
                    system += np.bincount(columns[:, i] * count + columns[:, j], values[:, i] * values[:, j], count * count).reshape(count, count)
        self.weights = np.linalg.solve(system, right)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        first, values = _basis(self.knots, self.order, x)
        return (self.weights[first[:, None] + np.arange(self.order + 1)] * values).sum(1)


def through(x: np.ndarray, y: np.ndarray, order: int) -> Spline:
    """Through all points: knots are the points, for even orders the middles between, without those next to the ends."""
    half = (order + 1) // 2
    inner = x[half : len(x) - half] if order % 2 else ((x[1:] + x[:-1]) / 2)[half : len(x) - 1 - half]
    return Spline(x, y, inner, order)


def near(x: np.ndarray, y: np.ndarray, order: int, distance: float) -> Spline:
    """Nearest to the points, with knots every ``distance`` samples from half of that on, of those that lie within."""
    first, last = np.ceil(x[0] / distance - 0.5), np.floor(x[-1] / distance - 0.5)
    knots = distance / 2 + distance * np.arange(first, last + 1)
    limit = x[-1] + 1 - distance / 2 + 2
    return Spline(x, y, knots[(knots > x[0]) & (knots < x[-1]) & (knots < limit)], order)


def _by_block(df: DataFrame, margin: int, block: int, least: int, make: Callable, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows that ``make(idx, x, low, high)`` gives of each block's samples; traces of fewer than ``least`` samples have none."""
    blocks = sample_blocks(df.withColumns({IDX: F.col(IDX).cast("long"), "x": F.col("x").cast("double")}), [TRACE], margin, margin, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i in range(batch.num_rows):
                at = batch.column("_block")[i].as_py()
                idx, x = (np.asarray(batch.column(c)[i].values) for c in ("_idx", "_x"))
                if len(idx) >= least:
                    parts.append(make(idx, x, at * block, (at + 1) * block))
                    rows.append(np.full(len(parts[-1][0]), i))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            columns = {name: pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), kind) for k, (name, kind) in enumerate(fields.items())}
            yield pa.record_batch({TRACE: batch.column(TRACE).take(take)} | columns)

    return blocks.mapInArrow(run, f"{TRACE} {dict(df.dtypes)[TRACE]}, {schema}")


def detrend_spline(df: DataFrame, order: int, distance: float) -> DataFrame:
    """(trace, idx, y): samples without the least-squares spline with a knot every ``distance`` samples; no trace shorter than order + 2 samples."""
    margin, block = int(FIT_MARGIN * distance), max(1, int(KNOTS * distance))

    def make(idx: np.ndarray, x: np.ndarray, low: int, high: int):
        own = (idx >= low) & (idx < high)
        level = x.mean()
        fit = near(idx.astype(float), x - level, order, distance)(idx[own].astype(float))
        return idx[own], x[own] - level - fit

    return _by_block(df, margin, block, order + 2, make, {IDX: pa.int64(), "y": pa.float64()}, f"{IDX} long, y double")


def interpolate_spline(df: DataFrame, start: float, step: float, order: int) -> DataFrame:
    """(trace, k, y) at places start + k step within a trace, on the spline through its samples; no trace of ``order`` samples or fewer."""

    def make(idx: np.ndarray, x: np.ndarray, low: int, high: int):
        # a block gives the places from its first sample up to the next block's first, or to the end
        first, last = max(low, idx[0]), min(high, idx[-1])
        k = np.arange(max(0, int(np.ceil((first - start) / step))), int(np.floor((last - start) / step)) + 1)
        at = start + k * step
        held = (at >= first) & ((at < high) if idx[-1] >= high else (at <= last))
        return k[held], through(idx.astype(float), x, order)(at[held])

    return _by_block(df, MARGIN, KNOTS, order + 1, make, {"k": pa.int64(), "y": pa.float64()}, "k long, y double")


def integrate_spline(df: DataFrame, dt: float = 1.0, order: int = 3) -> DataFrame:
    """(trace, idx, y): the integral of the spline through the samples from the first one on; no trace of ``order`` samples or fewer."""
    nodes, weights = np.polynomial.legendre.leggauss(3)

    def make(idx: np.ndarray, x: np.ndarray, low: int, high: int):
        own = idx[(idx >= low) & (idx < high)]
        spline = through(idx.astype(float), x, order)
        # knots lie on samples or in the middle between, so halves are polynomials
        halves = sum(w * (spline(own - 0.75 + n / 4) + spline(own - 0.25 + n / 4)) for n, w in zip(nodes, weights, strict=True)) / 4
        return own, np.where(own > idx[0], halves, 0.0) * dt

    steps = _by_block(df, MARGIN, KNOTS, order + 1, make, {IDX: pa.int64(), "step": pa.float64()}, f"{IDX} long, step double")
    return running(steps, y=F.col("step")).select(TRACE, IDX, "y")
