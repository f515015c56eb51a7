"""Processing by name: what a workflow file or a caller of the desktop toolbox asks for as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from . import kernels, series, splines


def _filter(kind: str) -> Callable[..., DataFrame]:
    def run(df: DataFrame, rate: float, corners: int = 4, zerophase: bool = False, freqmin: float | None = None, freqmax: float | None = None, freq: float | None = None) -> DataFrame:
        low, high = (freqmin, freqmax) if kind.startswith("band") else (None, freq) if kind == "lowpass" else (freq, None)
        return kernels.filter_blocks(df, kernels.butterworth(kind, corners, rate, low, high), zerophase)

    return run


def _rotation(kind: str) -> Callable[..., DataFrame]:
    """Rows (n, e) or (r, t), and their back azimuth in degrees."""

    def run(df: DataFrame, back_azimuth: str = "back_azimuth") -> DataFrame:
        angle = F.radians(back_azimuth)
        if kind == "NE->RT":
            r, t = geodesy.rotate_ne_rt(F.col("n"), F.col("e"), angle)
            return df.withColumns({"r": r, "t": t})
        n, e = geodesy.rotate_ne_rt(F.col("r"), F.col("t"), 2 * F.acos(F.lit(-1.0)) - angle)
        return df.withColumns({"n": n, "e": e})

    return run


_y = lambda df: df.select("trace", "idx", "y")

#: By kind and name: functions of a table (trace, idx, x) and their options.
NAMED: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "filter": {
        **{kind: _filter(kind) for kind in ("bandpass", "bandstop", "lowpass", "highpass")},
        "lowpass_cheby_2": lambda df, rate, freq, maxorder=12: kernels.filter_blocks(df, kernels.chebyshev_lowpass(freq, rate, most=maxorder)),
    },
    "detrend": {
        "simple": lambda df: _y(series.detrend_simple(df)),
        "linear": lambda df: _y(series.detrend_linear(df)),
        "constant": lambda df: _y(series.demean(df)),
        "demean": lambda df: _y(series.demean(df)),
        "polynomial": lambda df, order: _y(series.detrend_polynomial(df, order)),
        "spline": lambda df, order, dspline: splines.detrend_spline(df, order, dspline),
    },
    "taper": {kind: (lambda df, kind=kind, **options: _y(series.taper(df, kind, **options))) for kind in ("hann", "hamming", "cosine", "triang")},
    "trigger": {
        "classicstalta": series.classic_sta_lta,
        "recstalta": series.recursive_sta_lta,
        "delayedstalta": series.delayed_sta_lta,
        "carlstatrig": series.carl_sta_trig,
        "zdetect": series.z_detect,
    },
    "integrate": {"cumtrapz": lambda df, dt=1.0: _y(series.integrate(df, dt)), "spline": lambda df, dt=1.0, k=3: splines.integrate_spline(df, dt, k)},
    "differentiate": {"gradient": lambda df, dt=1.0: _y(series.differentiate(df, dt))},
    "interpolate": {
        "linear": lambda df, start, step: series.interpolate(df, start, step, "linear"),
        "nearest": lambda df, start, step: series.interpolate(df, start, step, "nearest"),
        "slinear": lambda df, start, step: splines.interpolate_spline(df, start, step, 1),
        "quadratic": lambda df, start, step: splines.interpolate_spline(df, start, step, 2),
        "cubic": lambda df, start, step: splines.interpolate_spline(df, start, step, 3),
        "lanczos": lambda df, start, step, a: series.interpolate_lanczos(df, start, step, a),
        "weighted_average_slopes": lambda df, start, step: series.interpolate_weighted_slopes(df, start, step),
    },
    "rotate": {kind: _rotation(kind) for kind in ("NE->RT", "RT->NE")},
}


def apply(kind: str, name: str, df: DataFrame, **options) -> DataFrame:
    """``df`` after the named processing; names are matched without regard to case, unknown ones are an error that lists the known."""
    known = {k.lower(): f for k, f in NAMED[kind].items()}
    if name.lower() not in known:
        raise ValueError(f"no {kind} is named {name!r}; known are {', '.join(sorted(NAMED[kind]))}")
    return known[name.lower()](df, **options)
