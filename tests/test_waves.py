"""Detection, picking, time-frequency analysis, beams, splines, polarisation and formats against brute force and on odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.functions import geodesy
from seismark.operators import arrays, collections, correlation, detection, kernels, named, network, picking, polarization, segments, series, splines, timefreq
from seismark.sources import archive, bulletins, sac, trees


def trace(spark, values, name=1):
    return spark.createDataFrame([(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "trace long, idx long, x double")


def column(df, name, order="idx"):
    return np.array([r[name] for r in df.orderBy(order).collect()], float)


# --- silent, constant, short and empty input

OPERATORS = {
    "classic": lambda df: series.classic_sta_lta(df, 3, 12),
    "recursive": lambda df: series.recursive_sta_lta(df, 3, 12),
    "delayed": lambda df: series.delayed_sta_lta(df, 3, 12),
    "z": lambda df: series.z_detect(df, 4),
    "ratio": lambda df: series.energy_ratio(df, 4),
    "modified": lambda df: series.modified_energy_ratio(df, 4),
    "aic": series.aic_simple,
    "carl": lambda df: series.carl_sta_trig(df, 3, 12, 0.8, 0.8),
    "demean": series.demean,
    "simple": series.detrend_simple,
    "linear": series.detrend_linear,
    "polynomial": lambda df: series.detrend_polynomial(df, 3),
    "spline": lambda df: splines.detrend_spline(df, 2, 20),
    "normalize": series.normalize,
    "differentiate": series.differentiate,
    "integrate": series.integrate,
    "integrate_spline": splines.integrate_spline,
    "smooth": lambda df: series.smooth(df, 3),
    "taper": series.taper,
    "welch": series.taper_welch,
    "interpolate": lambda df: series.interpolate(df, 0.3, 0.7),
    "lanczos": lambda df: series.interpolate_lanczos(df, 0.0, 0.7, 4),
    "slopes": lambda df: series.interpolate_weighted_slopes(df, 0.0, 0.7),
    "cubic": lambda df: splines.interpolate_spline(df, 0.0, 0.7, 3),
    "period": lambda df: series.dominant_period(df, 5),
    "statistics": series.statistics,
    "lowpass": lambda df: kernels.filter_blocks(df, kernels.butterworth("lowpass", 4, 100.0, high=10.0), True),
    "decimate": lambda df: kernels.decimate(df, 4, 100.0),
    "wavelets": lambda df: timefreq.wavelet_transform(df, ["trace"], 0.01, 2.0, 20.0, 3),
    "template": lambda df: correlation.match_template(df, df.where("idx < 8").select("trace", F.col("idx").alias("k"), F.col("x").alias("t")), 8),
    "picks": lambda df: picking.first_picks(df, 1.0, 2, 4, 1.5, 3.0, 6, 5),
    "eigenvalues": lambda df: polarization.window_eigenvalues(polarization.cut_windows(df.select("trace", "idx", F.col("x").alias("e"), F.col("x").alias("n"), F.col("x").alias("z")), 8, 4), [1.0]),
    "axes": lambda df: polarization.sliding_axes(df.select("trace", "idx", F.col("x").alias("e"), F.col("x").alias("n"), F.col("x").alias("z")), 8, 4),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_silence_and_short_traces(spark, name):
    """Zeros, a constant, a step to silence and one sample give rows without an error, and finite values or nulls; an empty table gives none."""
    parts = [trace(spark, [0.0] * 120, 1), trace(spark, [7.0] * 120, 2), trace(spark, [1.0, -2.0] * 30 + [0.0] * 60, 3), trace(spark, [5.0], 4), trace(spark, [0.0, 3.0], 5)]
    rows = OPERATORS[name](collections.joined(*parts)).collect()
    assert {r.trace for r in rows} >= {1, 2, 3} or name in ("eigenvalues", "axes", "spline")
    for r in rows:
        assert all(v is None or not isinstance(v, float) or not np.isnan(v) for v in r.asDict().values()), r
    assert OPERATORS[name](parts[0].limit(0)).collect() == []


def test_ratios_of_silence_are_zero_or_null(spark):
    silent = trace(spark, [0.0] * 120)
    assert set(column(series.classic_sta_lta(silent, 3, 12), "cft")) == {0.0}
    delayed = series.delayed_sta_lta(silent, 3, 12).orderBy("idx").collect()
    assert delayed[0].cft == 0 and delayed[-1].cft is None
    lines = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (1, 1.0, 2.0, 0.0), (1, 2.0, 5.0, 0.0)], "trace long, a double, b double, w double")
    assert series.weighted_line(lines, "a", "b", "w").collect() == []


def test_antipodes_have_a_fixed_distance(spark):
    line = geodesy.ellipsoid_inverse(*[F.lit(x) for x in (0.0, 0.0, 0.0, 180.0)])
    got = spark.range(1).select(line.alias("g")).first().g
    assert (got.meters, got.azimuth, got.back_azimuth) == (20004314.5, 0.0, 0.0)


# --- templates


def test_window_correlations_by_transform_and_by_sums(monkeypatch):
    rng = np.random.default_rng(1)
    x, t = rng.normal(5, 2, 700), rng.normal(3, 1, 80)
    long = detection.window_correlations(x, t, True, True)
    monkeypatch.setattr(detection, "DIRECT", 1000)
    short = detection.window_correlations(x, t, True, True)
    want = [np.corrcoef(x[i : i + 80], t)[0, 1] for i in range(621)]
    assert np.allclose(long, want) and np.allclose(short, want)
    assert not detection.window_correlations(np.full(100, 3.0), t, True, True).any()


def test_templates_over_blocks_and_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 300)
    frame = trace(spark, x).where("idx NOT BETWEEN 140 AND 149")
    template = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x[40:60])], "trace long, k int, t double")
    found = {r.idx: r.cc for r in detection.correlate_templates(frame, template, ["trace"], [], block=32).collect()}
    assert sorted(found) == [i for i in range(281) if i + 20 <= 140 or i >= 150]
    assert found[40] == pytest.approx(1) and found[200] == pytest.approx(np.corrcoef(x[200:220], x[40:60])[0, 1])


def greedy(rows, reach):
    kept = []
    for at, _score, tie in sorted(rows, key=lambda r: (-r[1], r[2])):
        if all(abs(at - k) > reach for k in kept):
            kept.append(at)
    return sorted(kept)


@pytest.mark.parametrize("reaches", [1, 32])
def test_thinning_is_greedy_over_any_ranges(spark, monkeypatch, reaches):
    """A ramp makes one chain over all ranges, which asks for wider margins."""
    monkeypatch.setattr(detection, "REACHES", reaches)
    monkeypatch.setattr(detection, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), float(i) / 1000, int(i)) for i in range(0, 90)] + [(int(i), float(rng.integers(0, 9)), int(i)) for i in sorted(rng.choice(np.arange(100, 900), 300, False))]
    frame = spark.createDataFrame([(1, *r) for r in rows], "stream long, idx long, score double, tie long")
    got = sorted(r.idx for r in detection.thin(frame, ["stream"], "score", 5, F.col("tie")).collect())
    assert got == greedy(rows, 5)


def test_unequal_lengths_are_centred(spark):
    a, b = np.zeros(9), np.ones(5)
    a[2:7] = 1.0
    frame = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    cc = frame.select(correlation.correlate(F.col("a"), F.col("b"), 3, normalize=False).alias("c"), correlation.correlate(F.slice("a", 1, 8), F.col("b"), 2, normalize=False).alias("d"), correlation.correlate(F.col("a"), F.col("b"), 0).alias("e")).first()
    full = np.correlate(a, b, "full")
    assert np.allclose(cc.c, full[6 - 3 : 6 + 4]) and int(np.argmax(cc.c)) == 3
    full = np.correlate(a[:8], b, "full")
    assert np.allclose(cc.d, full[6 - 2 : 6 + 2]) and len(cc.e) == 1


def test_products_of_long_traces(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, 200), rng.normal(0, 1, 170)
    found = {r.lag: r.product for r in detection.lagged_products(trace(spark, x), trace(spark, y), 7, 32).collect()}
    for lag in range(-7, 8):
        assert found[lag] == pytest.approx(sum(x[i + lag] * y[i] for i in range(170) if 0 <= i + lag < 200))


def test_likeness_lets_weak_events_stand(spark):
    rows = [(0, 5, "a", 1.0, None), (2, 6, "b", 1.0, 0.9), (20, 25, "a", 1.0, 0.5), (40, 45, "a", 1.0, 0.8)]
    frame = spark.createDataFrame(rows, "a long, z long, s string, peak double, like double")
    found = network.network_triggers(frame, "a", "z", "s", 3, similarity="like", threshold=0.7, details=("peak",)).orderBy("start").collect()
    assert [(r.start, r.stations, r.like) for r in found] == [(0, ["a", "b"], {"b": 0.9}), (40, ["a"], {"a": 0.8})]
    assert network.network_triggers(frame.limit(0), "a", "z", "s", 3).collect() == []


# --- picks


def machine(x, rate, down, up, on, limit, preset, duration):
    """Sample by sample, as the definition has it."""
    n, scale = len(x) - 1, max(abs(v) for v in x[1:])
    rise = [0.0, 0.0] + [(x[i] - x[i - 1]) * rate for i in range(2, n + 1)]
    y2, yt = (sum(v[i] ** 2 for i in range(2, preset + 1)) for v in (x, rise))
    first = preset * y2 - sum(x[1 : preset + 1]) ** 2
    sdev = np.sqrt(first) / preset**2 if first > 0 else 1.0
    mean = ssx = ssq = num = value = 0.0
    flag = itar = low = amp = noise = signal = until = way = 0
    for i in range(1, n + 1):
        energy = (x[i] ** 2 + y2 / yt * rise[i] ** 2) ** 2
        y2, yt = y2 + x[i] ** 2, yt + rise[i] ** 2
        value = (energy - mean) / sdev if sdev > 0 else value
        amp = max(amp, abs(int(256 * x[i] / scale + 0.5)))
        signal = amp if i <= until else signal
        if value > on and i > 2 * preset:
            if flag == 0:
                itar, flag, until, noise = i, 1, i + duration, noise or amp
                way = 1 if rise[i] < 0 else -1 if rise[i] > 0 else way
            elif value > 4 * on and low == 0:
                flag += 2
            low = 0
        elif flag:
            low += 1
            if low > down:
                if i - itar - low + flag >= up:
                    return itar + 1, quality(way, signal / noise)
                flag = itar = 0
        if value < limit or i <= 2 * preset:
            ssx, ssq, num = ssx + energy, ssq + energy**2, num + 1
            spread = (num * ssq - ssx * ssx) / num**2
            sdev, mean = (np.sqrt(spread) if spread >= 0 else 1.0), ssx / num
    if itar and n + 1 - itar - low + flag >= up:
        return itar + 1, quality(way, signal / noise)
    return 1, ""


def quality(way, ratio):
    grade = 4 - sum(ratio > q for q in (1.5, 4, 6, 8))
    return ("IP" if grade <= 1 else "EP") + (f"U{grade}" if way < 0 else f"D{grade}" if way > 0 else "")


@pytest.mark.parametrize("block", [17, 64, 1 << 16])
def test_picks_over_blocks(spark, block):
    rng = np.random.default_rng(6)
    parts, want = [], {}
    for name in range(6):
        x = rng.normal(0, 1 + (name == 3) * 4, 400)
        x[250:300] += 12 * np.sin(np.arange(50) / 2) * (name % 3 + 0.3)
        parts.append(trace(spark, x, name))
        want[name] = machine(x.tolist(), 20.0, 6, 10, 7.0, 12.0, 40, 30)
    got = {r.trace: (r.pick, r.phase) for r in picking.first_picks(collections.joined(*parts), 20.0, 6, 10, 7.0, 12.0, 40, 30, block).collect()}
    assert got == want and any(p > 1 for p, _ in want.values())


# --- time and frequency


def test_wavelets_over_blocks_and_misfits_of_equals(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 150)
    whole = timefreq.wavelet_transform(trace(spark, x), ["trace"], 0.01, 3.0, 30.0, 3)
    parts = {(r.k, r.idx): complex(r.re, r.im) for r in timefreq.wavelet_transform(trace(spark, x), ["trace"], 0.01, 3.0, 30.0, 3, block=40).collect()}
    for k, f in enumerate(timefreq.frequencies(3.0, 30.0, 3)):
        a = 6 / (2 * np.pi * f)
        for n in (0, 77, 149):
            u = (np.arange(150) - n + 0.5) * 0.01 / a
            want = (x * np.exp(-6j * u - u * u / 2)).sum() * np.pi**-0.25 * 0.01 / np.sqrt(a)
            assert parts[k, n] == pytest.approx(want, abs=1e-12)
    both = whole.withColumn("component", F.lit(0))
    pairs = timefreq.compared(both, both)
    for place in timefreq.PLACES:
        found = timefreq.misfits(pairs, place).collect()
        assert found and all(abs(r.envelope) < 1e-12 and abs(r.phase) < 1e-12 for r in found)


# --- arrays


def plane_wave(spark, slowness, rate=50.0):
    rng = np.random.default_rng(8)
    places = [(s, float(rng.uniform(-2, 2)), float(rng.uniform(-2, 2))) for s in range(8)]
    rows = []
    for s, px, py in places:
        delay = slowness[0] * px + slowness[1] * py
        at = np.arange(200) / rate - delay
        rows += [(0, s, i, float(v)) for i, v in enumerate(np.sin(2 * np.pi * 5 * at) + 0.5 * np.sin(2 * np.pi * 7 * at) + 0.01 * rng.normal(0, 1, 200))]
    geometry = spark.createDataFrame([(0, *p) for p in places], "array long, station long, x double, y double")
    return spark.createDataFrame(rows, "array long, station long, idx long, x double"), geometry


@pytest.mark.parametrize("capon, prewhiten", [(False, False), (False, True), (True, False)])
def test_beams_point_back_at_a_plane_wave(spark, capon, prewhiten):
    samples, geometry = plane_wave(spark, (-0.1, 0.05))
    found = arrays.array_processing(samples, geometry, 50.0, 64, 32, (-0.2, 0.2, -0.2, 0.2, 0.05), 4.0, 8.0, capon=capon, prewhiten=prewhiten, block=50).orderBy("idx").collect()
    assert [r.idx for r in found] == [0, 32, 64, 96, 128]
    for r in found:
        # a delay of s.x means that the wave travels along s, and comes from the other side
        assert r.slowness == pytest.approx(np.hypot(0.1, 0.05), abs=0.051)
        if not capon:
            assert r.slowness == pytest.approx(np.hypot(0.1, 0.05)) and abs(r.back_azimuth) == pytest.approx(abs(np.degrees(np.arctan2(-0.1, 0.05)) + 180), abs=1)
            assert r.relative > 0.85 or prewhiten


# --- splines and filters


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_splines_pass_through_polynomials(spark, order):
    x = np.polynomial.polynomial.polyval(np.arange(30) / 10, [1, -2, 0.5, 0.25, -0.125, 0.0625][: order + 1])
    found = splines.interpolate_spline(trace(spark, x), 0.0, 0.3, order).orderBy("k").collect()
    assert len(found) == 97 and np.allclose([r.y for r in found], np.polynomial.polynomial.polyval(np.arange(97) * 0.03, [1, -2, 0.5, 0.25, -0.125, 0.0625][: order + 1]))


def test_splines_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, 600)
    run = lambda: (column(splines.interpolate_spline(trace(spark, x), 0.1, 0.9, 3), "y", "k"), column(splines.integrate_spline(trace(spark, x), 0.5, 2), "y"), column(splines.detrend_spline(trace(spark, x), 3, 4), "y"))
    whole = run()
    monkeypatch.setattr(splines, "KNOTS", 30)
    for a, b in zip(whole, run(), strict=True):
        assert np.allclose(a, b, atol=1e-11)
    assert splines.interpolate_spline(trace(spark, [1, 2, 3]), 0.0, 0.5, 3).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3])
def test_spline_trend_is_the_least_squares_one(spark, order):
    rng = np.random.default_rng(10)
    x = np.cumsum(rng.normal(0, 1, 200))
    knots = np.arange(12.5, 200 - 12.5 + 2, 25)
    full = np.concatenate([np.full(order + 1, 0.0), knots, np.full(order + 1, 199.0)])
    first, values = splines._basis(full, order, np.arange(200.0))
    matrix = np.zeros((200, len(full) - order - 1))
    for i in range(200):
        matrix[i, first[i] : first[i] + order + 1] = values[i]
    assert np.allclose(matrix.sum(1), 1)
    want = x - matrix @ np.linalg.lstsq(matrix, x, rcond=None)[0]
    assert np.allclose(column(splines.detrend_spline(trace(spark, x), order, 25), "y"), want, atol=1e-8)


def test_stop_band_of_decimation(spark):
    sections = kernels.chebyshev_lowpass(12.5, 100.0)
    z = np.exp(2j * np.pi * np.array([0.0, 6.0, 12.5, 20.0, 49.0]) / 100)
    gain = np.abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2) for s in sections], axis=0))
    assert gain[0] == pytest.approx(1) and gain[1] > 10 ** (-1 / 20) and (gain[2:] < 1.001 * 10 ** (-96 / 20)).all()
    with pytest.raises(ValueError):
        kernels.decimate(trace(spark, [1.0]), 17, 100.0)
    assert column(kernels.decimate(trace(spark, np.ones(900)), 4, 100.0), "y")[-1] == pytest.approx(1, abs=1e-6)


def test_zero_phase_over_blocks(spark, monkeypatch):
    x = np.random.default_rng(11).normal(0, 1, 900)
    sections = kernels.butterworth("bandpass", 4, 100.0, 5.0, 20.0)
    want = kernels.sections_filter(sections, zero_phase=True)(x[None])[0]
    monkeypatch.setattr(kernels, "PIECE", 64)
    assert np.allclose(column(kernels.filter_blocks(trace(spark, x), sections, True, block=50), "y"), want, atol=1e-12)


# --- polarisation


def test_axes_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(12)
    data = rng.normal(0, 1, (80, 3)) @ rng.normal(0, 1, (3, 3))
    frame = spark.createDataFrame([(1, i, *map(float, row)) for i, row in enumerate(data)], "trace long, idx long, e double, n double, z double")
    got = polarization.axes(frame, ["trace"]).first()
    values, vectors = np.linalg.eigh(np.cov(data.T))
    e, n, z = vectors[:, 2] * np.sign(vectors[2, 2])
    assert got.azimuth == pytest.approx(np.degrees(np.arctan2(e, n)) % 180) and got.incidence == pytest.approx(np.degrees(np.arctan2(np.hypot(e, n), z)))
    assert got.rectilinearity == pytest.approx(1 - np.sqrt(values[1] / values[2])) and got.planarity == pytest.approx(1 - 2 * values[0] / (values[1] + values[2]))
    window = polarization.window_eigenvalues(polarization.cut_windows(frame, 40, 20), [1.0, 0.0, -1.0]).orderBy("idx").collect()
    assert len(window) == 3
    for i, r in enumerate(window):
        assert np.allclose([r.small, r.middle, r.large], np.linalg.eigvalsh(np.cov(data[20 * i : 20 * i + 40].T)))
    assert window[1].d_large == pytest.approx(window[2].large - window[0].large) and window[0].d_large == pytest.approx(window[1].large - window[0].large)


# --- formats


def test_cut_records_crlf_and_odd_lines(spark, tmp_path):
    text = "no event\r\n# 2000 01 02 03 04 60.5 1.5 -2.5 10.0 NaN 0.1 0.2 0.3 77\r\nSTA1   1.25 0.5 P\r\n\r\n# 2000 13 02 03 04 5.5 1 2 3 4 5 6 7 78\r\nSTA2 1 1 S\r\n"
    (tmp_path / "a.pha").write_bytes(text.encode())
    events, picks = (df.collect() for df in bulletins.read_phase_lists(spark, str(tmp_path)))
    times = {r.event: r.time for r in events}
    assert times["77"].second == 0 and times["77"].minute == 5 and times["78"] is None and [r.magnitude for r in events] == [None, 4.0]
    assert {(r.event, r.station, r.time is None) for r in picks} == {("77", "STA1", False), ("78", "STA2", True)}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "short.ndk").write_text("PDEW 2006/04/09 20:50:46.0 -20.45  -70.24  34.6 5.5 5.8 NEAR COAST\nC2006\n")
    assert bulletins.read_moment_tensors(spark, str(tmp_path / "b")).collect() == []


def test_moment_tensor_of_a_published_layout(spark, tmp_path):
    lines = [
        "PDEW 2006/04/09 20:50:46.0 -20.45  -70.24  34.6 5.5 5.8 A PLACE BY THE SEA     ",
        "E200604092050A   B: 88  166  40 S: 96  189  50 M: 41   52 125 CMT: 1 TRIHD:  1.8",
        "CENTROID:      5.3 0.1 -20.46 0.01  -70.73 0.01  39.0  0.4 FREE S-20060726112355",
        "24  4.180 0.069 -1.700 0.046 -2.480 0.060 -1.050 0.052 -2.410 0.075 -2.280 0.038",
        "V10   4.975 73 100   0.120  8 216  -5.095 15 308   5.035  49 30  106 211 61   81",
    ]
    (tmp_path / "one.ndk").write_text("\n".join(lines) + "\n")
    r = bulletins.read_moment_tensors(spark, str(tmp_path)).first()
    assert (r.event, r.latitude, r.longitude, r.depth, r.mb, r.ms, r.centroid_longitude, r.duration) == ("E200604092050A", -20.45, -70.24, 34.6, 5.5, 5.8, -70.73, 1.8)
    assert r.m_rr == pytest.approx(4.18e17) and r.m_tp_error == pytest.approx(3.8e15) and r.p_length == pytest.approx(-5.095e17) and (r.t_plunge, r.t_azimuth) == (73, 100)
    assert r.moment == pytest.approx(5.035e17) and r.mw == pytest.approx(5.735, abs=1e-3) and (r.strike1, r.dip1, r.rake1, r.strike2, r.dip2, r.rake2) == (49, 30, 106, 211, 61, 81)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"{'#' if i % 7 == 0 else ' '}{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = bulletins.numbered_lines(spark, str(tmp_path), F.col("value").startswith("#"))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert all(int(r.value[1:]) == r.line and r.record == r.line // 7 + 1 for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_trees_with_missing_parts(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<FDSNStationXML><Network code="XX"><Station code="A" startDate="2001-01-01T00:00:00"><Latitude>1.5</Latitude></Station><Station><Latitude>2</Latitude></Station></Network><Network code="YY"/></FDSNStationXML>')
    tables = trees.read_station_xml(spark, str(tmp_path / "s.xml"))
    assert [(r.network, r.stations) for r in tables["networks"].orderBy("network").collect()] == [("XX", 2), ("YY", 0)]
    assert [(r.station, r.latitude, r.site) for r in tables["stations"].collect()] == [("A", 1.5, None)] and tables["poles"].collect() == []
    (tmp_path / "e.xml").write_text('<q><eventParameters><event publicID="e1"><preferredOriginID>o</preferredOriginID><origin publicID="o"><time><value>2001-02-03T04:05:06.5Z</value></time></origin></event><event/></eventParameters></q>')
    events = trees.read_event_tree(spark, str(tmp_path / "e.xml"))
    assert [(r.event, r.preferred_origin, r.type) for r in events["events"].collect()] == [("e1", "o", None)]
    origin = events["origins"].first()
    assert (origin.time.microsecond, origin.latitude, origin.depth) == (500000, None, None)


def test_sac_files_are_read_and_cut_ones_skipped(spark, tmp_path):
    rows = [("XX", "ABC", "", "BHZ", 1_600_000_000_123_000, 40.0, [1.0, -2.0, 3.5])]
    frame = spark.createDataFrame(rows, "network string, station string, location string, channel string, start long, rate double, data array<double>")
    content = bytes(sac.encode_sac(frame).first().content)
    (tmp_path / "a.sac").write_bytes(content)
    (tmp_path / "cut.sac").write_bytes(content[:-2])
    (tmp_path / "short.sac").write_bytes(content[:100])
    (tmp_path / "zero.sac").write_bytes(bytes(700))
    assert [tuple(r) for r in sac.read_sac(spark, str(tmp_path)).collect()] == rows


# --- archives and tables


def test_patterns_are_shell_patterns(spark):
    codes = spark.createDataFrame([("N.", "S(1)", "", "BHZ", 0, 10), ("NX", "S1", "", "BHN", 5, 10)], "network string, station string, location string, channel string, earliest long, latest long")
    requests = spark.createDataFrame([(1, "N.", "S*", "*", "*", None, None), (2, "*", "S(1)", "*", "BH?", 3, 4), (3, "*", "*", "", "?H?", None, 4), (4, "*", "?", "*", "*", None, None)], "request int, network string, station string, location string, channel string, start long, end long")
    found = sorted((r.request, r.station, r.start, r.end) for r in archive.resolve(requests, codes).collect())
    assert found == [(1, "S(1)", 0, 10), (2, "S(1)", 3, 4), (3, "S(1)", 0, 4)]


def test_places_slices_and_names(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int")
    placed = collections.numbered(rows, "v").collect()
    assert all(r.place == r.v for r in placed)
    for bounds in ((None, None, 1), (5, None, 3), (-10, -2, 1), (200, None, 1)):
        assert sorted(r.v for r in collections.picked(rows, ["v"], *bounds).collect()) == list(range(101))[slice(*bounds)]
    with pytest.raises(ValueError, match="bandpass"):
        named.apply("filter", "notch", rows)
    assert collections.repeated(rows, 0).collect() == []
    assert segments.gaps is not None


def test_picks_of_a_shifted_wavelet_are_corrected(spark):
    t = np.arange(200.0)
    wave = lambda at: np.exp(-(((t - at) / 9) ** 2)) * np.cos((t - at) / 5)
    rows = collections.joined(trace(spark, wave(100.0), 1), trace(spark, wave(103.4), 2))
    pairs = spark.createDataFrame([(7, 1, 100, 2, 102), (8, 1, 5, 2, 102)], "pair int, one long, pick_one int, two long, pick_two int")
    found = detection.correct_picks(pairs, rows, 30, 40, 10).collect()
    # a pick of 102 is 1.4 samples early; the pair whose window starts before the trace has no correction
    assert [r.pair for r in found] == [7] and found[0].correction == pytest.approx(1.4, abs=0.05) and 0.95 < found[0].coefficient < 1.05
