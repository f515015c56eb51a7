"""Golden numbers and independent twins of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.functions import geodesy
from seismark.functions.text import glob
from seismark.operators import catalog, kernels, network, segments, series
from seismark.sources import tables
from seismark.streaming import processes


def trace(spark, values, name=1):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "trace long, idx long, x double")


def column(df, name):
    return np.array([r[name] for r in df.orderBy("idx").collect()], float)


def test_recursive_sta_lta_known_values(spark):
    values = np.random.RandomState(815).randn(100000)[:200]
    got = column(series.recursive_sta_lta(trace(spark, values), 5, 10), "cft")
    assert np.allclose(got[99:103], [0.80810165, 0.75939449, 0.91763978, 0.97465004], atol=1e-7)


def test_blocks_do_not_change_moving_results(spark, monkeypatch):
    values = np.random.RandomState(1).randn(500)
    whole = column(series.classic_sta_lta(trace(spark, values), 5, 40), "cft")
    summed = column(series.integrate(trace(spark, values)), "y")
    monkeypatch.setattr(series.with_halo, "__defaults__", (0, 37))
    monkeypatch.setattr(series, "BLOCK", 37)
    assert np.allclose(whole, column(series.classic_sta_lta(trace(spark, values), 5, 40), "cft"))
    assert np.allclose(summed, column(series.integrate(trace(spark, values)), "y"))
    square = values**2
    assert np.isclose(whole[100], square[96:101].mean() / square[61:101].mean())


def test_trigger_onset_keeps_last_sample_above_off(spark):
    values = [0, 1.6, 1.2, 0.9, 1.2, 1.2, 0, 2, 0.5]
    rows = series.trigger_onset(trace(spark, values).withColumnRenamed("x", "cft"), 1.5, 1.0).orderBy("on_idx").collect()
    assert [(r.on_idx, r.off_idx) for r in rows] == [(1, 2), (7, 7)]


def test_gaps_and_overlaps(spark):
    rows = [(1, 0.0, 10.0), (1, 12.0, 20.0), (1, 15.0, 18.0), (1, 19.0, 30.0), (1, 31.0, 40.0)]
    found = segments.gaps(spark.createDataFrame(rows, "trace long, start double, end double"), 1.0).orderBy("gap_end").collect()
    assert [(r.gap_end, r.delta) for r in found] == [(12.0, 1.0), (15.0, -4.0), (19.0, -2.0)]


def test_fill_methods(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 3, 4.0)], "trace long, idx long, x double")
    assert column(segments.fill(rows, "latest"), "x").tolist() == [1, 1, 1, 4]
    assert column(segments.fill(rows, "interpolate"), "x").tolist() == [1, 2, 3, 4]
    assert column(segments.fill(rows, 0), "x").tolist() == [1, 0, 0, 4]


def test_merge_methods(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 0, 5.0), (1, 0, 1, 1.0), (1, 1, 1, 2.0)], "trace long, part int, idx long, x double")
    assert [r.x for r in segments.merge_samples(rows, 0).orderBy("idx").collect()] == [5.0, None]
    assert [r.x for r in segments.merge_samples(rows, 1).orderBy("idx").collect()] == [5.0, 2.0]
    assert segments.cleanup(rows).count() == 0


def test_epoch_join_open_end(spark):
    events = spark.createDataFrame([("a", 5), ("a", 50), ("a", 500)], "key string, t long")
    epochs = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 60), ("a", 3, 60, None)], "key string, epoch int, start long, end long")
    assert [r.epoch for r in segments.epoch_join(events, epochs, "key", "t", 7).orderBy("t").collect()] == [1, 2, 3]


def test_catalog_rules_and_nulls(spark):
    rows = spark.createDataFrame([(1, 5.0, None), (2, None, 10.0), (3, 1.0, 500.0)], "event int, magnitude double, depth double")
    assert {r.event for r in catalog.filter_catalog(rows, "depth < 100").collect()} == {1, 2}
    assert {r.event for r in catalog.filter_catalog(rows, "magnitude < 6").collect()} == {1, 3}
    assert {r.event for r in catalog.filter_catalog(rows, "depth > 100").collect()} == {3}
    with pytest.raises(ValueError):
        catalog.rule("depth ~ 3")


def test_glob_and_geodesy(spark):
    rows = spark.createDataFrame([("EHZ",), ("ehn",), ("BHZ",)], "channel string")
    assert rows.where(glob(F.col("channel"), "EH?")).count() == 2
    assert rows.where(glob(F.col("channel"), "[!e]*")).count() == 1
    one = spark.range(1).select(
        geodesy.degrees_between(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("a"), geodesy.azimuth(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("b"), geodesy.degrees_to_kilometers(F.lit(1.0)).alias("c")
    ).first()
    assert np.allclose([one.a, one.b, one.c], [180, 0, 111.19492664])


@pytest.mark.parametrize("kind, low, high, corner", [("lowpass", None, 10.0, 10.0), ("highpass", 10.0, None, 10.0), ("bandpass", 5.0, 20.0, 5.0), ("bandpass", 5.0, 20.0, 20.0), ("bandstop", 5.0, 20.0, 5.0)])
def test_butterworth_is_3_db_down_at_corners(kind, low, high, corner):
    sections = kernels.butterworth(kind, 4, 100.0, low, high)
    z = np.exp(-2j * np.pi * corner / 100.0) ** np.arange(3)
    gain = np.prod([abs((s[:3] @ z) / (s[3:] @ z)) for s in sections])
    assert np.isclose(gain, 2**-0.5, atol=1e-6)


def test_kernels():
    x = np.sin(2 * np.pi * 5 * np.arange(200) / 100)[None, :]
    assert np.allclose(kernels.envelope(x)[0, 20:-20], 1, atol=1e-6)
    assert np.allclose(kernels.instantaneous_frequency(100.0)(x)[0, 20:-20], 5, atol=0.1)
    assert np.allclose(kernels.fourier_resample(0.5, window=False)(x)[0, ::2], x[0], atol=1e-9)
    assert np.allclose(kernels.polynomial_detrend(2)(np.arange(50.0)[None, :] ** 2), 0, atol=1e-6)
    filtered = kernels.sections_filter(kernels.butterworth("bandpass", 4, 100.0, 20.0, 30.0))(x)
    assert abs(filtered[0, 100:]).max() < 1e-3


def test_process_state_carries_over():
    x = np.random.RandomState(3).randn(100)
    for make in (processes.integrate(0.5), processes.differentiate(0.5), processes.boxcar(7), processes.kurtosis(1.0, 20.0)):
        whole, _ = make(x, [])
        parts, state = [], []
        for part in np.array_split(x, [5, 6, 40]):
            y, state = make(part, state)
            parts.append(y)
        assert np.allclose(whole, np.concatenate(parts))


def test_ellipsoid_inverse_known_line(spark):
    lat1, lon1 = -(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600
    lat2, lon2 = -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600
    line = geodesy.ellipsoid_inverse(*[F.lit(x) for x in (lat1, lon1, lat2, lon2)])
    same = geodesy.ellipsoid_inverse(*[F.lit(x) for x in (10.0, 20.0, 10.0, 20.0)])
    got = spark.range(1).select(line.alias("g"), same.alias("s")).first()
    assert abs(got.g.meters - 54972.27) < 0.02
    assert abs(got.g.azimuth - (306 + 52 / 60 + 5.37 / 3600)) < 1e-4 and abs(got.g.back_azimuth - (127 + 10 / 60 + 25.07 / 3600)) < 1e-4
    assert got.s.meters == 0


def test_weighted_slopes_keep_samples_and_extrema(spark):
    x = np.array([0.0, 1.0, 3.0, 2.0, 2.0, 5.0])
    rows = series.interpolate_weighted_slopes(trace(spark, x), 0.0, 0.25).orderBy("k").collect()
    y = np.array([r.y for r in rows])
    assert np.allclose(y[::4], x) and y.max() <= 5 and y[4:13].max() == 3


def _triggers(cft, on, off, max_len=None, delete=False):
    """One sample at a time: a trigger opens at a rise to ``on`` and closes where cft falls under ``off`` or max_len is over."""
    rises = [i for i, v in enumerate(cft) if v >= on and (i == 0 or cft[i - 1] < on)]
    out, last = [], -1
    for i in rises:
        end = i
        while end + 1 < len(cft) and cft[end + 1] >= off:
            end += 1
        if i <= last:
            continue
        if max_len is not None and end - i > max_len:
            if delete:
                continue
            end = i + max_len
        out.append((i, end))
        last = end
    return out


@pytest.mark.parametrize("max_len, delete", [(None, False), (3, False), (3, True), (20, False)])
def test_trigger_lengths(spark, monkeypatch, max_len, delete):
    monkeypatch.setattr(series, "BLOCK", 16)
    rng = np.random.default_rng(4)
    cft = np.round(np.abs(np.sin(np.arange(200) / 7) * 2 + rng.normal(0, 0.4, 200)), 3).tolist()
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(cft)], "trace string, idx long, cft double")
    got = sorted((r.on_idx, r.off_idx) for r in series.trigger_onset(frame, 1.5, 0.7, max_len, delete).collect())
    assert got == _triggers(cft, 1.5, 0.7, max_len, delete) and got


def test_recursive_means_over_many_groups(spark):
    x = np.random.default_rng(8).normal(0, 1, 3000)
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "trace string, idx long, x double")
    got = {r.idx: r.cft for r in series.recursive_sta_lta(frame, 1, 400).collect()}
    sta, lta = 0.0, 1e-99
    for i in range(1, 3000):
        sta, lta = x[i] ** 2, x[i] ** 2 / 400 + (1 - 1 / 400) * lta
        assert got[i] == pytest.approx(sta / lta if i >= 400 else 0, rel=1e-9)


def test_segments_of_one_sample(spark):
    every = [kernels.instantaneous_frequency(100.0), kernels.power_density(100.0), kernels.band_energies(100.0, 3.0, 6, 2)]
    assert all(len(kernel(np.ones((2, 1)))) == 2 for kernel in every)


def test_bandstop_up_to_nyquist_stops_all_above():
    t = np.arange(2000) / 100
    stop = kernels.sections_filter(kernels.butterworth("bandstop", 4, 100.0, 20.0, 60.0))
    assert np.abs(stop(np.sin(2 * np.pi * 40 * t)[None])[0, 500:]).max() < 0.01
    assert np.abs(stop(np.sin(2 * np.pi * 5 * t)[None])[0, 500:]).max() == pytest.approx(1, abs=0.01)


def test_blocks_filter_as_the_whole_trace(spark):
    values = np.random.RandomState(3).randn(900)
    for design in (("bandpass", 4, 100.0, 2.0, 20.0), ("lowpass", 2, 100.0, None, 4.0)):
        sections = kernels.butterworth(*design)
        want = kernels.sections_filter(sections)(values[None, :])[0]
        assert np.allclose(column(kernels.filter_blocks(trace(spark, values), sections, block=37), "y"), want, atol=1e-12)


def test_filter_blocks_splits_long_traces(spark, monkeypatch):
    monkeypatch.setattr(kernels, "PIECE", 32)
    values = np.random.RandomState(4).randn(2000)
    sections = kernels.butterworth("lowpass", 2, 100.0, None, 30.0)
    want = kernels.sections_filter(sections)(values[None, :])[0]
    assert np.allclose(column(kernels.filter_blocks(trace(spark, values), sections, block=50), "y"), want, atol=1e-12)


def greedy(triggers, least, extension):
    """Network events by popping the first trigger and scanning the rest."""
    left, events, last = sorted(triggers), [], None
    while left:
        a, off, s, w = left.pop(0)
        names, total = [s], w
        for b, z, other, weight in left:
            if other in names:
                continue
            if b > off + extension:
                break
            names.append(other)
            total += weight
            off = max(off, z)
        if total >= least and (last is None or off > last):
            events.append((a, off, total, tuple(names)))
            last = off
    return events


@pytest.mark.parametrize("rows_per_range", [3, 100_000])
def test_network_triggers_as_popped_one_by_one(spark, rows_per_range):
    r = np.random.RandomState(5)
    starts = np.cumsum(r.randint(0, 9, 120))
    triggers = [(int(a), int(a + r.randint(1, 14)), int(r.randint(0, 6)), float(r.randint(1, 3))) for a in starts]
    df = spark.createDataFrame(triggers, "a long, z long, s long, w double")
    got = sorted((e.start, e.end, e.coincidence_sum, tuple(e.stations)) for e in network.network_triggers(df, "a", "z", "s", 3, "w", 1, range_rows=rows_per_range).collect())
    assert got == sorted(greedy(triggers, 3, 1)) and len(got) > 5


def test_polynomial_trend_of_short_and_long_traces(spark):
    values = np.polynomial.polynomial.polyval(np.arange(400), [3, -2, 0.5, 1e-3])
    assert np.abs(column(series.detrend_polynomial(trace(spark, values), 3), "y")).max() < 1e-6
    assert column(series.detrend_polynomial(trace(spark, [4, 5, 9]), 3), "y").tolist() == [0, 0, 0]
    noise = np.random.RandomState(6).randn(50)
    fit = np.polynomial.polynomial.polyfit(np.arange(50), noise, 5)
    assert np.allclose(column(series.detrend_polynomial(trace(spark, noise), 5), "y"), noise - np.polynomial.polynomial.polyval(np.arange(50), fit))


def test_dominant_period_of_packets_is_that_of_the_whole():
    x = np.random.RandomState(7).randn(60)
    run = processes.dominant_period(0.5, 10)
    whole, _ = run(x, [])
    parts, state = [], []
    for piece in np.split(x, [1, 4, 30, 31]):
        y, state = run(piece, state)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), whole) and whole[0] == 0


def test_octave_centres_span_the_periods():
    centres = kernels.octave_centres(100.0, 32)
    assert np.isclose(centres[0], 0.02) and np.isclose(centres[-1], 0.32) and len(centres) == 33


def test_event_csv_with_missing_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2023,5,6,19,55,1.3,H,10.2,124.8,nan,0.2,one\n2023,5,6,19,55,2,H,,null,7,,two\n")
    rows = tables.read_event_csv(spark, str(tmp_path / "a.csv"), "year mon day hour minu sec _ lat lon dep mag id").orderBy("event").collect()
    assert [(r.event, r.latitude, r.longitude, r.depth, r.magnitude) for r in rows] == [("one", 10.2, 124.8, None, 0.2), ("two", None, None, 7000.0, None)]
    assert rows[0].time.microsecond == 300000
