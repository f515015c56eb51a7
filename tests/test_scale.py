"""Queries and operators on the odd and the large inputs of the findings."""

import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import greedy

from seismark.functions import geodesy
from seismark.operators import arrays, network
from seismark.plans import catalogue
from seismark.plans import trees as tree_plans
from seismark.sources import trees

SF = Path("/root/testdata/sf0.001")


def against_twin(spark, tmp_path, name, **tables):
    """Rows of the query and of its twin over tables that are given as SQL."""
    duck = duckdb.connect()
    for table, sql in tables.items():
        duck.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    want = duck.sql(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    order = lambda frame: frame.sort_values(list(frame.columns), ignore_index=True)
    return order(got), order(want)


def test_bands_without_energy_stay(spark, tmp_path):
    rows = "SELECT CAST(i AS BIGINT) AS vec_id, list_transform(range(0, 64), lambda k: CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 1e-5 * k ELSE sin(k * k) END AS FLOAT)) AS embedding, 0::INTEGER AS label FROM range(0, 3) r(i)"
    got, want = against_twin(spark, tmp_path, "band_energies", embeddings=rows)
    assert len(want) == 30 and (want.y == 0).sum() >= 10 and got.equals(want.astype(got.dtypes.to_dict()))


def brute_degrees(a, b):
    """Great-circle angles of all rows of a (latitude, longitude) with all of b."""
    (p, l), (q, m) = np.radians(np.asarray(a, float)).T, np.radians(np.asarray(b, float)).T
    p, d = p[:, None], m[None] - l[:, None]
    east, north = np.cos(q) * np.sin(d), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d)
    return np.degrees(np.arctan2(np.hypot(east, north), np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * np.cos(d)))


@pytest.mark.parametrize("rows, degrees", [(32_768, 10.3), (16, 10.3), (16, 0.5), (16, 180.0)])
def test_near_pairs_meet_in_parts_of_cells(spark, monkeypatch, rows, degrees):
    monkeypatch.setattr(geodesy, "MEET_ROWS", rows)
    rng = np.random.default_rng(3)
    places = np.concatenate([np.stack([rng.uniform(-90, 90, 100), rng.uniform(-180, 180, 100)], 1), [[12.0, 179.9]] * 30, [[12.0, -179.9]] * 30])
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "k long, latitude double, longitude double")
    plan = geodesy.near_pairs(frame, "k", degrees)
    away = brute_degrees(places, places)
    want = {(i, j) for i, j in zip(*np.nonzero(away <= degrees), strict=True) if i < j}
    found = plan.collect()
    assert len(found) == len(want) and {(r.k, r._k) for r in found} == want
    assert all(r.degrees == pytest.approx(away[r.k, r._k], abs=1e-9) for r in found)


def test_pairs_broadcast_no_multiplied_rows(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    for name in ("great_circle_pairs", "ellipsoid_pairs"):
        assert "Broadcast" not in catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_lines_take_no_lambda_rounds(spark, tmp_path):
    line = geodesy.ellipsoid_inverse(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rows = spark.createDataFrame([(10.0, 20.0, -33.3, 41.5), (0.0, 0.0, 0.3, 179.9), (None, 0.0, 1.0, 1.0), (5.0, 5.0, 5.0, 5.0)], "a double, b double, c double, d double").select(line.alias("g"))
    assert "aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    far, odd, none, same = [r.g for r in rows.collect()]
    assert far.meters == pytest.approx(5_305_000, rel=0.01) and 0 < far.azimuth < 360 and (odd.meters, odd.azimuth, none, same.meters) == (geodesy.ANTIPODES, 0.0, None, 0.0)


@pytest.mark.parametrize("rows", [32_768, 16])
def test_nearest_of_equally_near_ones_has_the_least_key(spark, monkeypatch, rows):
    monkeypatch.setattr(geodesy, "MEET_ROWS", rows)
    rng = np.random.default_rng(4)
    others = rng.integers([-40, -180], [40, 180], (120, 2)).astype(float)
    others[60:] = others[:60]
    points = np.concatenate([rng.integers([-90, -180], [90, 180], (200, 2)), others[:40]]).astype(float)
    keys = rng.permutation(120)
    frame = lambda rows, keys: spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in zip(keys, rows, strict=True)], "k long, latitude double, longitude double")
    found = geodesy.nearest(frame(points, range(240)), "k", frame(others, keys).withColumnRenamed("k", "s"), "s", 25.3, 5).collect()
    away = np.round(brute_degrees(points, others), 5)
    want = {i: min(zip(row, keys, strict=True)) for i, row in enumerate(away) if row.min() <= 25.3}
    assert {r.k: (r.degrees, r.s) for r in found} == want and len(found) == len(want) and 100 < len(want) < 240


def test_azimuths_just_below_north_turn_as_in_the_twin(spark, tmp_path):
    rows = "SELECT i AS s_suppkey, 'x' AS s_name, 1::INTEGER AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM unnest([44, 538, 401, 0, 783, 14, 587, 949, 1492]::BIGINT[]) t(i)"
    got, want = against_twin(spark, tmp_path, "ellipsoid_pairs", supplier=rows)
    assert len(want) >= 4 and (want[["azimuth", "back_azimuth"]] == 0).any(axis=None) and got.to_numpy().tolist() == want.to_numpy().tolist()


def test_event_trees_are_packed_and_shuffle_lines_once(spark, tmp_path):
    """Each level comes back from tables, and the queries' tree needs one exchange of lines and one of orders."""
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "events": one([("e", "o1", "m2", "f"), ("x", None, "none", None)], "event string, preferred_origin string, preferred_magnitude string, preferred_mechanism string").withColumn("type", F.lit("earthquake")),
        "descriptions": one([("e", "here", "name"), ("x", "there", "name")], "event string, text string, kind string"),
        "origins": one([("e", "o1", 1.5), ("e", "o2", None), ("gone", "o3", 1.0)], "event string, origin string, depth double").withColumns({"time": F.lit("2001-02-03 04:05:06.5").cast("timestamp"), "latitude": F.lit(1.0), "longitude": F.lit(2.0)}),
        "arrivals": one([("e", "o2", "p1"), ("e", "o2", "p2")], "event string, origin string, pick string").withColumns({"phase": F.lit("P"), "azimuth": F.lit(1.0), "distance": F.lit(2.0), "residual": F.lit(0.5)}),
        "magnitudes": one([("e", "m1", 4.0), ("e", "m2", 5.0), ("x", "m3", 6.0)], "event string, magnitude string, mag double").withColumns({"type": F.lit("ML"), "origin": F.lit("o1")}),
        "mechanisms": one([("e", "f")], "event string, mechanism string").withColumns({c: F.lit(7.0) for c in ("strike1", "dip1", "rake1", "strike2", "dip2", "rake2", "moment")}),
    }
    trees.write_event_tree(tables, str(tmp_path / "e"))
    assert all(p.suffix == ".gz" for p in (tmp_path / "e").glob("part-*"))
    read = trees.read_event_tree(spark, str(tmp_path / "e"))
    assert sorted((r.origin, r.depth) for r in read["origins"].collect()) == [("o1", 1.5), ("o2", None)]
    assert sorted((r.event, r.origin, r.pick, r.latitude, r.residual) for r in read["located"].collect()) == [("e", "o2", "p1", 1.0, 0.5), ("e", "o2", "p2", 1.0, 0.5)]
    assert sorted((r.event, r.text, r.mag, r.strike) for r in trees.read_preferred(spark, str(tmp_path / "e")).collect()) == [("e", "here", 5.0, 7.0), ("x", "there", None, None)]
    if SF.exists():
        plan = tree_plans._event_rows(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2
        for name in ("event_tree_origins", "event_tree_picks", "event_tree_preferred"):
            assert "Exchange" not in catalogue.QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows, members, gap", [(100_000, 1_000_000, 2), (40, 50, 2), (40, 50, 60)])
def test_events_of_all_stations_are_scanned_without_their_lists(spark, monkeypatch, rows, members, gap):
    """Chains that hardly end: what a range passes on is its standing events, or one open row, not the stations of each trigger."""
    monkeypatch.setattr(network, "MEMBERS", members)
    r = np.random.RandomState(8)
    starts = np.cumsum(r.randint(0, gap, 600))
    triggers = [(int(a), int(a + r.randint(5, 40)), int(r.randint(0, 70)), float(r.randint(1, 3))) for a in starts]
    df = spark.createDataFrame(triggers, "a long, z long, s long, w double")
    for least in (3, 8, 30):
        got = sorted((e.start, e.end, round(e.coincidence_sum, 9), tuple(e.stations)) for e in network.network_triggers(df, "a", "z", "s", least, "w", 1, range_rows=rows).collect())
        assert got == [(*e[:2], round(e[2], 9), e[3]) for e in sorted(greedy(triggers, least, 1))]
    part = pd.DataFrame(triggers, columns=["_a", "_z", "_s", "_w"]).assign(_own=True, _alike=False)
    passed = pd.concat(network._scan(3, 1, 71, 1, 9, [])((0,), iter([part])))
    assert passed["_open"].sum() <= 1 and passed.loc[passed["_open"], "stations"].map(len).sum() == 0


@pytest.mark.parametrize("kind", ["full", "copies", "silent"])
def test_steered_inverse_is_that_of_the_cross_spectra(kind):
    rng = np.random.default_rng(11)
    ft = rng.normal(size=(300, 3)) + 1j * rng.normal(size=(300, 3))
    ft = {"full": ft, "copies": np.tile(ft[:20], (4, 1)), "silent": np.concatenate([ft[:30], np.zeros((5, 3))])}[kind]
    steer = np.exp(1j * rng.uniform(0, 6, (9, len(ft))))
    cross = ft[:, None, :] * ft[None, :, :].conj()
    scale = np.abs(cross.sum(2))
    cross = cross / np.where(scale > 0, scale, 1.0)[:, :, None]
    for k in range(3):
        want = np.abs(np.einsum("gi,ij,gj->g", steer.conj(), np.linalg.pinv(cross[:, :, k], rcond=1e-6), steer))
        assert np.allclose(arrays.steered_inverse(ft, k, steer), want, rtol=1e-7)


def test_steered_inverse_holds_a_few_matrices_of_reals():
    rng = np.random.default_rng(12)
    ft, steer = rng.normal(size=(700, 40)) + 1j * rng.normal(size=(700, 40)), np.ones((2, 700), complex)
    tracemalloc.start()
    arrays.steered_inverse(ft, 0, steer)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * 8 * 700 * 700
