"""Distances, azimuths and boxes on the sphere as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product
from math import cos, pi, radians, sin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

EARTH_RADIUS_KM = 6371.0


def degrees_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in degrees; the arc tangent form is exact for near and for antipodal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    across = F.sqrt(F.pow(F.cos(b) * F.sin(d), 2) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), 2))
    return F.degrees(F.atan2(across, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def back_azimuth(angle: Column) -> Column:
    return F.when(angle >= 180, angle - 180).otherwise(angle + 180)


def kilometers_to_degrees(km: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    return km / (2 * pi * radius / 360)


def degrees_to_kilometers(degrees: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    return degrees * (2 * pi * radius / 360)


def in_bounds(
    latitude: Column,
    longitude: Column,
    minlatitude: float | None = None,
    maxlatitude: float | None = None,
    minlongitude: float | None = None,
    maxlongitude: float | None = None,
    center: tuple[float, float] | None = None,
    minradius: float | None = None,
    maxradius: float | None = None,
) -> Column:
    """Box (which may cross 180 degrees) and ring around a centre; a null coordinate fails any bound that needs it."""
    tests = []
    if minlatitude is not None:
        tests.append(latitude >= minlatitude)
    if maxlatitude is not None:
        tests.append(latitude <= maxlatitude)
    if minlongitude is not None and maxlongitude is not None and minlongitude > maxlongitude:
        tests.append((longitude >= minlongitude) | (longitude <= maxlongitude))
    else:
        if minlongitude is not None:
            tests.append(longitude >= minlongitude)
        if maxlongitude is not None:
            tests.append(longitude <= maxlongitude)
    if center is not None:
        away = degrees_between(F.lit(center[0]), F.lit(center[1]), latitude, longitude)
        if minradius is not None:
            tests.append(away >= minradius)
        if maxradius is not None:
            tests.append(away <= maxradius)
    out = F.lit(True)
    for test in tests:
        out = out & F.coalesce(test, F.lit(False))
    return out


#: Rows of either table that meet in one task, and pairs that it looks at at once; cells have so many rows where that is not too wide.
MEET_ROWS, MEET_PAIRS, CELL_ROWS = 32_768, 2_000_000, 500


def near_pairs(points: DataFrame, key: str, degrees: float) -> DataFrame:
    """Pairs of rows of a table (``key`` < ``_key``) at most ``degrees`` of arc apart."""
    return near_join(points, points, degrees, key)


def near_join(points: DataFrame, others: DataFrame, degrees: float, below: str | None = None) -> DataFrame:
    """Rows of two tables, with all columns of both (the others' named _), at most ``degrees`` of arc apart; ``below``: a column that must be less in the first.

    The rows meet cell by cell (``_meet``), and the work grows with the pairs that are near.
    """
    limit = cos(radians(min(degrees, 180.0))) - 1e-12

    def run(one: pa.RecordBatch, other: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p, q = _Places(one), _Places(other)
        for i, j in _tiles(p, q, degrees, lambda dots: dots >= limit):
            away = p.degrees_to(i, q, j)
            held = away <= degrees
            if below:
                held &= np.asarray(pc.fill_null(pc.less(one[below].take(pa.array(i)), other[f"_{below}"].take(pa.array(j))), False))
            i, j = pa.array(i[held]), pa.array(j[held])
            columns = [c.take(i) for c in one.columns] + [c.take(j) for c in other.columns] + [pa.array(away[held])]
            yield pa.record_batch(columns, [*one.schema.names, *other.schema.names, "degrees"])

    named = others.select(*[F.col(c).alias(f"_{c}") for c in others.columns])
    return _meet(points, named, degrees, run, StructType([*points.schema.fields, *named.schema.fields, StructField("degrees", DoubleType())]))


def nearest(points: DataFrame, key: str, others: DataFrame, other_key: str, degrees: float, digits: int) -> DataFrame:
    """(key, other_key, degrees): of each point the other that is nearest by degrees of arc rounded to ``digits``, the least key of equal ones, if at most ``degrees`` away."""
    ten, slack = 10.0**digits, radians(3 / 10.0**digits)

    def run(one: pa.RecordBatch, other: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = _Places(other)
        place, back = np.unique(np.stack([np.asarray(one["latitude"]), np.asarray(one["longitude"])], 1), axis=0, return_inverse=True)
        p, back = _Places(pa.record_batch({"latitude": pa.array(place[:, 0]), "longitude": pa.array(place[:, 1])})), back.ravel()
        order = np.empty(len(q.z), np.int64)
        order[np.asarray(pc.array_sort_indices(other[f"_{other_key}"]))] = np.arange(len(q.z))
        # what rounds alike, and what the product of vectors can not tell, is as near
        close = lambda dots: dots >= (np.cos(np.minimum(np.arccos(np.clip(dots.max(1), -1, 1)) + slack, pi)) - 1e-15)[:, None]
        best, away = np.full(len(place), -1), np.full(len(place), np.inf)
        for i, j in _tiles(p, q, degrees + 1 / ten, close):
            rounded = np.floor(p.degrees_to(i, q, j) * ten + 0.5) / ten
            ranked = np.lexsort((order[j], rounded, i))
            i, j, rounded = i[ranked], j[ranked], rounded[ranked]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]] & (rounded <= degrees)) if len(i) else np.zeros(0, int)
            best[i[first]], away[i[first]] = j[first], rounded[first]
        held = best[back] >= 0
        yield pa.record_batch([one[key].filter(pa.array(held)), other[f"_{other_key}"].take(pa.array(best[back[held]])), pa.array(away[back[held]])], [key, other_key, "degrees"])

    named = others.select(*[F.col(c).alias(f"_{c}") for c in (other_key, "latitude", "longitude")])
    schema = StructType([points.schema[key], others.schema[other_key], StructField("degrees", DoubleType())])
    found = _meet(points.select(key, "latitude", "longitude"), named, degrees + 1 / ten, run, schema)
    return found.groupBy(key).agg(F.min(F.struct("degrees", other_key)).alias("_s")).select(key, f"_s.{other_key}", "_s.degrees")


class _Places:
    """Unit vectors of the rows of a batch, sorted from south to north."""

    def __init__(self, rows: pa.RecordBatch):
        lat, self.longitude = (np.asarray(rows[c if c in rows.schema.names else f"_{c}"]) for c in ("latitude", "longitude"))
        lat, lon = np.radians(lat), np.radians(self.longitude)
        self.sin, self.cos = np.sin(lat), np.cos(lat)
        xyz = np.stack([self.cos * np.cos(lon), self.cos * np.sin(lon), self.sin], 1)
        self.order = np.argsort(self.sin, kind="stable")
        self.xyz, self.z = xyz[self.order], self.sin[self.order]

    def degrees_to(self, i: np.ndarray, others: _Places, j: np.ndarray) -> np.ndarray:
        """``degrees_between`` of rows."""
        d = np.radians(others.longitude[j] - self.longitude[i])
        east, along = np.sin(d), np.cos(d)
        s, c, t, k = self.sin[i], self.cos[i], others.sin[j], others.cos[j]
        east *= k
        return np.degrees(np.arctan2(np.sqrt(east**2 + (c * t - s * k * along) ** 2), s * t + c * k * along))


def _tiles(p: _Places, q: _Places, degrees: float, chosen: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both whose product of unit vectors is chosen, in tiles of a band of latitudes; a row of p is in one tile, with all of q that may be near."""
    reach, at = 2 * sin(radians(min(degrees, 180.0)) / 2) + 1e-9, 0
    step = max(1, min(512, MEET_PAIRS // max(1, len(q.z))))
    while at < len(p.z):
        tile = slice(at, at + step)
        first, last = np.searchsorted(q.z, [p.z[tile][0] - reach, p.z[tile][-1] + reach])
        if first < last:
            i, j = np.nonzero(chosen(p.xyz[tile] @ q.xyz[first:last].T))
            yield p.order[tile][i], q.order[first:last][j]
        at += step


def _meet(points: DataFrame, others: DataFrame, degrees: float, work: Callable[[pa.RecordBatch, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``work`` on the rows of two tables (the second's columns begin with _) that may lie ``degrees`` apart; rows without a place are left out.

    Points become unit vectors in a grid whose cells are at least as wide as the chord of that arc, so partners lie in the 27
    cells around. A cell is one group, or, where more than ``MEET_ROWS`` of either table meet in it, one for each of their parts
    with each of the others': a task holds so many rows of both, whatever lies in a cell. Only counts of cells are joined.
    """
    total = points.count() + others.count()
    width = max(2 * sin(radians(min(degrees, 180.0)) / 2) + 1e-9, min(0.5, (4 * pi * CELL_ROWS / max(total, 1)) ** 0.5))
    cells = ["_c0", "_c1", "_c2"]

    def celled(df: DataFrame, prefix: str) -> DataFrame:
        lat, lon = F.radians(f"{prefix}latitude"), F.radians(f"{prefix}longitude")
        xyz = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
        known = [c.isNotNull() & ~F.isnan(c) for c in xyz]
        return df.where(known[0] & known[1] & known[2]).withColumns({c: F.floor(x / width) for c, x in zip(cells, xyz, strict=True)})

    def around(df: DataFrame) -> DataFrame:
        steps = [F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in product((-1, 0, 1), repeat=3)]
        return df.withColumn("_d", F.explode(F.array(*steps))).withColumns({c: F.col(c) + F.col(f"_d.d{i}") for i, c in enumerate(cells)}).drop("_d")

    one, other = celled(points, ""), celled(others, "_")
    counted = one.groupBy(*cells).agg(F.count("*").alias("_n")).join(around(other.groupBy(*cells).agg(F.count("*").alias("_m"))).groupBy(*cells).agg(F.sum("_m").alias("_m")), cells)
    parts = lambda c: F.ceil(F.col(c) / MEET_ROWS).cast("int")
    full = counted.select(*cells, parts("_n").alias("_ni"), parts("_m").alias("_nj")).where("_ni > 1 OR _nj > 1")
    asked, split = counted.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0, full.count()
    other = around(other)
    if split:
        full = F.broadcast(full) if split <= 100_000 else full
        whole = lambda c: F.coalesce(F.col(c), F.lit(1))
        dealt = lambda df, own, own_n, each, each_n: df.withColumn("_id", F.monotonically_increasing_id()).join(full, cells, "left").withColumns({own: F.pmod("_id", whole(own_n)).cast("int"), each: F.explode(F.sequence(F.lit(0), whole(each_n) - 1))}).drop("_id", "_ni", "_nj")
        one, other = dealt(one, "_i", "_ni", "_j", "_nj"), dealt(other, "_j", "_nj", "_i", "_ni")
    else:
        one, other = (df.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for df in (one, other))
    keys = [*cells, "_i", "_j"]
    nothing = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    both = one.select(*keys, F.lit(True).alias("_one"), *points.columns, *nothing(others)).unionAll(other.select(*keys, F.lit(False).alias("_one"), *nothing(points), *others.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], []]
        for batch in batches:
            for i, (mine, names) in enumerate(((batch["_one"], own), (pc.invert(batch["_one"]), theirs))):
                held[i].append(batch.select(names).filter(mine))
        one, other = (pa.Table.from_batches(x).combine_chunks() for x in held)
        if one.num_rows and other.num_rows:
            yield from work(one.to_batches()[0], other.to_batches()[0])

    own, theirs = points.columns, others.columns
    deals = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, int(asked / 2e8)))
    return both.repartition(deals, *keys).groupBy(*keys).applyInArrow(run, schema)


# The WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
# Fixed value: the meters that stand for nearly antipodal points.
ANTIPODES = 20004314.5


def ellipsoid_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, a: float = WGS84_A, f: float = WGS84_F, rounds: int = 60) -> Column:
    """(meters, azimuth, back_azimuth) of a geodesic, by Vincenty's fixed point for the longitude on the auxiliary sphere.

    Where it does not settle (nearly antipodal points) the distance is ``ANTIPODES`` and both azimuths are 0; null where a
    coordinate is null.
    """
    b = a * (1 - f)

    def sphere(s1, c1, s2, c2, lam):  # noqa: ANN001, ANN202
        east, north = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
        sine, cosine = np.sqrt(east * east + north * north), s1 * s2 + c1 * c2 * np.cos(lam)
        alpha = np.where(sine > 0, c1 * c2 * np.sin(lam) / sine, 0.0)
        flat = 1 - alpha * alpha
        return sine, cosine, np.arctan2(sine, cosine), alpha, flat, np.where(flat > 1e-15, cosine - 2 * s1 * s2 / flat, 0.0), east, north

    @F.pandas_udf("meters double, azimuth double, back_azimuth double")
    def lines(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
        u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        apart = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
        lam, moved, open_ = apart.copy(), np.ones(len(apart)), np.arange(len(apart))
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(rounds):
                if not len(open_):
                    break
                sine, cosine, sigma, alpha, flat, m, _, _ = sphere(s1[open_], c1[open_], s2[open_], c2[open_], lam[open_])
                c = f / 16 * flat * (4 + f * (4 - 3 * flat))
                new = apart[open_] + (1 - c) * f * alpha * (sigma + c * sine * (m + c * cosine * (2 * m * m - 1)))
                moved[open_], lam[open_] = np.abs(new - lam[open_]), new
                open_ = open_[~(moved[open_] <= 1e-12)]
            sine, cosine, sigma, alpha, flat, m, east, north = sphere(s1, c1, s2, c2, lam)
            u = flat * (a * a - b * b) / (b * b)
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            shift = small * sine * (m + small / 4 * (cosine * (2 * m * m - 1) - small / 6 * m * (4 * sine * sine - 3) * (4 * m * m - 3)))
            back = np.arctan2(c1 * np.sin(lam), -s1 * c2 + c1 * s2 * np.cos(lam))
            settled = moved <= 1e-9
            # a turn is added first, so that an angle just below 0 gives 0 and not 360
            turn = lambda x, more: np.where(settled, np.fmod(np.degrees(x) + more, 360.0), 0.0)
            return pd.DataFrame({"meters": np.where(settled, b * big * (sigma - shift), ANTIPODES), "azimuth": turn(np.arctan2(east, north), 360.0), "back_azimuth": turn(back, 540.0)})

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, lines(lat1, lon1, lat2, lon2))


def rotate_ne_rt(n: Column, e: Column, back_azimuth: Column) -> tuple[Column, Column]:
    """Radial and transverse; with 360 degrees less the back azimuth, north and east from those."""
    return -e * F.sin(back_azimuth) - n * F.cos(back_azimuth), -e * F.cos(back_azimuth) + n * F.sin(back_azimuth)


def rotate_lqt_zne(l: Column, q: Column, t: Column, back_azimuth: Column, incidence: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Ray components back to vertical, north and east; angles in radians."""
    flat = q * F.cos(incidence) - l * F.sin(incidence)
    return l * F.cos(incidence) + q * F.sin(incidence), flat * F.cos(back_azimuth) + t * F.sin(back_azimuth), flat * F.sin(back_azimuth) - t * F.cos(back_azimuth)


def rotate_to_zne(components: list[Column], directions: list[tuple[float, float]]) -> list[Column]:
    """Vertical, north and east from three components with (azimuth, dip) in degrees; they must not lie in a plane."""
    base = np.array([[-np.sin(dip), np.cos(azimuth) * np.cos(dip), np.sin(azimuth) * np.cos(dip)] for azimuth, dip in np.radians(directions)])
    if not 1e-6 < abs(np.linalg.det(base)) < 1e6:
        raise ValueError("the directions are not linearly independent")
    return [sum((float(w) * c for w, c in zip(row[1:], components[1:], strict=True)), float(row[0]) * components[0]) for row in np.linalg.inv(base)]


# The ellipsoid of the local plane (radius in kilometers, flattening), a degree in radians and the squared axes' ratio.
PLANE_RADIUS, PLANE_FLATTENING, PLANE_DEGREE, PLANE_RATIO = 6378.163, 298.26, 1.7453292e-2, 9.9330647e-1


def _plane(lat0: Column) -> tuple[Column, Column, Callable[[Column], Column]]:
    """Kilometers of a minute of latitude and (at the equator's cosine) of longitude near a latitude, and the reduced latitude of degrees."""
    reduced = lambda degrees: F.atan(PLANE_RATIO * F.tan(degrees * PLANE_DEGREE))
    here = reduced(lat0)
    radius = PLANE_RADIUS * (1 - F.sin(here) * F.sin(here) / PLANE_FLATTENING)
    north = radius * (reduced(lat0 + 1 / 60) - here)
    east = radius * F.acos(1 - (1 - cos(PLANE_DEGREE / 60)) * F.cos(here) * F.cos(here)) / F.cos(here)
    return north, east, reduced


def to_plane(lon0: Column, lat0: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Kilometers east and north of a place from an origin, on a plane at the latitude between both."""
    north, east, reduced = _plane(lat0)
    return (lon - lon0) * 60 * east * F.cos(reduced((lat + lat0) / 2)), (lat - lat0) * 60 * north


def from_plane(lon0: Column, lat0: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of kilometers east and north of an origin."""
    north, east, reduced = _plane(lat0)
    lat = lat0 + y / north / 60
    return lon0 + x / (east * F.cos(reduced((lat + lat0) / 2))) / 60, lat
