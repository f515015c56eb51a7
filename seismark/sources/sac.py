"""SAC binary segments: a header of 70 floats, 40 ints and 24 eight-byte words (the second is sixteen), then float samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Places in the header and the mark of an undefined number.
_DELTA, _B, _NPTS, _VERSION, _EVEN = 0, 5, 79, 76, 105
_WORDS, _HEAD, _UNDEFINED = 440, 632, -12345
_STATION, _CHANNEL, _NETWORK, _LOCATION = 0, 160, 168, 24
_TIME = (70, 71, 72, 73, 74, 75)


def _encode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in rows:
        out = []
        for row in part.itertuples():
            head = np.full(110, _UNDEFINED, "<i4")
            floats = head.view("<f4")
            floats[:70] = _UNDEFINED
            floats[_DELTA], floats[_B] = 1 / row.rate, 0.0
            at = pd.Timestamp(row.start, unit="us")
            head[list(_TIME)] = (at.year, at.dayofyear, at.hour, at.minute, at.second, at.microsecond // 1000)
            head[_NPTS], head[_VERSION], head[_EVEN] = len(row.data), 6, 1
            words = bytearray(b"-12345  " * 24)
            for place, text in ((_STATION, row.station), (_CHANNEL, row.channel), (_NETWORK, row.network), (_LOCATION, row.location)):
                words[place : place + 8] = (text or "").encode()[:8].ljust(8)
            out.append(head.tobytes() + bytes(words) + np.asarray(row.data, "<f4").tobytes())
        yield pd.DataFrame({"name": part["station"], "content": out})


def encode_sac(traces: DataFrame) -> DataFrame:
    """(name, content) of (network, station, location, channel, start in microseconds, rate, data)."""
    return traces.select("network", "station", "location", "channel", "start", "rate", "data").mapInPandas(_encode, "name string, content binary")


def _decode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in rows:
        out = []
        for content in part["content"]:
            if len(content) < _HEAD:
                continue
            order = "<" if int.from_bytes(content[4 * _VERSION : 4 * _VERSION + 4], "little") < 100 else ">"
            ints, floats = np.frombuffer(content, f"{order}i4", 110), np.frombuffer(content, f"{order}f4", 70)
            if len(content) < _HEAD + 4 * int(ints[_NPTS]) or min(ints[i] for i in (_NPTS, *_TIME[:2])) < 0 or not floats[_DELTA] > 0:
                continue
            word = lambda place, c=content: c[_WORDS + place : _WORDS + place + 8].decode(errors="replace").strip().replace("-12345", "")
            year, day, hour, minute, second, milli = (int(ints[i]) for i in _TIME)
            start = int(np.datetime64(f"{year:04d}-01-01", "us").astype(np.int64)) + (((day - 1) * 24 + hour) * 60 + minute) * 60_000_000 + second * 1_000_000 + milli * 1000 + round(float(floats[_B]) * 1e6)
            out.append((word(_NETWORK), word(_STATION), word(_LOCATION), word(_CHANNEL), start, 1 / float(str(floats[_DELTA])), np.frombuffer(content, f"{order}f4", int(ints[_NPTS]), _HEAD).astype(float)))
        yield pd.DataFrame(out, columns=["network", "station", "location", "channel", "start", "rate", "data"])


def decode_sac(files: DataFrame) -> DataFrame:
    """Segments of (content); files that are cut short or that lack a start, a length or an interval give no row."""
    schema = "network string, station string, location string, channel string, start long, rate double, data array<double>"
    return files.select("content").mapInPandas(_decode, schema)


def read_sac(spark: SparkSession, path: str) -> DataFrame:
    """Segments of SAC files of either byte order."""
    return decode_sac(spark.read.format("binaryFile").load(path))
