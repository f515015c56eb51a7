"""Network events from single-station triggers, in ranges of time."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .series import BLOCK, IDX, TRACE

#: Triggers that a range of time should hold, and members of events that a task holds before it passes them on.
RANGE_ROWS, MEMBERS = 100_000, 1_000_000


class _Firsts:
    """The first trigger of each station from trigger i on, in order of time, and how far they reach without a gap.

    A tree over all triggers holds for each stretch the latest end, the sums of weights and likenesses, and the start of its last
    gap, that is of the last trigger that starts more than the extension after all before it in the stretch. Starts rise, so a
    stretch has a gap after an end exactly if its last one is: both passing to the next trigger and finding an event's end
    take as many steps as the tree has levels, however many stations the event has.
    """

    def __init__(self, a: np.ndarray, z: np.ndarray, w: np.ndarray, alike: np.ndarray, first: np.ndarray, extension: float):
        whole = a.dtype.kind == z.dtype.kind == "i"
        kind, never = (np.int64, -(2**62)) if whole else (np.float64, -np.inf)
        n = 1 << max(1, (len(a) - 1).bit_length())
        self.n, self.extension = n, extension
        trees = [np.full(2 * n, fill, t) for fill, t in ((never, kind), (never, kind), (0.0, np.float64), (0, np.int64))]
        for tree, values in zip(trees, (a, z, w, alike), strict=True):
            tree[n : n + len(a)][first] = values[first]
        gap, end, weight, like = trees
        while n > 1:
            level, left, right = slice(n // 2, n), slice(n, 2 * n, 2), slice(n + 1, 2 * n, 2)
            end[level], weight[level], like[level] = np.maximum(end[left], end[right]), weight[left] + weight[right], like[left] + like[right]
            gap[level] = np.where(gap[right] > end[left] + extension, gap[right], gap[left])
            n //= 2
        packed = lambda x, t: array("d" if t is np.float64 else "q", x.astype(t).tobytes())
        kinds = kind, kind, np.float64, np.int64
        self.trees, self.values = ([packed(x, t) for x, t in zip(held, kinds, strict=True)] for held in (trees, (a, z, w, alike)))

    def add(self, i: int) -> None:
        """Trigger i becomes the first of its station."""
        (gap, end, weight, like), k, extension = self.trees, self.n + i, self.extension
        gap[k], end[k], weight[k], like[k] = (v[i] for v in self.values)
        k >>= 1
        while k:
            left = 2 * k
            right, until = left + 1, end[left]
            end[k] = max(until, end[right])
            gap[k] = gap[right] if gap[right] > until + extension else gap[left]
            weight[k], like[k] = weight[left] + weight[right], like[left] + like[right]
            k >>= 1

    def event(self, i: int) -> tuple[float, float, bool, int]:
        """End, sum of weights and likeness of the event of trigger i, and the trigger that it does not reach (-1: it reaches all)."""
        (gap, end, weight, like), k, n, extension = self.trees, self.n + i, self.n, self.extension
        until, total, alike = end[k], weight[k], like[k]
        while k > 1:
            if not k & 1:
                node = k + 1
                if gap[node] > until + extension:
                    while node < n:
                        node *= 2
                        if not gap[node] > until + extension:
                            until, total, alike = max(until, end[node]), total + weight[node], alike + like[node]
                            node += 1
                    return until, total, alike > 0, node - n
                until, total, alike = max(until, end[node]), total + weight[node], alike + like[node]
            k >>= 1
        return until, total, alike > 0, -1


def _scan(least: float, extension: float, everyone: int, reach: int, last: int, details: list[str]) -> Callable[[tuple, pd.DataFrame], Iterator[pd.DataFrame]]:
    """The events of a range that may stand: they end after all that qualified before them in it; _open: an end may lie beyond ``reach`` ranges.

    An open range is scanned again, so nothing else of it is passed on.
    """
    columns = ["_range", "_i", "_open", "start", "end", "coincidence_sum", "stations", "_weights", *details]

    def events(at: int, part: pd.DataFrame) -> Iterator[tuple | None]:
        a, z, w, own = (part[c].to_numpy() for c in ("_a", "_z", "_w", "_own"))
        alike, places = part["_alike"].to_numpy(bool), part.index.to_series().groupby(part["_s"], sort=False)
        before, after = places.shift(1).fillna(-1).to_numpy(int), places.shift(-1).fillna(-1).to_numpy(int).tolist()
        firsts, latest, shut = _Firsts(a, z, w, alike.astype(np.int64), before < 0, extension), None, at + reach >= last
        left = int((before < 0).sum())
        for i in range(int(own.sum())):
            off, total, like, beyond = firsts.event(i)
            if beyond < 0 and left < everyone and not shut:
                yield None
                return
            # the sum over the tree may differ from that in the stations' order by rounding
            if (like or total >= least - 1e-9 * max(1.0, abs(least))) and (latest is None or off > latest):
                taken = i + np.flatnonzero(before[i : len(a) if beyond < 0 else beyond] < i)
                total = float(w[taken].sum())
                if like or total >= least:
                    held, latest = part.iloc[taken], off
                    yield (at, i, False, a[i], off, total, held["_s"].tolist(), held["_w"].tolist(), *[held[c].tolist() for c in details])
            if after[i] >= 0:
                firsts.add(after[i])
            else:
                left -= 1

    def work(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(parts).sort_values(["_a", "_z", "_s"], ignore_index=True)
        rows, held, any_open = [], 0, False
        for row in events(key[0], part):
            if row is None:
                any_open = True
                break
            rows.append(row)
            held += len(row[6])
            if held > MEMBERS:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if any_open:
            rows = [(key[0], -1, True, part["_a"].iloc[0], part["_z"].iloc[0], 0.0, [], [], *[[] for _ in details])]
        yield pd.DataFrame(rows, columns=columns)

    return work


def network_triggers(
    triggers: DataFrame, start: str, end: str, station: str, least: float, weight: str | None = None, extension: int = 0, similarity: str | None = None, threshold: float = 0.7, details: tuple[str, ...] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(start, end, coincidence_sum, stations, ...): network events from single-station triggers, each scanned from its first one.

    An event takes later triggers of further stations in order of time, station by station, until one starts more than
    ``extension`` after all of the event has ended. It qualifies if its weights sum to ``least`` or one of its triggers has a
    ``similarity`` above ``threshold`` (a number or a column of the triggers), and stands if it ends after every event that
    qualified before. ``similarity`` comes back as a map of stations; each column of ``details`` as an array in the stations'
    order and as its weighted mean ``<column>_mean``.

    Triggers are dealt to ranges of start time, each with the triggers of the ranges after it. Where an event goes on beyond
    those, all is scanned with twice as many, so the work of a task is that of its range and of the reach of its events. What
    qualified before a range is one figure per range.
    """
    carried = [c for c in (*details, similarity) if c]
    alike = F.coalesce(F.col(similarity) > threshold, F.lit(False)) if similarity else F.lit(False)
    rows = triggers.select(F.col(start).alias("_a"), F.col(end).alias("_z"), F.col(station).alias("_s"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), alike.alias("_alike"), *carried)
    found = rows.agg(F.min("_a"), F.max("_a"), F.count("*"), F.countDistinct("_s")).first()
    low, high, count, everyone = found if found[2] else (0, 0, 0, 0)
    width = max(1, -(-(high - low + 1) // max(1, -(-count // range_rows))))
    last = int((high - low) // width)
    dealt = rows.withColumn("_at", F.floor((F.col("_a") - low) / F.lit(width)))
    types = dict(rows.dtypes)
    schema = f"_range long, _i long, _open boolean, start {types['_a']}, end {types['_z']}, coincidence_sum double, stations array<{types['_s']}>, _weights array<double>"
    schema += "".join(f", {c} array<{types[c]}>" for c in carried)
    reach = 1
    while True:
        wide = dealt.withColumn("_range", F.explode(F.sequence(F.greatest(F.col("_at") - reach, F.lit(0)), F.col("_at")))).withColumn("_own", F.col("_range") == F.col("_at"))
        events = written(wide.groupBy("_range").applyInPandas(_scan(least, extension, everyone, reach, last, carried), schema))
        if not events.where("_open").limit(1).count():
            break
        reach *= 2
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy("_range").agg(F.max("end").alias("_end")).select("_range", F.max("_end").over(earlier).alias("_before"))
    out = events.join(F.broadcast(ends), "_range").where("_before IS NULL OR end > _before")
    for c in details:
        out = out.withColumn(f"{c}_mean", F.try_divide(_sum(F.zip_with(c, "_weights", lambda x, w: x * w)), _sum(F.col("_weights"))))
    if similarity:
        pairs = F.filter(F.arrays_zip(F.col("stations").alias("station"), F.col(similarity).alias("value")), lambda p: p["value"].isNotNull())
        out = out.withColumn(similarity, F.map_from_entries(pairs))
    return out.drop("_range", "_i", "_open", "_weights", "_before")


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def trigger_figures(triggers: DataFrame, samples: DataFrame) -> DataFrame:
    """``triggers`` (trace, on_idx, off_idx) with peak and std of the characteristic function (samples: trace, idx, cft) from on to before off."""
    last = F.greatest(F.col("off_idx") - 1, F.col("on_idx"))
    asked = triggers.select(TRACE, "on_idx", "off_idx").distinct().withColumn("_block", F.explode(F.sequence(F.floor(F.col("on_idx") / BLOCK), F.floor(last / BLOCK))))
    held = samples.select(TRACE, IDX, "cft").withColumn("_block", F.floor(F.col(IDX) / BLOCK)).join(asked, [TRACE, "_block"]).where(F.col(IDX).between(F.col("on_idx"), last))
    figures = held.groupBy(TRACE, "on_idx", "off_idx").agg(F.max("cft").alias("peak"), F.stddev_pop("cft").alias("std"))
    return triggers.join(figures, [TRACE, "on_idx", "off_idx"])
