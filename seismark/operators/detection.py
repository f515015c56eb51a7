"""Template detection over many channels and templates, in blocks of samples.

A block of a channel, with as many samples after it as the longest template has, is one row of arrays; each meets the
templates of its channel in an equi join, and one Arrow pass gives the normalised correlation of every window that starts in
the block: by direct sums for short templates, by Fourier transforms for long ones. So the rows that are shuffled are blocks,
not products, and a long trace is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .series import BLOCK, IDX, X, with_halo

#: Template samples up to which windows are summed directly.
DIRECT = 64
#: Distances that a range of candidates is widened by at first when they are thinned.
REACHES = 32


def sample_blocks(df: DataFrame, keys: list[str], before: int, after: int, block: int = BLOCK) -> DataFrame:
    """(keys, _block, _idx, _x): each block of the samples (keys, idx, x) with its neighbours, as sorted arrays."""
    halo = with_halo(df.select(*keys, IDX, X), before, after, block)
    grouped = halo.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(IDX, X))).alias("_s"))
    return grouped.select(*keys, "_block", F.col(f"_s.{IDX}").alias("_idx"), F.col(f"_s.{X}").alias("_x"))


def _products(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sums of products of t with every window of x."""
    if len(t) <= DIRECT:
        return np.correlate(x, t, "valid")
    n = 1 << (len(x) + len(t) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(t[::-1], n), n)[len(t) - 1 : len(x)]


def _window_sums(x: np.ndarray, length: int) -> np.ndarray:
    if length <= DIRECT:
        return np.lib.stride_tricks.sliding_window_view(x, length).sum(1)
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[length:] - total[:-length]


def window_correlations(x: np.ndarray, t: np.ndarray, demean: bool, normalize: bool) -> np.ndarray:
    """Correlation of t with every window of x; with a norm, windows or templates without energy give 0."""
    t = t - t.mean() if demean else t
    level = x.mean() if demean else 0.0
    x = x - level
    cc = _products(x, t)
    if not normalize:
        return cc
    energy = _window_sums(x * x, len(t))
    if demean:
        energy = energy - _window_sums(x, len(t)) ** 2 / len(t)
    spread = energy * (t @ t)
    sound = (spread > 1e-9) & (energy > 1e-12 * max(float((x * x).max()), level * level))
    return np.where(sound, cc / np.sqrt(np.where(sound, spread, 1.0)), 0.0)


def _correlated(keys: list[str], labels: list[str], demean: bool, normalize: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, values, sizes = [], [], [], []
            columns = [batch.column(c) for c in ("_block", "_idx", "_x", "_t")]
            for i in range(batch.num_rows):
                at, idx, x, t = columns[0][i].as_py(), *(np.asarray(c[i].values) for c in columns[1:])
                if len(idx) < len(t) or not len(t):
                    continue
                whole = (idx[len(t) - 1 :] - idx[: len(idx) - len(t) + 1] == len(t) - 1) & (idx[: len(idx) - len(t) + 1] // block == at)
                if whole.any():
                    places.append(idx[: len(whole)][whole])
                    values.append(window_correlations(x, t, demean, normalize)[whole])
                    sizes.append(_window_sums(np.abs(x), len(t))[whole] / len(t))
                    rows.append(np.full(len(places[-1]), i))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            take = pa.array(join(rows, np.int64))
            named = {c: batch.column(c).take(take) for c in (*labels, *keys)}
            yield pa.record_batch(named | {IDX: pa.array(join(places, np.int64)), "cc": pa.array(join(values, float)), "amplitude": pa.array(join(sizes, float))})

    return run


def correlate_templates(samples: DataFrame, templates: DataFrame, keys: list[str], labels: list[str], demean: bool = True, normalize: bool = True, block: int = BLOCK, length: int | None = None) -> DataFrame:
    """(labels, keys, idx, cc, amplitude): each full window of a channel against each template of that channel.

    samples: (keys, idx, x) with double x; templates: (labels, keys, k, t). Windows over a gap are left out; amplitude is the
    mean absolute value of the window. With a ``length``, templates of another length are left out; without, the longest is looked for.
    """
    arrays = templates.groupBy(*labels, *keys).agg(F.array_sort(F.collect_list(F.struct("k", F.col("t").cast("double").alias("t")))).alias("_s"))
    arrays = arrays.select(*labels, *keys, F.col("_s.t").alias("_t"))
    arrays = arrays if length is None else arrays.where(F.size("_t") == length)
    longest = length or arrays.agg(F.max(F.size("_t"))).first()[0] or 1
    blocks = sample_blocks(samples.withColumn(IDX, F.col(IDX).cast("long")).withColumn(X, F.col(X).cast("double")), keys, 0, longest - 1, max(block, longest))
    joined = blocks.join(arrays, keys)
    types = dict(joined.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*labels, *keys)) + f", {IDX} long, cc double, amplitude double"
    return joined.mapInArrow(_correlated(keys, labels, demean, normalize, max(block, longest)), schema)


def stream_correlations(samples: DataFrame, templates: DataFrame, demean: bool = True, normalize: bool = True) -> DataFrame:
    """(template, stream, channel, idx, cc, amplitude, channels): idx is where the template as a whole would start.

    samples: (stream, channel, idx, x); templates: (template, channel, k, t), k on one grid for all channels of a template, so
    that a channel may start later than others. Only channels that both have count, ``channels`` of them.
    """
    firsts = templates.groupBy("template", "channel").agg(F.min("k").alias("_first"))
    met = samples.select("stream", "channel").distinct().join(firsts, "channel")
    starts = met.groupBy("template", "stream").agg(F.min("_first").alias("_start"), F.count("*").alias("channels"))
    late = met.join(starts, ["template", "stream"]).select("template", "stream", "channel", (F.col("_first") - F.col("_start")).alias("_late"), "channels")
    held = templates.join(late, ["template", "channel"]).select("template", "stream", "channel", "k", "t")
    cc = correlate_templates(samples.select("stream", "channel", IDX, X), held, ["stream", "channel"], ["template"], demean, normalize)
    cc = cc.join(late, ["template", "stream", "channel"])
    return cc.select("template", "stream", "channel", (F.col(IDX) - F.col("_late")).alias(IDX), "cc", "amplitude", "channels")


def similarities(correlations: DataFrame) -> DataFrame:
    """(template, stream, idx, similarity, amplitude, values): means over the channels, where all of them have a window; values by channel."""
    entry = F.struct("channel", "cc")
    found = correlations.groupBy("template", "stream", IDX).agg(
        F.avg("cc").alias("similarity"), F.avg("amplitude").alias("amplitude"), F.map_from_entries(F.collect_list(entry)).alias("values"), F.count("*").alias("_n"), F.max("channels").alias("_channels")
    )
    return found.where(F.col("_n") == F.col("_channels")).drop("_n", "_channels")


def _thinned(keys: list[str], reach: int, span: int, halo: int, schema: str):
    """Marks the rows of a range that stay (_stays true or false), or whose answer may lie outside of it (null)."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[-1].as_py()
        at, score = rows.column("_at").to_numpy(), rows.column("_score").to_numpy()
        low = block * span - halo
        high = (block + 1) * span + halo
        order = np.argsort(at, kind="stable")
        at, score = at[order], score[order]
        ties = np.asarray(rows.column("_tie").combine_chunks().flatten()).reshape(len(at), -1)[order]
        a, b = np.searchsorted(at, at - reach, "left"), np.searchsorted(at, at + reach, "right")
        state = np.zeros(len(at), np.int8)  # 1 stays, 2 goes, 3 unknown
        for i in np.lexsort((*ties.T[::-1], -score)):
            near = state[a[i] : b[i]]
            if (near == 1).any():
                state[i] = 2
            elif (near == 3).any() or at[i] - reach < low and low > 0 or at[i] + reach >= high:
                state[i] = 3
            else:
                state[i] = 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        state = state[back]
        return rows.append_column("_stays", pa.array([None if v == 3 else bool(v == 1) for v in state], pa.bool_())).filter(rows.column("_own")).select([c.split()[0] for c in schema.split(", ")])

    return work


def thin(peaks: DataFrame, keys: list[str], score: str, reach: int, *ties: Column) -> DataFrame:
    """The rows that a greedy pass from the highest score down keeps: none within ``reach`` samples (of idx, from 0) of one kept before.

    Ranges of samples are passed apart, with a margin of ``REACHES`` distances; where a chain of close rows goes on beyond it, all is
    done again with twice the margin, so the result is that of one pass over everything. Of equal scores the one with the least ``ties`` is first.
    """
    columns = peaks.columns
    rows = peaks.withColumns({"_at": F.col(IDX).cast("long"), "_score": F.col(score).cast("double"), "_tie": F.array(*[t.cast("long") for t in ties])})
    halo = REACHES * max(reach, 1)
    while True:
        span = max(BLOCK, 2 * halo)
        wide = with_halo(rows, halo, halo, span)
        types = dict(wide.dtypes)
        schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", _stays boolean"
        marked = wide.groupBy(*keys, "_block").applyInArrow(_thinned(keys, reach, span, halo, schema), schema)
        marked = written(marked)
        if not marked.where("_stays IS NULL").limit(1).count():
            return marked.where("_stays").select(*columns)
        halo *= 2


def local_maxima(df: DataFrame, keys: list[str], column: str, height: DataFrame | float) -> DataFrame:
    """Rows higher than both their neighbours in idx, and at least ``height``: a number, or a table (template, height)."""
    halo = with_halo(df, 1, 1)
    order = Window.partitionBy(*keys, "_block").orderBy(IDX)
    beside = lambda shift: F.when(shift(IDX).over(order) == F.col(IDX) + (1 if shift is F.lead else -1), shift(column).over(order))
    marked = halo.withColumns({"_before": beside(F.lag), "_next": beside(F.lead)}).where("_own")
    peaks = marked.where((F.col(column) > F.col("_before")) & (F.col(column) > F.col("_next"))).drop("_before", "_next", "_own", "_block")
    if isinstance(height, DataFrame):
        return peaks.join(height, "template").where(F.col(column) >= F.col("height")).drop("height")
    return peaks.where(F.col(column) >= height)


def detect(samples: DataFrame, templates: DataFrame, heights: DataFrame | float, distance: int, magnitudes: DataFrame | None = None, demean: bool = True, normalize: bool = True) -> DataFrame:
    """(stream, template, idx, similarity, amplitude_ratio, values[, magnitude]): where streams look like templates.

    Local maxima of the mean correlation of each template are thinned from the highest down, so that those of one template lie
    ``distance`` samples apart or more, and those of all templates of a stream more than that. The ratio is that of mean
    amplitudes; magnitudes: (template, magnitude), to which 4 / 3 of the ratio's logarithm is added. Plateaus have no maximum.
    """
    similar = similarities(stream_correlations(samples, templates, demean, normalize))
    peaks = local_maxima(similar, ["template", "stream"], "similarity", heights)
    peaks = thin(peaks, ["template", "stream"], "similarity", distance - 1, -F.col(IDX))
    kept = thin(peaks, ["stream"], "similarity", distance, F.col("template"), F.col(IDX))
    own = templates.groupBy("template", "channel").agg(F.avg(F.abs("t")).alias("_a")).groupBy("template").agg(F.avg("_a").alias("_reference"))
    out = kept.join(own, "template").withColumn("amplitude_ratio", F.try_divide("amplitude", "_reference")).drop("_reference", "amplitude")
    if magnitudes is None:
        return out
    added = F.when(F.col("amplitude_ratio") > 0, 4 / 3 * F.log10("amplitude_ratio"))
    return out.join(magnitudes, "template", "left").withColumn("magnitude", F.col("magnitude") + added)


def lagged_products(samples: DataFrame, others: DataFrame, shift: int, block: int = BLOCK) -> DataFrame:
    """(trace, lag, product): sums of x[i + lag] y[i] of two traces on one grid, for lags -shift to shift.

    Blocks of the second trace meet those of the first with ``shift`` samples around; each gives one row per lag, which Spark adds.
    """
    size = max(block, 2 * shift)
    one = sample_blocks(samples, ["trace"], shift, shift, size)
    two = sample_blocks(others, ["trace"], 0, 0, size).select("trace", "_block", F.col("_idx").alias("_jdx"), F.col("_x").alias("_y"))
    joined = one.join(two, ["trace", "_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i in range(batch.num_rows):
                idx, x, jdx, y = (np.asarray(batch.column(c)[i].values) for c in ("_idx", "_x", "_jdx", "_y"))
                first = jdx[0] - shift
                wide, held = np.zeros(jdx[-1] - jdx[0] + 1 + 2 * shift), np.zeros(jdx[-1] - jdx[0] + 1)
                inside = (idx >= first) & (idx - first < len(wide))
                wide[idx[inside] - first] = x[inside]
                held[jdx - jdx[0]] = y
                parts.append(_products(wide, held))
            rows = np.repeat(np.arange(len(parts)), 2 * shift + 1)
            yield pa.record_batch({"trace": batch.column("trace").take(pa.array(rows)), "lag": pa.array(np.tile(np.arange(-shift, shift + 1), len(parts))), "product": pa.array(np.concatenate(parts) if parts else np.zeros(0))})

    return joined.mapInArrow(run, f"trace {dict(joined.dtypes)['trace']}, lag long, product double").groupBy("trace", "lag").agg(F.sum("product").alias("product"))


def correlate_components(samples: DataFrame, others: DataFrame, shift: int, normalize: bool = True, block: int = BLOCK) -> DataFrame:
    """(trace, lag, cc): demeaned correlation of (trace, component, idx, x) with others', added over components and divided by their number.

    A component without energy in one of both gives 0; only components that both have count.
    """
    key = F.struct("trace", "component")

    def centred(df: DataFrame) -> DataFrame:
        means = df.groupBy("trace", "component").agg(F.avg(X).alias("_m"))
        return df.join(means, ["trace", "component"]).select(key.alias("trace"), IDX, (F.col(X) - F.col("_m")).alias(X))

    a, b = centred(samples), centred(others)
    energy = lambda df, name: df.groupBy("trace").agg(F.sum(F.col(X) * F.col(X)).alias(name))
    norms = energy(a, "_a").join(energy(b, "_b"), "trace")
    cc = lagged_products(a, b, shift, block).join(norms, "trace")
    norm = F.sqrt(F.col("_a") * F.col("_b"))
    value = F.when(norm > 1e-12, F.col("product") / norm).otherwise(0.0) if normalize else F.col("product")
    return cc.select(F.col("trace.trace").alias("trace"), "lag", value.alias("_v")).groupBy("trace", "lag").agg(F.avg("_v").alias("cc"))


def lag_peak(correlations: DataFrame, absolute: bool = True) -> DataFrame:
    """(trace, shift, value): the lag of the largest (absolute) value, the first of equal ones."""
    size = F.abs("cc") if absolute else F.col("cc")
    best = F.max(F.struct(size.alias("size"), (-F.col("lag")).alias("first"), F.col("cc").alias("value")))
    return correlations.groupBy("trace").agg(best.alias("b")).select("trace", (-F.col("b.first")).alias("shift"), F.col("b.value").alias("value"))


def max_similarity(triggers: DataFrame, samples: DataFrame, templates: DataFrame, block: int = BLOCK) -> DataFrame:
    """(trigger, similarity): the greatest likeness of the samples around each trigger to a template of its station.

    triggers: (trigger, station, at); samples: (station, channel, idx, x); templates: (template, station, channel, k, t), the
    channels of a template equally long, n samples. From half of n - 1 before a trigger to one and a half after it, the channels
    that template and station share are standardised and correlated; at the shift of the largest sum, the likeness is the mean
    correlation coefficient of the channels. A trigger without such a template or window has none; windows are one row each.
    """
    sizes = templates.groupBy("template", "station", "channel").agg(F.array_sort(F.collect_list(F.struct("k", F.col("t").cast("double").alias("t")))).alias("_s"))
    sizes = sizes.select("template", "station", "channel", F.col("_s.t").alias("_t"), F.size("_s").alias("_n"))
    spans = sizes.groupBy("station").agg(F.max("_n").alias("_longest"))
    reach = (F.col("_longest") * 1.5).cast("long") + 1
    # samples meet the blocks that a trigger's window touches
    near = triggers.join(spans, "station").withColumn("_block", F.explode(F.sequence(F.floor((F.col("at") - reach) / block), F.floor((F.col("at") + reach) / block))))
    held = samples.withColumn("_block", F.floor(F.col(IDX) / block)).join(near, ["station", "_block"]).where(F.abs(F.col(IDX) - F.col("at")) <= reach)
    windows = held.groupBy("trigger", "station", "at", "channel").agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(X).cast("double").alias(X)))).alias("_s"))
    pairs = windows.join(sizes, ["station", "channel"]).groupBy("trigger", "template").agg(F.first("at").alias("at"), F.array_sort(F.collect_list(F.struct("channel", F.col(f"_s.{IDX}").alias("i"), F.col(f"_s.{X}").alias("x"), F.col("_t").alias("t")))).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, channels in zip(batch.column("at").to_pylist(), batch.column("_c").to_pylist(), strict=True):
                found.append(_likeness(at, [(np.array(c["i"]), np.array(c["x"]), np.array(c["t"])) for c in channels]))
            yield pa.record_batch({"trigger": batch.column("trigger"), "similarity": pa.array(found, pa.float64())})

    out = pairs.mapInArrow(run, f"trigger {dict(pairs.dtypes)['trigger']}, similarity double")
    return out.where("similarity IS NOT NULL").groupBy("trigger").agg(F.max("similarity").alias("similarity"))


def _likeness(at: int, channels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> float | None:
    total, cut = None, []
    duration = len(channels[0][2]) - 1
    for idx, x, t in channels:
        inside = (idx >= at - duration * 0.5) & (idx <= at + duration * 1.5)
        x = x[inside]
        short, long = (t, x) if len(x) > len(t) else (x, t)
        if not len(short) or short.std() == 0 or long.std() == 0 or inside.any() and idx[inside][-1] - idx[inside][0] + 1 != len(x):
            return None
        products = np.correlate((long - long.mean()) / long.std(), (short - short.mean()) / short.std(), "valid")
        if total is not None and len(total) != len(products):
            return None
        total = products if total is None else total + products
        cut.append((short, long))
    best = int(total.argmax())
    parts = [long[best : best + len(short)] for short, long in cut]
    if any(p.std() == 0 for p in parts):
        return None
    return float(np.mean([np.corrcoef(short, part)[0, 1] for (short, _), part in zip(cut, parts, strict=True)]))


def correct_picks(pairs: DataFrame, samples: DataFrame, before: int, after: int, lag: int) -> DataFrame:
    """(pair, correction, coefficient): how many samples to move the second pick of each pair so that both waveforms agree.

    pairs: (pair, one, pick_one, two, pick_two), picks in samples of the traces one and two. The samples from ``before`` to ``after`` a
    pick, half of ``lag`` more on both sides, are correlated for shifts up to ``lag``. Around the largest value, the places where the
    correlation is bent downwards are fitted by a parabola, whose vertex gives the shift and the coefficient. Pairs whose windows are
    not whole, or with fewer than three places to fit, have none.
    """
    from .correlation import correlate

    half = lag / 2
    sides = [pairs.select("pair", F.lit(k).alias("_side"), F.col(t).alias("trace"), F.col(p).alias("_pick")) for k, t, p in ((0, "one", "pick_one"), (1, "two", "pick_two"))]
    asked = sides[0].union(sides[1]).withColumn("_block", F.explode(F.sequence(F.floor((F.col("_pick") - before - half) / BLOCK), F.floor((F.col("_pick") + after + half) / BLOCK))))
    held = samples.withColumn("_block", F.floor(F.col(IDX) / BLOCK)).join(asked, ["trace", "_block"]).where(F.col(IDX).between(F.col("_pick") - before - half, F.col("_pick") + after + half))
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == k, F.struct(IDX, F.col(X).cast("double").alias(X))))), lambda r: r[X])
    both = held.groupBy("pair").agg(side(0).alias("a"), side(1).alias("b"))
    whole = int(np.floor(after + half) - np.ceil(-before - half)) + 1
    both = both.where((F.size("a") == whole) & (F.size("b") == whole))
    rows = both.select("pair", F.posexplode(correlate(F.col("a"), F.col("b"), lag, demean=True)).alias("_p", "_c"))
    order, all_ = Window.partitionBy("pair").orderBy("_p"), Window.partitionBy("pair")
    bend = F.coalesce(F.lead("_c").over(order) - 2 * F.col("_c") + F.lag("_c").over(order), F.lit(0.0))
    peak = F.max(F.struct("_c", (-F.col("_p")).alias("p"))).over(all_)
    bent = rows.withColumns({"_bend": bend, "_peak": -peak["p"]})
    low = F.max(F.when((F.col("_bend") > 0) & (F.col("_p") < F.col("_peak")), F.col("_p"))).over(all_)
    high = F.min(F.when((F.col("_bend") > 0) & (F.col("_p") > F.col("_peak")), F.col("_p"))).over(all_)
    near = bent.withColumns({"_low": low, "_high": high}).where((F.col("_low").isNull() | (F.col("_p") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_p") < F.col("_high"))))
    t = near.withColumn("_t", F.col("_p") - lag - F.avg(F.col("_p") - lag).over(all_)).withColumn("_mean", F.avg(F.col("_p") - lag).over(all_))
    power = lambda k: F.sum(F.pow("_t", F.lit(k)))
    sums = t.groupBy("pair").agg(F.count("*").alias("n"), F.first("_mean").alias("m"), power(2).alias("s2"), power(3).alias("s3"), power(4).alias("s4"), F.avg("_c").alias("y"), F.sum(F.col("_c") * F.col("_t")).alias("yt"), F.sum(F.col("_c") * F.col("_t") * F.col("_t")).alias("ytt"))
    fit = sums.where("n >= 3").withColumn("q", F.col("ytt") - F.col("s3") / F.col("s2") * F.col("yt") - F.col("s2") * F.col("y"))
    fit = fit.withColumn("a", F.try_divide("q", F.col("s4") - F.col("s3") * F.col("s3") / F.col("s2") - F.col("s2") * F.col("s2") / F.col("n")))
    fit = fit.withColumn("b", F.col("yt") / F.col("s2") - F.col("a") * F.col("s3") / F.col("s2"))
    vertex = F.try_divide(-F.col("b"), 2 * F.col("a"))
    return fit.select("pair", (-(F.col("m") + vertex)).alias("correction"), (F.col("y") - F.col("a") * F.col("s2") / F.col("n") + F.col("b") * vertex / 2).alias("coefficient"))
