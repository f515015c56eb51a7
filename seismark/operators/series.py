"""Operators on the long layout: one row per sample, with a trace key, a sample number and a value.

Moving operators work on blocks of a trace with a halo of neighbours, so a single long trace is spread over many tasks;
operators that need a whole trace's figure take it from a pre-aggregated table that is joined back.
"""

from __future__ import annotations

from math import ceil, log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
TRACE, IDX, X = "trace", "idx", "x"


def with_halo(df: DataFrame, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Each row in its own block and in those that need it as a neighbour; ``_own`` tells which."""
    own = F.floor(F.col(IDX) / block)
    first, last = F.floor((F.col(IDX) - after) / block), F.floor((F.col(IDX) + before) / block)
    return df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("_own", F.col("_block") == own)


def _rows(low: int, high: int):
    return Window.partitionBy(TRACE, "_block").orderBy(IDX).rowsBetween(low, high)


def _done(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.where("_own").select(*keep)


def moving(df: DataFrame, before: int, after: int, **columns: Column) -> DataFrame:
    """Adds columns made from window expressions over rows [-before, after]; each value is a function of a window."""
    halo = with_halo(df, before, after)
    for name, make in columns.items():
        halo = halo.withColumn(name, make(_rows))
    return _done(halo, [*df.columns, *columns])


def classic_sta_lta(df: DataFrame, nsta: int, nlta: int) -> DataFrame:
    """Ratio of the mean squares over the last nsta and nlta samples; 0 for the first nlta - 1 and where the longer mean is 0."""
    square = F.col(X) * F.col(X)
    ratio = lambda rows: F.when(F.col(IDX) >= nlta - 1, F.coalesce(F.try_divide(F.avg(square).over(rows(1 - nsta, 0)), F.avg(square).over(rows(1 - nlta, 0))), F.lit(0.0))).otherwise(0.0)
    return moving(df, nlta - 1, 0, cft=ratio)


#: Samples of a step of the recursion, and the share of an old state that no longer counts.
STEPS, FORGOTTEN = 64, 1e-18


def exponential_means(df: DataFrame, value: Column, **weights: float) -> DataFrame:
    """y[i] = c value[i] + (1 - c) y[i - 1], with y[0] = 0, for each weight c.

    A recursion of this kind is a sum of decayed values: one within groups of ``STEPS`` samples, whose terms are scaled to
    the group's start, plus the decayed ends of the groups before, back to where less than ``FORGOTTEN`` of them is left.
    """
    kept = df.withColumn("_group", F.floor(F.col(IDX) / STEPS)).withColumn("_at", F.col(IDX) % STEPS).withColumn("_v", F.when(F.col(IDX) == 0, F.lit(0.0)).otherwise(value))
    inside = Window.partitionBy(TRACE, "_group").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)

    def within(c: float) -> Column:
        return F.col("_v") if c >= 1 else F.pow(F.lit(1 - c), F.col("_at")) * F.sum(c * F.col("_v") * F.pow(F.lit(1 - c), -F.col("_at"))).over(inside)

    kept = kept.withColumns({f"_in_{name}": within(c) for name, c in weights.items()})
    ends = kept.groupBy(TRACE, F.col("_group").alias(IDX)).agg(*[F.max_by(f"_in_{name}", "_at").alias(f"_end_{name}") for name in weights])
    for name, c in weights.items():
        back = max(1, ceil(log(FORGOTTEN) / (STEPS * log(1 - c)))) if c < 1 else 1
        decay = [(1 - c) ** (STEPS * j) for j in range(back)]

        def carried(rows, name=name, back=back, decay=decay) -> Column:
            listed = F.reverse(F.collect_list(f"_end_{name}").over(rows(-back, -1)))
            return F.aggregate(F.zip_with(listed, F.array(*[F.lit(x) for x in decay]), lambda x, w: F.coalesce(x * w, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)

        ends = moving(ends, back, 0, **{f"_carry_{name}": carried})
    carries = ends.select(TRACE, F.col(IDX).alias("_group"), *[f"_carry_{name}" for name in weights])
    out = kept.join(carries, [TRACE, "_group"])
    out = out.withColumns({name: F.col(f"_in_{name}") + F.col(f"_carry_{name}") * F.pow(F.lit(1 - c), F.col("_at") + 1) for name, c in weights.items()})
    return out.select(*df.columns, *weights)


def recursive_sta_lta(df: DataFrame, nsta: int, nlta: int) -> DataFrame:
    """Ratio of two exponential means of the squares, from the second sample on; 0 for the first nlta samples."""
    means = exponential_means(df, F.col(X) * F.col(X), _sta=1.0 / nsta, _lta=1.0 / nlta)
    lta = F.col("_lta") + 1e-99 * F.pow(F.lit(1 - 1.0 / nlta), F.col(IDX))
    return means.select(TRACE, IDX, F.when(F.col(IDX) < nlta, F.lit(0.0)).otherwise(F.col("_sta") / lta).alias("cft"))


def z_detect(df: DataFrame, nsta: int) -> DataFrame:
    """Energy of the nsta samples before, standardised over the trace."""
    energy = lambda rows: F.when(F.col(IDX) >= nsta, F.sum(F.col(X) * F.col(X)).over(rows(-nsta, -1))).otherwise(0.0)
    out = moving(df, nsta, 0, energy=energy)
    figures = out.groupBy(TRACE).agg(F.avg("energy").alias("_mean"), F.stddev_pop("energy").alias("_std"))
    return out.join(figures, TRACE).withColumn("cft", F.when(F.col("_std") > 0, (F.col("energy") - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std", "energy")


def energy_ratio(df: DataFrame, nsta: int) -> DataFrame:
    """Energy of the next nsta samples (this one first) over that of the nsta before; 0 at edges."""
    square = F.col(X) * F.col(X)

    def ratio(rows) -> Column:
        before, after = F.sum(square).over(rows(-nsta, -1)), F.sum(square).over(rows(0, nsta - 1))
        whole = (F.count("*").over(rows(-nsta, -1)) == nsta) & (F.count("*").over(rows(0, nsta - 1)) == nsta)
        return F.when(whole & (before > 0), after / before).otherwise(0.0)

    return moving(df, nsta, nsta - 1, cft=ratio)


def modified_energy_ratio(df: DataFrame, nsta: int, power: float = 3) -> DataFrame:
    return energy_ratio(df, nsta).withColumn("cft", F.pow(F.col("cft") * F.abs(X), F.lit(power)))


def aic_simple(df: DataFrame) -> DataFrame:
    """(i + 1) log var(x[0..i]) + (n - i - 2) log var(x[i+1..]) from running sums."""
    square = F.col(X) * F.col(X)
    totals = df.groupBy(TRACE).agg(F.count("*").alias("_n"), F.sum(X).alias("_total"), F.sum(square).alias("_squares"))
    out = running(df, _s=F.col(X), _q=square).join(totals, TRACE)
    k, m = F.col(IDX) + 1, F.col("_n") - F.col(IDX) - 1
    left = F.col("_q") / k - F.pow(F.col("_s") / k, 2)
    right = (F.col("_squares") - F.col("_q")) / m - F.pow((F.col("_total") - F.col("_s")) / m, 2)
    value = k * F.log(left) + (m - 1) * F.log(right)
    return out.withColumn("cft", F.when((F.col(IDX) >= 1) & (m >= 2) & (left > 1e-9) & (right > 1e-9), value)).drop("_n", "_s", "_q", "_total", "_squares")


def _runs(high: DataFrame) -> DataFrame:
    """(trace, _first, _last): maximal runs of consecutive samples; runs are found in blocks and joined at their edges."""
    order = Window.partitionBy(TRACE, "_block").orderBy(IDX)
    blocked = high.select(TRACE, IDX).withColumn("_block", F.floor(F.col(IDX) / BLOCK))
    parts = blocked.withColumn("_run", F.col(IDX) - F.row_number().over(order)).groupBy(TRACE, "_block", "_run").agg(F.min(IDX).alias("_a"), F.max(IDX).alias("_z"))
    along = Window.partitionBy(TRACE).orderBy("_a")
    fresh = F.when(F.col("_a") == F.lag("_z").over(along) + 1, 0).otherwise(1)
    joined = parts.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(TRACE, "_run").agg(F.min("_a").alias("_first"), F.max("_z").alias("_last")).drop("_run")


def trigger_onset(df: DataFrame, on: float, off: float, max_len: int | None = None, max_len_delete: bool = False) -> DataFrame:
    """(trace, on_idx, off_idx): a trigger starts where cft first reaches ``on`` and lasts while cft is at least ``off``.

    Runs of cft >= off are found first; in each, starts are the first samples of runs of cft >= on. Without ``max_len`` a run
    counts once, from its first start. With it, a trigger of more than ``max_len`` samples after its start ends there and the
    next start beyond may trigger again; with ``max_len_delete`` it is dropped and the next start is tried.
    """
    low = _runs(df.where(F.col("cft") >= off)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_first") / BLOCK), F.floor(F.col("_last") / BLOCK))))
    starts = _runs(df.where(F.col("cft") >= on)).select(TRACE, F.col("_first").alias("_on"), F.floor(F.col("_first") / BLOCK).alias("_bucket"))
    hit = starts.join(low, [TRACE, "_bucket"]).where(F.col("_on").between(F.col("_first"), F.col("_last")))
    if max_len is None:
        return hit.groupBy(TRACE, F.col("_last").alias("off_idx")).agg(F.min("_on").alias("on_idx")).select(TRACE, "on_idx", "off_idx")
    if max_len_delete:
        short = hit.where(F.col("_last") - F.col("_on") <= max_len)
        return short.groupBy(TRACE, F.col("_last").alias("off_idx")).agg(F.min("_on").alias("on_idx")).select(TRACE, "on_idx", "off_idx")
    listed = hit.groupBy(TRACE, "_last").agg(F.array_sort(F.collect_list("_on")).alias("_starts"))
    # starts that lie within max_len of the last one taken are skipped
    taken = F.aggregate("_starts", F.array().cast("array<bigint>"), lambda done, s: F.when((F.size(done) == 0) | (s > F.get(done, F.size(done) - 1) + max_len), F.concat(done, F.array(s))).otherwise(done))
    return listed.select(TRACE, F.explode(taken).alias("on_idx"), "_last").select(TRACE, "on_idx", F.least("_last", F.col("on_idx") + max_len).alias("off_idx"))


#: Triggers that a range of time should hold.
RANGE_ROWS = 100_000


def _chains(triggers: DataFrame) -> DataFrame:
    """Triggers (_a, _z, ...) with ``_chain``: the start of their run of triggers that overlap or meet.

    Triggers are dealt to ranges of start time, as many as their number asks for. The greatest end before a range and the
    last chain that was open there come from one row per range, so no task sees all triggers.
    """
    edges = triggers.agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"), F.ceil(F.count("*") / RANGE_ROWS).alias("_n"))
    edges = edges.select("_lo", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.greatest(F.col("_n"), F.lit(1)))).alias("_width"))
    dealt = triggers.crossJoin(F.broadcast(edges)).withColumn("_range", F.floor((F.col("_a") - F.col("_lo")) / F.col("_width"))).drop("_lo", "_width")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_range").agg(F.max("_z").alias("_last")).select("_range", F.max("_last").over(before).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_a", "_z", "_s")
    reach = F.greatest(F.col("_before"), F.max("_z").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    out = dealt.join(carried, "_range").withColumn("_reach", reach)
    out = out.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("_a") > F.col("_reach")), F.col("_a")))
    opened = out.groupBy("_range").agg(F.max("_opens").alias("_open")).select("_range", F.max("_open").over(before).alias("_open"))
    chain = F.coalesce(F.max("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    return out.join(opened, "_range").withColumn("_chain", chain).select(*triggers.columns, "_chain")


def coincidences(triggers: DataFrame, start: str, end: str, station: str, least: int) -> DataFrame:
    """Groups of overlapping triggers with at least ``least`` distinct stations."""
    rows = triggers.select(F.col(start).alias("_a"), F.col(end).alias("_z"), F.col(station).alias("_s"))
    found = _chains(rows).groupBy("_chain").agg(F.min("_a").alias("start"), F.max("_z").alias("end"), F.countDistinct("_s").alias("stations"), F.count("*").alias("triggers"))
    return found.where(F.col("stations") >= least).drop("_chain")


def demean(df: DataFrame) -> DataFrame:
    mean = df.groupBy(TRACE).agg(F.avg(X).alias("_mean"))
    return df.join(mean, TRACE).withColumn("y", F.col(X) - F.col("_mean")).drop("_mean")


def detrend_simple(df: DataFrame) -> DataFrame:
    """Minus the line through the first and the last sample."""
    ends = df.groupBy(TRACE).agg(F.min_by(X, IDX).alias("_first"), F.max_by(X, IDX).alias("_last"), F.max(IDX).alias("_n"))
    line = F.col("_first") + F.when(F.col("_n") > 0, F.col(IDX) * (F.col("_last") - F.col("_first")) / F.col("_n")).otherwise(0.0)
    return df.join(ends, TRACE).withColumn("y", F.col(X) - line).drop("_first", "_last", "_n")


def detrend_linear(df: DataFrame) -> DataFrame:
    """Minus the least-squares line."""
    line = df.groupBy(TRACE).agg(F.regr_slope(X, F.col(IDX).cast("double")).alias("_slope"), F.regr_intercept(X, F.col(IDX).cast("double")).alias("_at"), F.avg(X).alias("_mean"))
    fit = F.coalesce(F.col("_at") + F.col("_slope") * F.col(IDX), F.col("_mean"))
    return df.join(line, TRACE).withColumn("y", F.col(X) - fit).drop("_slope", "_at", "_mean")


def detrend_polynomial(df: DataFrame, order: int) -> DataFrame:
    """Minus the least-squares polynomial; traces of at most ``order`` + 1 samples become 0.

    Polynomials that are orthogonal on n even places follow from a three-term recurrence in n alone, so each coefficient is
    one quotient of sums and all of them come from one aggregation.
    """
    sizes = df.groupBy(TRACE).agg(F.count("*").cast("double").alias("_n"))
    sized = df.join(sizes, TRACE).withColumn("_u", (2 * F.col(IDX) - F.col("_n") + 1) / F.col("_n"))
    terms = [F.lit(1.0), F.col("_u")]
    for k in range(1, order):
        terms.append(F.col("_u") * terms[k] - k * k * (1 - k * k / (F.col("_n") * F.col("_n"))) / (4 * k * k - 1) * terms[k - 1])
    terms = terms[: order + 1]
    sums = sized.groupBy(TRACE).agg(*[(F.sum(F.col(X) * p) / F.nullif(F.sum(p * p), F.lit(0.0))).alias(f"_k{i}") for i, p in enumerate(terms)])
    fit = sum((F.col(f"_k{i}") * p for i, p in enumerate(terms)), F.lit(0.0))
    out = sized.join(sums, TRACE).withColumn("y", F.when(F.col("_n") <= order + 1, F.lit(0.0)).otherwise(F.col(X) - fit))
    return out.select(*df.columns, "y")


def peak_motion(df: DataFrame, dt: float = 1.0) -> DataFrame:
    """Largest absolute acceleration, velocity and displacement of traces of acceleration."""
    velocity = integrate(df, dt).withColumnRenamed("y", "_v")
    motion = integrate(velocity.select(TRACE, IDX, F.col(X).alias("_a"), F.col("_v").alias(X)), dt)
    return motion.groupBy(TRACE).agg(F.max(F.abs("_a")).alias("acceleration"), F.max(F.abs(X)).alias("velocity"), F.max(F.abs("y")).alias("displacement"))


def normalize(df: DataFrame, over_all: bool = False) -> DataFrame:
    """Divided by the trace's (or all traces') largest absolute value; zeros stay."""
    norm = df.agg(F.max(F.abs(X)).alias("_norm")) if over_all else df.groupBy(TRACE).agg(F.max(F.abs(X)).alias("_norm"))
    joined = df.crossJoin(F.broadcast(norm)) if over_all else df.join(norm, TRACE)
    return joined.withColumn("y", F.when(F.col("_norm") > 0, F.col(X) / F.col("_norm")).otherwise(F.col(X))).drop("_norm")


def running(df: DataFrame, **columns: Column) -> DataFrame:
    """Running sums over each trace: within blocks, plus the sums of the blocks before, which are one row per block."""
    blocked = df.withColumn("_block", F.floor(F.col(IDX) / BLOCK))
    sums = blocked.groupBy(TRACE, "_block").agg(*[F.sum(x).alias(f"_sum_{c}") for c, x in columns.items()])
    earlier = Window.partitionBy(TRACE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(TRACE, "_block", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0.0)).alias(f"_base_{c}") for c in columns])
    inside = Window.partitionBy(TRACE, "_block").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(base, [TRACE, "_block"]).withColumns({c: F.col(f"_base_{c}") + F.sum(x).over(inside) for c, x in columns.items()})
    return out.drop("_block", *[f"_base_{c}" for c in columns])


def differentiate(df: DataFrame, dt: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the ends; null for a single sample."""

    def slope(rows) -> Column:
        back, ahead = F.first(X).over(rows(-1, 0)), F.last(X).over(rows(0, 1))
        return (ahead - back) / ((F.count("*").over(rows(-1, 1)) - 1) * dt)

    return moving(df, 1, 1, y=lambda rows: F.when(F.count("*").over(rows(-1, 1)) > 1, slope(rows)))


def integrate(df: DataFrame, dt: float = 1.0) -> DataFrame:
    """Cumulative trapezoids, 0 first: running sums within blocks, plus the sum of the blocks before."""
    steps = moving(df, 1, 0, _step=lambda rows: F.when(F.col(IDX) > 0, (F.col(X) + F.first(X).over(rows(-1, 0))) * dt / 2).otherwise(0.0))
    return running(steps, y=F.col("_step")).drop("_step")


def smooth(df: DataFrame, k: int) -> DataFrame:
    """Mean of k past and k future samples without the one itself; edges repeat the nearest full value, null if there is none."""
    around = lambda rows: F.when(F.count("*").over(rows(-k, k)) == 2 * k + 1, (F.sum(X).over(rows(-k, -1)) + F.sum(X).over(rows(1, k))) / (2 * k))
    nearest = lambda rows: F.coalesce("_full", F.first("_full", ignorenulls=True).over(rows(1, k)), F.last("_full", ignorenulls=True).over(rows(-k, -1)))
    return moving(moving(df, k, k, _full=around), k, k, y=nearest).drop("_full")


def slide(df: DataFrame, length: int, step: int) -> DataFrame:
    """(window, trace, idx, x): every full window of ``length`` samples that starts at a multiple of ``step``."""
    ends = df.groupBy(TRACE).agg((F.max(IDX) + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col(IDX) - length + 1) / step))
    out = df.join(ends, TRACE).withColumn("window", F.explode(F.when(first <= F.floor(F.col(IDX) / step), F.sequence(first, F.floor(F.col(IDX) / step))).otherwise(F.array().cast("array<bigint>"))))
    return out.where(F.col("window") * step + length <= F.col("_n")).drop("_n")


def preview(df: DataFrame, time: Column, delta: float) -> DataFrame:
    """Peak to peak per aligned bucket of ``delta`` seconds."""
    return df.groupBy(TRACE, F.floor(time / delta).alias("bucket")).agg((F.max(X) - F.min(X)).alias("peak_to_peak"), F.count("*").alias("samples"))


def merge_previews(df: DataFrame) -> DataFrame:
    """(trace, idx, x): the largest value of previews on one grid; places between that no preview has are -1."""
    merged = df.groupBy(TRACE, IDX).agg(F.max(X).alias(X))
    ahead = Window.partitionBy(TRACE).orderBy(IDX)
    width = F.coalesce(F.lead(IDX).over(ahead) - F.col(IDX), F.lit(1))
    spread = merged.withColumn("_width", width).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_width") - 1)))
    return spread.select(TRACE, (F.col(IDX) + F.col("_k")).alias(IDX), F.when(F.col("_k") == 0, F.col(X)).otherwise(-1.0).alias(X))


def resample_preview(df: DataFrame, samples: int, fast: bool = False) -> DataFrame:
    """(trace, k, x): the largest values of ``samples`` windows of a trace, as even as its length allows.

    ``fast`` takes windows of one length and leaves out what remains at the end. Traces that are shorter than ``samples`` have none.
    """
    sizes = df.groupBy(TRACE).agg(F.count("*").alias("_n")).where(F.col("_n") >= samples)
    rows = df.join(sizes, TRACE)
    if fast:
        k = F.floor(F.col(IDX) / F.floor(F.col("_n") / samples))
        return rows.select(TRACE, k.alias("k"), X).where(F.col("k") < samples).groupBy(TRACE, "k").agg(F.max(X).alias(X))
    # window k ends before floor((k + 1) n / samples)
    k = F.ceil((F.col(IDX) + 1) * F.lit(samples) / F.col("_n")) - 1
    return rows.select(TRACE, k.alias("k"), X).groupBy(TRACE, "k").agg(F.max(X).alias(X))


def weighted_line(df: DataFrame, x: str, y: str, weight: str, origin: bool = False) -> DataFrame:
    """(trace, slope, intercept, slope_error, intercept_error) of least squares with weights 1 / sigma, in one aggregation.

    ``origin`` holds the line at the origin. Errors are standard deviations, scaled by what the line leaves; traces without
    a degree of freedom, or all of whose weights are 0, have no line and are left out.
    """
    q = F.col(weight) * F.col(weight)
    sums = df.groupBy(TRACE).agg(
        F.count("*").alias("_n"), *[F.sum(q * v).alias(n) for n, v in {"_w": F.lit(1.0), "_x": F.col(x), "_y": F.col(y), "_xx": F.col(x) * F.col(x), "_xy": F.col(x) * F.col(y), "_yy": F.col(y) * F.col(y)}.items()]
    )
    sums = sums.where("_w > 0")
    if origin:
        slope = F.col("_xy") / F.col("_xx")
        left = (F.col("_yy") - slope * F.col("_xy")) / (F.col("_n") - 1)
        out = sums.where("_n > 1 AND _xx > 0").withColumns({"slope": slope, "intercept": F.lit(0.0), "slope_error": F.sqrt(left / F.col("_xx")), "intercept_error": F.lit(0.0)})
    else:
        spread = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_w")
        shared = F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_w")
        slope = shared / spread
        left = (F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_w") - slope * shared) / (F.col("_n") - 2)
        mean = F.col("_x") / F.col("_w")
        out = sums.where((F.col("_n") > 2) & (spread > 0)).withColumns(
            {"slope": slope, "intercept": F.col("_y") / F.col("_w") - slope * mean, "slope_error": F.sqrt(left / spread), "intercept_error": F.sqrt(left * (1 / F.col("_w") + mean * mean / spread))}
        )
    return out.select(TRACE, "slope", "intercept", "slope_error", "intercept_error")


#: Sums of squared slopes that count as none.
NO_SLOPE = 1e-20


def dominant_period(df: DataFrame, width: int, dt: float = 1.0) -> DataFrame:
    """2 pi times the root of squares over squared slopes, both summed over the last ``width`` samples."""
    slope = moving(df, 1, 0, _v=lambda rows: (F.col(X) - F.first(X).over(rows(-1, 0))) / dt)

    def period(rows) -> Column:
        last = rows(1 - width, 0)
        slopes = F.sum(F.col("_v") * F.col("_v")).over(last)
        return F.when(slopes > NO_SLOPE, 2 * pi * F.sqrt(F.sum(F.col(X) * F.col(X)).over(last) / slopes)).otherwise(0.0)

    return moving(slope, width - 1, 0, y=period).drop("_v")


def moment_integral(df: DataFrame, pick: int, length: int, dt: float, gain: float) -> DataFrame:
    """(trace, idx, y): running sum of what exceeds the value at the pick, from anew at each change of sign, over ``length`` samples.

    Only those samples of a trace take part, so a window per trace is bounded by ``length``.
    """
    after = df.where(F.col(IDX).between(pick, pick + length - 1))
    order = Window.partitionBy(TRACE).orderBy(IDX)
    above = after.withColumn("_a", F.col(X) - F.first(X).over(order)).withColumn("_up", F.col("_a") >= 0)
    turns = above.withColumn("_turn", F.when(F.col("_up") == F.lag("_up").over(order), 0).otherwise(1)).withColumn("_run", F.sum("_turn").over(order))
    total = F.sum("_a").over(Window.partitionBy(TRACE, "_run").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0))
    return turns.select(TRACE, IDX, (total * dt / gain).alias("y"))


# Density, wave speed and the mean radiation of the broadband moment magnitude.
MOMENT_FACTOR = 4 * pi * 3400 * 7900.0**3 * 2 * (10000 / 90) * 1000


def moment_magnitude(peak: Column, degrees: Column) -> Column:
    """Magnitude of the peak of a moment integral at a distance; -9.9 for none."""
    moment = MOMENT_FACTOR * peak * degrees
    return F.when(moment > 0, 2.0 / 3 * (F.log10(moment) - 9.1)).otherwise(-9.9)


def window_sum(df: DataFrame, length: int) -> DataFrame:
    """(trace, idx, y): sums of the full windows that start at a sample."""
    ahead = moving(df, 0, length - 1, y=lambda rows: F.when(F.count("*").over(rows(0, length - 1)) == length, F.sum(X).over(rows(0, length - 1))))
    return ahead.where("y IS NOT NULL").select(TRACE, IDX, "y")


def taper_welch(df: DataFrame) -> DataFrame:
    """Parabolic sides that meet in the middle; the first and the last sample become 0."""
    sizes = df.groupBy(TRACE).agg(F.count("*").cast("double").alias("_n"))
    rise, fall = F.ceil(F.col("_n") / 2), F.floor(F.col("_n") / 2)
    side = F.when(F.col(IDX) < rise, (rise - 1 - F.col(IDX)) / rise).otherwise((F.col(IDX) - rise) / fall)
    edge = (F.col(IDX) == 0) | (F.col(IDX) == F.col("_n") - 1)
    return df.join(sizes, TRACE).withColumn("y", F.when(edge, F.lit(0.0)).otherwise(F.col(X) * (1 - side * side))).drop("_n")


def statistics(df: DataFrame) -> DataFrame:
    """Sample metrics of each trace."""
    part = lambda p: F.percentile(X, p)
    return df.groupBy(TRACE).agg(
        F.count("*").alias("samples"),
        F.min(X).alias("sample_min"),
        F.max(X).alias("sample_max"),
        F.avg(X).alias("sample_mean"),
        part(0.5).alias("sample_median"),
        part(0.25).alias("sample_lower_quartile"),
        part(0.75).alias("sample_upper_quartile"),
        F.sqrt(F.avg(F.col(X) * F.col(X))).alias("sample_rms"),
        F.stddev_pop(X).alias("sample_stdev"),
    )


def carl_sta_trig(df: DataFrame, nsta: int, nlta: int, ratio: float, quiet: float) -> DataFrame:
    """star - ratio ltar - |sta - lta| - quiet; -1 for the first nlta samples.

    sta and star are means of x and of |x - lta| over the nsta samples before, lta and ltar are means of those over nlta
    samples, one sample late; all are 0 where their window is not full.
    """
    before = lambda x, n, late=0: lambda rows: F.when(F.col(IDX) >= n + late, F.avg(x).over(rows(-n - late, -1 - late))).otherwise(0.0)
    out = moving(df, nsta, 0, _sta=before(F.col(X), nsta))
    out = moving(out, nlta + 1, 0, _lta=before(F.col("_sta"), nlta, 1))
    out = moving(out, nsta, 0, _star=before(F.abs(F.col(X) - F.col("_lta")), nsta))
    out = moving(out, nlta + 1, 0, _ltar=before(F.col("_star"), nlta, 1))
    eta = F.col("_star") - ratio * F.col("_ltar") - F.abs(F.col("_sta") - F.col("_lta")) - quiet
    return out.withColumn("cft", F.when(F.col(IDX) < nlta, -1.0).otherwise(eta)).drop("_sta", "_lta", "_star", "_ltar")


def delayed_sta_lta(df: DataFrame, nsta: int, nlta: int) -> DataFrame:
    """Ratio of running sums of each sample's square and a delayed one's; 0 for the first nlta + nsta + 50 samples.

    As in the definition that is matched here, delayed squares are added, and a delay beyond the start wraps to the end: the
    last samples stand before the first as well, so that frames do for all delays. Null where the longer sum is still 0.
    """
    longest = nsta + nlta + 1
    sizes = df.groupBy(TRACE).agg(F.count("*").alias("_n"))
    tail = df.join(sizes, TRACE).where(F.col(IDX) >= F.col("_n") - longest).withColumn(IDX, F.col(IDX) - F.col("_n")).select(*df.columns)
    delayed = lambda k: lambda rows: F.coalesce(F.first(F.col(X) * F.col(X)).over(rows(-k, -k)), F.lit(0.0))
    out = moving(df.union(tail), longest, 0, _a=delayed(nsta), _b=delayed(nsta + 1), _c=delayed(longest))
    out = running(out, _sta=F.col(X) * F.col(X) + F.col("_a"), _lta=F.col("_b") + F.col("_c"))
    ratio = F.try_divide(F.col("_sta") / nsta, F.col("_lta") / nlta)
    return out.withColumn("cft", F.when(F.col(IDX) >= nlta + nsta + 50, ratio).otherwise(0.0)).select(*df.columns, "cft")


def interpolate(df: DataFrame, start: float, step: float, method: str = "linear") -> DataFrame:
    """(trace, k, y) at places start + k step within the trace: on the line between the samples around, or the nearest sample.

    Every sample gives the places up to the next one, so neither a grid nor a join is needed.
    """
    ahead = moving(df, 0, 1, _next=lambda rows: F.when(F.count("*").over(rows(0, 1)) == 2, F.last(X).over(rows(0, 1))))
    first = F.greatest(F.ceil((F.col(IDX) - start) / step), F.lit(0))
    last = F.when(F.col("_next").isNull(), F.floor((F.col(IDX) - start) / step)).otherwise(F.ceil((F.col(IDX) + 1 - start) / step) - 1)
    places = ahead.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k"))
    part = start + F.col("k") * step - F.col(IDX)
    line = F.when(F.col("_next").isNull() | (part == 0), F.col(X)).otherwise(F.col(X) + (F.col("_next") - F.col(X)) * part)
    near = F.when(F.col("_next").isNull() | (part < 0.5), F.col(X)).otherwise(F.col("_next"))
    return places.select(TRACE, "k", (line if method == "linear" else near).alias("y"))


def _places(rows: DataFrame, start: float, step: float, value: Column) -> DataFrame:
    """(trace, k, y) at places start + k step from a sample (``_last``: the trace's last) up to the next one; value: of the sample's columns and ``_part``."""
    first = F.greatest(F.ceil((F.col(IDX) - start) / step), F.lit(0))
    last = F.when(F.col("_last"), F.floor((F.col(IDX) - start) / step)).otherwise(F.ceil((F.col(IDX) + 1 - start) / step) - 1)
    places = rows.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k"))
    return places.withColumn("_part", start + F.col("k") * step - F.col(IDX)).select(TRACE, "k", value.alias("y"))


def interpolate_lanczos(df: DataFrame, start: float, step: float, width: int) -> DataFrame:
    """(trace, k, y): sums of the samples within ``width`` of a place, weighted by a sinc that a wider one fades out."""
    held = moving(df, width, width, _near=lambda r: F.collect_list(F.struct((F.col(IDX)).alias("i"), F.col(X).alias("x"))).over(r(-width, width)), _last=lambda r: F.count("*").over(r(0, 1)) == 1)
    sinc = lambda t: F.when(t == 0, F.lit(1.0)).otherwise(F.sin(pi * t) / F.when(t == 0, F.lit(1.0)).otherwise(pi * t))

    def weighted(s: Column) -> Column:
        away = F.col(IDX) + F.col("_part") - s["i"]
        return F.when(F.abs(away) <= width, s["x"] * sinc(away) * sinc(away / width)).otherwise(0.0)

    return _places(held, start, step, F.aggregate(F.transform("_near", weighted), F.lit(0.0), lambda a, v: a + v))


def interpolate_weighted_slopes(df: DataFrame, start: float, step: float) -> DataFrame:
    """(trace, k, y): cubic Hermite values; a sample's slope is the mean of both sides' weighted by the inverse of their size, 0 at turns."""
    sides = moving(df, 1, 1, _a=lambda r: F.col(X) - F.first(X).over(r(-1, -1)), _b=lambda r: F.first(X).over(r(1, 1)) - F.col(X))
    weight = lambda c: 1 / F.greatest(F.abs(c), F.lit(2.0**-52))
    inner = (weight("_a") * F.col("_a") + weight("_b") * F.col("_b")) / (weight("_a") + weight("_b"))
    slope = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).when(F.signum("_a") == F.signum("_b"), inner).otherwise(0.0)
    sloped = sides.withColumn("_k", F.coalesce(slope, F.lit(0.0))).drop("_a", "_b")
    ahead = moving(sloped, 0, 1, _x=lambda r: F.first(X).over(r(1, 1)), _m=lambda r: F.first("_k").over(r(1, 1)), _last=lambda r: F.count("*").over(r(0, 1)) == 1)
    t = F.col("_part")
    cubic = F.col(X) * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("_k") * t * (1 - t) * (1 - t) + F.col("_x") * t * t * (3 - 2 * t) + F.col("_m") * t * t * (t - 1)
    return _places(ahead, start, step, F.when(F.col("_last"), F.col(X)).otherwise(cubic))


def taper(df: DataFrame, kind: str = "hann", max_percentage: float | None = 0.05, max_length: int | None = None, side: str = "both") -> DataFrame:
    """Flanks of a symmetric window at the ends of a trace; the shorter of a share and a number of samples, at most half of it."""
    sizes = df.groupBy(TRACE).agg((F.max(IDX) + 1).alias("_n"))
    limits = [F.floor(F.col("_n") * max_percentage)] if max_percentage is not None else []
    limits += [F.lit(max_length).cast("long")] if max_length is not None else []
    half = F.floor(F.col("_n") / 2)
    flank = F.least(*limits, half) if limits else half
    out = df.join(sizes, TRACE).withColumn("_flank", flank)
    # an even trace that is all flank takes an even window, others an odd one
    size = F.when(2 * F.col("_flank") == F.col("_n"), 2 * F.col("_flank")).otherwise(2 * F.col("_flank") + 1)
    shapes = {
        "hann": lambda i: 0.5 - 0.5 * F.cos(2 * pi * i / (size - 1)),
        "hamming": lambda i: 0.54 - 0.46 * F.cos(2 * pi * i / (size - 1)),
        "cosine": lambda i: F.sin(pi * (i + 0.5) / size),
        "triang": lambda i: F.when(size % 2 == 1, 2 * (i + 1) / (size + 1)).otherwise((2 * i + 1) / size),
    }
    left, right = F.col(IDX), F.col("_n") - 1 - F.col(IDX)
    at = {"left": left, "right": right, "both": F.least(left, right)}[side]
    return out.withColumn("y", F.when(at < F.col("_flank"), F.col(X) * shapes[kind](at.cast("double"))).otherwise(F.col(X))).drop("_n", "_flank")


def frames(df: DataFrame, length: int, step: int) -> DataFrame:
    """(window, trace, idx, y): full frames of a trace, each minus its mean."""
    cut = slide(df, length, step)
    means = cut.groupBy(TRACE, "window").agg(F.avg(X).alias("_mean"))
    return cut.join(means, [TRACE, "window"]).withColumn("y", F.col(X) - F.col("_mean")).drop("_mean", X)
