"""Bulletins: text whose records are several lines with fields at fixed columns.

Lines are numbered across the splits of a file: within a split by the reader's order, and from the number of lines (or of record
starts) in the splits before, which is one row per split. So a record may lie across a border, a file of any length is read by
many tasks, and only a record's own lines ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, starts: Column | None = None) -> DataFrame:
    """(file, line, value[, record]): lines from 0 in each file; record: how many lines up to this one ``starts`` holds for."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"), F.regexp_replace("value", "\r$", "").alias("value"))
    raw = raw.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("long") if starts is not None else F.lit(0).cast("long"))
    sizes = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.sum("_start").alias("_s"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("_n", "_lines"), ("_s", "_records"))])
    inside = Window.partitionBy("file", "_block").orderBy("_order")
    rows = raw.join(base, ["file", "_block"])
    rows = rows.withColumns({"line": F.col("_lines") + F.row_number().over(inside) - 1, "record": F.col("_records") + F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.select("file", "line", "value", *(["record"] if starts is not None else []))


def _cell(line: Column, low: int, high: int) -> Column:
    """Columns low to high (from 1, both included) without blanks; null if empty."""
    return F.nullif(F.trim(F.substring(line, low, high - low + 1)), F.lit(""))


def _number(line: Column, low: int, high: int, kind: str = "double") -> Column:
    return _cell(line, low, high).try_cast(kind)


def _instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A time whose seconds may be 60 or more; null if it is none."""
    minutes = F.try_make_timestamp(year, month, day, hour, minute, F.lit(0).cast("decimal(8,6)"))
    return F.timestamp_micros(F.unix_micros(minutes) + F.round(second * 1_000_000).cast("long"))


# --- moment tensors, five lines each

_TENSOR = ("rr", "tt", "pp", "rt", "rp", "tp")


def read_moment_tensors(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of five lines: hypocenter, centroid with errors, tensor, axes, moment in newton meters and planes.

    Records whose times or places are none, and a last record that is cut short, give no row.
    """
    lines = numbered_lines(spark, path)
    record = lines.groupBy("file", F.floor(F.col("line") / 5).alias("record")).agg(*[F.max(F.when(F.col("line") % 5 == i, F.col("value"))).alias(f"l{i + 1}") for i in range(5)], F.count("*").alias("_n")).where("_n = 5")
    one, two, three, four, five = (F.col(f"l{i}") for i in range(1, 6))
    date, clock = F.split(_cell(one, 6, 15), "/"), F.split(_cell(one, 17, 26), ":")
    part = lambda x, i, kind="int": F.get(x, F.lit(i)).try_cast(kind)
    time = _instant(part(date, 0), part(date, 1), part(date, 2), part(clock, 0), part(clock, 1), part(clock, 2, "double"))
    centroid = F.split(F.trim(F.substring(three, 10, 49)), r"\s+")
    exponent = F.pow(F.lit(10.0), _number(four, 1, 2) - 7)
    tensor = [c for i, name in enumerate(_TENSOR) for c in ((_number(four, 3 + 13 * i, 9 + 13 * i) * exponent).alias(f"m_{name}"), (_number(four, 10 + 13 * i, 15 + 13 * i) * exponent).alias(f"m_{name}_error"))]
    axes = [c for i, name in enumerate("tnp") for c in ((_number(five, 4 + 15 * i, 11 + 15 * i) * exponent).alias(f"{name}_length"), _number(five, 12 + 15 * i, 14 + 15 * i).alias(f"{name}_plunge"), _number(five, 15 + 15 * i, 18 + 15 * i).alias(f"{name}_azimuth"))]
    moment = _number(five, 50, 56) * exponent
    planes = [_number(five, a, b).alias(n) for n, a, b in (("strike1", 58, 60), ("dip1", 61, 63), ("rake1", 64, 68), ("strike2", 69, 72), ("dip2", 73, 75), ("rake2", 76, 80))]
    rows = record.select(
        "file",
        "record",
        _cell(two, 1, 16).alias("event"),
        _cell(one, 1, 4).alias("catalog"),
        time.alias("time"),
        *[_number(one, a, b).alias(n) for n, a, b in (("latitude", 28, 33), ("longitude", 35, 41), ("depth", 43, 47), ("mb", 49, 51), ("ms", 53, 55))],
        _cell(one, 57, 80).alias("place"),
        *[part(centroid, i, "double").alias(n) for i, n in enumerate(("shift", "shift_error", "centroid_latitude", "latitude_error", "centroid_longitude", "longitude_error", "centroid_depth", "depth_error"))],
        _cell(three, 60, 63).alias("depth_type"),
        _number(two, 76, 80).alias("duration"),
        *tensor,
        *axes,
        moment.alias("moment"),
        (F.lit(2.0) / 3 * (F.log10(moment) - 9.1)).alias("mw"),
        *planes,
    )
    return rows.where((F.col("time").isNotNull()) & (F.abs("latitude") <= 90) & (F.abs("centroid_latitude") <= 90) & (F.abs("longitude") <= 180))


def write_moment_tensors(rows: DataFrame, path: str, exponent: int = 24) -> None:
    """The columns that ``read_moment_tensors`` gives, as records of five lines; moments in units of 10^(exponent - 7) newton meters."""
    scale = 10.0 ** (exponent - 7)
    f = F.format_string
    one = f("%-4s %s %s %6.2f %7.2f %5.1f %3.1f %3.1f %-24s", "catalog", F.date_format("time", "yyyy/MM/dd"), F.substring(F.date_format("time", "HH:mm:ss.SSS"), 1, 10), "latitude", "longitude", "depth", "mb", "ms", "place")
    two = f("%-16s B:  0    0   0 S:  0    0   0 M:  0    0   0 CMT: 1 TRIHD:%5.1f", "event", "duration")
    three = f("CENTROID:  %7.1f%4.1f%7.2f%5.2f%8.2f%5.2f%6.1f%5.1f %-4s S-00000000000000", "shift", "shift_error", "centroid_latitude", "latitude_error", "centroid_longitude", "longitude_error", "centroid_depth", "depth_error", "depth_type")
    four = f("%2d" + "%7.3f%6.3f" * 6, F.lit(exponent), *[F.col(c) / scale for name in _TENSOR for c in (f"m_{name}", f"m_{name}_error")])
    axis = [c for name in "tnp" for c in (F.col(f"{name}_length") / scale, F.col(f"{name}_plunge").cast("long"), F.col(f"{name}_azimuth").cast("long"))]
    five = f("V10" + "%8.3f%3d%4d" * 3 + "%8.3f %3d%3d%5d%4d%3d%5d", *axis, F.col("moment") / scale, *[F.col(c).cast("long") for c in ("strike1", "dip1", "rake1", "strike2", "dip2", "rake2")])
    rows.select(F.concat_ws("\n", one, two, three, four, five)).write.text(path)


# --- phase lists: a line with # for each event, then one for each pick


def read_phase_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events (event, time, latitude, longitude, depth in meters, magnitude, horizontal and vertical errors in meters, rms) and picks
    (event, station, time, weight, phase); a magnitude or error of NaN is null, and picks before the first event are left out.
    """
    lines = numbered_lines(spark, path, F.col("value").startswith("#")).where("trim(value) <> '' AND record > 0")
    words = F.split(F.trim(F.regexp_replace("value", "^#", "")), r"\s+")
    number = lambda i, kind="double": F.get(words, F.lit(i)).try_cast(kind)
    real = lambda i: F.when(~F.isnan(number(i)), number(i))
    head = F.col("value").startswith("#")
    time = _instant(*[number(i, "int") for i in range(5)], number(5))
    events = lines.where(head).select("file", "record", F.get(words, F.lit(13)).alias("event"), time.alias("time"), number(6).alias("latitude"), number(7).alias("longitude"), (number(8) * 1000).alias("depth"), real(9).alias("magnitude"), (real(10) * 1000).alias("horizontal_error"), (real(11) * 1000).alias("vertical_error"), real(12).alias("rms"))
    picks = lines.where(~head).select("file", "record", F.get(words, F.lit(0)).alias("station"), number(1).alias("_after"), number(2).alias("weight"), F.get(words, F.lit(3)).alias("phase"))
    held = picks.join(events.select("file", "record", "event", F.col("time").alias("_origin")), ["file", "record"])
    after = F.timestamp_micros(F.unix_micros("_origin") + F.round(F.col("_after") * 1_000_000).cast("long"))
    return events.drop("file", "record"), held.select("event", "station", after.alias("time"), "weight", "phase")


def write_phase_lists(events: DataFrame, picks: DataFrame, path: str) -> None:
    """Those tables as phase lists; a pick's time is seconds after the event, and events without picks have their line alone."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
    kilometers = lambda c: F.coalesce((F.col(c) / 1000).cast("string"), F.lit("NaN"))
    head = F.concat_ws(" ", F.lit("#"), F.date_format("time", "yyyy MM dd HH mm ss.SSSSSS"), text("latitude"), text("longitude"), kilometers("depth"), text("magnitude"), kilometers("horizontal_error"), kilometers("vertical_error"), text("rms"), "event")
    timed = picks.join(events.select("event", F.col("time").alias("_origin")), "event")
    row = F.format_string("%-6s  %.4f  %s  %s", "station", (F.unix_micros("time") - F.unix_micros("_origin")) / 1e6, F.col("weight").cast("string"), "phase")
    listed = timed.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("time", "station", row.alias("row")))).alias("_rows"))
    rows = events.join(listed, "event", "left")
    rows.select(F.concat_ws("\n", head, F.transform(F.coalesce("_rows", F.array().cast("array<struct<time:timestamp,station:string,row:string>>")), lambda r: r["row"]))).write.text(path)


# --- Nordic blocks: lines whose 80th column tells their kind, closed by a blank line


def read_nordic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events (event: file and number of the block, time, latitude, longitude, depth in meters, magnitude, its type, rms) and picks
    (event, station, component, phase, weight, polarity, time) of Nordic blocks. A block starts with a line of kind 1 after a blank
    line or at the top; hours of picks may exceed 24; lines of other kinds, and blocks without a time, are left out.
    """
    lines = numbered_lines(spark, path)
    marked = lines.withColumns({"_kind": F.substring("value", 80, 1), "_blank": F.trim("value") == ""})
    numbered = numbered_lines(spark, path, F.trim("value") == "").select("file", "line", F.col("record").alias("block"))
    rows = marked.where("NOT _blank").join(numbered, ["file", "line"])
    v = F.col("value")
    whole = lambda a, b: F.coalesce(_number(v, a, b, "int"), F.lit(0))
    first = F.row_number().over(Window.partitionBy("file", "block").orderBy("line"))
    event = F.concat_ws("#", "file", F.col("block").cast("string"))
    time = _instant(_number(v, 2, 5, "int"), _number(v, 7, 8, "int"), _number(v, 9, 10, "int"), whole(12, 13), whole(14, 15), F.coalesce(_number(v, 17, 20), F.lit(0.0)))
    heads = rows.where("_kind = '1'").withColumn("_first", first).where("_first = 1").withColumns({"event": event, "time": time}).where("time IS NOT NULL")
    events = heads.select("event", "time", _number(v, 24, 30).alias("latitude"), _number(v, 31, 38).alias("longitude"), (_number(v, 39, 43) * 1000).alias("depth"), _number(v, 56, 59).alias("magnitude"), _cell(v, 60, 60).alias("magnitude_type"), _number(v, 52, 55).alias("rms"))
    picks = rows.where("_kind IN ('4', ' ', '')").withColumn("event", event).join(heads.select("event", F.date_trunc("day", "time").alias("_day")), "event")
    seconds = whole(19, 20) * 3600 + whole(21, 22) * 60 + F.coalesce(_number(v, 23, 28), F.lit(0.0))
    at = F.timestamp_micros(F.unix_micros("_day") + F.round(seconds * 1_000_000).cast("long"))
    return events, picks.where(_cell(v, 2, 6).isNotNull()).select("event", _cell(v, 2, 6).alias("station"), _cell(v, 8, 8).alias("component"), _cell(v, 11, 14).alias("phase"), whole(15, 15).alias("weight"), _cell(v, 17, 17).alias("polarity"), at.alias("time"))


def write_nordic(events: DataFrame, picks: DataFrame, path: str) -> None:
    """Events (event, time, latitude, longitude, depth, magnitude, magnitude_type, rms) and picks as Nordic blocks, seconds to two digits."""
    f = F.format_string
    number = lambda form, c: F.coalesce(f(form, c), F.lit(" " * int(form[1 : form.index(".")])))
    tenth = F.format_string("%4.1f", F.second("time") + F.floor(F.unix_micros("time") % 1_000_000 / 100_000) / 10)
    clock = F.concat(F.date_format("time", " yyyy "), f("%2d%2d %2d%2d ", F.month("time"), F.dayofmonth("time"), F.hour("time"), F.minute("time")), tenth)
    head = F.concat(clock, F.lit(" L "), number("%7.3f", "latitude"), number("%8.3f", "longitude"), number("%5.1f", F.col("depth") / 1000), F.lit(" " * 8), number("%4.1f", "rms"), number("%4.1f", "magnitude"), F.coalesce(F.col("magnitude_type"), F.lit(" ")))
    line = lambda text, kind: F.concat(F.rpad(text, 79, " "), F.lit(kind))
    row = F.concat(f(" %-5s", "station"), F.lit(" "), F.rpad(F.coalesce("component", F.lit(" ")), 1, " "), F.lit("  "), f("%-4s", "phase"), f("%1d ", "weight"), F.rpad(F.coalesce("polarity", F.lit(" ")), 1, " "), F.lit(" "))
    held = picks.join(events.select("event", F.col("time").alias("_origin")), "event")
    seconds = (F.unix_micros("time") - F.unix_micros(F.date_trunc("day", "_origin"))) / 1e6
    hour = F.floor(seconds / 3600)
    row = F.concat(row, f("%2d%2d%6.2f", hour, F.floor(seconds / 60) - hour * 60, seconds - F.floor(seconds / 60) * 60))
    listed = held.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("time", "station", line(row, "4").alias("row")))).alias("_rows"))
    rows = events.join(listed, "event", "left")
    body = F.transform(F.coalesce("_rows", F.array().cast("array<struct<time:timestamp,station:string,row:string>>")), lambda r: r["row"])
    rows.select(F.concat_ws("\n", line(head, "1"), body, F.lit(" "))).write.text(path)


# --- centroid solutions: a line of the hypocenter, then one figure a line

# Names of the lines of a solution.
_SOLUTION = {"event name": "event", "time shift": "shift", "half duration": "half_duration", "latitude": "centroid_latitude", "longitude": "centroid_longitude", "depth": "centroid_depth", "Mrr": "m_rr", "Mtt": "m_tt", "Mpp": "m_pp", "Mrt": "m_rt", "Mrp": "m_rp", "Mtp": "m_tp"}


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """One row per solution: catalog, hypocenter, place, centroid, half duration and moment tensor in newton meters; a time that is none gives no row."""
    name = F.trim(F.split("value", ":", 2)[0])
    head = ~F.col("value").contains(":") & (F.trim("value") != "")
    lines = numbered_lines(spark, path, head).where("record > 0 AND trim(value) <> ''")
    words = F.split(F.trim(F.max(F.when(head, F.col("value")))), r"\s+", 13)
    cells = {c: F.trim(F.max(F.when(~head & (name == n), F.split("value", ":", 2)[1]))) for n, c in _SOLUTION.items()}
    rows = lines.groupBy("file", "record").agg(words.alias("_w"), *[v.alias(c) for c, v in cells.items()])
    number = lambda i, kind="double": F.get("_w", F.lit(i)).try_cast(kind)
    time = _instant(*[number(i, "int") for i in range(1, 6)], number(6))
    hypocenter = [number(i).alias(n) for i, n in ((7, "latitude"), (8, "longitude"), (9, "depth"), (10, "mb"), (11, "ms"))]
    figures = [(F.col(c).try_cast("double") / (1e7 if c.startswith("m_") else 1)).alias(c) for c in _SOLUTION.values() if c != "event"]
    return rows.select("event", F.get("_w", F.lit(0)).alias("catalog"), time.alias("time"), *hypocenter, F.get("_w", F.lit(12)).alias("place"), *figures).where("time IS NOT NULL")


def write_solutions(rows: DataFrame, path: str) -> None:
    """The columns that ``read_solutions`` gives, as solutions."""
    f = F.format_string
    head = f(" %s %s %8.4f %9.4f %5.1f %.1f %.1f %s", "catalog", F.concat(F.date_format("time", "yyyy MM dd HH mm ss."), f("%02d", F.floor(F.unix_micros("time") % 1_000_000 / 10_000))), "latitude", "longitude", "depth", "mb", "ms", "place")
    lines = [f(f"{n + ':':<12}%15s" if c == "event" else f"{n + ':':<12}%15.6e" if c.startswith("m_") else f"{n + ':':<12}%15.4f", F.col(c) * 1e7 if c.startswith("m_") else F.col(c)) for n, c in _SOLUTION.items()]
    rows.select(F.concat_ws("\n", head, *lines)).write.text(path)


# --- poles and zeros of a channel: header lines with *, then lists

# Names of the header lines.
_HEADER = {"NETWORK": "network", "STATION": "station", "LOCATION": "location", "CHANNEL": "channel", "START": "start", "END": "end", "LATITUDE": "latitude", "LONGITUDE": "longitude", "ELEVATION": "elevation", "DEPTH": "depth", "DIP": "dip", "AZIMUTH": "azimuth", "SAMPLE RATE": "rate", "INPUT UNIT": "units"}
_TEXTS = ("network", "station", "location", "channel", "units")


def read_pole_zeros(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Channels (codes, start, end, place, rate, units, constant) and roots (file, record, kind, number, re, im) of pole-zero text.

    A record starts with its network line. Roots that a list counts but does not write are 0, as the format has it for zeros; cells
    that are no numbers are null.
    """
    lines = numbered_lines(spark, path, F.col("value").rlike(r"^\*\s*NETWORK\b")).where("record > 0 AND trim(value) <> ''")
    comment = F.col("value").startswith("*")
    name = F.trim(F.regexp_replace(F.regexp_extract("value", r"^\*\s*([A-Z ]+)", 1), r"\s+$", ""))
    content = F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1))
    words = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    key = F.when(comment, F.lit(None)).otherwise(F.when(words[0].rlike("^[A-Z]"), words[0]))
    cells = {c: F.max(F.when(comment & (name == n), content)) for n, c in _HEADER.items()}
    heads = lines.groupBy("file", "record").agg(*[v.alias(c) for c, v in cells.items()], F.max(F.when(key == "CONSTANT", F.get(words, F.lit(1)))).try_cast("double").alias("constant"))
    typed = [F.col(c).alias(c) if c in _TEXTS else F.col(c).try_cast("timestamp").alias(c) if c in ("start", "end") else F.col(c).try_cast("double").alias(c) for c in _HEADER.values()]
    channels = heads.select("file", "record", *typed, "constant")
    inside = Window.partitionBy("file", "record").orderBy("line")
    listed = lines.where(~comment).withColumns({"_key": key, "_words": words}).withColumn("_list", F.last("_key", ignorenulls=True).over(inside)).where("_list IN ('POLES', 'ZEROS')")
    counts = listed.where("_key IS NOT NULL").select("file", "record", F.col("_list"), F.get("_words", F.lit(1)).try_cast("int").alias("_n"), F.col("line").alias("_from"))
    given = listed.where("_key IS NULL").join(counts, ["file", "record", "_list"]).select("file", "record", "_list", (F.col("line") - F.col("_from") - 1).cast("int").alias("number"), F.get("_words", F.lit(0)).try_cast("double").alias("re"), F.get("_words", F.lit(1)).try_cast("double").alias("im"))
    asked = counts.where("_n > 0").withColumn("number", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    roots = asked.join(given, ["file", "record", "_list", "number"], "left")
    kind = F.when(F.col("_list") == "POLES", "pole").otherwise("zero")
    return channels, roots.select("file", "record", kind.alias("kind"), "number", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


def write_pole_zeros(channels: DataFrame, roots: DataFrame, keys: list[str], path: str) -> None:
    """Channels and roots (keys, kind, number, re, im) as pole-zero text; zeros at 0 are only counted, and so stand last in their list."""
    cell = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if c in ("start", "end") else F.col(c).cast("string"), F.lit(""))
    line = F.lit("* " + "*" * 34)
    heads = [F.concat(F.lit(f"* {n:<18}: "), cell(c)) if c in channels.columns else None for n, c in _HEADER.items()]
    plain = (F.col("re") == 0) & (F.col("im") == 0)
    row = F.when((F.col("kind") == "zero") & plain, F.lit(None)).otherwise(F.format_string("\t%+.6e\t%+.6e", "re", "im"))
    order = F.struct(F.when(F.col("kind") == "zero", plain).otherwise(False).alias("_last"), "number", row.alias("row"))
    lists = roots.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("rows"))
    text = lists.select(*keys, "kind", F.concat_ws("\n", F.concat(F.when(F.col("kind") == "pole", "POLES\t").otherwise("ZEROS\t"), F.col("n").cast("string")), F.filter(F.transform("rows", lambda r: r["row"]), lambda r: r.isNotNull())).alias("_text"))
    both = text.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "zero", F.col("_text"))).alias("_zeros"), F.max(F.when(F.col("kind") == "pole", F.col("_text"))).alias("_poles"))
    rows = channels.join(both, keys, "left")
    rows.select(F.concat_ws("\n", line, *[h for h in heads if h is not None], line, F.coalesce("_zeros", F.lit("ZEROS\t0")), F.coalesce("_poles", F.lit("POLES\t0")), F.format_string("CONSTANT\t%.6e", "constant"))).write.text(path)
