"""Catalog and station tables as delimited text and XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column orders of the formats.
ZMAP = ("longitude", "latitude", "year", "month", "day", "magnitude", "depth", "hour", "minute", "second")


# Columns of station text at its three levels, with their types.
STATION_TEXT = {
    "network": {"network": "string", "description": "string", "starttime": "timestamp", "endtime": "timestamp", "totalstations": "bigint"},
    "station": {"network": "string", "station": "string", "latitude": "double", "longitude": "double", "elevation": "double", "sitename": "string", "starttime": "timestamp", "endtime": "timestamp"},
    "channel": {
        "network": "string", "station": "string", "location": "string", "channel": "string", "latitude": "double", "longitude": "double", "elevation": "double", "depth": "double", "azimuth": "double", "dip": "double",
        "sensordescription": "string", "scale": "double", "scalefreq": "double", "scaleunits": "string", "samplerate": "double", "starttime": "timestamp", "endtime": "timestamp",
    },
}


def write_station_text(rows: DataFrame, path: str, level: str) -> None:
    """Station text with its # header line; columns that the rows lack, and nulls, are empty cells."""
    types = STATION_TEXT[level]
    cell = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if types[c] == "timestamp" else F.col(c).cast("string")
    cells = [cell(c).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in types]
    names = [f"#{c}" if i == 0 else c for i, c in enumerate(types)]
    rows.select(*cells).toDF(*names).write.option("header", True).option("sep", "|").option("comment", "~").option("nullValue", "").option("emptyValue", "").csv(path)


def read_station_text(spark: SparkSession, path: str, level: str) -> DataFrame:
    """Typed columns of a level; empty cells, and cells that are no value of the type, are null."""
    rows = read_delimited(spark, path, tuple(STATION_TEXT[level]))
    return rows.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in STATION_TEXT[level].items()])


def read_event_csv(spark: SparkSession, path: str, names: str, sep: str = ",", header: bool = False) -> DataFrame:
    """(event, time, latitude, longitude, depth, magnitude) of a delimited catalog whose columns ``names`` lists, in order.

    The time is one column ``time`` or six: year mon day hour minu sec. Depths are kilometers (``dep``) or meters (``depm``) and
    come out in meters. Columns named _ are skipped; missing columns and cells that are no numbers are null.
    """
    columns = [f"_skipped{i}" if c == "_" else c for i, c in enumerate(names.split())]
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", sep).option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = F.lit(None).cast("double")
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")) if c in columns else raw
    whole = lambda c: F.col(c).try_cast("int")
    time = F.col("time").try_cast("timestamp") if "time" in columns else F.try_make_timestamp(*[whole(c) for c in ("year", "mon", "day", "hour", "minu")], F.col("sec").try_cast("decimal(8,6)"))
    depth = number("depm") if "depm" in columns else number("dep") * 1000
    event = F.col("id") if "id" in columns else F.lit(None).cast("string")
    return rows.select(event.alias("event"), time.alias("time"), number("lat").alias("latitude"), number("lon").alias("longitude"), depth.alias("depth"), number("mag").alias("magnitude"))


def write_zmap(events: DataFrame, path: str) -> None:
    """(time, latitude, longitude, depth, magnitude); decimal years, nulls as NaN."""
    t = F.col("time")
    year_length = F.when((F.year(t) % 4 == 0) & ((F.year(t) % 100 != 0) | (F.year(t) % 400 == 0)), 366).otherwise(365)
    fraction = (F.dayofyear(t) - 1 + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400) / year_length
    parts = {"year": F.year(t) + fraction, "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.date_format(t, "s.SSSSSS").cast("double")}
    columns = [parts.get(c, F.col(c) if c not in parts else None) for c in ZMAP]
    events.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NaN")) for c in columns])).write.text(path)


def read_zmap(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} double" for c in ZMAP)
    rows = spark.read.schema(schema).option("sep", "\t").csv(path)
    whole = lambda c: F.col(c).cast("int")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    time = F.make_timestamp(F.floor("year").cast("int"), whole("month"), whole("day"), whole("hour"), whole("minute"), F.col("second").cast("decimal(8,6)"))
    return rows.select(time.alias("time"), *[number(c) for c in ("latitude", "longitude", "depth", "magnitude")])


def read_delimited(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = "|") -> DataFrame:
    """Web-service text (a # header line, blanks around cells); empty cells are null."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", sep).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in columns])


def write_delimited(rows: DataFrame, path: str, sep: str = "|") -> None:
    """A # header line per file, then cells; nulls as empty cells."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    rows.select(F.concat_ws(sep, *cells)).write.text(path)


def write_events_xml(events: DataFrame, path: str) -> None:
    """(event, time, latitude, longitude, depth, magnitude) as event elements with origin and magnitude."""
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"))).alias(c)
    origin = F.struct(F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("value")).alias("time"), value("latitude"), value("longitude"), value("depth"))
    nested = events.select(F.col("event").cast("string").alias("_publicID"), origin.alias("origin"), F.when(F.col("magnitude").isNotNull(), F.struct(F.struct(F.col("magnitude").alias("value")).alias("mag"))).alias("magnitude"))
    nested.write.format("xml").option("rootTag", "eventParameters").option("rowTag", "event").save(path)


def read_events_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "_publicID string, origin struct<time: struct<value: string>, latitude: struct<value: double>, longitude: struct<value: double>, depth: struct<value: double>>, magnitude struct<mag: struct<value: double>>"
    )
    rows = spark.read.format("xml").option("rowTag", "event").schema(schema).load(path)
    return rows.select(
        F.col("_publicID").alias("event"),
        F.to_timestamp("origin.time.value").alias("time"),
        *[F.col(f"origin.{c}.value").alias(c) for c in ("latitude", "longitude", "depth")],
        F.col("magnitude.mag.value").alias("magnitude"),
    )


# Columns of event text.
EVENT_TEXT = {
    "EventID": "string", "Time": "timestamp", "Latitude": "double", "Longitude": "double", "Depth/km": "double", "Author": "string", "Catalog": "string", "Contributor": "string", "ContributorID": "string", "MagType": "string", "Magnitude": "double", "MagAuthor": "string", "EventLocationName": "string",
}
_EVENT_NAMES = dict(zip(EVENT_TEXT, ("event", "time", "latitude", "longitude", "depth", "author", "catalog", "contributor", "contributor_id", "magnitude_type", "magnitude", "magnitude_author", "place"), strict=True))


def write_event_text(events: DataFrame, path: str) -> None:
    """Event text with its # header line; depths in meters become kilometers; columns that the rows lack, and nulls, are empty cells."""
    cell = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "double": lambda c: (F.col(c) / 1000 if c == "depth" else F.col(c)).cast("string"), "string": lambda c: F.col(c).cast("string")}
    cells = [cell[kind](_EVENT_NAMES[n]).alias(n) if _EVENT_NAMES[n] in events.columns else F.lit(None).cast("string").alias(n) for n, kind in EVENT_TEXT.items()]
    names = [f"#{n}" if i == 0 else n for i, n in enumerate(EVENT_TEXT)]
    events.select(*cells).toDF(*names).write.option("header", True).option("sep", "|").option("comment", "~").option("nullValue", "").option("emptyValue", "").csv(path)


def read_event_text(spark: SparkSession, path: str) -> DataFrame:
    """Typed columns of event text, depths in meters; empty cells, and cells that are no value of the type, are null."""
    rows = read_delimited(spark, path, tuple(EVENT_TEXT))
    typed = [F.col(f"`{n}`").try_cast(kind).alias(_EVENT_NAMES[n]) for n, kind in EVENT_TEXT.items()]
    return rows.select(*typed).withColumn("depth", F.col("depth") * 1000)
