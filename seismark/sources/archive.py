"""Waveform archives and their index: bulk requests with wildcards, and reads of only the files that they ask for.

Requests are a table: (request, network, station, location, channel, start, end), codes with ``*`` and ``?``, times in
microseconds or null for no limit. Patterns are resolved once against the distinct codes of the index; what is left is a join of
equal codes and days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ["network", "station", "location", "channel"]
#: Microseconds of a day, and requests with wildcards in the station that are matched at once.
DAY, PATTERNS = 86_400_000_000, 10_000


def _expression(pattern: Column) -> Column:
    """Shell wildcards as a regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def resolve(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """(request, codes, start, end): each request for each channel of (codes, earliest, latest) that it names and whose span it touches.

    Requests for one station meet its channels by an equi join. Those with a wildcard there come as one array, whose number is
    checked, that every row of the codes is matched with; more are matched in parts.
    """
    wild = F.col("station").rlike(r"[*?]")
    fields = ["request", *CODES, "start", "end"]
    named = requests.where(~wild).select(*[F.col(c).alias(f"_{c}") for c in fields])
    hits = [codes.join(named, F.col("station") == F.col("_station"))]
    open_ended = requests.where(wild)
    parts = -(-open_ended.count() // PATTERNS)
    for part in range(parts):
        one = open_ended.where(F.pmod(F.xxhash64("request"), F.lit(parts)) == part)
        patterns = one.select(F.struct(*fields).alias("r")).agg(F.collect_list("r").alias("_all"))
        rows = codes.crossJoin(F.broadcast(patterns)).select("*", F.explode(F.filter("_all", lambda r: F.rlike(F.col("station"), _expression(r["station"])))).alias("r"))
        hits.append(rows.select(*codes.columns, *[F.col(f"r.{c}").alias(f"_{c}") for c in fields]))
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    match = F.lit(True)
    for c in CODES:
        match = match & F.rlike(F.col(c), _expression(F.col(f"_{c}")))
    start, end = F.coalesce("_start", "earliest"), F.coalesce("_end", "latest")
    return found.where(match & (F.col("earliest") <= end) & (F.col("latest") >= start)).select(F.col("_request").alias("request"), *CODES, start.alias("start"), end.alias("end"))


def index_rows(index: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, requeststart, requestend, index columns): rows of the index (codes, start, end, ...) that touch a request's span.

    Both sides are dealt to days; a pair counts in the first day that both have.
    """
    codes = index.groupBy(*CODES).agg(F.min("start").alias("earliest"), F.max("end").alias("latest"))
    asked = resolve(requests, codes).withColumnsRenamed({"start": "requeststart", "end": "requestend"})
    deal = lambda df, a, b, name: df.withColumn(name, F.floor(F.col(a) / DAY)).withColumn("_day", F.explode(F.sequence(F.floor(F.col(a) / DAY), F.floor(F.col(b) / DAY))))
    pairs = deal(index, "start", "end", "_first").join(deal(asked.where("requeststart <= requestend"), "requeststart", "requestend", "_from"), [*CODES, "_day"])
    once = F.col("_day") == F.greatest("_first", "_from")
    hit = pairs.where(once & (F.col("start") <= F.col("requestend")) & (F.col("end") >= F.col("requeststart")))
    return hit.drop("_day", "_first", "_from")


def has_data(index: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, has_data) of every request."""
    held = index_rows(index, requests).select("request").distinct().withColumn("_held", F.lit(True))
    return requests.select("request").join(held, "request", "left").select("request", F.coalesce("_held", F.lit(False)).alias("has_data"))


def write_archive(samples: DataFrame, path: str) -> None:
    """Samples (codes, t in microseconds, x) as files by network, station and day; the other codes stay columns."""
    rows = samples.withColumn("day", F.floor(F.col("t") / DAY))
    rows.repartition("network", "station", "day").sortWithinPartitions("network", "station", "day", "location", "channel", "t").write.partitionBy("network", "station", "day").parquet(path)


def read_archive(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """(request, codes, t, x) of an archive: the samples from start to end of each request.

    The archive's stations come from its folders, without reading a file. The resolved stations and days are joined to the
    folders' columns, so the scan is pruned to the files that are asked for before it starts; channels and times filter the rest.
    """
    archive = spark.read.parquet(path).withColumns({"network": F.col("network").cast("string"), "station": F.col("station").cast("string")})
    days = archive.select("network", "station", "day").distinct()
    spans = days.groupBy("network", "station").agg((F.min("day") * DAY).alias("earliest"), ((F.max("day") + 1) * DAY - 1).alias("latest"))
    everything = spans.withColumns({"location": F.lit(""), "channel": F.lit("")})
    named = requests.withColumns({"_location": F.col("location"), "_channel": F.col("channel")})
    asked = resolve(named.withColumns({"location": F.lit("*"), "channel": F.lit("*")}), everything).select("request", "network", "station", "start", "end")
    asked = asked.join(requests.select("request", F.col("location").alias("_location"), F.col("channel").alias("_channel")), "request")
    dealt = asked.where("start <= end").withColumn("day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor(F.col("end") / DAY))))
    rows = archive.join(F.broadcast(dealt) if dealt.count() <= PATTERNS * 10 else dealt, ["network", "station", "day"])
    inside = F.col("t").between(F.col("start"), F.col("end")) & F.rlike(F.col("location"), _expression(F.col("_location"))) & F.rlike(F.col("channel"), _expression(F.col("_channel")))
    return rows.where(inside).select("request", *CODES, "t", "x")
