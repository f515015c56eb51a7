"""The driver's tables as traces, segments, vectors, stations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import micros
from ..sources.scratch import folder  # noqa: F401


#: Microseconds of a trace that are numbered in one task: a day.
BLOCK_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of (trace, t, x); t in 64ths of a microsecond, distinct in a trace."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may stand for a file or a folder
    return rows.select(F.col("user_id").alias("trace"), (micros(F.col("ts")) * 64 + F.col("event_id") % 64).alias("t"), F.col("value").alias("x"))


PACKETS = "pk AS (SELECT user_id AS trace, epoch_us(ts) * 64 + event_id % 64 AS t, value AS x FROM events)"


def numbered(rows: DataFrame, time: Column, *order: str) -> DataFrame:
    """``idx`` of each row in its trace: its number within a block of time, plus the rows of the blocks before."""
    rows = rows.withColumn("_block", F.floor(time / BLOCK_US))
    counts = rows.groupBy("trace", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("trace").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("trace", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("trace", "_block").orderBy(*order)
    return rows.join(base, ["trace", "_block"]).withColumn("idx", F.col("_base") + F.row_number().over(inside) - 1).drop("_block", "_base")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, idx, x): events of a user in time order."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), "event_id", "ts", F.col("value").alias("x"))
    return numbered(rows, micros(F.col("ts")), "ts", "event_id").select("trace", "idx", "x")


SAMPLES = "s AS (SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, trace, channel, t, x): t in microseconds."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("trace"), F.col("event_type").alias("channel"), micros(F.col("ts")).alias("t"), F.col("value").alias("x"))


TIMED = "e AS (SELECT event_id, user_id AS trace, event_type AS channel, epoch_us(ts) AS t, value AS x FROM events)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, idx, x): daily order totals of 25 customer groups; days without orders are gaps."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("trace"), day.alias("idx")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))


DAYS = "d AS (SELECT o_custkey % 25 AS trace, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS idx, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, label, data): one evenly sampled segment per embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("data"))


VECTORS = "v AS (SELECT vec_id AS trace, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, network, latitude, longitude): suppliers at places that their key gives."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("network"), ((F.col("s_suppkey") * 37) % 181 - 90).cast("double").alias("latitude"), ((F.col("s_suppkey") * 71) % 361 - 180).cast("double").alias("longitude")
    )


STATIONS = "st AS (SELECT s_suppkey AS station, s_nationkey AS network, CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS latitude, CAST((s_suppkey * 71) % 361 - 180 AS DOUBLE) AS longitude FROM supplier)"


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, time, latitude, longitude, depth, magnitude): orders as a catalog, with nulls in magnitude and depth."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event"),
        F.col("o_orderdate").cast("timestamp").alias("time"),
        ((F.col("o_custkey") * 13) % 179 - 89).cast("double").alias("latitude"),
        ((F.col("o_orderkey") * 7) % 359 - 179).cast("double").alias("longitude"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 700).cast("double")).alias("depth"),
        F.when(F.col("o_orderkey") % 13 != 0, F.round(F.col("o_totalprice") / 50000, 1)).alias("magnitude"),
    )


QUAKES = "q AS (SELECT o_orderkey AS event, o_orderdate AS time, CAST((o_custkey * 13) % 179 - 89 AS DOUBLE) AS latitude, CAST((o_orderkey * 7) % 359 - 179 AS DOUBLE) AS longitude, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 700 AS DOUBLE) END AS depth, CASE WHEN o_orderkey % 13 <> 0 THEN round(o_totalprice / 50000, 1) END AS magnitude FROM orders)"
