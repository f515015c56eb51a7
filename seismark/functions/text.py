"""Codes, globs and instants as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(column: Column, pattern: str) -> Column:
    """Case-insensitive shell pattern (``*``, ``?``, ``[..]``) on a code; without wildcards it is an equality that scans can use."""
    if not re.search(r"[*?\[]", pattern):
        return F.upper(column) == pattern.upper()
    out = ""
    for part in re.findall(r"\[[^\]]*\]|.", pattern):
        out += {"*": ".*", "?": "."}.get(part) or (part.replace("[!", "[^") if part.startswith("[") and len(part) > 1 else re.escape(part))
    return column.rlike(f"(?is)^{out}$")


def seed_id(network: Column, station: Column, location: Column, channel: Column) -> Column:
    """net.sta.loc.cha"""
    return F.concat_ws(".", *[F.coalesce(c.cast("string"), F.lit("")) for c in (network, station, location, channel)])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the session's zone is taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seed_time(ts: Column) -> Column:
    """YYYY,DDD,HH:MM:SS.ffffff"""
    return F.date_format(ts, "yyyy,DDD,HH:mm:ss.SSSSSS")


def hour_of_day(ts: Column) -> Column:
    """Hours with their fraction."""
    return F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(n))).cast("long")


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def parse_instant(value: Column) -> Column:
    """Timestamp of a calendar (2010-02-03), ordinal (2010-034) or week date (2010-W05-3), with T and a time of day or without."""
    date, clock = F.split_part(value, F.lit("T"), F.lit(1)), F.split_part(value, F.lit("T"), F.lit(2))
    year = F.left(date, F.lit(4)).cast("int")
    ordinal = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.substring(date, 6, 3).cast("int") - 1)
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # the 4th of January lies in week 1
    week = F.date_add(fourth, (F.substring(date, 7, 2).cast("int") - 1) * 7 + F.substring(date, 10, 1).cast("int") - 1 - F.weekday(fourth))
    day = F.when(date.rlike("^[0-9]{4}-[0-9]{3}$"), ordinal).when(date.rlike("^[0-9]{4}-W[0-9]{2}-[1-7]$"), week).when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(date))
    parts = F.split(F.when(clock == "", F.lit("0")).otherwise(clock), ":")
    part = lambda i: F.coalesce(F.get(parts, i).cast("decimal(20,6)"), F.lit(0))
    seconds = part(0) * 3600 + part(1) * 60 + part(2)
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + (seconds * 1000000).cast("long"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    """An instant some seconds later, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1000000).cast("long"))


# Patterns in which data centres write instants.
INSTANT_FORMATS = {
    "seed": "yyyy,DDD,HH:mm:ss.SSSS",
    "fissures": "yyyyDDD'T'HHmmss.SSSS'Z'",
    "arclink": "yyyy,M,d,H,m,s,",
    "seedlink": "yyyy,M,d,H,m,s",
    "iris": "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def format_instant(ts: Column, style: str) -> Column:
    """An instant as text; fractions are cut. ``seed`` leaves out midnight, ``seed_compact`` all that is zero at the end."""
    if style == "seed_compact":
        micro, second, minute = F.unix_micros(ts) % 1000000, F.second(ts), F.minute(ts)
        part = lambda pattern: F.date_format(ts, pattern)
        return F.when(micro > 0, part(INSTANT_FORMATS["seed"])).when(second > 0, part("yyyy,DDD,HH:mm:ss")).when(minute > 0, part("yyyy,DDD,HH:mm")).when(F.hour(ts) > 0, part("yyyy,DDD,HH")).otherwise(part("yyyy,DDD"))
    out = F.date_format(ts, INSTANT_FORMATS[style])
    if style == "seed":
        return F.when(F.unix_micros(ts) % 86_400_000_000 == 0, F.date_format(ts, "yyyy,DDD")).otherwise(out)
    return F.concat(out, (F.unix_micros(ts) % 1000000).cast("string")) if style == "arclink" else out


# The usual sampling rate of each band code of a channel.
BAND_RATES = {"F": 1000.0, "G": 1000.0, "D": 250.0, "C": 250.0, "E": 80.0, "S": 10.0, "H": 80.0, "B": 10.0, "M": 1.0, "L": 1.0, "V": 0.1, "U": 0.01, "R": 0.0001, "P": 1e-6, "T": 1e-7, "Q": 1e-8}


def band_delta(channel: Column) -> Column:
    """Seconds between samples that a channel code suggests; 0 where it says nothing."""
    rates = F.create_map(*[F.lit(x) for kv in BAND_RATES.items() for x in kv])
    return F.coalesce(1 / F.try_element_at(rates, F.left(channel, F.lit(1))), F.lit(0.0))


def power_of_two(n: Column, which: str) -> Column:
    """The previous, next or nearest (of equally near, the previous) power of two of a positive integer."""
    low = F.pow(F.lit(2.0), F.length(F.bin(n.cast("long"))) - 1).cast("long")
    high = F.when(low == n, low).otherwise(low * 2)
    return {"previous": low, "next": high}.get(which, F.when(high - n < n - low, high).otherwise(low))


def prime_factors(x: Column) -> Column:
    """Prime factors of a whole number from 1 on, rising; [1] of 1. Its work grows with the root of the number."""
    whole = x.cast("long")
    start = F.struct(whole.alias("rest"), F.array().cast("array<bigint>").alias("found"))

    def divided(state: Column, d: Column) -> Column:
        times = F.floor(F.log2(F.greatest(state["rest"], F.lit(1))) / F.log2(d)).cast("int") + 1

        def once(s: Column, _: Column) -> Column:
            hit = s["rest"] % d == 0
            return F.struct(F.when(hit, F.floor(s["rest"] / d)).otherwise(s["rest"]).cast("long").alias("rest"), F.when(hit, F.concat(s["found"], F.array(d))).otherwise(s["found"]).alias("found"))

        return F.when(state["rest"] % d == 0, F.aggregate(F.sequence(F.lit(1), times), state, once)).otherwise(state)

    root = F.floor(F.sqrt(whole.cast("double"))).cast("long")
    tried = F.when(root >= 2, F.sequence(F.lit(2).cast("long"), root)).otherwise(F.array().cast("array<bigint>"))
    rest = lambda s: F.when(s["rest"] > 1, F.concat(s["found"], F.array(s["rest"]))).otherwise(s["found"])
    return F.when(whole == 1, F.array(F.lit(1).cast("long"))).otherwise(F.aggregate(tried, start, divided, rest))


def transform_length(samples: Column, most: int = 500, tries: int = 10) -> Column:
    """Samples of a transform that does not wrap: twice the (even) number; where that is over 5000 and has a prime factor of ``most`` or more, the
    first of the next ``tries`` even numbers without one, else the next power of two.
    """
    twice = (2 * (samples + samples % 2)).cast("long")
    smooth = lambda n: F.array_max(prime_factors(n)) < most
    other = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: twice + 2 * i), smooth), F.lit(0))
    return F.when((twice <= 5000) | smooth(twice), twice).otherwise(F.coalesce(other, next_power_of_two(twice)))
