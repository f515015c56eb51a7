"""Station and event trees as XML: nested schemas that Spark's XML source reads, and keyed tables by level.

A tree is a struct per element of its root (a network, an event). Reading takes the schema as it stands, so Spark neither samples
the files nor parses what is not asked for; each level below is an explode of the one above, and carries the keys of all levels.
Writing nests the tables again. A network of many stations, and an event of many picks, become several elements with the same
code or name, so that no row outgrows a task; reading joins them by key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob
from ..operators.segments import active

#: Stations of a network element.
STATIONS = 1000

# Elements and attributes (with _) of the station format.
_STAGE = "struct<_number: int, PolesZeros: struct<InputUnits: struct<Name: string>, OutputUnits: struct<Name: string>, NormalizationFactor: double, Zero: array<struct<_number: int, Real: double, Imaginary: double>>, Pole: array<struct<_number: int, Real: double, Imaginary: double>>>, StageGain: struct<Value: double, Frequency: double>>"
_CHANNEL = f"struct<_code: string, _locationCode: string, _startDate: timestamp, _endDate: timestamp, Latitude: double, Longitude: double, Elevation: double, Depth: double, Azimuth: double, Dip: double, SampleRate: double, Response: struct<InstrumentSensitivity: struct<Value: double, Frequency: double, InputUnits: struct<Name: string>>, Stage: array<{_STAGE}>>>"
_STATION = f"struct<_code: string, _startDate: timestamp, _endDate: timestamp, Latitude: double, Longitude: double, Elevation: double, Site: struct<Name: string>, Channel: array<{_CHANNEL}>>"
NETWORK = f"_code string, _startDate timestamp, _endDate timestamp, Description string, Station array<{_STATION}>"


def _exploded(df: DataFrame, column: str, keep: list[str | Column]) -> DataFrame:
    return df.select(*keep, F.explode(column).alias("_e"))


def read_station_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables networks, stations, channels, stages and poles of station XML; elements without a code give no row.

    The key of a channel is network, station, start of the station, location, channel and start of the channel.
    """
    root = spark.read.format("xml").option("rowTag", "Network").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").schema(NETWORK).load(path).where("_code IS NOT NULL")
    networks = root.groupBy(F.col("_code").alias("network")).agg(F.min("_startDate").alias("start"), F.max("_endDate").alias("end"), F.max("Description").alias("description"), F.sum(F.coalesce(F.size("Station"), F.lit(0))).alias("stations"))
    held = _exploded(root, "Station", [F.col("_code").alias("network")]).where("_e._code IS NOT NULL")
    key = ["network", F.col("_e._code").alias("station"), F.col("_e._startDate").alias("station_start")]
    at = lambda *names: [F.col(f"_e.{n}").alias(n.lower()) for n in names]
    stations = held.select(*key, F.col("_e._endDate").alias("station_end"), *at("Latitude", "Longitude", "Elevation"), F.col("_e.Site.Name").alias("site"))
    parts = _exploded(held, "_e.Channel", key).where("_e._code IS NOT NULL")
    own = ["network", "station", "station_start", F.coalesce("_e._locationCode", F.lit("")).alias("location"), F.col("_e._code").alias("channel"), F.col("_e._startDate").alias("start")]
    gain = F.col("_e.Response.InstrumentSensitivity")
    channels = parts.select(
        *own, F.col("_e._endDate").alias("end"), *at("Latitude", "Longitude", "Elevation", "Depth", "Azimuth", "Dip"), F.col("_e.SampleRate").alias("rate"), gain["Value"].alias("sensitivity"), gain["Frequency"].alias("frequency"), gain["InputUnits"]["Name"].alias("units")
    )
    names = ["network", "station", "station_start", "location", "channel", "start"]
    staged = _exploded(parts, "_e.Response.Stage", own)
    stages = staged.select(*names, F.col("_e._number").alias("stage"), F.col("_e.StageGain.Value").alias("gain"), F.col("_e.StageGain.Frequency").alias("gain_frequency"), F.col("_e.PolesZeros.NormalizationFactor").alias("factor"))
    roots = [_exploded(staged, f"_e.PolesZeros.{kind}", [*names, F.col("_e._number").alias("stage"), F.lit(kind.lower()).alias("kind")]) for kind in ("Pole", "Zero")]
    poles = roots[0].union(roots[1]).select(*names, "stage", "kind", F.col("_e._number").alias("number"), F.col("_e.Real").alias("re"), F.col("_e.Imaginary").alias("im"))
    return {"networks": networks, "stations": stations, "channels": channels, "stages": stages, "poles": poles}


def _listed(rows: DataFrame, keys: list[str], element: Column, order: list[str], name: str) -> DataFrame:
    """One sorted array of elements for each key."""
    place = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], element.alias("_v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["_v"]).alias(name))


def write_station_xml(stations: DataFrame, channels: DataFrame, stages: DataFrame, poles: DataFrame, path: str) -> None:
    """The tables that ``read_station_xml`` gives, as station XML; channels of stations that are not there are left out."""
    names = ["network", "station", "station_start", "location", "channel", "start"]
    place = F.struct(F.col("number").alias("_number"), F.col("re").alias("Real"), F.col("im").alias("Imaginary"))
    of = lambda kind, name: _listed(poles.where(F.col("kind") == kind), [*names, "stage"], place, ["number"], name)
    full = stages.join(of("zero", "_zeros"), [*names, "stage"], "left").join(of("pole", "_poles"), [*names, "stage"], "left")
    rational = F.struct(F.col("factor").alias("NormalizationFactor"), F.col("_zeros").alias("Zero"), F.col("_poles").alias("Pole"))
    stage = F.struct(F.col("stage").alias("_number"), F.when(F.col("factor").isNotNull(), rational).alias("PolesZeros"), F.struct(F.col("gain").alias("Value"), F.col("gain_frequency").alias("Frequency")).alias("StageGain"))
    held = channels.join(_listed(full, names, stage, ["stage"], "_stages"), names, "left")
    response = F.struct(F.struct(F.col("sensitivity").alias("Value"), F.col("frequency").alias("Frequency"), F.struct(F.col("units").alias("Name")).alias("InputUnits")).alias("InstrumentSensitivity"), F.col("_stages").alias("Stage"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    upper = lambda *cs: [F.col(c).alias(c.capitalize()) for c in cs]
    channel = F.struct(
        F.col("channel").alias("_code"), F.col("location").alias("_locationCode"), time("start").alias("_startDate"), time("end").alias("_endDate"), *upper("latitude", "longitude", "elevation", "depth", "azimuth", "dip"), F.col("rate").alias("SampleRate"), response.alias("Response")
    )
    tree = stations.join(_listed(held, names[:3], channel, ["location", "channel", "start"], "_channels"), names[:3], "left")
    station = F.struct(
        F.col("station").alias("_code"), time("station_start").alias("_startDate"), time("station_end").alias("_endDate"), *upper("latitude", "longitude", "elevation"), F.struct(F.col("site").alias("Name")).alias("Site"), F.col("_channels").alias("Channel")
    )
    counts = tree.groupBy("network").agg(F.ceil(F.count("*") / STATIONS).alias("_parts"), F.min("station_start").alias("_from"), F.when(F.count("*") == F.count("station_end"), F.max("station_end")).alias("_to"))
    tree = tree.join(counts, "network").withColumn("_part", F.pmod(F.xxhash64("station"), "_parts"))
    nested = _listed(tree, ["network", "_from", "_to", "_part"], station, ["station", "station_start"], "Station")
    rows = nested.select(F.col("network").alias("_code"), time("_from").alias("_startDate"), time("_to").alias("_endDate"), "Station")
    rows.write.format("xml").option("rootTag", "FDSNStationXML").option("rowTag", "Network").save(path)


def select_inventory(tables: dict[str, DataFrame], network: str = "*", station: str = "*", location: str = "*", channel: str = "*", time: Column | None = None, keep_empty: bool = False, remove: bool = False) -> dict[str, DataFrame]:
    """The part of an inventory (tables as ``read_station_xml`` gives them) that codes with wildcards and a time choose, level by level.

    A network or station stands if it matches and, unless ``keep_empty``, if a station or channel below it does. With ``remove`` the
    chosen channels go, or all of a station if only its code and the network's are given, and what is then empty goes too.
    """
    held = lambda start, end: (F.lit(True) if time is None else active(F.col(start), F.col(end), time))
    keys = ["network", "station", "station_start"]
    stations = tables["stations"].where(glob(F.col("network"), network) & glob(F.col("station"), station) & held("station_start", "station_end"))
    channels = tables["channels"].join(stations.select(*keys), keys, "left_semi").where(glob(F.col("location"), location) & glob(F.col("channel"), channel) & held("start", "end"))
    names = [*keys, "location", "channel", "start"]
    if remove:
        if channel == location == "*":
            channels = tables["channels"].join(stations.select(*keys), keys, "left_anti")
        else:
            channels = tables["channels"].join(channels.select(*names), names, "left_anti")
        stations = tables["stations"] if channel != "*" or location != "*" else tables["stations"].join(stations.select(*keys), keys, "left_anti")
    if not keep_empty:
        stations = stations.join(channels.select(*keys), keys, "left_semi")
    networks = tables["networks"].where(glob(F.col("network"), network)) if not remove else tables["networks"]
    networks = networks if keep_empty else networks.join(stations.select("network"), "network", "left_semi")
    parts = {name: tables[name].join(channels.select(*names), names, "left_semi") for name in ("stages", "poles")}
    return {"networks": networks, "stations": stations, "channels": channels} | parts


# Elements and attributes of the event format.
_VALUE, _WHEN = "struct<value: double, uncertainty: double>", "struct<value: string, uncertainty: double>"
_STREAM = "struct<_networkCode: string, _stationCode: string, _locationCode: string, _channelCode: string>"
_ARRIVAL = "struct<_publicID: string, pickID: string, phase: string, azimuth: double, distance: double, timeResidual: double>"
_ORIGIN = f"struct<_publicID: string, time: {_WHEN}, latitude: {_VALUE}, longitude: {_VALUE}, depth: {_VALUE}, evaluationMode: string, arrival: array<{_ARRIVAL}>>"
_MAGNITUDE = f"struct<_publicID: string, mag: {_VALUE}, type: string, originID: string>"
_PICK = f"struct<_publicID: string, time: {_WHEN}, waveformID: {_STREAM}, phaseHint: string, polarity: string>"
_PLANES = f"struct<nodalPlane1: struct<strike: {_VALUE}, dip: {_VALUE}, rake: {_VALUE}>, nodalPlane2: struct<strike: {_VALUE}, dip: {_VALUE}, rake: {_VALUE}>>"
_MECHANISM = f"struct<_publicID: string, nodalPlanes: {_PLANES}, momentTensor: struct<scalarMoment: {_VALUE}>>"
EVENT = f"_publicID string, preferredOriginID string, preferredMagnitudeID string, preferredFocalMechanismID string, type string, description array<struct<text: string, type: string>>, origin array<{_ORIGIN}>, magnitude array<{_MAGNITUDE}>, pick array<{_PICK}>, focalMechanism array<{_MECHANISM}>"


def _events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "event").schema(EVENT).load(path).where("_publicID IS NOT NULL")


def read_preferred(spark: SparkSession, path: str) -> DataFrame:
    """(event, text, mag, strike, rake, moment): each description of an event with its preferred magnitude and mechanism, if they are there.

    It takes elements that hold a whole event, as ``write_events`` and ``write_event_tree`` write them, so that nothing is joined.
    """
    wanted = lambda name, first: F.try_element_at(F.filter(name, lambda x: x["_publicID"] == F.col(first)), F.lit(1))
    held = _events(spark, path).select(
        F.col("_publicID").alias("event"), F.explode("description").alias("_d"), wanted("magnitude", "preferredMagnitudeID").alias("_m"), wanted("focalMechanism", "preferredFocalMechanismID").alias("_f")
    )
    plane = lambda n: F.col(f"_f.nodalPlanes.nodalPlane1.{n}.value").alias(n)
    return held.select("event", "_d.text", F.col("_m.mag.value").alias("mag"), plane("strike"), plane("rake"), F.col("_f.momentTensor.scalarMoment.value").alias("moment"))


def read_event_tree(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables events, descriptions, origins, arrivals, magnitudes, picks and mechanisms of event XML; depths in meters, as there.

    located holds the arrivals with all of the origin that they lie in, as a join of both would, where an origin is one element.
    """
    root = _events(spark, path)
    key = F.col("_publicID").alias("event")
    instant = lambda c: F.to_timestamp(F.regexp_replace(c, "Z$", ""))
    part = lambda c: _exploded(root, c, [key])
    value = lambda *names: [F.col(f"_e.{n}.value").alias(n) for n in names]
    first = {f"preferred{kind}ID": name for kind, name in (("Origin", "preferred_origin"), ("Magnitude", "preferred_magnitude"), ("FocalMechanism", "preferred_mechanism"))}
    events = root.groupBy(key).agg(*[F.max(c).alias(n) for c, n in first.items()], F.max("type").alias("type"))
    place = [F.col("_e._publicID").alias("origin"), instant(F.col("_e.time.value")).alias("time"), *value("latitude", "longitude", "depth"), F.col("_e.depth.uncertainty").alias("depth_error"), F.col("_e.evaluationMode").alias("mode")]
    arrived = [F.col("_e.pickID").alias("pick"), "_e.phase", "_e.azimuth", "_e.distance", F.col("_e.timeResidual").alias("residual")]
    origins = part("origin").select("event", *place)
    arrivals = _exploded(part("origin"), "_e.arrival", ["event", F.col("_e._publicID").alias("origin")])
    located = _exploded(part("origin"), "_e.arrival", ["event", *place])
    plane = lambda i: [F.col(f"_e.nodalPlanes.nodalPlane{i}.{n}.value").alias(f"{n}{i}") for n in ("strike", "dip", "rake")]
    return {
        "events": events,
        "descriptions": part("description").select("event", "_e.text", F.col("_e.type").alias("kind")),
        "origins": origins,
        "arrivals": arrivals.select("event", "origin", *arrived),
        "located": located.select("event", *origins.columns[1:], *arrived),
        "magnitudes": part("magnitude").select("event", F.col("_e._publicID").alias("magnitude"), F.col("_e.mag.value").alias("mag"), "_e.type", F.col("_e.originID").alias("origin")),
        "picks": part("pick").select("event", F.col("_e._publicID").alias("pick"), instant(F.col("_e.time.value")).alias("time"), F.col("_e.waveformID._networkCode").alias("network"), F.col("_e.waveformID._stationCode").alias("station"), F.col("_e.phaseHint").alias("phase"), "_e.polarity"),
        "mechanisms": part("focalMechanism").select("event", F.col("_e._publicID").alias("mechanism"), *plane(1), *plane(2), F.col("_e.momentTensor.scalarMoment.value").alias("moment")),
    }


def _one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c.alias("value")))


def _moment(c: Column) -> Column:
    return F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("value"))


#: The element of a row of each table of ``read_event_tree``; its columns are given by name.
ELEMENTS: dict[str, Callable[[Mapping[str, Column]], Column]] = {
    "descriptions": lambda c: F.struct(c["text"].alias("text"), c["kind"].alias("type")),
    "arrivals": lambda c: F.struct(F.concat_ws("/", c["origin"], c["pick"]).alias("_publicID"), c["pick"].alias("pickID"), *[c[n].alias(n) for n in ("phase", "azimuth", "distance")], c["residual"].alias("timeResidual")),
    "origins": lambda c: F.struct(
        c["origin"].alias("_publicID"),
        _moment(c["time"]).alias("time"),
        *[_one(c[n]).alias(n) for n in ("latitude", "longitude")],
        (F.when(c["depth"].isNotNull(), F.struct(c["depth"].alias("value"), c["depth_error"].alias("uncertainty"))) if "depth_error" in c else _one(c["depth"])).alias("depth"),
        *([c["mode"].alias("evaluationMode")] if "mode" in c else []),
        *([c["_arrivals"].alias("arrival")] if "_arrivals" in c else []),
    ),
    "magnitudes": lambda c: F.struct(c["magnitude"].alias("_publicID"), _one(c["mag"]).alias("mag"), c["type"].alias("type"), c["origin"].alias("originID")),
    "picks": lambda c: F.struct(c["pick"].alias("_publicID"), _moment(c["time"]).alias("time"), F.struct(c["network"].alias("_networkCode"), c["station"].alias("_stationCode")).alias("waveformID"), c["phase"].alias("phaseHint"), c["polarity"].alias("polarity")),
    "mechanisms": lambda c: F.struct(
        c["mechanism"].alias("_publicID"),
        F.struct(*[F.struct(*[_one(c[f"{n}{i}"]).alias(n) for n in ("strike", "dip", "rake")]).alias(f"nodalPlane{i}") for i in (1, 2)]).alias("nodalPlanes"),
        F.struct(_one(c["moment"]).alias("scalarMoment")).alias("momentTensor"),
    ),
}


def write_event_tree(tables: dict[str, DataFrame], path: str) -> None:
    """The tables that ``read_event_tree`` gives (only events need be there) as event XML; children of no event are left out."""
    out = tables["events"]
    order = {"descriptions": "text", "origins": "origin", "magnitudes": "magnitude", "picks": "pick", "mechanisms": "mechanism"}
    for name in (n for n in order if n in tables):
        rows = tables[name]
        if name == "origins" and "arrivals" in tables:
            arrivals = tables["arrivals"]
            rows = rows.join(_listed(arrivals, ["event", "origin"], ELEMENTS["arrivals"]({c: F.col(c) for c in arrivals.columns}), ["pick"], "_arrivals"), ["event", "origin"], "left")
        out = out.join(_listed(rows, ["event"], ELEMENTS[name]({c: F.col(c) for c in rows.columns}), [order[name]], name), "event", "left")
    write_events(out, path)


def write_events(events: DataFrame, path: str) -> None:
    """Events as event XML, packed and without indents; their children are arrays of elements (``ELEMENTS``) in columns named as the tables of ``read_event_tree``."""
    lists = {"descriptions": "description", "origins": "origin", "magnitudes": "magnitude", "picks": "pick", "mechanisms": "focalMechanism"}
    first = {"preferred_origin": "preferredOriginID", "preferred_magnitude": "preferredMagnitudeID", "preferred_mechanism": "preferredFocalMechanismID"}
    named = lambda names: [F.col(c).alias(n) for c, n in names.items() if c in events.columns]
    rows = events.select(F.col("event").alias("_publicID"), *named(first), "type", *named(lists))
    rows.write.format("xml").option("rootTag", "eventParameters").option("rowTag", "event").option("compression", "gzip").option("indent", "").save(path)
