"""Readers: schedule files by header, date-partitioned JSON, optional Parquet, nested feeds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.numbers import lookup
from ..functions.times import epoch_to_timestamp


def read_csv_by_header(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV columns found by header name, in any order that may differ from file to file; declared columns a file lacks are NULL.

    Only header lines are read ahead, to put the declared types in file order. Files of one order are read together.
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    options = {"header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "escape": '"', "multiLine": False}
    types = {f.name: f.dataType for f in declared.fields}
    orders: dict[tuple[str, ...], list[str]] = {}
    for file in spark.read.text(path).inputFiles():  # a schedule comes as a handful of files
        orders.setdefault(tuple(spark.read.options(**options).csv(file).columns), []).append(file)
    parts = []
    for header, files in orders.items():
        in_file = T.StructType([T.StructField(c, types.get(c.strip().lstrip("﻿"), T.StringType())) for c in header])
        rows = spark.read.options(**options).schema(in_file).csv(files)
        names = {c.strip().lstrip("﻿"): c for c in header}
        parts.append(rows.select(*[(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
                                   for f in declared.fields]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], declared)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def partition_date() -> Column:
    return F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))


def read_recent_json(spark: SparkSession, base: str, schema: str, today: str, days: int = 7,
                     partitions: str = "year string, month string, day string") -> DataFrame | None:
    """The last N days of date-partitioned JSON lines, read from the folders of those days only; None without data."""
    last = date.fromisoformat(today)
    wanted = [last - timedelta(days=k) for k in range(days)]
    folders = [f"{base}/year={d:%Y}/month={d:%m}/day={d:%d}" for d in wanted]
    folders = [f for f in folders if _exists(spark, f)]
    if not folders:
        return None
    recent = spark.read.schema(f"{schema}, {partitions}").option("ignoreMissingFiles", True).option("basePath", base).json(folders)
    return None if recent.isEmpty() else recent


def read_day_json(spark: SparkSession, base: str, schema: str, day: str, partitions: str = "year string, month string, day string") -> DataFrame | None:
    return read_recent_json(spark, base, schema, day, 1, partitions)


def read_parquet_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Parquet rows, or None when the path is missing or empty."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        rows = reader.parquet(path)
    except AnalysisException:
        return None
    return None if rows.isEmpty() else rows


# ---- feeds -------------------------------------------------------------------


def flatten_feed(entities: DataFrame) -> DataFrame:
    """One row per stop update of each entity with a trip update, in list order; entities without stops keep one row."""
    trips = entities.filter(F.col("tripUpdate").isNotNull())
    u = "tripUpdate"
    exploded = trips.select("id", F.col(f"{u}.trip.tripId").alias("trip_id"), F.upper(F.col(f"{u}.trip.routeId")).alias("route_id"),
                            F.col(f"{u}.trip.startDate").alias("start_date"), F.col(f"{u}.vehicle.id").alias("vehicle_id"),
                            epoch_to_timestamp(f"{u}.timestamp").alias("feed_time"),
                            F.posexplode_outer(f"{u}.stopTimeUpdate").alias("seq", "s"))
    return exploded.select(
        "id", "trip_id", "route_id", "start_date", "vehicle_id", "feed_time", "seq", F.col("s.stopId").alias("stop_id"), F.col("s.stopName").alias("stop_name"),
        epoch_to_timestamp("s.arrival.time").alias("arrival_time"), F.col("s.arrival.delay").alias("arrival_delay"),
        epoch_to_timestamp("s.departure.time").alias("departure_time"), F.col("s.departure.delay").alias("departure_delay"),
        F.coalesce("s.scheduleRelationship", F.when(F.col("s").isNotNull(), "SCHEDULED")).alias("schedule_relationship"))


def parse_alerts(entities: DataFrame, routes: Sequence[str], severities: dict[str, str], now: Column) -> DataFrame:
    """Service alerts that touch known routes: text by language, severity by type, periods as timestamps."""
    informed = F.col("alert.informed_entity")
    upper = F.transform(informed, lambda e: F.upper(e["route_id"]))
    known = F.array(*[F.lit(x) for x in routes])
    touched = F.filter(upper, lambda x: x.isNotNull() & F.array_contains(known, x))
    stops = F.filter(F.transform(informed, lambda e: e["stop_id"]), lambda x: x.isNotNull() & (x != ""))
    extra = F.col("`transit_realtime.mercury_alert`")
    kind = F.coalesce(extra["alert_type"], F.lit("Information"))

    def stamp(c):
        return F.coalesce(F.when(c != 0, F.timestamp_seconds(c)), now)

    periods = F.transform(F.coalesce("alert.active_period", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda p: F.struct(
        stamp(p["start"]).alias("start"), F.when(p["end"] != 0, F.timestamp_seconds(p["end"])).alias("end")))
    out = entities.filter(F.col("alert").isNotNull()).select(
        F.col("id").alias("alert_id"), kind.alias("alert_type"), lookup(severities, kind, F.lit("info")).alias("severity"),
        text.preferred_text("alert.header_text.translation").alias("header_text"),
        text.preferred_text("alert.description_text.translation", True).alias("description_html"),
        F.coalesce(touched, F.array().cast("array<string>")).alias("affected_routes"),
        F.coalesce(stops, F.array().cast("array<string>")).alias("affected_stops"), periods.alias("active_periods"),
        stamp(extra["created_at"]).alias("created_at"), stamp(extra["updated_at"]).alias("updated_at"))
    return out.filter(F.size("affected_routes") > 0)


def parse_outages(outages: DataFrame, now: Column) -> DataFrame:
    """Typed equipment outages; unreadable dates count as now, days out never go below 0."""
    fmt = "MM/dd/yyyy hh:mm:ss a"

    def stamp(c):
        return F.coalesce(F.try_to_timestamp(F.col(c), F.lit(fmt)), now)

    start = stamp("outagedate")
    days = F.floor((F.unix_micros(now) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("bigint")
    return outages.select(
        F.col("equipment").alias("equipment_id"), "station", F.transform(F.split("trainno", "/"), lambda x: F.trim(x)).alias("routes"),
        F.when(F.col("equipmenttype") == "EL", "elevator").otherwise("escalator").alias("kind"), "serving",
        (F.col("ADA") == "Y").alias("is_ada"), start.alias("outage_start"), stamp("estimatedreturntoservice").alias("estimated_return"), "reason",
        (F.col("isupcomingoutage") == "Y").alias("is_upcoming"), (F.col("ismaintenanceoutage") == "Y").alias("is_maintenance"),
        F.greatest(F.lit(0), days).alias("days_out"))


def news_items(feeds: DataFrame, key: str, body: str, item: str = "item", title: str = "title", description: str = "description",
               per_feed: int = 5, cut: int = 100) -> DataFrame:
    """Items of each feed's markup: title and shortened description, tags stripped; items without title are left out."""
    def inner(tag: str) -> str:
        return rf"(?s)<{tag}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>"

    found = F.slice(F.regexp_extract_all(F.col(body), F.lit(rf"(?s)<{item}(?:\s[^>]*)?>.*?</{item}>"), F.lit(0)), 1, per_feed)
    items = feeds.select(key, F.posexplode(found).alias("pos", "_item"))
    kept = items.filter(F.regexp_like("_item", F.lit(inner(title))))
    plain = F.trim(F.substring(text.strip_tags(F.regexp_extract("_item", inner(description), 1)), 1, cut))
    return kept.select(key, "pos", F.trim(text.strip_tags(F.regexp_extract("_item", inner(title), 1))).alias("title"),
                       F.when(F.regexp_like("_item", F.lit(inner(description))), plain).alias("description"))


# Weather codes and their texts.
WEATHER_CODES = {
    0: "clear skies", 1: "mostly clear", 2: "partly cloudy", 3: "overcast", 45: "foggy", 48: "freezing fog",
    51: "light drizzle", 53: "drizzle", 55: "heavy drizzle", 61: "light rain", 63: "rain", 65: "heavy rain",
    66: "freezing rain", 67: "heavy freezing rain", 71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains",
    80: "light showers", 81: "showers", 82: "heavy showers", 85: "light snow showers", 86: "heavy snow showers",
    95: "thunderstorms", 96: "thunderstorms with hail", 99: "severe thunderstorms",
}


def weather_rows(reports: DataFrame, key: str, first: int = 2, count: int = 5) -> DataFrame:
    """Parallel daily arrays (time, high, low, code) to one row per day, from the second day on."""
    rows = reports.select(key, F.inline(F.slice(F.arrays_zip("time", "high", "low", "code"), first, count)))
    return rows.select(key, F.col("time").alias("date"), F.date_format("time", "EEEE").alias("day"),
                       F.floor(F.col("high") + 0.5).alias("high"), F.floor(F.col("low") + 0.5).alias("low"),
                       lookup(WEATHER_CODES, "code", F.lit("variable conditions")).alias("description"))
