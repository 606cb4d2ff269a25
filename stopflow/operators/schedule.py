"""Static-schedule statistics: headways, busiest stations, duration matrix, segments, boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import js_round_long
from ..functions.times import minutes_to_clock
from ..session import cut_lineage
from .joins import join_aggregate
from .ordered import _match, latest_per_key, top_per_key, with_position_of_many, with_previous, with_previous_of_many


def schedule_stats(stop_times: DataFrame, trips: DataFrame, service_id: str, max_headway: int = 120,
                   order: Sequence[str] = ("stop_sequence",)) -> DataFrame:
    """Per route and direction for one service day: mean headway, first and last train, trips, mean length."""
    day = trips.filter(F.col("service_id") == service_id).select("trip_id", "route_id", "direction_id", "headsign")
    at = F.struct(*order)
    ends = stop_times.groupBy("trip_id").agg(
        F.min_by("departure_seconds", at).alias("_start"), F.max_by("arrival_seconds", at).alias("_end"),
        F.count("*").alias("_stops"))
    runs = ends.join(day, "trip_id").select(
        "trip_id", "route_id", "direction_id", "headsign", "_stops", F.floor(F.col("_start") / 60).alias("_m"),
        (F.floor(F.col("_end") / 60) - F.floor(F.col("_start") / 60)).alias("_len"))
    keys = ["route_id", "direction_id"]
    # Equal start minutes give a headway of 0, which is ignored: distinct minutes are enough, and few.
    starts = runs.select(*keys, "_m").distinct()
    gap = F.col("_m") - F.lag("_m").over(Window.partitionBy(*keys).orderBy("_m"))
    spaced = starts.withColumn("_h", gap).groupBy(*keys).agg(
        F.coalesce(js_round_long(F.avg(F.when((F.col("_h") > 0) & (F.col("_h") < max_headway), F.col("_h")))), F.lit(0)).alias("avg_headway_minutes"))
    totals = runs.groupBy(*keys).agg(
        F.min_by("headsign", F.when(F.col("headsign").isNotNull(), F.col("trip_id"))).alias("headsign"), minutes_to_clock(F.min("_m")).alias("first_train"),
        minutes_to_clock(F.max("_m")).alias("last_train"), F.count("*").alias("trips_per_day"),
        js_round_long(F.avg("_len")).alias("avg_duration_minutes"), js_round_long(F.avg("_stops")).alias("stop_count"))
    return _match(totals, spaced, keys)


def busiest_stations(stop_times: DataFrame, trips: DataFrame, service_id: str, k: int = 20) -> DataFrame:
    """Top stations by visits, with their sorted routes; route lists are bounded by the route table."""
    day = trips.filter(F.col("service_id") == service_id).select("trip_id", "route_id")
    visits = (stop_times.select("trip_id", text.parent_stop("stop_id").alias("stop_id")).join(day, "trip_id")
              .groupBy("stop_id", "route_id").agg(F.count("*").alias("_n")))
    return (visits.groupBy("stop_id").agg(F.sum("_n").alias("daily_trains"), F.array_sort(F.collect_list("route_id")).alias("routes"))
            .orderBy(F.desc("daily_trains"), "stop_id").limit(k))


def stop_steps(stop_times: DataFrame, order: Sequence[str] = ("stop_sequence",), segment: Column | None = None) -> DataFrame:
    """Each stop of a trip with the next one and the seconds between; past-midnight steps are repaired.

    Trips are shuffled whole; one of more than ``ordered.HEAVY_ROWS`` rows is cut by ``segment``.
    """
    block = F.floor(F.col(order[0]) / 1000) if segment is None else segment
    steps = with_previous_of_many(stop_times, ["trip_id"], list(order), {"next_stop": "stop_id", "next_arrival": "arrival_seconds"},
                                  block, following=True)
    seconds = F.col("next_arrival") - F.col("departure_seconds")
    return steps.filter(F.col("next_stop").isNotNull()).withColumn(
        "step_seconds", F.when(seconds < 0, seconds + 86400).otherwise(seconds))


def duration_matrix(steps: DataFrame, trips: DataFrame, max_seconds: int = 1800) -> DataFrame:
    """Mean seconds per route and stop pair, for steps in (0, max]."""
    valid = steps.filter((F.col("step_seconds") > 0) & (F.col("step_seconds") <= max_seconds))
    per_trip = valid.select("trip_id", F.col("stop_id").alias("from_stop"), F.col("next_stop").alias("to_stop"), "step_seconds")
    return (per_trip.join(trips.select("trip_id", "route_id"), "trip_id").groupBy("route_id", "from_stop", "to_stop")
            .agg(js_round_long(F.avg("step_seconds")).alias("seconds"), F.count("*").alias("n")))


def common_patterns(stop_times: DataFrame, trips: DataFrame, order: Sequence[str] = ("stop_sequence",), min_stops: int = 1,
                    segment: Column | None = None) -> DataFrame:
    """Stops, in order, of the most frequent stop pattern per route and direction.

    A trip's pattern is identified by its length and two order-aware hashes that combine row by
    row, so no trip is ever held as a list. Ties go to the pattern with the lowest trip id. Once the patterns are chosen, the stops
    of their trips alone are read again.
    """
    block = F.floor(F.col(order[0]) / 1000) if segment is None else segment
    parented = stop_times.select("trip_id", *order, text.parent_stop("stop_id").alias("stop_id"))
    placed = with_position_of_many(parented, ["trip_id"], list(order), block)
    signed = placed.groupBy("trip_id").agg(
        F.count("*").alias("n_stops"), F.bit_xor(F.xxhash64("position", "stop_id")).alias("_h1"),
        F.bit_xor(F.xxhash64("stop_id", "position", F.lit("second"))).alias("_h2"))
    keys = ["route_id", "direction_id"]
    runs = signed.filter(F.col("n_stops") >= min_stops).join(trips.select("trip_id", *keys), "trip_id")
    patterns = runs.groupBy(*keys, "n_stops", "_h1", "_h2").agg(F.count("*").alias("n_trips"), F.min("trip_id").alias("trip_id"))
    best = patterns.groupBy(*keys).agg(F.min_by(F.struct("trip_id", "n_trips", "n_stops"),
                                                F.struct(-F.col("n_trips"), F.col("trip_id"))).alias("_b"))
    chosen = best.select(*keys, "_b.trip_id", "_b.n_trips")
    listed = join_aggregate(parented, chosen, ["trip_id"], "inner")
    return cut_lineage(with_position_of_many(listed, [*keys, "trip_id"], list(order), block).select(*keys, "n_trips", "position", "stop_id"))


def route_segments(patterns: DataFrame, steps: DataFrame, trips: DataFrame, max_seconds: int = 1800) -> DataFrame:
    """Edges of each pattern with the mean seconds over all trips of the route and direction."""
    keys = ["route_id", "direction_id"]
    led = with_previous(patterns, keys, ["position"], {"to_stop": "stop_id"}, F.floor(F.col("position") / 100_000), following=True)
    edges = led.filter(F.col("to_stop").isNotNull()).withColumnRenamed("stop_id", "from_stop")
    valid = steps.filter((F.col("step_seconds") > 0) & (F.col("step_seconds") <= max_seconds)).select(
        "trip_id", text.parent_stop("stop_id").alias("from_stop"), text.parent_stop("next_stop").alias("to_stop"), "step_seconds")
    means = valid.join(trips.select("trip_id", *keys), "trip_id").groupBy(*keys, "from_stop", "to_stop").agg(
        js_round_long(F.avg("step_seconds")).alias("seconds"))
    return edges.join(means, [*keys, "from_stop", "to_stop"])


def station_routes(stops: DataFrame, express: str = "X$") -> DataFrame:
    """Sorted routes per parent station, numbers first, express variants left out."""
    tokens = stops.select(text.parent_stop("stop_id").alias("station_id"), F.explode(text.route_tokens("routes")).alias("route_id"))
    pairs = tokens.filter(~F.col("route_id").rlike(express)).distinct()
    number = F.col("route_id").try_cast("int")
    entry = F.struct(F.coalesce(number, F.lit(2147483647)).alias("n"), F.col("route_id"))
    return pairs.groupBy("station_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["route_id"]).alias("routes"))


def natural_routes(routes: DataFrame) -> DataFrame:
    return routes.orderBy(*text.natural_order("route_id"))


# ---- arrival boards ------------------------------------------------------------


def next_arrivals(arrivals: DataFrame, k: int = 8, stop: str = "stop_id", trip: str = "trip_id", due: str = "due",
                  tie: str = "arrival_id") -> DataFrame:
    """Next k arrivals per stop, one per trip (the first listed by ``tie``); rows without trip are dropped.

    Deduplication combines before the shuffle and the rank filter cuts each map task to k rows per stop.
    """
    listed = arrivals.filter(F.col(trip).isNotNull())
    single = latest_per_key(listed, [stop, trip], F.struct(F.col(tie)), first=True)
    return top_per_key(single, [stop], [F.col(due).asc(), F.col(tie).asc()], k)


def arrival_board(requests: DataFrame, arrivals: DataFrame, k: int = 8, due: str = "due", tie: str = "arrival_id",
                  trip: str = "trip_id") -> DataFrame:
    """Board for a requested stop: its own rows, else its parent's, else both platforms merged.

    Candidates are tagged with their priority; the best priority that has rows is kept.
    """
    wanted = requests.select(F.col("stop_id").alias("board")).distinct()
    base = text.parent_stop("board")
    choices = wanted.select("board", F.inline(F.array_distinct(F.array(
        F.struct(F.lit(0).alias("_p"), F.col("board").alias("_s")), F.struct(F.lit(1).alias("_p"), base.alias("_s")),
        F.struct(F.lit(2).alias("_p"), F.concat(base, F.lit("N")).alias("_s")),
        F.struct(F.lit(2).alias("_p"), F.concat(base, F.lit("S")).alias("_s"))))))
    choices = choices.groupBy("board", "_s").agg(F.min("_p").alias("_p"))
    per_stop = next_arrivals(arrivals, k, trip=trip, due=due, tie=tie).drop("rank")
    rows = choices.join(per_stop, F.col("_s") == F.col("stop_id")).drop("_s")
    best = rows.groupBy(F.col("board").alias("_b")).agg(F.min("_p").alias("_best"))
    kept = rows.join(best, (F.col("board") == F.col("_b")) & (F.col("_p") == F.col("_best"))).drop("_b", "_best", "_p")
    single = latest_per_key(kept, ["board", trip], F.struct(F.col(due), F.col(tie)), first=True)
    return top_per_key(single, ["board"], [F.col(due).asc(), F.col(tie).asc()], k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest_per_key(df, list(keys), F.struct(*order), first=True)


def terminals(patterns: DataFrame) -> DataFrame:
    """First and last stop per route and direction."""
    return patterns.groupBy("route_id", "direction_id").agg(
        F.min_by("stop_id", "position").alias("first_stop"), F.max_by("stop_id", "position").alias("last_stop"))


def with_terminal_flags(positions: DataFrame, ends: DataFrame) -> DataFrame:
    """Whether a position's next stop is the first or last stop of its route and direction."""
    joined = join_aggregate(positions, ends, ["route_id", "direction_id"])
    at = text.parent_stop("next_stop_id")
    return joined.withColumns({"at_first_stop": F.coalesce(at == text.parent_stop("first_stop"), F.lit(False)),
                               "at_last_stop": F.coalesce(at == text.parent_stop("last_stop"), F.lit(False))}).drop("first_stop", "last_stop")
