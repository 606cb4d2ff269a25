"""Dashboard aggregates over window metrics, daily roll-ups, events and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import js_round, js_round_long, lookup, mean_tenths, seconds_to_minutes
from .joins import join_aggregate
from .ordered import with_position

# ---- reads ----------------------------------------------------------------


def in_range(df: DataFrame, column: str, start, end, route_id: str | None = None,
             direction: str | None = None) -> DataFrame:
    """Rows of a time range (both ends in), optionally one route and direction; none means all."""
    out = df.filter(F.col(column).between(start, end))
    if route_id is not None:
        out = out.filter(F.col("route_id") == route_id)
    if direction is not None:
        out = out.filter(F.col("direction") == direction)
    return out


def events_of(events: DataFrame, start, end, event_type: str = "TRIP_END", route_id: str | None = None,
              direction: str | None = None) -> DataFrame:
    """Events of a type and range; type, route and direction come from the composite key."""
    parts = F.split("pk", "#")
    split = events.withColumns({"event_type": parts[0], "route_id": F.try_element_at(parts, F.lit(2)),
                                "direction": F.try_element_at(parts, F.lit(3))})
    return in_range(split.filter(F.col("event_type") == event_type), "timestamp", start, end, route_id, direction)


def anomaly_feed(events: DataFrame, now, since, types: Sequence[str] | None = None, route_id: str | None = None,
                 limit: int = 200) -> DataFrame:
    """Newest events of the last period, filtered by type and route; the limit stays in 1..200."""
    parts = F.split("pk", "#")
    out = events.filter((F.col("timestamp") > since) & (F.col("timestamp") <= now))
    if types:
        out = out.filter(parts[0].isin(*types))
    if route_id:
        out = out.filter(F.try_element_at(parts, F.lit(2)) == route_id)
    return out.orderBy(F.desc("timestamp"), "pk").limit(max(1, min(limit, 200)))


def latest_health(health: DataFrame, group_schema: str) -> DataFrame:
    """The newest health record with its groups unpacked."""
    newest = health.orderBy(F.desc("timestamp")).limit(1)
    return newest.select("timestamp", F.col("train_count").alias("active_trains"),
                         F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
                         F.inline_outer(F.from_json("feed_group_data", group_schema)))


# ---- per route ------------------------------------------------------------


def route_performance(rollups: DataFrame, since) -> DataFrame:
    """Per route since a date: means, peak, sums, distinct days."""
    return rollups.filter(F.col("date") >= since).groupBy("route_id").agg(
        mean_tenths("avg_delay").alias("avg_delay"), mean_tenths("on_time_percent").alias("on_time_percent"),
        js_round_long(F.avg("avg_headway")).alias("avg_headway"),
        js_round_long(F.avg("median_headway")).alias("median_headway"),
        F.max("peak_train_count").alias("peak_train_count"),
        F.sum(F.coalesce("total_bunching", F.lit(0))).alias("total_bunching"),
        F.sum(F.coalesce("total_gaps", F.lit(0))).alias("total_gaps"),
        F.count_distinct("date").alias("days"))


def grade_score() -> Column:
    """Score of 100: on-time 50, bunching 20, gaps 20, headway regularity 10 (5 when unknown)."""
    regular = F.when((F.col("median_headway").isNotNull()) & (F.col("avg_headway") > 0),
                     F.least(F.col("median_headway") / F.col("avg_headway"), F.lit(1.0)) * 10).otherwise(F.lit(5.0))

    def penalty(c):
        return F.greatest(F.lit(0.0), F.lit(20.0) - F.col(c) * 2)

    return F.col("on_time_percent") / 100 * 50 + penalty("total_bunching") + penalty("total_gaps") + regular


def grades(performance: DataFrame) -> DataFrame:
    """Letter per route; NULL without on-time data."""
    score = F.col("score")
    letter = (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D")
              .when(score.isNotNull(), "F"))
    return performance.withColumn("score", grade_score()).withColumn("grade", letter)


def best_and_worst(rollups: DataFrame, date) -> DataFrame:
    """Best and worst route of a day by mean on-time; no worst when only one route has data."""
    routes = (rollups.filter(F.col("date") == date).groupBy("route_id").agg(
        F.coalesce(F.avg("avg_delay"), F.lit(0.0)).alias("avg_delay"), F.avg("on_time_percent").alias("on_time_percent"),
        F.sum(F.coalesce("total_trains", F.lit(0))).alias("total_trips")).filter(F.col("on_time_percent").isNotNull()))
    row = F.struct("route_id", "avg_delay", "on_time_percent", "total_trips")
    ends = routes.agg(F.count("*").alias("n"), F.min_by(row, F.struct(-F.col("on_time_percent"), F.col("route_id"))).alias("best"),
                      F.max_by(row, F.struct(-F.col("on_time_percent"), F.col("route_id"))).alias("worst"))
    pair = F.array(F.struct(F.lit("best").alias("place"), F.col("best").alias("row")),
                   F.struct(F.lit("worst").alias("place"), F.col("worst").alias("row")))
    return (ends.select("n", F.inline(pair)).filter((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("place") == "best")))
            .select("place", "row.*"))


def delay_distribution(rollups: DataFrame) -> DataFrame:
    """On-time share and the late share by size of the mean delay, in percent points."""
    on_time = F.col("on_time_percent") / 100
    size = F.abs(F.coalesce("avg_delay", F.lit(0.0)))
    bucket = (F.when(size < 120, "0-2 min").when(size < 300, "2-5 min").when(size < 600, "5-10 min").otherwise("10+ min"))
    late = F.greatest(F.lit(0.0), 1 - on_time)
    names = ["on_time", "0-2 min", "2-5 min", "5-10 min", "10+ min"]
    shares = rollups.agg(F.coalesce(F.sum(on_time), F.lit(0.0)).alias("b0"), *[
        F.coalesce(F.sum(F.when(bucket == n, late)), F.lit(0.0)).alias(f"b{i}") for i, n in enumerate(names) if i])
    rows = F.array(*[F.struct(F.lit(n).alias("bucket"), js_round_long(F.col(f"b{i}") * 100).alias("share"))
                     for i, n in enumerate(names)])
    return shares.select(F.inline(rows))


def spacing_trend(rollups: DataFrame) -> DataFrame:
    """Per date: how many routes had bunching, and gaps."""
    return rollups.groupBy("date").agg(
        F.count_distinct(F.when(F.col("total_bunching") > 0, F.col("route_id"))).alias("routes_bunching"),
        F.count_distinct(F.when(F.col("total_gaps") > 0, F.col("route_id"))).alias("routes_gaps"))


def delay_trend(rollups: DataFrame, since, routes: Sequence[str]) -> DataFrame:
    """Date by route pivot of the mean delay."""
    return (rollups.filter(F.col("date") >= since).groupBy("date").pivot("route_id", list(routes))
            .agg(mean_tenths("avg_delay")))


def system_timeline(rollups: DataFrame, alerts: str | None = "total_alerts") -> DataFrame:
    """Per date: mean delay, mean on-time, alert sum."""
    total = F.sum(F.coalesce(F.col(alerts), F.lit(0))) if alerts else F.lit(0).cast("bigint")
    return rollups.groupBy("date").agg(
        F.coalesce(mean_tenths("avg_delay"), F.lit(0.0)).alias("avg_delay"),
        F.coalesce(mean_tenths("on_time_percent"), F.lit(0.0)).alias("on_time_percent"), total.alias("alerts"))


def trip_volume(rollups: DataFrame) -> DataFrame:
    """Trips per route with data, descending, with the grand total beside."""
    per_route = rollups.groupBy("route_id").agg(
        F.sum(F.coalesce("total_trains", F.lit(0))).alias("trips"),
        mean_tenths("on_time_percent").alias("on_time_percent")).filter(F.col("trips") > 0)
    total = per_route.agg(F.sum("trips")).scalar()
    return per_route.withColumn("grand_total", total).orderBy(F.desc("trips"), "route_id")


def operational_snapshot(rollups: DataFrame, today, since) -> DataFrame:
    """Routes with bunching or gaps today; mean on-time since a date."""
    is_today = F.col("date") == today
    return rollups.filter(F.col("date").between(since, today)).agg(
        F.count_distinct(F.when(is_today & (F.col("total_bunching") > 0), F.col("route_id"))).alias("bunching_today"),
        F.count_distinct(F.when(is_today & (F.col("total_gaps") > 0), F.col("route_id"))).alias("gaps_today"),
        mean_tenths("on_time_percent").alias("on_time_percent"))


def activity_counts(routes: DataFrame, observed: DataFrame) -> DataFrame:
    """Count per route over the full list, 0 where none."""
    counts = observed.groupBy(F.upper("route_id").alias("route_id")).agg(F.count("*").alias("_n"))
    return routes.select("route_id").join(counts, "route_id", "left").select(
        "route_id", F.coalesce("_n", F.lit(0)).alias("train_count"))


def feed_health(feeds: DataFrame, healthy: Column) -> DataFrame:
    return feeds.agg(js_round_long(F.avg(healthy.cast("double")) * 100).alias("feed_health"))


# ---- alerts and equipment ---------------------------------------------------


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("n_alerts"))


def alerts_by_route(alerts: DataFrame) -> DataFrame:
    """Per route: alert count, first alert, worst severity (a summary row, not a list)."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return (alerts.select("alert_id", "severity", F.explode(F.array_distinct("affected_routes")).alias("route_id"))
            .groupBy("route_id").agg(F.count("*").alias("n_alerts"), F.min("alert_id").alias("first_alert"),
                                     F.min_by("severity", rank).alias("worst_severity")))


def sort_alerts(alerts: DataFrame, ranks: dict[str, int], updated: str = "updated_at", tie: str = "alert_id") -> DataFrame:
    return alerts.withColumn("severity_rank", lookup(ranks, "severity", F.lit(len(ranks)))).orderBy(
        "severity_rank", F.desc(updated), tie)


def alert_speed(alerts: DataFrame, routes: DataFrame, factors: Sequence[tuple[str, float]]) -> DataFrame:
    """Lowest speed factor any alert of a route calls for; 1.0 without one."""
    kind = F.lower(F.coalesce("alert_type", F.lit("")))
    factor = F.lit(1.0)
    for word, value in sorted(factors, key=lambda f: -f[1]):
        factor = F.when(kind.contains(word), F.lit(value)).otherwise(factor)
    worst = (alerts.select(factor.alias("_f"), F.explode("affected_routes").alias("_r"))
             .groupBy(F.upper("_r").alias("_r")).agg(F.min("_f").alias("_f")))
    return routes.join(worst, F.upper("route_id") == F.col("_r"), "left").select(
        "route_id", F.coalesce("_f", F.lit(1.0)).alias("speed_factor"))


def equipment_stats(equipment: DataFrame, outages: DataFrame) -> DataFrame:
    """Totals by type, current outages by type, step-free units out, upcoming outages."""
    current = ~F.col("is_upcoming")
    out = outages.agg(
        F.count_if(current & (F.col("kind") == "elevator")).alias("elevators_out"),
        F.count_if(current & (F.col("kind") == "escalator")).alias("escalators_out"),
        F.count_if(current & F.col("is_ada")).alias("ada_out"), F.count_if("is_upcoming").alias("upcoming"))
    totals = equipment.agg(F.count_if(F.col("kind") == "elevator").alias("elevators"),
                           F.count_if(F.col("kind") == "escalator").alias("escalators"))
    return out.select("*", totals.select("elevators").scalar().alias("elevators"),
                      totals.select("escalators").scalar().alias("escalators"))


# ---- station states -----------------------------------------------------------


def train_states(arrivals: DataFrame, now: Column, stop: str = "stop_id", ts: str = "ts") -> DataFrame:
    """Per stop: trains at the platform, arriving (2 min) and en route (5 min)."""
    s = (F.unix_micros(ts) - F.unix_micros(now)) / F.lit(1e6)
    return arrivals.filter((s > -30) & (s <= 300)).groupBy(stop).agg(
        F.count_if(s <= 30).alias("at_station"), F.count_if((s > 30) & (s <= 120)).alias("arriving"),
        F.count_if(s > 120).alias("en_route"))


def arriving_stops(arrivals: DataFrame, now: Column, stop: str = "stop_id", ts: str = "ts",
                   low: float = -15, high: float = 60) -> DataFrame:
    s = (F.unix_micros(ts) - F.unix_micros(now)) / F.lit(1e6)
    return arrivals.filter((s >= low) & (s < high)).select(stop).distinct()


def station_rows(stations: DataFrame, states: DataFrame, alerted: DataFrame, stop: str = "stop_id") -> DataFrame:
    """Station with train states (0 when none) and whether an alert names it."""
    flags = alerted.select(stop).distinct().withColumn("_alert", F.lit(True))
    joined = stations.join(states, stop, "left").join(flags, stop, "left")
    return joined.select(*stations.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("at_station", "arriving", "en_route")],
                         F.coalesce("_alert", F.lit(False)).alias("has_alert"))


# ---- signals ------------------------------------------------------------------


def direction_imbalance(metrics: DataFrame, keys: Sequence[str], ratio: float = 1.5) -> DataFrame:
    """Keys whose northbound and southbound counts differ by more than ``ratio``."""
    both = metrics.groupBy(*keys).agg(
        F.max(F.when(F.col("direction") == "N", F.col("train_count"))).alias("north"),
        F.max(F.when(F.col("direction") == "S", F.col("train_count"))).alias("south"))
    found = F.greatest("north", "south") / F.least("north", "south")
    return both.filter((F.col("north") > 0) & (F.col("south") > 0) & (found > ratio)).withColumn("ratio", js_round(found, 1))


def cascading_routes(events: DataFrame, since: Column | int, types: Sequence[str] = ("BUNCH", "GAP", "DELAY"),
                     minimum: int = 2) -> DataFrame:
    """Every anomaly of the routes that have several in the period, as rows (route_id, rank, n_anomalies, summary) in time order.

    The text is the type and the description, or the minutes of delay where there is none.
    """
    parts = F.split("pk", "#")
    detail = F.col("description")
    if "delay_seconds" in events.columns:
        detail = F.coalesce(detail, F.concat(seconds_to_minutes("delay_seconds").cast("string"), F.lit(" min delay")))
    hits = events.filter(parts[0].isin(*types) & (F.col("timestamp") >= since)).select(
        parts[1].alias("route_id"), "timestamp", F.concat(parts[0], F.lit(": "), F.coalesce(detail, F.lit(""))).alias("summary"))
    several = hits.groupBy("route_id").agg(F.count("*").alias("n_anomalies")).filter(F.col("n_anomalies") >= minimum)
    listed = join_aggregate(hits, several, ["route_id"], "inner")
    ranked = with_position(listed, ["route_id"], ["timestamp", "summary"], F.floor(F.col("timestamp") / 3_600_000), "rank")
    return ranked.select("route_id", "rank", "n_anomalies", "summary")


def ahead_of_schedule(metrics: DataFrame, minutes: float = -0.5) -> DataFrame:
    delay = seconds_to_minutes("avg_delay_seconds")
    return metrics.withColumn("delay_minutes", delay).filter(F.col("delay_minutes") < minutes)


# ---- paging -------------------------------------------------------------------


def page_of(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


