"""Headways, windowed service metrics, service events and daily roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import js_round, js_round_long, mean_tenths
from ..functions.times import local_date
from .ordered import _match, exact_quantiles, time_segment_of, with_previous

KEYS = ("route_id", "direction")


def headways(arrivals: DataFrame, keys: Sequence[str] = (*KEYS, "stop_id"), ts: str = "ts", tie: str = "arrival_id",
             bunch: float = 120, gap: float = 900, max_headway: float | None = 3600,
             segment: Column | None = None) -> DataFrame:
    """Seconds since the previous arrival at the same key, kept when 0 < h < max_headway, with flags."""
    lagged = with_previous(arrivals, keys, [ts, tie], {"prev_ts": ts}, time_segment_of(ts) if segment is None else segment)
    seconds = (F.unix_micros(ts) - F.unix_micros("prev_ts")) / F.lit(1e6)
    valid = seconds > 0 if max_headway is None else (seconds > 0) & (seconds < max_headway)
    h = F.when(valid, seconds)
    return lagged.withColumns({
        "headway_seconds": h,
        "is_bunch": F.coalesce(h < bunch, F.lit(False)),
        "is_gap": F.coalesce(h > gap, F.lit(False)),
    }).drop("prev_ts")


def window_sums(observed: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", tie: str = "arrival_id",
                window: str = "5 minutes", poll: str = "minute", on_time: float = 300) -> DataFrame:
    """Additive sums per window and key.

    Rows are first folded per poll, so a hot key leaves each map task as a handful of partial
    rows; the train count is the mean over polls.
    """
    delay = F.col("delay_seconds")
    last = F.struct(F.col(ts), F.col(tie))
    polls = observed.groupBy(*keys, F.date_trunc(poll, ts).alias("poll")).agg(
        F.count("*").alias("n"), F.sum(delay).alias("sum_delay"), F.count(delay).alias("n_delay"),
        F.count_if(F.abs(delay) < on_time).alias("n_on_time"),
        F.sum("headway_seconds").alias("sum_headway"), F.count("headway_seconds").alias("n_headway"),
        F.sum("latency_ms").alias("sum_latency"), F.count("latency_ms").alias("n_latency"),
        F.max(F.struct(last.alias("at"), F.col("status"))).alias("last"),
        F.count_if("is_bunch").alias("n_bunch"), F.count_if("is_gap").alias("n_gap"),
    )
    added = ["sum_delay", "n_delay", "n_on_time", "sum_headway", "n_headway", "sum_latency", "n_latency", "n_bunch", "n_gap"]
    return polls.groupBy(*keys, F.window("poll", window)["start"].alias("window_start")).agg(
        js_round_long(F.avg("n")).alias("train_count"), *[F.sum(c).alias(c) for c in added],
        F.max("last")["status"].alias("feed_status"))


def window_metrics(observed: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """One row per window and key: train count, mean delay, on-time %, mean headway, latency, status."""
    return window_sums(observed, keys, **options).select(
        *keys, "window_start", "train_count",
        js_round(F.try_divide("sum_delay", "n_delay"), 1).alias("avg_delay_seconds"),
        js_round(F.try_divide(F.col("n_on_time") * 100.0, "n_delay"), 1).alias("on_time_percent"),
        js_round_long(F.try_divide("sum_headway", "n_headway")).alias("headway_avg_seconds"),
        js_round_long(F.try_divide("sum_latency", "n_latency")).alias("feed_latency_ms"),
        "feed_status", F.col("n_bunch").alias("bunch_count"), F.col("n_gap").alias("gap_count"))


def _event(kind: str, df: DataFrame, keys: Sequence[str]) -> Column:
    return F.concat_ws("#", F.lit(kind), *keys)


def _windowed(observed: DataFrame, ts: str, window: str) -> DataFrame:
    return observed.withColumn("window_start", F.window(ts, window)["start"])


def _stop_names(events: DataFrame, names: DataFrame | None) -> DataFrame:
    """Add stop_name: the dimension's name, else the id itself."""
    if names is None:
        return events.withColumn("stop_name", F.col("stop_id"))
    joined = events.join(names.select("stop_id", F.col("stop_name").alias("_name")), "stop_id", "left")
    return joined.withColumn("stop_name", F.coalesce("_name", "stop_id")).drop("_name")


def delay_events(observed: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", window: str = "5 minutes",
                 threshold: float = 300, names: DataFrame | None = None) -> DataFrame:
    """One DELAY event per window and key with any delay above the threshold."""
    late = _windowed(observed.filter(F.col("delay_seconds") > threshold), ts, window)
    worst = late.groupBy(*keys, "window_start").agg(
        js_round_long(F.max("delay_seconds")).alias("delay_seconds"),
        F.min_by("stop_id", F.struct(-F.col("delay_seconds"), F.col("stop_id"))).alias("stop_id"))
    named = _stop_names(worst, names)
    return named.select(
        _event("DELAY", named, keys).alias("pk"), F.unix_millis("window_start").alias("timestamp"), "stop_id",
        "delay_seconds",
        F.concat(js_round_long(F.col("delay_seconds") / 60).cast("string"), F.lit("m delay at "),
                 F.col("stop_name")).alias("description"))


def spacing_events(observed: DataFrame, kind: str, keys: Sequence[str] = KEYS, ts: str = "ts",
                   window: str = "5 minutes", names: DataFrame | None = None) -> DataFrame:
    """BUNCH or GAP events: count and most frequent stop per window and key."""
    flag, words = ("is_bunch", " bunching at ") if kind == "BUNCH" else ("is_gap", " service gaps at ")
    hits = _windowed(observed.filter(F.col(flag)), ts, window)
    per_stop = hits.groupBy(*keys, "window_start", "stop_id").agg(F.count("*").alias("n"))
    top = per_stop.groupBy(*keys, "window_start").agg(
        F.sum("n").alias("n"), F.min_by("stop_id", F.struct(-F.col("n"), F.col("stop_id"))).alias("stop_id"))
    named = _stop_names(top, names)
    return named.select(
        _event(kind, named, keys).alias("pk"), F.unix_millis("window_start").alias("timestamp"), "stop_id",
        F.col("n").alias("event_count"),
        F.concat(F.col("n").cast("string"), F.lit(words), F.col("stop_name")).alias("description"))


def stop_windows(observed: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Per window, key and stop: largest delay, bunching and gap counts."""
    return _windowed(observed, ts, window).groupBy("window_start", *keys, "stop_id").agg(
        F.max("delay_seconds").alias("max_delay"), F.count_if("is_bunch").alias("n_bunch"), F.count_if("is_gap").alias("n_gap"))


def events_of_stops(stops: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 300) -> DataFrame:
    """DELAY, BUNCH and GAP events from rows of ``stop_windows``, all three in one pass."""
    def worst(c):
        return F.min_by("stop_id", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("stop_id"))))

    top = stops.groupBy("window_start", *keys).agg(
        F.max("max_delay").alias("d"), worst("max_delay").alias("ds"), F.sum("n_bunch").alias("b"), worst("n_bunch").alias("bs"),
        F.sum("n_gap").alias("g"), worst("n_gap").alias("gs"))

    def event(kind, stop, keep, description):
        return F.when(keep, F.struct(F.concat_ws("#", F.lit(kind), *keys).alias("pk"), F.unix_millis("window_start").alias("timestamp"),
                                     F.col(stop).alias("stop_id"), description.alias("description")))

    minutes = js_round_long(js_round_long("d") / 60).cast("string")
    made = F.array_compact(F.array(
        event("DELAY", "ds", F.col("d") > threshold, F.concat(minutes, F.lit("m delay at "), F.col("ds"))),
        event("BUNCH", "bs", F.col("b") > 0, F.concat(F.col("b").cast("string"), F.lit(" bunching at "), F.col("bs"))),
        event("GAP", "gs", F.col("g") > 0, F.concat(F.col("g").cast("string"), F.lit(" service gaps at "), F.col("gs")))))
    return top.select(F.inline(made))


def service_events(observed: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", window: str = "5 minutes", threshold: float = 300) -> DataFrame:
    return events_of_stops(stop_windows(observed, keys, ts, window), keys, threshold)


def skipped_stops(updates: DataFrame, zone: str, keys: Sequence[str] = KEYS, ts: str = "ts",
                  relation: str = "schedule_relationship") -> DataFrame:
    """Skipped stop updates per key and local day."""
    return (updates.groupBy(local_date(ts, zone).alias("date"), *keys)
            .agg(F.count_if(F.col(relation) == "SKIPPED").alias("total_skipped_stops")))


def daily_rollup(observed: DataFrame, zone: str, keys: Sequence[str] = KEYS, ts: str = "ts", tie: str = "arrival_id",
                 on_time: float = 300, headway_bucket: float = 60.0) -> DataFrame:
    """Per local day and key: means from window sums, exact median headway, peak and totals.

    ``total_trains`` sums the window train counts; ``n_windows`` counts the windows.
    """
    windows = window_sums(observed, keys, ts, tie, on_time=on_time)
    daily = windows.groupBy(local_date("window_start", zone).alias("date"), *keys).agg(
        js_round(F.try_divide(F.sum("sum_delay"), F.sum("n_delay")), 1).alias("avg_delay"),
        js_round(F.try_divide(F.sum("n_on_time") * 100.0, F.sum("n_delay")), 1).alias("on_time_percent"),
        js_round_long(F.try_divide(F.sum("sum_headway"), F.sum("n_headway"))).alias("avg_headway"),
        F.sum("n_bunch").alias("total_bunching"), F.sum("n_gap").alias("total_gaps"),
        F.max("train_count").alias("peak_train_count"), F.sum("train_count").alias("total_trains"),
        F.count("*").alias("n_windows"))
    dated = observed.select(local_date(ts, zone).alias("date"), *keys, "headway_seconds")
    medians = exact_quantiles(dated, ["date", *keys], "headway_seconds", {"median_headway": 0.5},
                              F.floor(F.col("headway_seconds") / headway_bucket).cast("bigint"))
    return _match(daily, medians.withColumn("median_headway", js_round_long("median_headway")), ["date", *keys])


def mean_rollup(metrics: DataFrame, zone: str, keys: Sequence[str] = ("route_id",)) -> DataFrame:
    """Daily roll-up of window rows: averages of averages, peak and row count."""
    return metrics.groupBy(local_date("window_start", zone).alias("date"), *keys).agg(
        mean_tenths("avg_delay_seconds").alias("avg_delay"),
        mean_tenths("on_time_percent").alias("on_time_percent"),
        js_round_long(F.avg("headway_avg_seconds")).alias("avg_headway"),
        F.max("train_count").alias("peak_train_count"), F.count("*").alias("n_windows"))


def group_status(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Per window and feed group: trains, worst latency, ``error`` only when one was seen."""
    return (metrics.join(groups, "route_id").groupBy("window_start", "feed_group").agg(
        F.sum("train_count").alias("train_count"), F.coalesce(F.max("feed_latency_ms"), F.lit(0)).alias("latency_ms"),
        F.when(F.bool_or(F.col("feed_status") == "error"), "error").otherwise("ok").alias("status")))


def system_health(metrics: DataFrame, groups: DataFrame, alert_count: Column | None = None) -> DataFrame:
    """One record per window; groups as JSON. Groups per window are bounded by the group list.

    Window totals are folded from the group rows, so the metrics are read once.
    """
    error = F.bool_or(F.col("feed_status") == "error")
    per = metrics.join(groups, "route_id", "left").groupBy("window_start", "feed_group").agg(
        F.sum("train_count").alias("train_count"), F.coalesce(F.max("feed_latency_ms"), F.lit(0)).alias("latency_ms"),
        F.when(error, "error").otherwise("ok").alias("status"), F.sum(F.coalesce("feed_latency_ms", F.lit(0))).alias("_sum"), F.count("*").alias("_n"))
    group = F.when(F.col("feed_group").isNotNull(), F.struct("feed_group", "train_count", "latency_ms", "status"))
    totals = per.groupBy("window_start").agg(
        F.sum("train_count").alias("train_count"), js_round_long(F.sum("_sum") / F.sum("_n")).alias("feed_latency_ms"),
        F.when(F.bool_or(F.col("status") == "error"), "degraded").otherwise("ok").alias("feed_status"),
        F.to_json(F.array_sort(F.collect_list(group))).alias("feed_group_data"))
    return totals.select(F.unix_millis("window_start").alias("timestamp"), "train_count", "feed_latency_ms", "feed_status", "feed_group_data",
                         (F.lit(0).cast("bigint") if alert_count is None else alert_count).alias("alert_count"))


def route_alert_counts(alerts: DataFrame, zone: str, directions: Sequence[str] = ("N", "S"),
                       ts: str = "captured_at") -> DataFrame:
    """Distinct alerts per route and local day, given to every direction."""
    counts = (alerts.select(local_date(ts, zone).alias("date"), "alert_id", F.explode("affected_routes").alias("route_id"))
              .groupBy("date", "route_id").agg(F.count_distinct("alert_id").alias("total_alerts")))
    return counts.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in directions])))


def alert_events(alerts: DataFrame, poll: str = "captured_at", order: str = "alert_id", cut: int = 200) -> DataFrame:
    """One ALERT event per route and poll: the first alert, its text cut."""
    per_route = alerts.select(poll, order, "severity", "header_text", F.explode("affected_routes").alias("route_id"))
    first = per_route.groupBy("route_id", poll).agg(
        F.min(order).alias(order), F.min_by("severity", order).alias("severity"),
        F.min_by("header_text", order).alias("header_text"))
    return first.select(F.concat_ws("#", F.lit("ALERT"), "route_id").alias("pk"),
                        F.unix_millis(poll).alias("timestamp"), order, "severity",
                        F.substring("header_text", 1, cut).alias("description"))
