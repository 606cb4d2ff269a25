"""Joins: schedule deviation, tiered lookups, names, snapshots, segment durations, bracketing stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import bearing
from ..functions.numbers import interpolate, progress
from ..functions.times import local_date, seconds_of_local_day, service_day_type
from ..session import cut_lineage
from .joins import join_aggregate
from .ordered import _match, whole_or_cut

# ---- platform variants ------------------------------------------------------
#
# An id and its N/S platforms are folded into one row per parent, so a lookup with platform
# fallback is one equi-join instead of one per candidate id.


MARKS = {"N": "_n", "S": "_s", "-": "_b"}


def fold_platforms(df: DataFrame, keys: Sequence[str], stop: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row per keys and parent stop: the first (order, value) for each platform."""
    platform = F.coalesce(text.direction(stop), F.lit("-"))
    entry = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("value"))
    return df.groupBy(*keys, text.parent_stop(stop).alias("_parent")).agg(
        *[F.min(F.when(platform == mark, entry)).alias(c) for mark, c in MARKS.items()])


def refold(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same on fewer keys, from folded rows."""
    return folded.groupBy(*keys, "_parent").agg(*[F.min(c).alias(c) for c in MARKS.values()])


def platform_value(stop: str, tag: str = "") -> Column:
    """The folded value for the exact platform, else the first of the parent."""
    d = F.coalesce(text.direction(stop), F.lit("-"))
    first = F.least(*[F.col(f"{tag}{c}") for c in MARKS.values()])
    exact = F.when(d == "N", F.col(f"{tag}_n")).when(d == "S", F.col(f"{tag}_s")).otherwise(F.col(f"{tag}_b"))
    return F.coalesce(exact, first)["value"]


def _join_folded(df: DataFrame, folded: DataFrame, keys: Sequence[str], stop: str, tag: str) -> DataFrame:
    renamed = folded.select(*[F.col(c).alias(f"{tag}_k_{c}" if c in keys else f"{tag}{c}") for c in folded.columns])
    cond = text.parent_stop(stop) == F.col(f"{tag}_parent")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"{tag}_k_{k}"))
    return df.join(renamed, cond, "left")


# ---- schedule ---------------------------------------------------------------


def schedule_deviation(live: DataFrame, schedule: DataFrame, zone: str, ts: str = "ts",
                       truncate_minutes: bool = False) -> DataFrame:
    """Actual minus scheduled seconds of the local day.

    Live trips match scheduled ones on the trip key (id cut after its direction mark), the stop and
    the service day type; among equal keys the largest trip id wins.
    """
    planned = F.floor(F.col("arrival_seconds") / 60) * 60 if truncate_minutes else F.col("arrival_seconds")
    best = (schedule.select(text.trip_key("trip_id").alias("_key"), F.col("stop_id").alias("_stop"),
                            F.col("service_type").alias("_service"), "trip_id", planned.alias("_planned"))
            .groupBy("_key", "_stop", "_service").agg(F.max(F.struct("trip_id", "_planned"))["_planned"].alias("scheduled_seconds")))
    actual = seconds_of_local_day(ts, zone)
    keyed = live.withColumns({"_lk": text.trip_key("trip_id"), "_ls": service_day_type(local_date(ts, zone))})
    joined = keyed.join(best, (F.col("_lk") == F.col("_key")) & (F.col("stop_id") == F.col("_stop")) & (F.col("_ls") == F.col("_service")), "left")
    return joined.withColumn("deviation_seconds", actual - F.col("scheduled_seconds")).drop("_lk", "_ls", "_key", "_stop", "_service")


def _trip_columns(df: DataFrame) -> DataFrame:
    shaped = df.withColumn("_shape", text.trip_shape("_trip"))
    return shaped.withColumn("_dir", text.shape_direction("_shape"))


def schedule_index(schedule: DataFrame, order: Sequence[str] = ("trip_id", "stop_sequence"),
                   asked: DataFrame | None = None) -> list[tuple[list[str], DataFrame]]:
    """Scheduled seconds by trip, by route and shape, by route and direction, each folded by platform.

    The schedule is read once; its finest fold is written to the shared folder and the coarser
    tiers are folds of that. Build it once per schedule and use it for many lookups. With ``asked``, rows that are to be looked up,
    it covers their stops, on every platform, and no others.
    """
    if asked is not None:
        parents = asked.select(text.parent_stop("stop_id").alias("_asked")).distinct()
        schedule = join_aggregate(schedule.withColumn("_asked", text.parent_stop("stop_id")), parents, ["_asked"], "left_semi").drop("_asked")
    tailed = schedule.withColumn("_trip", F.coalesce(text.trip_suffix("trip_id"), F.col("trip_id")))
    finest = cut_lineage(_trip_columns(fold_platforms(tailed, ["_trip", "route_id"], "stop_id", "arrival_seconds", order)))
    by_shape = refold(finest.filter(F.col("_shape").isNotNull()), ["route_id", "_shape", "_dir"])
    return [(["_trip"], refold(finest, ["_trip"])), (["route_id", "_shape"], by_shape.drop("_dir")),
            (["route_id", "_dir"], refold(by_shape, ["route_id", "_dir"]))]


def tiered_schedule(live: DataFrame, index: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """Scheduled seconds by trip, else by route and shape, else by route and direction.

    Every tier falls back from the platform to its parent. ``tier`` tells which one answered.
    """
    out = _trip_columns(live.withColumn("_trip", F.coalesce(text.trip_suffix("trip_id"), F.col("trip_id"))))
    for i, (keys, tier) in enumerate(index, 1):
        out = _join_folded(out, tier, keys, "stop_id", f"t{i}")
    found = [platform_value("stop_id", f"t{i}") for i in (1, 2, 3)]
    return out.select(*live.columns, F.coalesce(*found).alias("scheduled_seconds"),
                      F.when(found[0].isNotNull(), 1).when(found[1].isNotNull(), 2).when(found[2].isNotNull(), 3).alias("tier"))


def tiered_headsign(live: DataFrame, trips: DataFrame) -> DataFrame:
    """Headsign by trip (or its suffix), else route and shape, else route and direction; lowest trip id first.

    A scheduled trip's own shape_id, where the table has one, goes before the shape read from its id. The trips are read once; the
    tiers are folds of their first rows by trip, route and shape.
    """
    shape = text.trip_shape("trip_id")
    own = F.coalesce(F.nullif(F.col("shape_id"), F.lit("")), shape) if "shape_id" in trips.columns else shape
    named = trips.filter(F.col("headsign").isNotNull() & (F.col("headsign") != "")).withColumns({
        "_trip": F.coalesce(text.trip_suffix("trip_id"), F.col("trip_id")), "_shape": own})
    finest = cut_lineage(named.groupBy("_trip", "route_id", "_shape").agg(F.min(F.struct("trip_id", "headsign")).alias("_first")))
    finest = finest.withColumn("_dir", text.shape_direction("_shape"))
    wanted = live.withColumns({"_trip": F.coalesce(text.trip_suffix("trip_id"), F.col("trip_id")),
                               "_shape": text.trip_shape("trip_id")})
    out = wanted.withColumn("_dir", text.shape_direction("_shape"))
    for i, keys in enumerate((["_trip"], ["route_id", "_shape"], ["route_id", "_dir"]), 1):
        tier = finest.dropna(subset=keys).groupBy(*keys).agg(F.min("_first")["headsign"].alias(f"_h{i}"))
        out = join_aggregate(out, tier, keys)
    return out.select(*live.columns, F.coalesce("_h1", "_h2", "_h3").alias("headsign"))


def stop_names(df: DataFrame, stops: DataFrame, stop: str = "stop_id") -> DataFrame:
    """Name of the stop, else of its parent, else the id."""
    names = stops.groupBy(F.col("stop_id").alias("_id")).agg(F.min("stop_name").alias("_n"))
    own = names.select(F.col("_id").alias("_id1"), F.col("_n").alias("_n1"))
    above = names.select(F.col("_id").alias("_id2"), F.col("_n").alias("_n2"))
    return (df.join(own, F.col(stop) == F.col("_id1"), "left").join(above, text.parent_stop(stop) == F.col("_id2"), "left")
            .withColumn("stop_name", F.coalesce("_n1", "_n2", F.col(stop))).drop("_id1", "_id2", "_n1", "_n2"))


def segment_duration(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """Seconds from the duration matrix, exact ids first, then the other platforms in fixed order.

    The matrix is folded to one row per route and pair of parents, with an array of nine slots by platforms, so the 16 candidates
    cost one join. Parents and platforms are computed once per row.
    """
    def mark(c):
        return F.coalesce(text.direction(c), F.lit("-"))

    def place(c):
        return F.when(c == "N", 0).when(c == "S", 1).otherwise(2)

    marks = ["N", "S", "-"]
    marked = matrix.select(F.col("route_id").alias("_r"), text.parent_stop("from_stop").alias("_f"), text.parent_stop("to_stop").alias("_t"),
                           mark("from_stop").alias("_fm"), mark("to_stop").alias("_tm"), "seconds")
    slots = [F.min(F.when((F.col("_fm") == a) & (F.col("_tm") == b), F.col("seconds"))) for a in marks for b in marks]
    folded = marked.groupBy("_r", "_f", "_t").agg(F.array(*slots).alias("_slots"))
    keyed = pairs.withColumns({"_pf": text.parent_stop("from_stop"), "_pt": text.parent_stop("to_stop"),
                               "_i": place(mark("from_stop")), "_j": place(mark("to_stop"))})
    joined = keyed.join(folded, (F.col("route_id") == F.col("_r")) & (F.col("_pf") == F.col("_f")) & (F.col("_pt") == F.col("_t")), "left")
    froms, tos = ([F.col(own), F.lit(0), F.lit(1), F.lit(2)] for own in ("_i", "_j"))
    found = F.coalesce(*[F.get("_slots", a * 3 + b) for a in froms for b in tos])
    return joined.withColumn("seconds", found).select(*pairs.columns, "seconds")


# ---- features and roll-up joins ------------------------------------------------


def windowed_with_events(metrics: DataFrame, events: DataFrame | None, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Left join of window metrics with event counts; missing counts are 0."""
    if events is None:
        return metrics.withColumns({c: F.lit(0).cast("bigint") for c in counts})
    return metrics.join(events, list(keys), "left").fillna(0, subset=list(counts))


def monthly_reliability(base: DataFrame, otp: DataFrame | None = None, incidents: DataFrame | None = None,
                        service: DataFrame | None = None) -> DataFrame:
    """Base rows with monthly aggregates of the optional tables, each aggregated before its join."""
    out = base.withColumns({"year": F.year(F.to_date("month")), "month_num": F.month(F.to_date("month"))})
    pair = ["month", "division"]
    if otp is not None:
        out = join_aggregate(out, otp.dropna(subset=pair).groupBy(*pair).agg(F.avg("terminal_on_time_performance").alias("otp_pct")), pair)
    if incidents is not None:
        out = join_aggregate(out, incidents.dropna(subset=pair).groupBy(*pair).agg(F.sum("incident_count").alias("total_incidents")), pair)
    if service is not None:
        out = join_aggregate(out, service.dropna(subset=["month"]).groupBy("month").agg(F.avg("service_delivered_pct").alias("service_pct")), ["month"])
    return out


def division_months(mdbf: DataFrame, otp: DataFrame, incidents: DataFrame, service: DataFrame,
                    line_division: DataFrame) -> DataFrame:
    """Month by division table of four aggregates; lines map to divisions, unmapped lines are left out."""
    keys = ["month", "division"]
    base = mdbf.groupBy(*keys).agg(F.avg("mdbf").alias("mdbf_mean"), F.min("mdbf").alias("mdbf_min"),
                                   F.max("mdbf").alias("mdbf_max"), F.count_distinct("car_class").alias("n_car_classes"))
    on_time = otp.groupBy(*keys).agg(F.avg("terminal_on_time_performance").alias("otp_mean"))
    by_line = incidents.groupBy("month", "line").agg(F.count("*").alias("_n")).join(line_division, "line")
    counts = by_line.groupBy(*keys).agg(F.sum("_n").alias("incident_count"))
    line_service = service.groupBy("month", "line").agg(
        F.sum("service_delivered_pct").alias("_s"), F.count("service_delivered_pct").alias("_c")).join(line_division, "line")
    delivered = line_service.groupBy(*keys).agg((F.sum("_s") / F.sum("_c")).alias("service_pct_mean"))
    return (base.join(on_time, keys, "left").join(counts, keys, "left").join(delivered, keys, "left")
            .fillna(0, subset=["incident_count"]))


def with_attributes(df: DataFrame, attributes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Optional attributes of a dimension row, one row kept per key."""
    one = attributes.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    return df.join(one, key, "left")


def with_alert_counts(rollup: DataFrame, alert_events: DataFrame) -> DataFrame:
    """Daily alert count per route beside the roll-up, 0 when none; the alert key is split first."""
    counts = alert_events.groupBy("date", text.key_part("pk", 1).alias("route_id")).agg(F.count("*").alias("total_alerts"))
    return _match(rollup, counts, ["date", "route_id"]).fillna(0, subset=["total_alerts"])


# ---- snapshots ------------------------------------------------------------------


def snapshot_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that left (``removed``) and keys that came (``new``)."""
    k = list(keys)
    before, after = previous.select(*k).distinct(), current.select(*k).distinct()
    return (before.join(after, k, "left_anti").withColumn("change", F.lit("removed"))
            .unionByName(after.join(before, k, "left_anti").withColumn("change", F.lit("new"))))


def prefer_fresh(sources: Sequence[tuple[str, DataFrame]], group: str) -> DataFrame:
    """Rows of the first source, in order of preference, that has any for a group."""
    rows = None
    for i, (name, df) in enumerate(sources):
        tagged = df.withColumns({"source": F.lit(name), "_rank": F.lit(i)})
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    best = rows.groupBy(group).agg(F.min("_rank").alias("_best"))
    return join_aggregate(rows, best, [group]).filter(F.col("_rank") == F.col("_best")).drop("_rank", "_best")


# ---- positions from stop updates ---------------------------------------------------


def bracketing_stops(updates: DataFrame, stops: DataFrame, now: Column, trip: str = "trip_id", seq: str = "seq") -> DataFrame:
    """Interpolated position per trip between the first stop still ahead and the one before it.

    Both stops come from mergeable aggregates: the first sequence with arrival after now, then the
    largest sequence below it. Trips are shuffled once, whole, but for those of more than ``ordered.HEAVY_ROWS`` rows.
    """
    ahead = (F.col("arrival_time") > now) & F.col(trip).isNotNull()

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_next_seq", F.min(F.when(ahead, F.col(seq))).over(Window.partitionBy(trip)))

    def cut(rows: DataFrame) -> DataFrame:
        return join_aggregate(rows, rows.filter(ahead).groupBy(trip).agg(F.min(seq).alias("_next_seq")), [trip])

    left = F.struct("stop_id", F.coalesce("departure_time", "arrival_time").alias("left_at"), "route_id")
    pair = whole_or_cut(updates, [trip], None, whole, cut).groupBy(trip).agg(
        F.min_by(F.struct("stop_id", "arrival_time"), F.when(ahead, F.col(seq))).alias("_next"),
        F.max_by(left, F.when(F.col(seq) < F.col("_next_seq"), F.col(seq))).alias("_prev"))
    a = stops.select(F.col("stop_id").alias("_a"), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"))
    b = stops.select(F.col("stop_id").alias("_b"), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"))
    placed = pair.join(a, F.col("_prev.stop_id") == F.col("_a")).join(b, F.col("_next.stop_id") == F.col("_b"))
    start, end = F.unix_millis("_prev.left_at"), F.unix_millis("_next.arrival_time")
    p = progress(F.unix_millis(now), start, end)
    return placed.filter(end > start).select(
        trip, F.col("_prev.route_id").alias("route_id"), F.col("_prev.stop_id").alias("prev_stop_id"),
        F.col("_next.stop_id").alias("next_stop_id"), interpolate("_lat1", "_lat2", p).alias("lat"),
        interpolate("_lon1", "_lon2", p).alias("lon"), bearing("_lat1", "_lon1", "_lat2", "_lon2").alias("heading"),
        start.alias("prev_time_ms"), end.alias("next_time_ms"))


def affected_stop_names(alerts: DataFrame, stops: DataFrame) -> DataFrame:
    """Distinct parent-stop names per alert in first-seen order; an alert's stop list stays its own row size."""
    listed = alerts.select("alert_id", F.posexplode("affected_stops").alias("pos", "stop_id"))
    named = stop_names(listed.withColumn("stop_id", text.parent_stop("stop_id")), stops)
    first = named.groupBy("alert_id", "stop_name").agg(F.min("pos").alias("pos"))
    return first.groupBy("alert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_name"))),
                                                     lambda x: x["stop_name"]).alias("stop_names"))


