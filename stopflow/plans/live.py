"""Streaming queries over the events table as a file stream, run until all rows are read, and their batch twins."""

from pyspark.sql import functions as F


from ..functions import numbers
from ..operators.ordered import time_segment_of
from ..session import scratch_path
from ..sources import schemas, sinks
from ..streaming import carry
from ..streaming import facts as X
from ..streaming import lifecycle as Z
from ..streaming import stateful as S
from .base import ARRIVALS, Tables, arrivals_of, query, r, rl
from .service import BUNCH, EVENTS, GAP, METRIC_COLS, METRICS, OBSERVED, ROLLUP_COLS, ROLLUPS, ZONE, observed, sql_local

ONCE = {"availableNow": True}
rd = numbers.js_round


def paths(t: Tables, *names):
    return [scratch_path(t.spark, n) for n in names]


def finish(stream):
    stream.awaitTermination()


def live(t: Tables):
    return arrivals_of(t.stream("events"))


# ---- facts ----

HEADWAY_SCHEMA = ("arrival_id bigint, route_id string, direction string, stop_id string, trip_id bigint, ts timestamp, delay_seconds bigint, latency_ms bigint, "
                  "status string, headway_seconds double, is_bunch boolean, is_gap boolean")


@query("streamed_headways", f"WITH {OBSERVED} SELECT arrival_id, {r('headway_seconds', 3)} AS headway_seconds, is_bunch, is_gap FROM observed", "I1 E1")
def streamed_headways(t: Tables):
    out, state, check = paths(t, "headways", "state", "check")
    finish(X.headway_stream(live(t), out, state, check, trigger=ONCE, bunch=BUNCH, gap=GAP, max_headway=None))
    return carry.read_parts(t.spark, out, HEADWAY_SCHEMA).select("arrival_id", rd("headway_seconds", 3).alias("headway_seconds"), "is_bunch", "is_gap")


def observed_stream(t: Tables):
    """The batch headways written out and read back as a stream."""
    path = scratch_path(t.spark, "observed")
    observed(t).write.parquet(path)
    return t.spark.readStream.schema(HEADWAY_SCHEMA).parquet(path)


METRIC_SCHEMA = ("route_id string, direction string, window_start timestamp, train_count bigint, avg_delay_seconds double, on_time_percent double, headway_avg_seconds bigint, "
                 "feed_latency_ms bigint, feed_status string, bunch_count bigint, gap_count bigint")
ROLLUP_SCHEMA = "date date, route_id string, direction string, total_trains bigint, peak_train_count bigint, n_windows bigint, total_bunching bigint, total_gaps bigint"
CLOSED = "window_start + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def run_metrics(t: Tables):
    sink = paths(t, "metrics", "events", "rollups", "check")
    finish(X.metric_stream(observed_stream(t), *sink, ZONE, trigger=ONCE))
    return sink


@query("streamed_window_metrics", f"WITH {METRICS} SELECT {', '.join(METRIC_COLS)}, epoch_ms(window_start) AS timestamp FROM metrics WHERE {CLOSED}", "I1")
def streamed_window_metrics(t: Tables):
    return carry.read_parts(t.spark, run_metrics(t)[0], METRIC_SCHEMA).select(*METRIC_COLS, F.unix_millis("window_start").alias("timestamp"))


@query("streamed_service_events", f"WITH {EVENTS} SELECT pk, timestamp, stop_id, description FROM facts WHERE timestamp + 300000 <= (SELECT floor(epoch_us(max(ts)) / 1000.0)::BIGINT - 600000 FROM events)", "I1")
def streamed_service_events(t: Tables):
    return carry.read_parts(t.spark, run_metrics(t)[1], "pk string, timestamp bigint, stop_id string, description string").drop("batch_id")


@query("streamed_daily_totals", f"""WITH {METRICS} SELECT {sql_local('window_start')}::VARCHAR AS date, route_id, direction, sum(train_count)::BIGINT AS total_trains, max(train_count) AS peak_train_count, count(*) AS n_windows,
  sum(bunch_count)::BIGINT AS total_bunching, sum(gap_count)::BIGINT AS total_gaps FROM metrics WHERE {CLOSED} GROUP BY ALL""", "I1 D6")
def streamed_daily_totals(t: Tables):
    return X.daily_sums(carry.read_parts(t.spark, run_metrics(t)[2], ROLLUP_SCHEMA)).withColumn("date", F.col("date").cast("string"))


CLOSED_ROLLUPS = METRICS + ROLLUPS[len(METRICS):].replace("FROM observed GROUP BY", f"FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM observed) WHERE {CLOSED} GROUP BY").replace(
    "FROM metrics GROUP BY", f"FROM metrics WHERE {CLOSED} GROUP BY")


@query("streamed_daily_rollup", f"WITH {CLOSED_ROLLUPS} SELECT date::VARCHAR AS date, {', '.join(ROLLUP_COLS)} FROM rollups", "I1 I9 D6")
def streamed_daily_rollup(t: Tables):
    parts, counts, check = paths(t, "daily", "headways", "check")
    finish(X.daily_stream(observed_stream(t), parts, counts, check, ZONE, trigger=ONCE))
    out = X.daily_rollup_so_far(carry.read_parts(t.spark, parts, X.DAILY_PARTS), carry.read_parts(t.spark, counts, X.HEADWAY_COUNTS))
    return out.select(F.col("date").cast("string").alias("date"), *ROLLUP_COLS)


@query("streamed_daily_accumulator", f"""WITH {ARRIVALS} SELECT {sql_local('ts')}::VARCHAR AS date, route_id, direction, sum(delay_seconds)::BIGINT AS sum_delay, count(*) AS n_delay, count(*) FILTER (abs(delay_seconds) < 300) AS n_on_time, count(*) AS n_seen FROM arrivals GROUP BY ALL""", "I9")
def streamed_daily_accumulator(t: Tables):
    path, check = paths(t, "daily", "check")
    finish(X.daily_accumulator(live(t), path, check, ZONE, trigger=ONCE))
    schema = "date date, route_id string, direction string, sum_delay bigint, n_delay bigint, n_on_time bigint, n_seen bigint"
    return sinks.current_rows(t.spark, path, schema, ["date", "route_id", "direction"], "n_seen").withColumn("date", F.col("date").cast("string"))


STATUS = f"""WITH {ARRIVALS} SELECT route_id AS feed_group, epoch_ms(date_trunc('hour', ts)) AS cycle_ms, count(*) AS n_rows, max(latency_ms) AS latency_ms, CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status, count(*) FILTER (status <> 'success') AS n_failed FROM arrivals GROUP BY ALL"""


@query("feed_status_cycles", STATUS, "I12")
def feed_status_cycles(t: Tables):
    return X.feed_status(t.arrivals, "route_id", "hour").withColumn("cycle_ms", F.unix_millis("cycle")).drop("cycle")


@query("streamed_feed_status", STATUS.replace("'hour'", "'minute'"), "I12")
def streamed_feed_status(t: Tables):
    path, check = paths(t, "status", "check")
    finish(X.status_stream(live(t), "route_id", path, check, ONCE))
    return X.fold_status(carry.read_parts(t.spark, path, X.STATUS_PARTS)).withColumn("cycle_ms", F.unix_millis("cycle")).drop("cycle")


@query("streamed_metric_feed", f"WITH {ARRIVALS} SELECT arrival_id, delay_seconds FROM arrivals WHERE route_id = 'click'", "I11")
def streamed_metric_feed(t: Tables):
    path, check = paths(t, "feed", "check")
    finish(X.metric_feed(live(t).select("arrival_id", "route_id", "delay_seconds"), path, check, "click", ONCE))
    return t.spark.read.schema("arrival_id bigint, route_id string, delay_seconds bigint").parquet(path).drop("route_id")


# ---- archives and change records ----


@query("streamed_position_archive", """SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour, event_type AS feed_group, count(*) AS n, min(floor(epoch_us(ts) / 1000.0))::BIGINT AS first_ms FROM events GROUP BY ALL""", "A7 I5")
def streamed_position_archive(t: Tables):
    path, check = paths(t, "positions", "check")
    rows = t.stream("events").select(F.col("user_id").cast("string").alias("tripId"), F.col("event_type").alias("routeId"), F.col("value").alias("lat"), F.col("value").alias("lon"), "ts")
    stamped = sinks.stamped_positions(rows, F.unix_millis("ts"), F.col("routeId")).drop("ts")
    finish(sinks.archive_positions(stamped, path, check, ONCE))
    back = t.spark.read.schema(f"{schemas.ARCHIVED_POSITION}, {schemas.HOUR_PARTITIONS}").json(path)
    return back.groupBy("year", "month", "day", "hour", F.col("feedGroupId").alias("feed_group")).agg(F.count("*").alias("n"), F.min("capturedAt").alias("first_ms"))


def change_stream(t: Tables):
    """events as change records: every second one a metric, one in four a removal, some without a known shape."""
    k = F.col("event_id")
    values = {"routeId": F.when(k % 2 == 0, F.col("event_type")), "trainCount": F.when(k % 2 == 0, F.col("user_id").cast("int")),
              "pk": F.when((k % 2 == 1) & (k % 9 > 0), F.concat(F.lit("DELAY#"), F.col("event_type"))), "timestamp": F.unix_millis("ts")}
    names = list(dict.fromkeys(schemas.METRIC_COLUMNS + schemas.EVENT_COLUMNS))
    kinds = {c.split()[0]: c.split()[1] for c in f"{schemas.METRIC}, {schemas.EVENT}".split(", ")}
    image = F.struct(*[values.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    name = F.when(k % 4 == 3, "REMOVE").when(k % 4 == 1, "MODIFY").otherwise("INSERT")
    return t.stream("events").select(name.alias("eventName"), image.alias("image"))


@query("streamed_change_records", """WITH k AS (SELECT ts, event_type, CASE WHEN event_id % 2 = 0 THEN 'metrics' WHEN event_id % 9 > 0 THEN 'events' END AS kind FROM events WHERE event_id % 4 <> 3)
  SELECT kind, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, CASE WHEN kind = 'metrics' THEN strftime(ts, '%H') END AS hour, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""", "A8 I13")
def streamed_change_records(t: Tables):
    out = None
    for kind, columns, parts in (("metrics", schemas.METRIC_COLUMNS, schemas.HOUR_PARTITIONS), ("events", schemas.EVENT_COLUMNS, "year string, month string, day string")):
        path, check = paths(t, kind, "check")
        finish(sinks.write_changes(change_stream(t), kind, path, check, F.timestamp_millis("image.timestamp"), columns, ONCE))
        schema = schemas.METRIC if kind == "metrics" else schemas.EVENT
        rows = t.spark.read.schema(f"{schema}, {parts}").json(path)
        hour = F.col("hour") if kind == "metrics" else F.lit(None).cast("string")
        counts = rows.groupBy(F.lit(kind).alias("kind"), "month", "day", hour.alias("hour")).agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


@query("streamed_upserts", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL", "A10")
def streamed_upserts(t: Tables):
    path, check = paths(t, "upserts", "check")
    rows = t.stream("events").select("user_id", "event_type", "event_id", "value")
    finish(sinks.upsert_stream(rows, path, check, ["user_id", "event_type"], "event_id", ONCE))
    return sinks.current_rows(t.spark, path, "user_id bigint, event_type string, event_id bigint, value double", ["user_id", "event_type"], "event_id")


# ---- lifecycle ----

HALF_DAY = 12 * 3600
SESSIONS = f"""{ARRIVALS}, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS d FROM arrivals WINDOW w AS (PARTITION BY trip_id ORDER BY ts, arrival_id)),
  n AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= {HALF_DAY} * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY ts, arrival_id) AS session FROM g),
  trips AS (SELECT trip_id, session::BIGINT AS session, min(ts) AS a, max(ts) AS b, count(*) AS n_seen, count(DISTINCT route_id) AS stops_served, arg_max(stop_id, (ts, arrival_id)) AS last_stop_id FROM n GROUP BY trip_id, session)"""


def batch_sessions(t: Tables):
    return Z.trip_sessions(t.arrivals, time_segment_of("ts"), stop="route_id", gap_seconds=HALF_DAY)


@query("trip_sessions", f"WITH {SESSIONS} SELECT trip_id, session, epoch_us(a) AS started_us, epoch_us(b) AS last_seen_us, n_seen, stops_served FROM trips", "I2")
def trip_sessions(t: Tables):
    return batch_sessions(t).select("trip_id", "session", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_seen_at").alias("last_seen_us"), "n_seen", "stops_served")


NOW = "2024-01-30 12:00:00"


@query("trip_lifecycle_events", f"""WITH {SESSIONS} SELECT trip_id, stops_served, 'TRIP_START' AS pk, floor(epoch_us(a) / 1000.0)::BIGINT AS timestamp, NULL::BIGINT AS duration_seconds FROM trips UNION ALL
  SELECT trip_id, stops_served, 'TRIP_END', floor(epoch_us(b) / 1000.0)::BIGINT, {rl('(epoch_us(b) - epoch_us(a)) / 1e6')} FROM trips WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(b) > {HALF_DAY} * 1000000::BIGINT""", "I2")
def trip_lifecycle_events(t: Tables):
    return Z.lifecycle_events(batch_sessions(t), F.lit(NOW).cast("timestamp"), HALF_DAY)


@query("streamed_trip_sessions", f"""WITH {SESSIONS} SELECT trip_id, epoch_us(a) AS started_us, epoch_us(b) AS last_seen_us, n_seen, stops_served FROM trips
  WHERE b + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""", "I2")
def streamed_trip_sessions(t: Tables):
    path, check = paths(t, "sessions", "check")
    sessions = Z.session_stream(live(t), "1 hour", "12 hours", stop="route_id")
    writer = sessions.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).outputMode("append")
    finish(writer.trigger(**ONCE).start())
    rows = t.spark.read.schema("trip_id bigint, started_at timestamp, last_seen_at timestamp, n_seen bigint, stops_served bigint").parquet(path)
    return rows.select("trip_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_seen_at").alias("last_seen_us"), "n_seen", "stops_served")


LISTED = """WITH x AS (SELECT event_type AS g, user_id AS k, date_trunc('day', ts) AS p, event_id % 7 AS s FROM events),
  polls AS (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY p) AS i, count(*) OVER (PARTITION BY g) AS open FROM (SELECT DISTINCT g, p FROM x)),
  placed AS (SELECT x.*, i, open FROM x JOIN polls USING (g, p)), marks AS (SELECT g, k, i, i - row_number() OVER (PARTITION BY g, k ORDER BY i) AS run FROM (SELECT DISTINCT g, k, i FROM placed)),
  trips AS (SELECT g, k, run, min(p) AS a, max(p) AS b, max(i) AS i, any_value(open) AS open, count(DISTINCT s) AS n FROM placed JOIN marks USING (g, k, i) GROUP BY ALL)
  SELECT k AS trip_id, 'TRIP_START#' || g AS pk, epoch_ms(a::TIMESTAMP) AS timestamp, NULL::BIGINT AS stops_served, NULL::BIGINT AS duration_seconds FROM trips
  UNION ALL SELECT k, 'TRIP_END#' || g, epoch_ms(b::TIMESTAMP), n, (epoch_ms(b::TIMESTAMP) - epoch_ms(a::TIMESTAMP)) // 1000 FROM trips WHERE i + 1 < open"""


def listed(events):
    """Daily polls of feed groups that list the trips seen that day, each with a stop."""
    return events.select(F.col("event_type").alias("feed_group"), F.col("user_id").alias("trip_id"), F.date_trunc("day", "ts").cast("timestamp").alias("poll"),
                         (F.col("event_id") % 7).cast("string").alias("stop_id"))


@query("listed_trip_events", LISTED, "I2")
def listed_trip_events(t: Tables):
    return Z.listed_trips(listed(t.events), "feed_group", "trip_id", "poll", "stop_id", "feed_group")


@query("streamed_listed_trip_events", LISTED, "I2")
def streamed_listed_trip_events(t: Tables):
    out, state, check = paths(t, "listed", "state", "check")
    finish(Z.listed_stream(listed(t.stream("events")), "feed_group", "trip_id", "poll", "stop_id", "feed_group", out, state, check, ONCE))
    return carry.read_parts(t.spark, out, "trip_id bigint, pk string, timestamp bigint, stops_served bigint, duration_seconds bigint").drop("batch_id")


CHANGES = """WITH rows_ AS (SELECT DISTINCT event_type AS g, user_id AS k, ts::DATE AS p FROM events), polls AS (SELECT *, lead(p) OVER (PARTITION BY g ORDER BY p) AS nx, lag(p) OVER (PARTITION BY g ORDER BY p) AS pv FROM (SELECT DISTINCT g, p FROM rows_)),
  x AS (SELECT rows_.*, nx, pv FROM rows_ JOIN polls USING (g, p))
  SELECT g AS feed_group, k AS trip_id, nx::VARCHAR AS poll, 'removed' AS change FROM x WHERE nx IS NOT NULL AND (g, k, nx) NOT IN (SELECT (g, k, p) FROM rows_)
  UNION ALL SELECT g, k, p::VARCHAR, 'new' FROM x WHERE pv IS NOT NULL AND (g, k, pv) NOT IN (SELECT (g, k, p) FROM rows_)"""


def polls(events):
    return events.select(F.col("event_type").alias("feed_group"), F.col("user_id").alias("trip_id"), F.to_date("ts").alias("poll"))


@query("poll_changes", CHANGES, "I3 I4 C9")
def poll_changes(t: Tables):
    return Z.poll_changes(polls(t.events), "feed_group", "trip_id", "poll").withColumn("poll", F.col("poll").cast("string"))


@query("streamed_poll_changes", CHANGES, "I3 I4")
def streamed_poll_changes(t: Tables):
    out, state, check = paths(t, "changes", "state", "check")
    finish(Z.change_stream(polls(t.stream("events")), "feed_group", "trip_id", "poll", out, state, check, ONCE))
    found = Z.changes_so_far(t.spark, out, state, "feed_group", "trip_id", "poll", "feed_group string, trip_id bigint, poll date")
    return found.withColumn("poll", F.col("poll").cast("string"))


@query("streamed_arrival_boards", f"""WITH {ARRIVALS}, w AS (SELECT DISTINCT s_suppkey || 'N' AS stop_id FROM supplier), f AS (SELECT * FROM arrivals WHERE stop_id IN (SELECT stop_id FROM w) QUALIFY row_number() OVER (PARTITION BY stop_id, latency_ms ORDER BY arrival_id) = 1)
  SELECT * FROM (SELECT stop_id, arrival_id, row_number() OVER (PARTITION BY stop_id ORDER BY ts, arrival_id)::INT AS rank FROM f) WHERE rank <= 8""", "I6 E7")
def streamed_arrival_boards(t: Tables):
    path, state, check = paths(t, "boards", "state", "check")
    rows = live(t).select("arrival_id", "stop_id", F.col("latency_ms").alias("trip_id"), F.col("ts").alias("due"))
    wanted = t.supplier.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("N")).alias("stop_id"))
    finish(Z.board_stream(rows, wanted, path, state, check, 8, trigger=ONCE))
    boards = Z.latest_boards(t.spark, path, "arrival_id bigint, stop_id string, trip_id bigint, due timestamp")
    return boards.select(F.col("board").alias("stop_id"), "arrival_id", "rank")


LATEST = """SELECT user_id, event_type, event_id FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) WHERE event_type <> 'error'"""


def tombstoned(events):
    return events.select("user_id", "event_type", "event_id", (F.col("event_type") == "error").alias("is_removed"))


@query("latest_trip_state", LATEST, "I7")
def latest_trip_state(t: Tables):
    return Z.latest_state(tombstoned(t.events), ["user_id"], ["event_id"])


@query("streamed_trip_state", LATEST, "I7")
def streamed_trip_state(t: Tables):
    path, check = paths(t, "state", "check")
    finish(Z.state_stream(tombstoned(t.stream("events")), path, check, ["user_id"], "event_id", ONCE))
    rows = sinks.current_rows(t.spark, path, "user_id bigint, event_type string, event_id bigint, is_removed boolean", ["user_id"], "event_id")
    return rows.filter(~F.col("is_removed")).drop("is_removed")


@query("marker_statuses", f"""WITH s AS (SELECT user_id AS trip_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS route_id FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1), c AS (SELECT DISTINCT user_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{NOW}')
  SELECT trip_id, CASE WHEN trip_id IN (SELECT user_id FROM c) THEN 'active' WHEN route_id = 'signup' THEN 'removed' WHEN trip_id % 10 = 0 THEN 'fading' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen) > 36000000000 THEN 'fading'
    WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen) > 7200000000 THEN 'stale-dim' ELSE 'active' END AS status FROM s""", "I8")
def marker_statuses(t: Tables):
    now = F.lit(NOW).cast("timestamp")
    past = t.events.filter(F.col("ts") <= now)
    state = past.groupBy(F.col("user_id").alias("trip_id")).agg(F.max("ts").alias("last_seen_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("route_id"))
    current = past.filter(F.col("ts") > now - F.make_dt_interval(hours=F.lit(1))).select(F.col("user_id").alias("trip_id"))
    out = Z.marker_status(state, current, now, F.col("route_id") != "signup", F.col("trip_id") % 10 == 0, 7200, 36000)
    return out.select("trip_id", "status")


# Markers of users that act: missed after an hour, dim after two, fading after ten, gone after a day.
MARKER_SECONDS = {"missed_seconds": 3600, "dim_seconds": 7200, "cull_seconds": 36000, "forget_seconds": 86400}
MARKER_CHANGES = """WITH x AS (SELECT user_id AS trip_id, floor(epoch_us(ts) / 1000.0)::BIGINT AS ms, event_id, event_type <> 'signup' AS shown, user_id % 10 = 0 AS at_last FROM events),
  clock AS (SELECT max(ms) AS now FROM x),
  n AS (SELECT *, coalesce(lead(ms) OVER w, now) - ms AS gap, lag(event_id) OVER w IS NULL AS first FROM x, clock WINDOW w AS (PARTITION BY trip_id ORDER BY ms, event_id)),
  c AS (SELECT trip_id, 'removed' AS status, ms + 3600001 AS at_ms FROM n WHERE NOT shown AND gap > 3600000
    UNION ALL SELECT trip_id, 'fading', ms + 3600001 FROM n WHERE shown AND at_last AND gap > 3600000
    UNION ALL SELECT trip_id, 'stale-dim', ms + 7200001 FROM n WHERE shown AND NOT at_last AND gap > 7200000
    UNION ALL SELECT trip_id, 'fading', ms + 36000001 FROM n WHERE shown AND NOT at_last AND gap > 36000000
    UNION ALL SELECT trip_id, 'removed', ms + 86400001 FROM n WHERE shown AND gap > 86400000),
  changed AS (SELECT *, lag(CASE WHEN NOT shown OR at_last THEN gap > 3600000 ELSE gap > 7200000 END) OVER (PARTITION BY trip_id ORDER BY ms, event_id) AS before FROM n)
  SELECT trip_id, 'active' AS status, ms AS at_ms FROM changed WHERE first OR before UNION ALL SELECT * FROM c"""


def markers(events):
    return events.select(F.col("user_id").alias("trip_id"), "ts", F.col("event_id").alias("arrival_id"), F.col("event_type").alias("route_id"))


def shown_and_last():
    return F.col("route_id") != "signup", F.col("trip_id") % 10 == 0


@query("marker_changes", MARKER_CHANGES, "I8")
def marker_changes(t: Tables):
    rows = markers(t.events)
    return S.marker_changes(rows, rows.agg(F.unix_millis(F.max("ts"))).scalar(), *shown_and_last(), **MARKER_SECONDS)


@query("streamed_marker_changes", MARKER_CHANGES, "I8")
def streamed_marker_changes(t: Tables):
    path, check = paths(t, "markers", "check")
    finish(S.marker_stream(markers(t.stream("events")), path, check, *shown_and_last(), **MARKER_SECONDS, trigger=ONCE))
    return carry.read_parts(t.spark, path, f"trip_id bigint, {S.TRANSITION}").drop("batch_id")


@query("rolling_anomaly_store", """WITH x AS (SELECT event_type || '#' || event_id AS pk, floor(epoch_us(ts) / 1000.0)::BIGINT AS timestamp FROM events) SELECT * FROM x WHERE timestamp > (SELECT max(timestamp) FROM x) - 24 * 3600000 ORDER BY timestamp DESC, pk LIMIT 200""", "I10")
def rolling_anomaly_store(t: Tables):
    path, check = paths(t, "store", "check")
    rows = t.stream("events").select(F.concat_ws("#", "event_type", "event_id").alias("pk"), F.unix_millis("ts").alias("timestamp"))
    finish(Z.rolling_store(rows, path, check, lambda df: df.agg(F.max("timestamp")).scalar(), hours=24, trigger=ONCE))
    schema = "pk string, timestamp bigint"
    return carry.read_before(t.spark, path, schema, 2 ** 62)


