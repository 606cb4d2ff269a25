"""Events as observed arrivals: headways, window metrics, service events, daily roll-ups, dashboards."""

from pyspark.sql import functions as F

from .. import config
from ..operators import headways as H
from ..operators import rollups as R
from .base import ALERTS, ARRIVALS, ROUTE_IDS, Tables, mt, query, r, rl, route_of, sql_list, values_sql

ZONE = config.LOCAL_ZONE
BUNCH, GAP = 3600, 86400

# Feed group of each route of the binding.
GROUPS = [("click", "web"), ("error", "ops"), ("purchase", "shop"), ("signup", "shop"), ("view", "web")]
KINDS = [g[0] for g in GROUPS]


def observed(t: Tables):
    return H.headways(t.arrivals, bunch=BUNCH, gap=GAP, max_headway=None)


def groups(t: Tables):
    return t.spark.createDataFrame(GROUPS, "route_id string, feed_group string")


def metrics(t: Tables):
    return H.window_metrics(observed(t))


def rollups(t: Tables):
    return H.daily_rollup(observed(t), ZONE, headway_bucket=3600.0)


def service_events(t: Tables):
    return H.service_events(observed(t))


def sql_local(ts):
    return f"timezone('{ZONE}', timezone('UTC', {ts}))::DATE"


OBSERVED = ARRIVALS + f""",
gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY route_id, direction, stop_id ORDER BY ts, arrival_id)) / 1e6 AS h FROM arrivals),
observed AS (SELECT * EXCLUDE (h), CASE WHEN h > 0 THEN h END AS headway_seconds,
  coalesce(h > 0 AND h < {BUNCH}, false) AS is_bunch, coalesce(h > {GAP}, false) AS is_gap FROM gaps)"""

METRICS = OBSERVED + f""",
polled AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, date_trunc('minute', ts) AS poll FROM observed),
per_poll AS (SELECT route_id, direction, window_start, avg(n) AS n FROM (
  SELECT route_id, direction, window_start, poll, count(*) AS n FROM polled GROUP BY ALL) GROUP BY ALL),
metrics AS (SELECT p.route_id, p.direction, p.window_start, {rl('any_value(q.n)')} AS train_count,
  {r('avg(delay_seconds)', 1)} AS avg_delay_seconds,
  {r('count(*) FILTER (abs(delay_seconds) < 300) * 100.0 / count(delay_seconds)', 1)} AS on_time_percent,
  {rl('avg(headway_seconds)')} AS headway_avg_seconds, {rl('avg(latency_ms)')} AS feed_latency_ms,
  arg_max(status, (ts, arrival_id)) AS feed_status, count(*) FILTER (is_bunch) AS bunch_count,
  count(*) FILTER (is_gap) AS gap_count
  FROM polled p JOIN per_poll q USING (route_id, direction, window_start) GROUP BY ALL)"""

ROLLUPS = METRICS + f""",
rollups AS (SELECT * FROM (SELECT {sql_local('ts')} AS date, route_id, direction, {r('avg(delay_seconds)', 1)} AS avg_delay,
    {r('count(*) FILTER (abs(delay_seconds) < 300) * 100.0 / count(delay_seconds)', 1)} AS on_time_percent,
    {rl('avg(headway_seconds)')} AS avg_headway, {rl('median(headway_seconds)')} AS median_headway,
    count(*) FILTER (is_bunch) AS total_bunching, count(*) FILTER (is_gap) AS total_gaps FROM observed GROUP BY ALL)
  LEFT JOIN (SELECT {sql_local('window_start')} AS date, route_id, direction, max(train_count) AS peak_train_count,
    sum(train_count)::BIGINT AS total_trains, count(*) AS n_windows FROM metrics GROUP BY ALL) USING (date, route_id, direction))"""

EVENTS = OBSERVED + f""",
windowed AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM observed),
delay_events AS (SELECT 'DELAY#' || route_id || '#' || direction AS pk, epoch_ms(window_start) AS timestamp, stop_id,
    {rl('d')} AS delay_seconds, {rl(rl('d') + '/60')}::VARCHAR || 'm delay at ' || stop_id AS description
  FROM (SELECT route_id, direction, window_start, max(delay_seconds) AS d, arg_min(stop_id, (-delay_seconds, stop_id)) AS stop_id
        FROM windowed WHERE delay_seconds > 300 GROUP BY ALL)),
per_stop AS (SELECT route_id, direction, window_start, stop_id, is_bunch, count(*) AS n FROM windowed
             WHERE is_bunch OR is_gap GROUP BY ALL),
spacing AS (SELECT route_id, direction, window_start, is_bunch, sum(n)::BIGINT AS n, arg_min(stop_id, (-n, stop_id)) AS stop_id
            FROM per_stop GROUP BY ALL),
spacing_events AS (SELECT CASE WHEN is_bunch THEN 'BUNCH#' ELSE 'GAP#' END || route_id || '#' || direction AS pk,
    epoch_ms(window_start) AS timestamp, stop_id, n AS event_count,
    n::VARCHAR || CASE WHEN is_bunch THEN ' bunching at ' ELSE ' service gaps at ' END || stop_id AS description FROM spacing),
facts AS (SELECT pk, timestamp, stop_id, description FROM delay_events UNION ALL
          SELECT pk, timestamp, stop_id, description FROM spacing_events)"""


@query("headway_gaps", f"WITH {OBSERVED} SELECT arrival_id, route_id, direction, stop_id, {r('headway_seconds', 3)} AS headway_seconds, is_bunch, is_gap FROM observed", "E1")
def headway_gaps(t):
    return observed(t).select("arrival_id", "route_id", "direction", "stop_id",
                              R.js_round("headway_seconds", 3).alias("headway_seconds"), "is_bunch", "is_gap")


METRIC_COLS = ["route_id", "direction", "train_count", "avg_delay_seconds", "on_time_percent", "headway_avg_seconds",
               "feed_latency_ms", "feed_status", "bunch_count", "gap_count"]


@query("five_minute_metrics", f"WITH {METRICS} SELECT {', '.join(METRIC_COLS)}, epoch_ms(window_start) AS timestamp FROM metrics", "D1")
def five_minute_metrics(t):
    return metrics(t).select(*METRIC_COLS, F.unix_millis("window_start").alias("timestamp"))


@query("delay_events", f"WITH {EVENTS} SELECT * FROM delay_events", "D2")
def delay_events(t):
    return H.delay_events(observed(t))


@query("bunching_events", f"WITH {EVENTS} SELECT * FROM spacing_events WHERE pk LIKE 'BUNCH%'", "D3")
def bunching_events(t):
    return H.spacing_events(observed(t), "BUNCH")


@query("gap_events", f"WITH {EVENTS} SELECT * FROM spacing_events WHERE pk LIKE 'GAP%'", "D4")
def gap_events(t):
    return H.spacing_events(observed(t), "GAP")


@query("skipped_stops", f"""WITH {ARRIVALS} SELECT strftime({sql_local('ts')}, '%Y-%m-%d') AS date, route_id, direction,
  count(*) FILTER (status <> 'success') AS total_skipped_stops FROM arrivals GROUP BY ALL""", "D5")
def skipped_stops(t):
    updates = t.arrivals.withColumn("schedule_relationship", F.when(F.col("status") != "success", "SKIPPED").otherwise("SCHEDULED"))
    return H.skipped_stops(updates, ZONE).withColumn("date", F.col("date").cast("string"))


ROLLUP_COLS = ["route_id", "direction", "avg_delay", "on_time_percent", "avg_headway", "median_headway", "total_bunching",
               "total_gaps", "peak_train_count", "total_trains", "n_windows"]


@query("daily_service_rollup", f"WITH {ROLLUPS} SELECT date::VARCHAR AS date, {', '.join(ROLLUP_COLS)} FROM rollups", "D6")
def daily_service_rollup(t):
    return rollups(t).select(F.col("date").cast("string").alias("date"), *ROLLUP_COLS)


@query("daily_mean_rollup", f"""WITH {METRICS} SELECT {sql_local('window_start')}::VARCHAR AS date, route_id,
  {mt('avg_delay_seconds')} AS avg_delay, {mt('on_time_percent')} AS on_time_percent,
  {rl('avg(headway_avg_seconds)')} AS avg_headway, max(train_count) AS peak_train_count, count(*) AS n_windows
  FROM metrics GROUP BY ALL""", "D7")
def daily_mean_rollup(t):
    return H.mean_rollup(metrics(t), ZONE).withColumn("date", F.col("date").cast("string"))


GROUP_SQL = f"""groups AS (SELECT * FROM {values_sql(GROUPS, 'route_id, feed_group', 'g')}),
group_rows AS (SELECT window_start, feed_group, sum(train_count)::BIGINT AS train_count,
  coalesce(max(feed_latency_ms), 0) AS latency_ms,
  CASE WHEN bool_or(feed_status = 'error') THEN 'error' ELSE 'ok' END AS status
  FROM metrics JOIN groups USING (route_id) GROUP BY ALL)"""

HEALTH = f"""{METRICS}, {GROUP_SQL},
health AS (SELECT epoch_ms(window_start) AS timestamp, sum(train_count)::BIGINT AS train_count,
    {rl('avg(coalesce(feed_latency_ms, 0))')} AS feed_latency_ms,
    CASE WHEN bool_or(feed_status = 'error') THEN 'degraded' ELSE 'ok' END AS feed_status
  FROM metrics GROUP BY window_start)"""


@query("feed_group_status", f"WITH {METRICS}, {GROUP_SQL} SELECT epoch_ms(window_start) AS timestamp, feed_group, train_count, latency_ms, status FROM group_rows", "D8")
def feed_group_status(t):
    out = H.group_status(metrics(t), groups(t))
    return out.select(F.unix_millis("window_start").alias("timestamp"), "feed_group", "train_count", "latency_ms", "status")


@query("system_health", f"""WITH {HEALTH}, packed AS (SELECT epoch_ms(window_start) AS timestamp,
  '[' || string_agg('{{"feed_group":"' || feed_group || '","train_count":' || train_count || ',"latency_ms":' || latency_ms
   || ',"status":"' || status || '"}}', ',' ORDER BY feed_group) || ']' AS feed_group_data FROM group_rows GROUP BY window_start)
  SELECT timestamp, train_count, feed_latency_ms, feed_status, feed_group_data, 0::BIGINT AS alert_count
  FROM health JOIN packed USING (timestamp)""", "D9")
def system_health(t):
    return H.system_health(metrics(t), groups(t))


@query("latest_system_health", f"""WITH {HEALTH}, last AS (SELECT max(timestamp) AS timestamp FROM health)
  SELECT timestamp, h.train_count AS active_trains, 0::BIGINT AS alert_count, feed_group, g.train_count, latency_ms, status
  FROM last JOIN health h USING (timestamp) JOIN group_rows g ON epoch_ms(g.window_start) = timestamp""", "F4")
def latest_system_health(t):
    return R.latest_health(H.system_health(metrics(t), groups(t)),
                           "array<struct<feed_group string, train_count bigint, latency_ms bigint, status string>>")


@query("route_alert_counts", f"""WITH {ALERTS}, x AS (SELECT {sql_local('captured_at')}::VARCHAR AS date, alert_id, unnest(affected_routes) AS route_id FROM alerts)
  SELECT date, route_id, d AS direction, count(DISTINCT alert_id) AS total_alerts FROM x, (VALUES ('N'), ('S')) v(d) GROUP BY ALL""", "D10")
def route_alert_counts(t):
    return H.route_alert_counts(t.alerts, ZONE).withColumn("date", F.col("date").cast("string"))


@query("alert_events", f"""WITH {ALERTS}, x AS (SELECT *, unnest(affected_routes) AS route_id FROM alerts)
  SELECT 'ALERT#' || route_id AS pk, epoch_ms(captured_at) AS timestamp, min(alert_id) AS alert_id,
  arg_min(severity, alert_id) AS severity, substr(arg_min(header_text, alert_id), 1, 200) AS description
  FROM x GROUP BY route_id, captured_at""", "D11")
def alert_events(t):
    return H.alert_events(t.alerts)


# ---- reads ----

DAY0, DAY1 = "2024-01-05", "2024-01-25"


@query("metric_series", f"""WITH {METRICS} SELECT route_id, direction, epoch_ms(window_start) AS timestamp, train_count, avg_delay_seconds
  FROM metrics WHERE route_id = 'click' AND direction = 'N' AND window_start BETWEEN TIMESTAMP '{DAY0}' AND TIMESTAMP '{DAY1}'""", "B13")
def metric_series(t):
    out = R.in_range(metrics(t), "window_start", F.lit(DAY0).cast("timestamp"), F.lit(DAY1).cast("timestamp"), "click", "N")
    return out.orderBy("window_start").select("route_id", "direction", F.unix_millis("window_start").alias("timestamp"),
                                              "train_count", "avg_delay_seconds")


@query("rollups_in_range", f"""WITH {ROLLUPS} SELECT date::VARCHAR AS date, {', '.join(ROLLUP_COLS)} FROM rollups
  WHERE date BETWEEN DATE '{DAY0}' AND DATE '{DAY1}' AND direction = 'S'""", "B14")
def rollups_in_range(t):
    out = R.in_range(rollups(t), "date", F.lit(DAY0).cast("date"), F.lit(DAY1).cast("date"), None, "S")
    return out.orderBy("date").select(F.col("date").cast("string").alias("date"), *ROLLUP_COLS)


@query("events_by_type", f"""WITH {EVENTS} SELECT pk, timestamp, stop_id, description, split_part(pk, '#', 1) AS event_type,
  split_part(pk, '#', 2) AS route_id, split_part(pk, '#', 3) AS direction FROM facts
  WHERE pk LIKE 'GAP#view%' AND timestamp BETWEEN epoch_ms(TIMESTAMP '{DAY0}') AND epoch_ms(TIMESTAMP '{DAY1}')""", "B15 B19")
def events_by_type(t):
    ms = [F.unix_millis(F.lit(d).cast("timestamp")) for d in (DAY0, DAY1)]
    return R.events_of(service_events(t), *ms, event_type="GAP", route_id="view")


@query("anomaly_feed", f"""WITH {EVENTS} SELECT * FROM facts WHERE (pk LIKE 'DELAY#%' OR pk LIKE 'GAP#%')
  AND timestamp > epoch_ms(TIMESTAMP '{DAY0}') AND timestamp <= epoch_ms(TIMESTAMP '{DAY1}')
  ORDER BY timestamp DESC, pk LIMIT 200""", "F3")
def anomaly_feed(t):
    ms = [F.unix_millis(F.lit(d).cast("timestamp")) for d in (DAY1, DAY0)]
    return R.anomaly_feed(service_events(t), *ms, types=["DELAY", "GAP"])


# ---- dashboards ----

PERF = f"""{ROLLUPS}, perf AS (SELECT route_id, {mt('avg_delay')} AS avg_delay, {mt('on_time_percent')} AS on_time_percent,
  {rl('avg(avg_headway)')} AS avg_headway, {rl('avg(median_headway)')} AS median_headway, max(peak_train_count) AS peak_train_count,
  sum(total_bunching)::BIGINT AS total_bunching, sum(total_gaps)::BIGINT AS total_gaps, count(DISTINCT date) AS days
  FROM rollups WHERE date >= DATE '{DAY0}' GROUP BY route_id)"""


@query("route_performance", f"WITH {PERF} SELECT * FROM perf", "D17")
def route_performance(t):
    return R.route_performance(rollups(t), F.lit(DAY0).cast("date"))


@query("route_grades", f"""WITH {PERF}, scored AS (SELECT route_id, on_time_percent / 100 * 50 + greatest(0, 20 - total_bunching * 2)
  + greatest(0, 20 - total_gaps * 2) + CASE WHEN median_headway IS NOT NULL AND avg_headway > 0
      THEN least(median_headway / avg_headway, 1) * 10 ELSE 5 END AS s FROM perf)
  SELECT route_id, {r('s', 4)} AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C'
  WHEN s >= 60 THEN 'D' WHEN s IS NOT NULL THEN 'F' END AS grade FROM scored""", "D18")
def route_grades(t):
    out = R.grades(R.route_performance(rollups(t), F.lit(DAY0).cast("date")))
    return out.select("route_id", R.js_round("score", 4).alias("score"), "grade")


@query("best_and_worst_route", f"""WITH {ROLLUPS}, day AS (SELECT route_id, coalesce(avg(avg_delay), 0) AS avg_delay, avg(on_time_percent) AS o,
    sum(total_trains)::BIGINT AS total_trips FROM rollups WHERE date = DATE '2024-01-10' GROUP BY route_id HAVING avg(on_time_percent) IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (ORDER BY o DESC, route_id) AS a, count(*) OVER () AS n FROM day)
  SELECT CASE WHEN a = 1 THEN 'best' ELSE 'worst' END AS place, route_id, {r('avg_delay', 4)} AS avg_delay,
  {r('o', 4)} AS on_time_percent, total_trips FROM ranked WHERE a = 1 OR a = n""", "D19")
def best_and_worst_route(t):
    out = R.best_and_worst(rollups(t), F.lit("2024-01-10").cast("date"))
    return out.withColumns({c: R.js_round(c, 4) for c in ("avg_delay", "on_time_percent")})


@query("delay_distribution", f"""WITH {ROLLUPS}, s AS (SELECT on_time_percent / 100 AS o, abs(coalesce(avg_delay, 0)) AS d FROM rollups WHERE on_time_percent IS NOT NULL),
  b AS (SELECT 'on_time' AS bucket, o AS v FROM s UNION ALL SELECT CASE WHEN d < 120 THEN '0-2 min' WHEN d < 300 THEN '2-5 min'
    WHEN d < 600 THEN '5-10 min' ELSE '10+ min' END, greatest(0, 1 - o) FROM s
    UNION ALL SELECT unnest(['on_time', '0-2 min', '2-5 min', '5-10 min', '10+ min']), 0)
  SELECT bucket, {rl('sum(v) * 100')} AS share FROM b GROUP BY bucket""", "D20")
def delay_distribution(t):
    return R.delay_distribution(rollups(t))


@query("spacing_trend", f"""WITH {ROLLUPS} SELECT date::VARCHAR AS date, count(DISTINCT CASE WHEN total_bunching > 0 THEN route_id END) AS routes_bunching,
  count(DISTINCT CASE WHEN total_gaps > 0 THEN route_id END) AS routes_gaps FROM rollups GROUP BY date""", "D21")
def spacing_trend(t):
    return R.spacing_trend(rollups(t)).withColumn("date", F.col("date").cast("string"))


PIVOT = ", ".join(f"{mt('avg_delay', f'FILTER (route_id = {chr(39)}{k}{chr(39)})')} AS {k}" for k in KINDS)


@query("delay_trend", f"WITH {ROLLUPS} SELECT date::VARCHAR AS date, {PIVOT} FROM rollups WHERE date >= DATE '{DAY0}' GROUP BY date", "D22")
def delay_trend(t):
    return R.delay_trend(rollups(t), F.lit(DAY0).cast("date"), KINDS).withColumn("date", F.col("date").cast("string"))


@query("system_timeline", f"""WITH {ROLLUPS} SELECT date::VARCHAR AS date, coalesce({mt('avg_delay')}, 0) AS avg_delay,
  coalesce({mt('on_time_percent')}, 0) AS on_time_percent, sum(total_gaps)::BIGINT AS alerts FROM rollups GROUP BY date""", "D23")
def system_timeline(t):
    return R.system_timeline(rollups(t), "total_gaps").withColumn("date", F.col("date").cast("string"))


@query("trip_volume", f"""WITH {ROLLUPS} SELECT route_id, sum(total_trains)::BIGINT AS trips, {mt('on_time_percent')} AS on_time_percent,
  (sum(sum(total_trains)) OVER ())::BIGINT AS grand_total FROM rollups GROUP BY route_id""", "D24")
def trip_volume(t):
    return R.trip_volume(rollups(t))


@query("operational_snapshot", f"""WITH {ROLLUPS} SELECT count(DISTINCT CASE WHEN date = DATE '{DAY1}' AND total_bunching > 0 THEN route_id END) AS bunching_today,
  count(DISTINCT CASE WHEN date = DATE '{DAY1}' AND total_gaps > 0 THEN route_id END) AS gaps_today,
  {mt('on_time_percent')} AS on_time_percent FROM rollups WHERE date BETWEEN DATE '{DAY1}' - 1 AND DATE '{DAY1}'""", "D25")
def operational_snapshot(t):
    today = F.lit(DAY1).cast("date")
    return R.operational_snapshot(rollups(t), today, F.date_sub(today, 1))


@query("route_activity", f"""SELECT ro.x AS route_id, count(e.route) AS train_count FROM (SELECT unnest({sql_list(ROUTE_IDS + ['QQ'])}) AS x) ro
  LEFT JOIN (SELECT ({sql_list(ROUTE_IDS)})[user_id % {len(ROUTE_IDS)} + 1] AS route FROM events) e ON e.route = ro.x GROUP BY 1""", "D26")
def route_activity(t):
    routes = t.spark.createDataFrame([(x,) for x in ROUTE_IDS + ["QQ"]], "route_id string")
    return R.activity_counts(routes, t.events.select(F.lower(route_of(F.col("user_id"))).alias("route_id")))


@query("feed_health", f"WITH {ARRIVALS} SELECT {rl('avg((status = ' + chr(39) + 'success' + chr(39) + ')::INT) * 100')} AS feed_health FROM arrivals", "D27")
def feed_health(t):
    return R.feed_health(t.arrivals, F.col("status") == "success")


NOW = "2024-01-15 12:00:00"


@query("station_train_states", f"""WITH {ARRIVALS}, x AS (SELECT trip_id, (epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 3600e6 AS s FROM arrivals)
  SELECT trip_id, count(*) FILTER (s <= 30) AS at_station, count(*) FILTER (s > 30 AND s <= 120) AS arriving,
  count(*) FILTER (s > 120) AS en_route FROM x WHERE s > -30 AND s <= 300 GROUP BY trip_id""", "D28")
def station_train_states(t):
    """One hour of the table counts as one second, so that every window is filled."""
    scaled = F.timestamp_micros(((F.unix_micros("ts") - F.unix_micros(F.lit(NOW).cast("timestamp"))) / 3600).cast("bigint"))
    return R.train_states(t.arrivals.select("trip_id", scaled.alias("ts")), F.lit("1970-01-01").cast("timestamp"), "trip_id")


@query("arriving_stops", f"""WITH {ARRIVALS} SELECT DISTINCT stop_id FROM arrivals WHERE epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}') >= -15e6 * 60
  AND epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}') < 60e6 * 60""", "D29")
def arriving_stops(t):
    return R.arriving_stops(t.arrivals, F.lit(NOW).cast("timestamp"), low=-15 * 60, high=60 * 60)


@query("alert_severity_counts", f"WITH {ALERTS} SELECT severity, count(*) AS n_alerts FROM alerts GROUP BY severity", "D30")
def alert_severity_counts(t):
    return R.severity_counts(t.alerts)


@query("alerts_by_route", f"""WITH {ALERTS}, x AS (SELECT alert_id, severity, unnest(list_distinct(affected_routes)) AS route_id FROM alerts)
  SELECT route_id, count(*) AS n_alerts, min(alert_id) AS first_alert,
  (['critical', 'warning', 'info'])[min(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END)] AS worst_severity
  FROM x GROUP BY route_id""", "D30")
def alerts_by_route(t):
    return R.alerts_by_route(t.alerts)


@query("alerts_sorted", f"""WITH {ALERTS} SELECT alert_id, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank,
  epoch_ms(updated_at) AS updated_ms FROM alerts""", "F1")
def alerts_sorted(t):
    out = R.sort_alerts(t.alerts.select("alert_id", "severity", "updated_at"), config.SEVERITY_RANK)
    return out.select("alert_id", "severity", "severity_rank", F.unix_millis("updated_at").alias("updated_ms"))


@query("alert_speed_factors", f"""WITH {ALERTS}, x AS (SELECT lower(alert_type) AS k, unnest(affected_routes) AS route_id FROM alerts)
  SELECT a.route_id, coalesce(min(CASE WHEN k LIKE '%suspension%' OR k LIKE '%cancel%' THEN 0.5 WHEN k LIKE '%delay%' THEN 0.8
    WHEN k LIKE '%service change%' OR k LIKE '%detour%' THEN 0.9 ELSE 1.0 END), 1.0)::DOUBLE AS speed_factor
  FROM (SELECT unnest({sql_list(ROUTE_IDS + ['QQ'])}) AS route_id) a LEFT JOIN x USING (route_id) GROUP BY 1""", "D46")
def alert_speed_factors(t):
    routes = t.spark.createDataFrame([(x,) for x in ROUTE_IDS + ["QQ"]], "route_id string")
    return R.alert_speed(t.alerts, routes, config.ALERT_SPEED)


# ---- signals ----


@query("direction_imbalance", f"""WITH {ROLLUPS}, x AS (SELECT date::VARCHAR AS date, route_id, max(total_trains) FILTER (direction = 'N') AS north,
  max(total_trains) FILTER (direction = 'S') AS south FROM rollups GROUP BY ALL)
  SELECT date, route_id, north, south, {r('greatest(north, south)::DOUBLE / least(north, south)', 1)} AS ratio FROM x
  WHERE north > 0 AND south > 0 AND greatest(north, south)::DOUBLE / least(north, south) > 1.5""", "D43")
def direction_imbalance(t):
    daily = rollups(t).select(F.col("date").cast("string").alias("date"), "route_id", "direction", F.col("total_trains").alias("train_count"))
    return R.direction_imbalance(daily, ["date", "route_id"])


@query("cascading_routes", f"""WITH {EVENTS}, x AS (SELECT split_part(pk, '#', 2) AS route_id, timestamp, split_part(pk, '#', 1) || ': ' || description AS summary
  FROM facts WHERE timestamp >= epoch_ms(TIMESTAMP '{DAY0}'))
  SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY timestamp, summary) AS rank, count(*) OVER (PARTITION BY route_id) AS n_anomalies, summary
  FROM x QUALIFY n_anomalies >= 2""", "D44")
def cascading_routes(t):
    return R.cascading_routes(service_events(t), F.unix_millis(F.lit(DAY0).cast("timestamp")))


@query("ahead_of_schedule", f"""WITH {METRICS}, x AS (SELECT route_id, direction, epoch_ms(window_start) AS timestamp, {r('avg_delay_seconds / 60', 1)} AS delay_minutes FROM metrics)
  SELECT * FROM x WHERE delay_minutes < -0.5""", "D45 H13")
def ahead_of_schedule(t):
    out = R.ahead_of_schedule(metrics(t))
    return out.select("route_id", "direction", F.unix_millis("window_start").alias("timestamp"), "delay_minutes")
