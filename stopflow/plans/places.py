"""customers as stops, events as positions, documents as alerts: filters, flags, names, texts, set operations."""

from pyspark.sql import functions as F

from .. import config
from ..functions import geo, numbers, text, times
from ..operators import lookups as L
from ..operators import predicates as P
from ..operators import rollups as R
from .base import (ALERTS, ARRIVALS, STOPS, Tables, query, r, rl, route_of, sql_list, sql_route_of, values_sql)

ALIASES = config.ROUTE_ALIASES


def sql_canonical(c):
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sorted(ALIASES.items()))
    return f"(CASE upper({c}) {whens} ELSE upper({c}) END)"


# ---- stops ----


@query("stop_directions", f"""WITH {STOPS} SELECT stop_key, stop_id, CASE WHEN stop_id LIKE '%N' THEN 'N' WHEN stop_id LIKE '%S' THEN 'S' END AS direction,
  CASE WHEN stop_id LIKE '%N' THEN 'Northbound' WHEN stop_id LIKE '%S' THEN 'Southbound' ELSE 'Unknown' END AS label,
  regexp_replace(stop_id, '[NS]$', '') AS parent_id FROM stops""", "B1 B2 H15")
def stop_directions(t):
    d = text.direction("stop_id")
    return t.stops.select("stop_key", "stop_id", d.alias("direction"), text.direction_label(d).alias("label"),
                          text.parent_stop("stop_id").alias("parent_id"))


@query("parent_stations", f"WITH {STOPS} SELECT stop_key, stop_id FROM stops WHERE parent_station IS NULL AND NOT regexp_matches(stop_id, '[NS]$')", "B3")
def parent_stations(t):
    return P.parent_stations(t.stops).select("stop_key", "stop_id")


def positions(t: Tables):
    u = F.col("user_id")
    nxt = F.concat((F.col("event_id") % 640).cast("string"), F.when(F.col("event_id") % 3 == 0, "N").when(F.col("event_id") % 3 == 1, "S").otherwise(""))
    north = [n for _, n, _ in config.ROUTE_TERMINALS]
    sign = F.element_at(F.array(*[F.lit(x) for x in sorted(set(north))]), (F.col("event_id") % len(set(north)) + 1).cast("int"))
    return t.events.select("event_id", F.lower(route_of(u)).alias("route_id"), nxt.alias("next_stop_id"),
                           F.when(F.col("event_id") % 5 > 0, sign).alias("headsign"), "ts")


NORTH = sorted({n for _, n, _ in config.ROUTE_TERMINALS})
POSITIONS = f"""positions AS (SELECT event_id, lower({sql_route_of('user_id')}) AS route_id,
  (event_id % 640)::VARCHAR || CASE event_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS next_stop_id,
  CASE WHEN event_id % 5 > 0 THEN ({sql_list(NORTH)})[event_id % {len(NORTH)} + 1] END AS headsign, ts FROM events)"""


@query("canonical_routes", f"WITH {POSITIONS} SELECT event_id, route_id, {sql_canonical('route_id')} AS canonical_route FROM positions", "B4")
def canonical_routes(t):
    return P.with_canonical_route(positions(t), ALIASES).select("event_id", "route_id", "canonical_route")


@query("route_filter", f"WITH {POSITIONS} SELECT event_id, route_id FROM positions WHERE upper(route_id) IN ('S', '6X', 'A') OR {sql_canonical('route_id')} IN ('S', '6X', 'A')", "B5")
def route_filter(t):
    return P.filter_routes(positions(t), ["s", "6X", "A"], ALIASES).select("event_id", "route_id")


def sql_serves(route):
    parts = [f"list_contains(string_split(routes, ' '), '{route}')"]
    parts += [f"stop_id LIKE '{p}%'" for o, p in config.ROUTE_PREFIXES if o == route]
    parts += [f"coalesce(TRY_CAST(regexp_extract(stop_id, '^R?(\\d+)', 1) AS INTEGER) BETWEEN {a} AND {b}, false)" for o, a, b in config.ROUTE_RANGES if o == route]
    return " OR ".join(parts)


@query("stops_serving_route", f"""WITH {STOPS} SELECT 'N' AS route_id, stop_key, stop_id FROM stops WHERE {sql_serves('N')}
  UNION ALL SELECT '5X', stop_key, stop_id FROM stops WHERE {sql_serves('5')}""", "B6 F7")
def stops_serving_route(t):
    out = None
    for route in ("N", "5X"):
        one = P.filter_stops_by_route(t.stops, route, config.ROUTE_PREFIXES, config.ROUTE_RANGES, ALIASES)
        one = one.orderBy("stop_name", "stop_id").select(F.lit(route).alias("route_id"), "stop_key", "stop_id")
        out = one if out is None else out.unionByName(one)
    return out


PREFIX_SQL = values_sql(config.ROUTE_PREFIXES, "route_id, prefix", "p")


@query("routes_of_stops", f"""WITH {STOPS}, pairs AS (SELECT stop_key, unnest(string_split(routes, ' ')) AS route_id FROM stops
    UNION SELECT stop_key, p.route_id FROM stops JOIN {PREFIX_SQL} ON starts_with(stop_id, prefix))
  SELECT stop_key, string_agg(route_id, ' ' ORDER BY route_id) AS all_routes FROM pairs GROUP BY 1""", "B7")
def routes_of_stops(t):
    return P.routes_of_stops(t.stops, config.ROUTE_PREFIXES).select("stop_key", F.array_join(F.array_sort("all_routes"), " ").alias("all_routes"))


OWNERS = values_sql([(g, x) for g, members in config.FEED_GROUPS.items() for x in members], "feed_group, route", "g")


@query("feed_groups_of_routes", f"WITH {POSITIONS} SELECT event_id, feed_group FROM positions LEFT JOIN {OWNERS} ON route = regexp_replace(upper(route_id), 'X$', '')", "B8")
def feed_groups_of_routes(t):
    return P.with_feed_group(positions(t), config.FEED_GROUPS).select("event_id", "feed_group")


@query("stop_search", f"WITH {STOPS} SELECT stop_key, stop_name FROM stops WHERE (lower(stop_name) LIKE '%00001%' OR lower(stop_id) LIKE '%00001%') AND list_contains(string_split(routes, ' '), 'A') ORDER BY stop_name, stop_id LIMIT 25", "B9")
def stop_search(t):
    return P.search_stops(t.stops, "00001", "a", 25).select("stop_key", "stop_name")


@query("alerts_for_routes", f"WITH {ALERTS} SELECT alert_id FROM alerts WHERE list_has_any(affected_routes, ['A', '7'])", "B10")
def alerts_for_routes(t):
    return P.alerts_for_routes(t.alerts, ["A", "7"]).select("alert_id")


NOW = "2024-01-15 12:00:00"


def alerts_with_periods(t: Tables):
    k = F.col("alert_id")
    end = F.when(k % 3 > 0, F.timestamp_seconds(F.unix_timestamp("captured_at") + k % 50 * 3600))
    empty = F.array().cast("array<struct<start:timestamp,end:timestamp>>")
    later = F.struct(F.timestamp_seconds(F.unix_timestamp("captured_at") + 864000).alias("start"), F.lit(None).cast("timestamp").alias("end"))
    one = F.struct(F.col("captured_at").alias("start"), end.alias("end"))
    return t.alerts.withColumn("active_periods", F.when(k % 10 == 0, empty).when(k % 4 == 0, F.array(later, one)).otherwise(F.array(one)))


PERIODS = f"""{ALERTS}, timed AS (SELECT *, captured_at AS s1, CASE WHEN alert_id % 3 > 0 THEN captured_at + to_hours(alert_id % 50) END AS e1,
  captured_at + INTERVAL 10 DAY AS s2 FROM alerts)"""


@query("active_alerts", f"""WITH {PERIODS} SELECT alert_id FROM timed WHERE alert_id % 10 = 0 OR (alert_id % 4 = 0 AND s2 <= TIMESTAMP '{NOW}')
  OR (s1 <= TIMESTAMP '{NOW}' AND (e1 IS NULL OR TIMESTAMP '{NOW}' <= e1))""", "B11")
def active_alerts(t):
    return P.active_alerts(alerts_with_periods(t), F.lit(NOW).cast("timestamp")).select("alert_id")


def sql_stamp(c):
    lt = f"timezone('{config.LOCAL_ZONE}', timezone('UTC', {c}))"
    return f"strftime({lt}, '%b %-d, %-I:%M %p')"


@query("alert_period_texts", f"""WITH {PERIODS}, x AS (SELECT alert_id, CASE WHEN alert_id % 4 = 0 THEN s2 ELSE s1 END AS s, CASE WHEN alert_id % 4 <> 0 THEN e1 END AS e FROM timed)
  SELECT alert_id, CASE WHEN alert_id % 10 = 0 THEN 'Ongoing' WHEN e IS NULL THEN 'Starting ' || {sql_stamp('s')} ELSE {sql_stamp('s')} || ' - ' || {sql_stamp('e')} END AS period FROM x""", "H10")
def alert_period_texts(t):
    return alerts_with_periods(t).select("alert_id", times.period_text("active_periods", config.LOCAL_ZONE).alias("period"))


def updates(t: Tables):
    k = F.col("arrival_id")
    return t.arrivals.select(k, "stop_id", F.when(k % 6 > 0, F.col("ts")).alias("arrival_time"), F.timestamp_seconds(F.unix_timestamp("ts") + 30).alias("departure_time"))


@query("upcoming_arrivals", f"""WITH {ARRIVALS}, u AS (SELECT arrival_id, stop_id, CASE WHEN arrival_id % 6 > 0 THEN ts ELSE date_trunc('second', ts) + INTERVAL 30 SECOND END AS due FROM arrivals),
  w AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_custkey || 'N' END AS s FROM customer)
  SELECT arrival_id, stop_id, epoch_us(due) AS due_us FROM u WHERE epoch_us(due) - epoch_us(TIMESTAMP '{NOW}') BETWEEN -60000000::BIGINT * 60 AND 1200000000::BIGINT * 60
    AND (stop_id IN (SELECT s FROM w) OR regexp_replace(stop_id, '[NS]$', '') IN (SELECT s FROM w))""", "B12")
def upcoming_arrivals(t):
    c = F.col("c_custkey")
    wanted = t.customer.select(F.when(c % 2 == 0, c.cast("string")).otherwise(F.concat(c.cast("string"), F.lit("N"))).alias("stop_id"))
    out = P.upcoming_arrivals(updates(t), F.lit(NOW).cast("timestamp"), wanted, 3600, 72000)
    return out.select("arrival_id", "stop_id", F.unix_micros("due").alias("due_us"))


@query("positions_on_route", f"WITH {POSITIONS} SELECT event_id FROM positions WHERE upper(route_id) = 'GS'", "B16")
def positions_on_route(t):
    return P.positions_on_route(positions(t), "gs").select("event_id")


@query("positions_near_stop", f"WITH {POSITIONS} SELECT event_id, next_stop_id FROM positions WHERE next_stop_id IN ('41', '41N', '41S')", "B16")
def positions_near_stop(t):
    return P.positions_near_stop(positions(t), "41").select("event_id", "next_stop_id")


@query("id_validity", f"""WITH {STOPS}, x AS (SELECT stop_key, CASE WHEN stop_key % 5 = 0 THEN stop_name ELSE split_part(routes, ' ', 1) END AS route_id, stop_id,
    CASE WHEN stop_key % 7 > 0 THEN regexp_replace(stop_id, '[NS]$', '') ELSE stop_id || '-' END AS station_id, split_part(routes, ' ', 2) AS feed_group FROM stops)
  SELECT stop_key, concat_ws(',', CASE WHEN NOT regexp_matches(route_id, '^[A-Za-z0-9]{{1,3}}$') THEN 'route_id' END,
    CASE WHEN NOT (regexp_matches(stop_id, '^[A-Za-z0-9]+[NSns]?$') AND length(stop_id) <= 10) THEN 'stop_id' END,
    CASE WHEN NOT (regexp_matches(station_id, '^[A-Za-z]?[0-9]+$') AND length(station_id) <= 10) THEN 'station_id' END,
    CASE WHEN feed_group NOT IN {tuple(config.FEED_GROUPS)} THEN 'feed_group' END) AS failed_rules FROM x""", "B17")
def id_validity(t):
    k = F.col("stop_key")
    tokens = F.split("routes", " ")
    rows = t.stops.select(k, F.when(k % 5 == 0, F.col("stop_name")).otherwise(tokens[0]).alias("route_id"), "stop_id",
                          F.when(k % 7 > 0, text.parent_stop("stop_id")).otherwise(F.concat("stop_id", F.lit("-"))).alias("station_id"), tokens[1].alias("feed_group"))
    rules = P.id_rules("route_id", "stop_id", "station_id", "feed_group", list(config.FEED_GROUPS))
    return P.with_failed_rules(rows, rules).select("stop_key", F.array_join("failed_rules", ",").alias("failed_rules"))


TERMINALS = values_sql(config.ROUTE_TERMINALS, "route, n, s", "tm")


@query("headsign_check", f"""WITH {POSITIONS}, x AS (SELECT event_id, headsign, right(next_stop_id, 1) AS d, n, s FROM positions LEFT JOIN {TERMINALS} ON route = upper(route_id)),
  y AS (SELECT *, CASE d WHEN 'N' THEN n WHEN 'S' THEN s END AS ahead, CASE d WHEN 'N' THEN s WHEN 'S' THEN n END AS behind FROM x)
  SELECT event_id, CASE WHEN ahead IS NOT NULL AND (headsign IS NULL OR contains(lower(headsign), split_part(split_part(lower(behind), '-', 1), ' ', 1))) THEN ahead
    WHEN headsign IS NULL THEN 'Unknown' ELSE headsign END AS headsign_shown FROM y""", "B18")
def headsign_check(t):
    return P.with_valid_headsign(positions(t), config.ROUTE_TERMINALS).select("event_id", "headsign_shown")


# ---- joins and set operations ----


@query("customer_attributes", "SELECT c_custkey, s_name AS attribute_name, s_nationkey AS attribute_nation FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey", "C8")
def customer_attributes(t):
    attributes = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("attribute_name"), F.col("s_nationkey").alias("attribute_nation"))
    return L.with_attributes(t.customer, attributes, "c_custkey", ["attribute_name", "attribute_nation"]).select("c_custkey", "attribute_name", "attribute_nation")


def day_ids(t, day):
    return t.arrivals.filter(F.to_date("ts") == F.lit(day).cast("date")).select("trip_id", "route_id")


@query("snapshot_changes", """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts::DATE = DATE '2024-01-10'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts::DATE = DATE '2024-01-11')
  SELECT user_id AS trip_id, event_type AS route_id, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
  UNION ALL SELECT user_id, event_type, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", "C9 G4 I4")
def snapshot_changes(t):
    return L.snapshot_changes(day_ids(t, "2024-01-10"), day_ids(t, "2024-01-11"), ["trip_id", "route_id"])


@query("fresh_over_stale", """WITH f AS (SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND event_type IN ('click', 'view')),
    c AS (SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type <> 'error'), s AS (SELECT event_id, event_type FROM events)
  SELECT *, 'fresh' AS source FROM f UNION ALL SELECT *, 'cached' FROM c WHERE event_type NOT IN (SELECT event_type FROM f)
  UNION ALL SELECT *, 'stale' FROM s WHERE event_type NOT IN (SELECT event_type FROM f UNION SELECT event_type FROM c)""", "G3")
def fresh_over_stale(t):
    e = t.events.select("event_id", "event_type", "ts")
    sources = [("fresh", e.filter("ts >= timestamp'2024-01-30' and event_type in ('click', 'view')")),
               ("cached", e.filter("ts >= timestamp'2024-01-20' and event_type <> 'error'")), ("stale", e)]
    return L.prefer_fresh(sources, "event_type").select("event_id", "event_type", "source")


@query("union_by_name", """SELECT event_id AS id, event_type AS kind, value, NULL::VARCHAR AS text FROM events UNION ALL SELECT doc_id, lang, NULL, text FROM documents""", "G1")
def union_by_name(t):
    a = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    b = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "text")
    return a.unionByName(b, allowMissingColumns=True)


@query("station_route_pairs", f"""WITH {STOPS} SELECT regexp_replace(stop_id, '[NS]$', '') AS station_id, split_part(routes, ' ', 1) AS route_id FROM stops
  UNION SELECT l_suppkey::VARCHAR, {sql_route_of('l_orderkey')} FROM lineitem""", "G5")
def station_route_pairs(t):
    a = t.stops.select(text.parent_stop("stop_id").alias("station_id"), F.split("routes", " ")[0].alias("route_id"))
    b = t.lineitem.select(F.col("l_suppkey").cast("string").alias("station_id"), route_of(F.col("l_orderkey")).alias("route_id"))
    return a.union(b).distinct()


STATES = f"""{ARRIVALS}, x AS (SELECT trip_id, (epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 3600e6 AS s FROM arrivals),
states AS (SELECT trip_id, count(*) FILTER (s <= 30) AS at_station, count(*) FILTER (s > 30 AND s <= 120) AS arriving, count(*) FILTER (s > 120) AS en_route
  FROM x WHERE s > -30 AND s <= 300 GROUP BY trip_id)"""


@query("station_rows", f"""WITH {STATES} SELECT c_custkey AS trip_id, c_name AS station_name, coalesce(at_station, 0) AS at_station, coalesce(arriving, 0) AS arriving, coalesce(en_route, 0) AS en_route,
  c_custkey IN (SELECT doc_id FROM labels WHERE toxic = 1) AS has_alert FROM customer LEFT JOIN states ON trip_id = c_custkey""", "C16")
def station_rows(t):
    scaled = F.timestamp_micros(((F.unix_micros("ts") - F.unix_micros(F.lit(NOW).cast("timestamp"))) / 3600).cast("bigint"))
    states = R.train_states(t.arrivals.select("trip_id", scaled.alias("ts")), F.lit("1970-01-01").cast("timestamp"), "trip_id")
    stations = t.customer.select(F.col("c_custkey").alias("trip_id"), F.col("c_name").alias("station_name"))
    return R.station_rows(stations, states, t.labels.filter("toxic = 1").select(F.col("doc_id").alias("trip_id")), "trip_id")


@query("rollup_alert_counts", f"""WITH {ALERTS}, e AS (SELECT strftime(captured_at, '%Y-%m-%d') AS date, unnest(affected_routes) AS route_id FROM alerts),
  c AS (SELECT date, route_id, count(*) AS n FROM e GROUP BY ALL),
  b AS (SELECT strftime(ts, '%Y-%m-%d') AS date, {sql_route_of('user_id')} AS route_id, count(*) AS n_events FROM events GROUP BY ALL)
  SELECT b.*, coalesce(n, 0) AS total_alerts FROM b LEFT JOIN c USING (date, route_id)""", "C17")
def rollup_alert_counts(t):
    day = F.date_format("captured_at", "yyyy-MM-dd").alias("date")
    alert_rows = t.alerts.select(day, F.explode(F.transform("affected_routes", lambda x: F.concat(F.lit("ALERT#"), x))).alias("pk"))
    base = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), route_of(F.col("user_id")).alias("route_id")).agg(F.count("*").alias("n_events"))
    return L.with_alert_counts(base, alert_rows)


@query("affected_stop_names", f"""WITH {STOPS}, n AS (SELECT stop_id, min(stop_name) AS n FROM stops GROUP BY 1),
  x AS (SELECT alert_id, p, s FROM (SELECT doc_id AS alert_id, [0, 1, 2] AS ps, [(n_chars % 700)::VARCHAR || 'N', (doc_id * 2 % 700)::VARCHAR, (n_chars % 700)::VARCHAR || 'S'] AS ss FROM documents),
    LATERAL (SELECT unnest(ps) AS p, unnest(ss) AS s)),
  y AS (SELECT alert_id, coalesce(n.n, rtrim(s, 'NS')) AS name, min(p) AS p FROM x LEFT JOIN n ON n.stop_id = rtrim(s, 'NS') GROUP BY ALL)
  SELECT alert_id, string_agg(name, '|' ORDER BY p) AS stop_names FROM y GROUP BY 1""", "C19")
def affected_stop_names(t):
    n, d = F.col("n_chars") % 700, F.col("doc_id") * 2 % 700
    listed = F.array(F.concat(n.cast("string"), F.lit("N")), d.cast("string"), F.concat(n.cast("string"), F.lit("S")))
    alerts = t.documents.select(F.col("doc_id").alias("alert_id"), listed.alias("affected_stops"))
    return L.affected_stop_names(alerts, t.stops).select("alert_id", F.array_join("stop_names", "|").alias("stop_names"))


@query("document_library", """WITH x AS (SELECT DISTINCT d.doc_id, lang, source, n_chars FROM documents d UNION SELECT d.doc_id, lang, source, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality = 1)
  SELECT doc_id, lang, n_chars, count(*) OVER (PARTITION BY lang) AS n_in_category FROM x ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 25""", "F6")
def document_library(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    merged = d.union(d.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id").select(d.columns)).distinct()
    sizes = merged.groupBy("lang").agg(F.count("*").alias("n_in_category"))
    page = R.page_of(merged, [F.desc("n_chars"), F.asc("doc_id")], 25, 50)
    return page.join(sizes, "lang").select("doc_id", "lang", "n_chars", "n_in_category")


# ---- scalar expressions ----


def coords(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", "label", (F.lit(40.7) + e[0].cast("double") / 10).alias("lat"), (F.lit(-74.0) + e[1].cast("double") / 10).alias("lon"))


SQL_KM = "2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))"


def sql_hav(lat1, lon1, lat2, lon2):
    return f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"


def sql_bearing(lat1, lon1, lat2, lon2):
    return (f"(degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - "
            f"sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))) + 360) % 360")


COORDS = "coords AS (SELECT vec_id, label, 40.7 + embedding[1]::DOUBLE / 10 AS lat, -74.0 + embedding[2]::DOUBLE / 10 AS lon FROM embeddings)"


@query("distances_and_bearings", f"""WITH {COORDS}, x AS (SELECT vec_id, {sql_hav('40.7', '-74.0', 'lat', 'lon')} AS a, {sql_bearing('40.7', '-74.0', 'lat', 'lon')} AS b FROM coords), y AS (SELECT vec_id, {SQL_KM} AS km, b FROM x)
  SELECT vec_id, {r('km', 6)} AS km, {r('b', 4)} AS bearing, CASE WHEN km * 1000 / 1609.344 < 0.1 THEN {rl('km * 1000 * 3.28084')} || ' ft' ELSE printf('%.1f mi', km * 1000 / 1609.344) END AS shown FROM y""", "H1 H2 H12")
def distances_and_bearings(t):
    here = (F.lit(40.7), F.lit(-74.0))
    km = geo.haversine_km(*here, "lat", "lon")
    return coords(t).select("vec_id", numbers.js_round(km, 6).alias("km"), numbers.js_round(geo.bearing(*here, "lat", "lon"), 4).alias("bearing"),
                            geo.distance_text(km * 1000).alias("shown"))


def sql_local(c):
    return f"timezone('{config.LOCAL_ZONE}', timezone('UTC', {c}))"


@query("local_times", f"""SELECT event_id, extract('epoch' FROM date_trunc('second', {sql_local('ts')})::TIME)::BIGINT AS day_seconds, ({sql_local('ts')} - INTERVAL 3 HOUR)::DATE::VARCHAR AS service_date,
  CASE dayofweek({sql_local('ts')}) WHEN 6 THEN 'Saturday' WHEN 0 THEN 'Sunday' ELSE 'Weekday' END AS service_type, strftime({sql_local('ts')}, '%-I:%M %p') AS clock FROM events""", "H5 H6 H10")
def local_times(t):
    z = config.LOCAL_ZONE
    return t.events.select("event_id", times.seconds_of_local_day("ts", z).alias("day_seconds"), times.service_date("ts", z).cast("string").alias("service_date"),
                           times.service_day_type(times.local_date("ts", z)).alias("service_type"), times.local_clock("ts", z).alias("clock"))


@query("relative_times", f"""WITH x AS (SELECT event_id, ts, floor((epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 1e6 + 0.5)::BIGINT AS s FROM events)
  SELECT event_id, CASE WHEN s < -30 THEN abs(floor(s / 60.0 + 0.5))::BIGINT || 'm ago' WHEN s <= 30 THEN 'now' WHEN floor(s / 60.0) <= 1 THEN '1m' ELSE floor(s / 60.0)::BIGINT || 'm' END AS eta,
   CASE WHEN floor((epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 6e7 + 0.5) <= 0 THEN 'Arriving' WHEN floor((epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 6e7 + 0.5) = 1 THEN '1 min'
     ELSE floor((epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 6e7 + 0.5)::BIGINT || ' mins' END AS minutes_text,
   CASE WHEN floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 6e7) < 1 THEN 'just now' WHEN floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 6e7) < 60
     THEN floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 6e7)::BIGINT || 'm ago' ELSE floor(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 6e7) / 60)::BIGINT || 'h ago' END AS age FROM x""", "H10 H15")
def relative_times(t):
    now = F.lit(NOW).cast("timestamp")
    return t.events.select("event_id", times.relative_eta("ts", now).alias("eta"), times.eta_minutes_text("ts", now).alias("minutes_text"),
                           times.age_text("ts", F.lit("2024-02-01").cast("timestamp")).alias("age"))


@query("clock_seconds", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE (l_quantity::INT % 30) || ':' || lpad((l_partkey % 60)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') END AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c <> 'n/a' THEN split_part(c, ':', 1)::BIGINT * 3600 + split_part(c, ':', 2)::BIGINT * 60 + split_part(c, ':', 3)::BIGINT END AS seconds,
   CASE WHEN c <> 'n/a' THEN split_part(c, ':', 1)::BIGINT * 3600 + split_part(c, ':', 2)::BIGINT * 60 END AS minute_seconds FROM x""", "H4")
def clock_seconds(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    clock = F.concat_ws(":", (F.col("l_quantity").cast("int") % 30).cast("string"), F.lpad((p % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))
    c = F.when(p % 9 == 0, "n/a").otherwise(clock)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", times.clock_to_seconds(c).alias("seconds"),
                             times.clock_to_seconds(c, True).alias("minute_seconds"))


@query("parsed_numbers", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE format('{:,.2f}', o_totalprice) END AS price, o_orderkey % 9973 / 100.0 || '%' AS share,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00') ELSE '' END AS d FROM orders)
  SELECT o_orderkey, TRY_CAST(replace(price, ',', '') AS DOUBLE) AS price, coalesce(trunc(TRY_CAST(replace(price, ',', '') AS DOUBLE)), 0)::BIGINT AS whole, replace(share, '%', '')::DOUBLE AS share,
   CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM x JOIN orders USING (o_orderkey)""", "H8 H9")
def parsed_numbers(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    price = F.when(k % 13 == 0, " ").otherwise(F.format_number("o_totalprice", 2))
    share = F.concat((k % 9973 / 100.0).cast("string"), F.lit("%"))
    date = (F.when(k % 4 == 0, F.date_format(d, "M/d/yyyy")).when(k % 4 == 1, F.date_format(d, "M/d/yy")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).otherwise(""))
    return t.orders.select("o_orderkey", numbers.parse_double(price).alias("price"), numbers.parse_long(price, True).alias("whole"),
                           numbers.parse_double(share).alias("share"), times.normalize_date(date).alias("date"))


@query("trip_id_parts", f"""SELECT event_id, nullif(regexp_extract(i, '-00_(.+)$', 1), '') AS suffix, nullif(regexp_extract(i, '_([A-Za-z0-9]+\\.\\.[NSns][A-Za-z0-9]*)$', 1), '') AS shape,
  regexp_extract(coalesce(nullif(regexp_extract(i, '-00_(.+)$', 1), ''), i), '^(.*?\\.\\..)', 1) AS key, 'r:' || user_id || ':' || event_type AS composed, event_type AS second_part
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'AB-Weekday-00_' ELSE '' END || lpad((event_id % 1440 * 100)::VARCHAR, 6, '0') || '_' || {sql_route_of('user_id')} || '..S' || user_id AS i FROM events)""", "H7 H20 B19")
def trip_id_parts(t):
    k = F.col("event_id")
    i = F.concat(F.when(k % 2 == 0, "AB-Weekday-00_").otherwise(""), F.lpad((k % 1440 * 100).cast("string"), 6, "0"), F.lit("_"), route_of(F.col("user_id")), F.lit("..S"), F.col("user_id").cast("string"))
    composed = text.compose_key(F.lit("r"), "user_id", "event_type")
    return t.events.select(k, text.trip_suffix(i).alias("suffix"), text.trip_shape(i).alias("shape"), text.trip_key(i).alias("key"),
                           composed.alias("composed"), text.key_part(composed, 2, ":").alias("second_part"))


@query("document_texts", r"""SELECT doc_id, sha256(text) AS content_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short, regexp_replace(text, '<[^>]*>', '', 'g') AS plain FROM documents""", "H15 H19")
def document_texts(t):
    return t.documents.select("doc_id", text.content_id("text").alias("content_id"), text.truncate_text("text", 80).alias("short"), text.strip_tags("text").alias("plain"))


@query("lead_sentences", r"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
  SELECT doc_id, array_to_string(list_filter(s, lambda x: length(trim(x)) > 10)[1:2], ' ') AS lead FROM p""", "H19")
def lead_sentences(t):
    return t.documents.select("doc_id", text.lead_sentences("text").alias("lead"))


@query("preferred_texts", r"""SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE source END AS plain, CASE WHEN doc_id % 2 = 0 THEN '<p>' || doc_id || '</p>' WHEN lang = 'en' THEN text ELSE source END AS html FROM documents""", "H14")
def preferred_texts(t):
    rows = F.array(F.struct(F.lit("xx").alias("language"), F.col("source").alias("text")), F.struct(F.col("lang").alias("language"), F.col("text").alias("text")),
                   F.struct(F.when(F.col("doc_id") % 2 == 0, "en-html").otherwise("none").alias("language"), F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.lit("</p>")).alias("text")))
    plain = text.preferred_text(F.filter(rows, lambda x: x["language"] != "en-html"))
    return t.documents.select("doc_id", plain.alias("plain"), text.preferred_text(rows, True).alias("html"))


@query("calendar_features", f"""SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS day_of_week, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day_of_month, dayofyear(o_orderdate)::INT AS day_of_year, weekofyear(o_orderdate)::INT AS week_of_year,
  year(o_orderdate)::INT AS year, (isodow(o_orderdate) >= 6)::INT AS is_weekend, {r('sin(2 * pi() * (isodow(o_orderdate) - 1) / 7)', 6)} AS dow_sin, {r('cos(2 * pi() * month(o_orderdate) / 12)', 6)} AS month_cos FROM orders""", "H16 H17")
def calendar_features(t):
    parts = times.calendar_features("o_orderdate")
    return t.orders.select("o_orderkey", *[c.cast("int").alias(n) for n, c in parts.items()],
                           numbers.js_round(numbers.cyclic(parts["day_of_week"], 7)[0], 6).alias("dow_sin"), numbers.js_round(numbers.cyclic(parts["month"], 12)[1], 6).alias("month_cos"))


@query("rush_flags", f"""SELECT event_id, hour(ts)::INT AS hour, (hour(ts) * 60 + minute(ts))::INT AS minute_of_day, (hour(ts) * (isodow(ts) - 1))::INT AS hour_x_dow, (hour(ts) BETWEEN 7 AND 9)::INT AS is_am_rush,
  (hour(ts) BETWEEN 17 AND 19)::INT AS is_pm_rush, (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19)::INT AS is_rush_hour,
  CASE WHEN value < 20 THEN 'on_time' WHEN value < 60 THEN 'minor' ELSE 'major' END AS delay_class FROM events""", "H16 H18")
def rush_flags(t):
    return t.events.select("event_id", *[c.cast("int").alias(n) for n, c in times.rush_flags("ts").items()], numbers.delay_class("value", 20, 60).alias("delay_class"))
