"""orders as trips and lineitem as stop times: schedule statistics, lookups, segments, boards."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text
from ..functions.numbers import js_round
from ..operators import lookups as L
from ..operators import schedule as S
from ..operators.ordered import with_position_of_many
from .base import ARRIVALS, STOPS, Tables, query, r, rl, route_of, sql_route_of

ORDER = ["stop_sequence", "tie_part", "tie_supplier", "tie_price"]
SQL_ORDER = ", ".join(ORDER)


def tail(k):
    """Trip id tail: start text, route, direction mark and shape number."""
    start = F.lpad((k % 1440 * 100).cast("string"), 6, "0")
    return F.concat(start, F.lit("_"), route_of(k), F.lit(".."), F.when(k % 2 == 0, "N").otherwise("S"),
                    F.lpad((k % 97).cast("string"), 2, "0"), F.lit("R"))


def service(k):
    return F.when(k % 7 == 5, "Saturday").when(k % 7 == 6, "Sunday").otherwise("Weekday")


def full_trip(k):
    return F.concat(F.lit("BIND"), k.cast("string"), F.lit("-"), service(k), F.lit("-00_"), tail(k))


def sql_tail(k):
    return (f"lpad(({k} % 1440 * 100)::VARCHAR, 6, '0') || '_' || {sql_route_of(k)} || '..' || "
            f"CASE WHEN {k} % 2 = 0 THEN 'N' ELSE 'S' END || lpad(({k} % 97)::VARCHAR, 2, '0') || 'R'")


def sql_service(k):
    return f"CASE {k} % 7 WHEN 5 THEN 'Saturday' WHEN 6 THEN 'Sunday' ELSE 'Weekday' END"


def sql_full(k):
    return f"'BIND' || {k} || '-' || {sql_service(k)} || '-00_' || {sql_tail(k)}"


def stop_times(t: Tables):
    k = F.col("l_orderkey")
    platform = F.when(F.col("l_linenumber") == 7, "").when(k % 2 == 0, "N").otherwise("S")
    at = (k % 1080 * 60 + F.col("l_linenumber") * 600 + F.floor("l_quantity") * 10).cast("bigint")
    return t.lineitem.select(
        full_trip(k).alias("trip_id"), route_of(k).alias("route_id"), service(k).alias("service_type"),
        F.concat(F.col("l_suppkey").cast("string"), platform).alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"),
        F.col("l_partkey").alias("tie_part"), F.col("l_suppkey").alias("tie_supplier"), F.col("l_extendedprice").alias("tie_price"), at.alias("arrival_seconds"),
        (at + 20).alias("departure_seconds"), k.alias("order_key"), "l_tax")


def trips(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(
        full_trip(k).alias("trip_id"), route_of(k).alias("route_id"), (k % 2).cast("int").alias("direction_id"),
        service(k).alias("service_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("to "), F.col("o_orderpriority"))).alias("headsign"))


def lagged_steps(t: Tables):
    return S.stop_steps(stop_times(t), ORDER, segment=F.col("stop_sequence"))


STOP_TIMES = f"""stop_times AS (SELECT {sql_full('l_orderkey')} AS trip_id, {sql_route_of('l_orderkey')} AS route_id,
  {sql_service('l_orderkey')} AS service_type,
  l_suppkey::VARCHAR || CASE WHEN l_linenumber = 7 THEN '' WHEN l_orderkey % 2 = 0 THEN 'N' ELSE 'S' END AS stop_id,
  l_linenumber AS stop_sequence, l_partkey AS tie_part, l_suppkey AS tie_supplier, l_extendedprice AS tie_price,
  (l_orderkey % 1080 * 60 + l_linenumber * 600 + floor(l_quantity) * 10)::BIGINT AS arrival_seconds,
  (l_orderkey % 1080 * 60 + l_linenumber * 600 + floor(l_quantity) * 10 + 20)::BIGINT AS departure_seconds, l_orderkey AS order_key, l_tax
  FROM lineitem)"""
TRIPS = f"""trips AS (SELECT {sql_full('o_orderkey')} AS trip_id, {sql_route_of('o_orderkey')} AS route_id,
  (o_orderkey % 2)::INT AS direction_id, {sql_service('o_orderkey')} AS service_id,
  CASE WHEN o_orderstatus <> 'P' THEN 'to ' || o_orderpriority END AS headsign FROM orders)"""
STEPS = f"""{STOP_TIMES}, {TRIPS}, led AS (SELECT *, lead(stop_id) OVER w AS next_stop, lead(arrival_seconds) OVER w AS next_arrival
  FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY {SQL_ORDER})),
steps AS (SELECT *, CASE WHEN next_arrival < departure_seconds THEN next_arrival - departure_seconds + 86400
  ELSE next_arrival - departure_seconds END AS step_seconds FROM led WHERE next_stop IS NOT NULL)"""


@query("stop_steps", f"WITH {STEPS} SELECT trip_id, stop_sequence, tie_part, stop_id, next_stop, step_seconds FROM steps", "E13")
def stop_steps(t):
    return lagged_steps(t).select("trip_id", "stop_sequence", "tie_part", "stop_id", "next_stop", "step_seconds")


MATRIX = f"""{STEPS}, matrix AS (SELECT tr.route_id, s.stop_id AS from_stop, s.next_stop AS to_stop, {rl('avg(step_seconds)')} AS seconds, count(*) AS n
  FROM steps s JOIN trips tr USING (trip_id) WHERE step_seconds > 0 AND step_seconds <= 1800 GROUP BY ALL)"""


@query("duration_matrix", f"WITH {MATRIX} SELECT * FROM matrix", "D14")
def duration_matrix(t):
    return S.duration_matrix(lagged_steps(t), trips(t))


@query("segment_durations", f"""WITH {MATRIX}, pairs AS (SELECT l_orderkey AS id, {sql_route_of('l_orderkey')} AS route_id, l_suppkey::VARCHAR AS from_stop,
    (l_partkey % 100)::VARCHAR || CASE l_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS to_stop FROM lineitem),
  c AS (SELECT p.*, f.i AS fi, g.i AS gi, CASE f.i WHEN 0 THEN from_stop ELSE rtrim(from_stop, 'NS') || f.s END AS cf,
    CASE g.i WHEN 0 THEN to_stop ELSE rtrim(to_stop, 'NS') || g.s END AS ct
    FROM (SELECT DISTINCT route_id, from_stop, to_stop FROM pairs) p, (VALUES (0, ''), (1, 'N'), (2, 'S'), (3, '')) f(i, s), (VALUES (0, ''), (1, 'N'), (2, 'S'), (3, '')) g(i, s)),
  hit AS (SELECT c.route_id, c.from_stop, c.to_stop, arg_min(m.seconds, fi * 4 + gi) AS seconds
    FROM c JOIN matrix m ON m.route_id = c.route_id AND m.from_stop = cf AND m.to_stop = ct GROUP BY ALL)
  SELECT p.*, seconds FROM pairs p LEFT JOIN hit USING (route_id, from_stop, to_stop)""", "C15")
def segment_durations(t):
    part = F.col("l_partkey")
    pairs = t.lineitem.select(
        F.col("l_orderkey").alias("id"), route_of(F.col("l_orderkey")).alias("route_id"),
        F.col("l_suppkey").cast("string").alias("from_stop"),
        F.concat((part % 100).cast("string"), F.when(part % 3 == 0, "N").when(part % 3 == 1, "S").otherwise("")).alias("to_stop"))
    return L.segment_duration(pairs, S.duration_matrix(lagged_steps(t), trips(t)))


PATTERNS = f"""{STEPS}, listed AS (SELECT trip_id, count(*) AS n_stops, string_agg(rtrim(stop_id, 'NS'), ',' ORDER BY {SQL_ORDER}) AS pattern
    FROM stop_times GROUP BY trip_id HAVING count(*) >= 2),
  counted AS (SELECT route_id, direction_id, pattern, count(*) AS n_trips, min(trip_id) AS trip_id FROM listed JOIN trips USING (trip_id) GROUP BY ALL),
  best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n_trips DESC, trip_id) = 1),
  patterns AS (SELECT b.route_id, b.direction_id, n_trips, row_number() OVER (PARTITION BY trip_id ORDER BY {SQL_ORDER}) AS position,
    rtrim(s.stop_id, 'NS') AS stop_id FROM best b JOIN stop_times s USING (trip_id))"""


def patterns(t):
    return S.common_patterns(stop_times(t), trips(t), ORDER, min_stops=2, segment=F.col("stop_sequence"))


@query("common_stop_patterns", f"WITH {PATTERNS} SELECT * FROM patterns", "D15")
def common_stop_patterns(t):
    return patterns(t)


@query("route_segments", f"""WITH {PATTERNS}, edges AS (SELECT *, lead(stop_id) OVER (PARTITION BY route_id, direction_id ORDER BY position) AS to_stop FROM patterns),
  means AS (SELECT tr.route_id, direction_id, rtrim(stop_id, 'NS') AS stop_id, rtrim(next_stop, 'NS') AS to_stop, {rl('avg(step_seconds)')} AS seconds
    FROM steps JOIN trips tr USING (trip_id) WHERE step_seconds > 0 AND step_seconds <= 1800 GROUP BY ALL)
  SELECT route_id, direction_id, position, stop_id AS from_stop, to_stop, seconds FROM edges JOIN means USING (route_id, direction_id, stop_id, to_stop)""", "D15 K1")
def route_segments(t):
    out = S.route_segments(patterns(t), lagged_steps(t), trips(t))
    return out.select("route_id", "direction_id", "position", "from_stop", "to_stop", "seconds")


def clock_sql(m):
    return (f"(CASE WHEN ({m}) // 60 % 24 % 12 = 0 THEN 12 ELSE ({m}) // 60 % 12 END)::BIGINT || ':' || lpad((({m}) % 60)::BIGINT::VARCHAR, 2, '0') "
            f"|| CASE WHEN ({m}) // 60 % 24 >= 12 THEN ' PM' ELSE ' AM' END")


@query("schedule_statistics", f"""WITH {STOP_TIMES}, {TRIPS}, ends AS (SELECT trip_id, arg_min(departure_seconds, ({SQL_ORDER})) // 60 AS m,
    arg_max(arrival_seconds, ({SQL_ORDER})) // 60 AS e, count(*) AS stops FROM stop_times GROUP BY trip_id),
  runs AS (SELECT route_id, direction_id, headsign, trip_id, m, e - m AS len, stops FROM ends JOIN trips USING (trip_id) WHERE service_id = 'Weekday'),
  gaps AS (SELECT route_id, direction_id, m - lag(m) OVER (PARTITION BY route_id, direction_id ORDER BY m) AS h FROM runs),
  spaced AS (SELECT route_id, direction_id, coalesce({rl('avg(h) FILTER (h > 0 AND h < 120)')}, 0) AS avg_headway_minutes FROM gaps GROUP BY ALL)
  SELECT route_id, direction_id, arg_min(headsign, trip_id) AS headsign, {clock_sql('min(m)')} AS first_train, {clock_sql('max(m)')} AS last_train,
    count(*) AS trips_per_day, {rl('avg(len)')} AS avg_duration_minutes, {rl('avg(stops)')} AS stop_count, any_value(avg_headway_minutes) AS avg_headway_minutes
  FROM runs JOIN spaced USING (route_id, direction_id) GROUP BY ALL""", "D12 H11")
def schedule_statistics(t):
    return S.schedule_stats(stop_times(t), trips(t), "Weekday", order=ORDER)


@query("busiest_stations", f"""WITH {STOP_TIMES}, {TRIPS} SELECT rtrim(s.stop_id, 'NS') AS stop_id, count(*) AS daily_trains,
  array_to_string(list_sort(list(DISTINCT tr.route_id)), ' ') AS routes FROM stop_times s JOIN trips tr USING (trip_id) WHERE service_id = 'Weekday'
  GROUP BY 1 ORDER BY daily_trains DESC, stop_id LIMIT 20""", "D13 F5")
def busiest_stations(t):
    return S.busiest_stations(stop_times(t), trips(t), "Weekday").withColumn("routes", F.array_join("routes", " "))


@query("station_routes", f"""WITH {STOPS}, x AS (SELECT DISTINCT regexp_replace(stop_id, '[NS]$', '') AS station_id, unnest(string_split(routes, ' ')) AS route_id FROM stops)
  SELECT station_id, string_agg(route_id, ' ' ORDER BY coalesce(TRY_CAST(route_id AS INTEGER), 2147483647), route_id) AS routes FROM x
  WHERE NOT regexp_matches(route_id, 'X$') GROUP BY 1""", "D16 F2")
def station_routes(t):
    return S.station_routes(t.stops).withColumn("routes", F.array_join("routes", " "))


@query("routes_in_natural_order", f"""WITH {TRIPS}, x AS (SELECT route_id, count(*) AS n_trips FROM trips GROUP BY 1)
  SELECT *, row_number() OVER (ORDER BY TRY_CAST(route_id AS INTEGER) NULLS LAST, route_id) AS place FROM x""", "F2")
def routes_in_natural_order(t):
    counted = trips(t).groupBy("route_id").agg(F.count("*").alias("n_trips"))
    return S.natural_routes(counted.withColumn("place", F.row_number().over(Window.orderBy(*text.natural_order("route_id")))))


# ---- schedule lookups ----


def live(t: Tables):
    """events as live trip updates whose ids match the schedule on different tiers."""
    k, kind, u = F.col("event_id"), F.col("event_id") % 4, F.col("user_id")
    base = tail(k)
    late = F.concat(F.lit("9"), F.substring(base, 2, 100))
    cut = F.regexp_extract(base, r"^(.*\.\.[NS])", 1)
    trip = F.when(kind == 0, base).when(kind == 1, late).when(kind == 2, cut).otherwise(F.concat(cut, F.lit("ZZ")))
    stop = F.concat((u % 100).cast("string"), F.when(u % 3 == 0, "N").when(u % 3 == 1, "S").otherwise(""))
    return t.events.select("event_id", trip.alias("trip_id"), route_of(k).alias("route_id"), stop.alias("stop_id"), "ts")


LIVE = f"""live AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN b WHEN 1 THEN '9' || substr(b, 2) WHEN 2 THEN regexp_extract(b, '^(.*\\.\\.[NS])', 1)
    ELSE regexp_extract(b, '^(.*\\.\\.[NS])', 1) || 'ZZ' END AS trip_id, route_id, stop_id, ts
  FROM (SELECT *, {sql_tail('event_id')} AS b, {sql_route_of('event_id')} AS route_id,
    (user_id % 100)::VARCHAR || CASE user_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS stop_id FROM events))"""
SHAPE = "nullif(regexp_extract({c}, '_([A-Z0-9]+\\.\\.[NS][A-Z0-9]*)$', 1), '')"


def sql_tier(i, keys):
    on = " AND ".join(f"s.{k} = l.{k}" for k in keys)
    return f"""t{i} AS (SELECT event_id, coalesce(arg_min(arrival_seconds, (s.trip_id, stop_sequence, tie_part, tie_supplier, tie_price)) FILTER (s.stop_id = l.stop_id),
      arg_min(arrival_seconds, (s.trip_id, stop_sequence, tie_part, tie_supplier, tie_price))) AS v FROM l JOIN s ON {on} AND rtrim(s.stop_id, 'NS') = rtrim(l.stop_id, 'NS') GROUP BY event_id)"""


@query("tiered_schedule_lookup", f"""WITH {STOP_TIMES}, {LIVE},
  s AS (SELECT *, split_part(trip_id, '-00_', 2) AS tail, {SHAPE.format(c='trip_id')} AS shape, regexp_extract(trip_id, '\\.\\.([NS])', 1) AS dir FROM stop_times),
  l AS (SELECT *, trip_id AS tail, {SHAPE.format(c='trip_id')} AS shape, regexp_extract({SHAPE.format(c='trip_id')}, '\\.\\.([NS])', 1) AS dir FROM live),
  {sql_tier(1, ['tail'])}, {sql_tier(2, ['route_id', 'shape'])}, {sql_tier(3, ['route_id', 'dir'])}
  SELECT event_id, coalesce(t1.v, t2.v, t3.v) AS scheduled_seconds,
    CASE WHEN t1.v IS NOT NULL THEN 1 WHEN t2.v IS NOT NULL THEN 2 WHEN t3.v IS NOT NULL THEN 3 END AS tier
  FROM live LEFT JOIN t1 USING (event_id) LEFT JOIN t2 USING (event_id) LEFT JOIN t3 USING (event_id)""", "C2 H7")
def tiered_schedule_lookup(t):
    rows = live(t)
    out = L.tiered_schedule(rows, L.schedule_index(stop_times(t), ["trip_id", *ORDER], rows))
    return out.select("event_id", "scheduled_seconds", "tier")


@query("tiered_headsign_lookup", f"""WITH {TRIPS}, {LIVE},
  s AS (SELECT *, split_part(trip_id, '-00_', 2) AS tail, {SHAPE.format(c='trip_id')} AS shape, regexp_extract(trip_id, '\\.\\.([NS])', 1) AS dir FROM trips WHERE headsign IS NOT NULL),
  l AS (SELECT event_id, route_id, trip_id AS tail, {SHAPE.format(c='trip_id')} AS shape, regexp_extract({SHAPE.format(c='trip_id')}, '\\.\\.([NS])', 1) AS dir FROM live),
  a AS (SELECT tail, arg_min(headsign, trip_id) AS v FROM s GROUP BY ALL), b AS (SELECT route_id, shape, arg_min(headsign, trip_id) AS v FROM s GROUP BY ALL),
  c AS (SELECT route_id, dir, arg_min(headsign, trip_id) AS v FROM s GROUP BY ALL)
  SELECT event_id, coalesce(a.v, b.v, c.v) AS headsign FROM l LEFT JOIN a USING (tail) LEFT JOIN b USING (route_id, shape) LEFT JOIN c USING (route_id, dir)""", "C3")
def tiered_headsign_lookup(t):
    return L.tiered_headsign(live(t), trips(t)).select("event_id", "headsign")


@query("schedule_deviation", f"""WITH {STOP_TIMES},
  live AS (SELECT order_key, stop_sequence, tie_part, {sql_tail('order_key')} AS trip, stop_id,
    TIMESTAMP '2024-03-04 05:00:00' + to_days((order_key % 7)::INT) + to_seconds(arrival_seconds + floor(l_tax * 6000 + 0.5) - 240) AS ts FROM stop_times),
  keyed AS (SELECT *, regexp_extract(trip, '^(.*?\\.\\..)', 1) AS k, timezone('{config.LOCAL_ZONE}', timezone('UTC', ts)) AS lt FROM live),
  planned AS (SELECT regexp_extract(split_part(trip_id, '-00_', 2), '^(.*?\\.\\..)', 1) AS k, stop_id, service_type, arg_max(arrival_seconds, (trip_id, arrival_seconds)) AS scheduled_seconds
    FROM stop_times GROUP BY ALL)
  SELECT order_key, stop_sequence, tie_part, scheduled_seconds, extract('epoch' FROM lt::TIME)::BIGINT - scheduled_seconds AS deviation_seconds
  FROM keyed LEFT JOIN planned p ON keyed.k = p.k AND keyed.stop_id = p.stop_id AND
    p.service_type = CASE dayofweek(lt) WHEN 6 THEN 'Saturday' WHEN 0 THEN 'Sunday' ELSE 'Weekday' END""", "C1 H5 H6")
def schedule_deviation(t):
    base = stop_times(t)
    start = F.unix_timestamp(F.lit("2024-03-04 05:00:00").cast("timestamp"))
    ts = F.timestamp_seconds(start + F.col("order_key") % 7 * 86400 + F.col("arrival_seconds") + F.floor(F.col("l_tax") * 6000 + 0.5) - 240)
    rows = base.select("order_key", "stop_sequence", "tie_part", tail(F.col("order_key")).alias("trip_id"), "stop_id", ts.alias("ts"))
    out = L.schedule_deviation(rows, base, config.LOCAL_ZONE)
    return out.select("order_key", "stop_sequence", "tie_part", "scheduled_seconds", "deviation_seconds")


@query("stop_name_lookup", f"""WITH {STOPS}, n AS (SELECT stop_id, min(stop_name) AS n FROM stops GROUP BY 1),
  x AS (SELECT event_id, (user_id * 4 % 700)::VARCHAR || CASE event_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS stop_id FROM events)
  SELECT event_id, x.stop_id, coalesce(a.n, b.n, x.stop_id) AS stop_name FROM x LEFT JOIN n a ON a.stop_id = x.stop_id
  LEFT JOIN n b ON b.stop_id = rtrim(x.stop_id, 'NS')""", "C4")
def stop_name_lookup(t):
    e = F.col("event_id") % 3
    rows = t.events.select("event_id", F.concat((F.col("user_id") * 4 % 700).cast("string"), F.when(e == 0, "N").when(e == 1, "S").otherwise("")).alias("stop_id"))
    return L.stop_names(rows, t.stops)


# ---- boards ----

NOW = "2024-01-15 12:00:00"


def due_rows(t: Tables):
    """Arrivals due after now; trip ids are missing for some and repeat across sources."""
    a = t.arrivals.filter(F.col("ts") >= F.lit(NOW).cast("timestamp"))
    trip = F.when(F.col("arrival_id") % 11 != 0, (F.col("arrival_id") % 37).cast("string"))
    return a.select("arrival_id", "stop_id", trip.alias("trip_id"), F.col("ts").alias("due"), F.col("route_id").alias("feed_group"))


DUE = f"""{ARRIVALS}, due AS (SELECT arrival_id, stop_id, CASE WHEN arrival_id % 11 <> 0 THEN (arrival_id % 37)::VARCHAR END AS trip_id, ts AS due, route_id AS feed_group
  FROM arrivals WHERE ts >= TIMESTAMP '{NOW}'),
single AS (SELECT * FROM due WHERE trip_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stop_id, trip_id ORDER BY arrival_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY due, arrival_id) AS rank FROM single)"""


@query("next_arrivals", f"WITH {DUE} SELECT arrival_id, stop_id, trip_id, epoch_us(due) AS due_us, rank::INT AS rank FROM ranked WHERE rank <= 8", "E7 G2")
def next_arrivals(t):
    return S.next_arrivals(due_rows(t)).select("arrival_id", "stop_id", "trip_id", F.unix_micros("due").alias("due_us"), "rank")


@query("arrival_boards", f"""WITH {DUE}, req AS (SELECT DISTINCT user_id::VARCHAR || CASE event_id % 5 WHEN 0 THEN 'N' WHEN 1 THEN '' ELSE '' END AS board FROM events),
  cand AS (SELECT board, s, min(p) AS p FROM (SELECT board, 0 AS p, board AS s FROM req UNION ALL SELECT board, 1, rtrim(board, 'NS') FROM req
    UNION ALL SELECT board, 2, rtrim(board, 'NS') || 'N' FROM req UNION ALL SELECT board, 2, rtrim(board, 'NS') || 'S' FROM req) GROUP BY ALL),
  rows_ AS (SELECT board, p, k.* FROM cand JOIN ranked k ON k.stop_id = s AND k.rank <= 8),
  kept AS (SELECT * FROM rows_ QUALIFY p = min(p) OVER (PARTITION BY board)),
  one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY board, trip_id ORDER BY due, arrival_id) = 1)
  SELECT board, stop_id, trip_id, arrival_id, row_number() OVER (PARTITION BY board ORDER BY due, arrival_id)::INT AS rank FROM one
  QUALIFY row_number() OVER (PARTITION BY board ORDER BY due, arrival_id) <= 8""", "E8")
def arrival_boards(t):
    wanted = t.events.select(F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "N").otherwise("")).alias("stop_id"))
    return S.arrival_board(wanted, due_rows(t)).select("board", "stop_id", "trip_id", "arrival_id", "rank")


@query("first_arrival_per_trip", f"WITH {ARRIVALS} SELECT trip_id, arg_min(arrival_id, (ts, arrival_id)) AS arrival_id, epoch_us(min(ts)) AS first_us FROM arrivals GROUP BY 1", "E9")
def first_arrival_per_trip(t):
    out = S.first_per_key(t.arrivals.select("trip_id", "arrival_id", "ts"), ["trip_id"], ["ts", "arrival_id"])
    return out.select("trip_id", "arrival_id", F.unix_micros("ts").alias("first_us"))


@query("terminal_flags", f"""WITH {PATTERNS}, ends AS (SELECT route_id, direction_id, arg_min(stop_id, position) AS a, arg_max(stop_id, position) AS b FROM patterns GROUP BY ALL),
  pos AS (SELECT event_id, {sql_route_of('event_id')} AS route_id, (event_id % 2)::INT AS direction_id, (user_id % 100)::VARCHAR AS next_stop_id FROM events)
  SELECT event_id, coalesce(next_stop_id = a, false) AS at_first_stop, coalesce(next_stop_id = b, false) AS at_last_stop
  FROM pos LEFT JOIN ends USING (route_id, direction_id)""", "L11")
def terminal_flags(t):
    k = F.col("event_id")
    pos = t.events.select(k, route_of(k).alias("route_id"), (k % 2).cast("int").alias("direction_id"), (F.col("user_id") % 100).cast("string").alias("next_stop_id"))
    return S.with_terminal_flags(pos, S.terminals(patterns(t))).select("event_id", "at_first_stop", "at_last_stop")


# ---- feed rows and positions ----


def updates(t: Tables):
    """Stop updates of trips on one day, in stop order."""
    rows = stop_times(t).select("trip_id", "route_id", "stop_id", *ORDER, "arrival_seconds", "departure_seconds")
    placed = with_position_of_many(rows, ["trip_id"], ORDER, F.floor(F.col("stop_sequence") / 1000), "seq")
    start = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return placed.select("trip_id", "route_id", "stop_id", "seq", F.timestamp_seconds(start + F.col("arrival_seconds")).alias("arrival_time"),
                         F.timestamp_seconds(start + F.col("departure_seconds")).alias("departure_time"))


@query("bracketing_positions", f"""WITH {STOP_TIMES}, u AS (SELECT trip_id, route_id, stop_id, row_number() OVER (PARTITION BY trip_id ORDER BY {SQL_ORDER}) AS seq,
    arrival_seconds AS a, departure_seconds AS d FROM stop_times),
  coord AS (SELECT stop_id, min(tie_supplier) AS k FROM stop_times GROUP BY 1),
  geo AS (SELECT stop_id, 40.5 + (s_acctbal + 1000) / 40000 AS lat, -74.2 + (k % 97) / 250.0 AS lon FROM coord JOIN supplier ON s_suppkey = k),
  nxt AS (SELECT trip_id, min(seq) AS ns FROM u WHERE a > 43200 GROUP BY 1),
  pair AS (SELECT n.trip_id, p.route_id, p.stop_id AS prev_stop_id, q.stop_id AS next_stop_id, p.d AS t0, q.a AS t1 FROM nxt n
    JOIN u p ON p.trip_id = n.trip_id AND p.seq = n.ns - 1 JOIN u q ON q.trip_id = n.trip_id AND q.seq = n.ns WHERE q.a > p.d),
  x AS (SELECT pair.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (43200 - t0)::DOUBLE / (t1 - t0))) AS p, g.lat AS y0, g.lon AS x0, h.lat AS y1, h.lon AS x1
    FROM pair JOIN geo g ON g.stop_id = prev_stop_id JOIN geo h ON h.stop_id = next_stop_id)
  SELECT trip_id, route_id, prev_stop_id, next_stop_id, {r('y0 + (y1 - y0) * p', 6)} AS lat, {r('x0 + (x1 - x0) * p', 6)} AS lon,
    {r('''(degrees(atan2(sin(radians(x1 - x0)) * cos(radians(y1)), cos(radians(y0)) * sin(radians(y1)) - sin(radians(y0)) * cos(radians(y1)) * cos(radians(x1 - x0)))) + 360) % 360''', 4)} AS heading,
    epoch_ms(TIMESTAMP '2024-01-15') + t0 * 1000 AS prev_time_ms, epoch_ms(TIMESTAMP '2024-01-15') + t1 * 1000 AS next_time_ms FROM x""", "C18 H2 H3")
def bracketing_positions(t):
    key = stop_times(t).groupBy("stop_id").agg(F.min("tie_supplier").alias("k"))
    geo = key.join(t.supplier, F.col("k") == F.col("s_suppkey")).select(
        "stop_id", (F.lit(40.5) + (F.col("s_acctbal") + 1000) / 40000).alias("lat"), (F.lit(-74.2) + F.col("k") % 97 / 250.0).alias("lon"))
    out = L.bracketing_stops(updates(t), geo, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return out.withColumns({"lat": js_round("lat", 6), "lon": js_round("lon", 6), "heading": js_round("heading", 4)})
