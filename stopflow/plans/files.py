"""Sources and sinks on files that Spark writes from the given tables, read back and compared."""

from pyspark.sql import functions as F


from ..functions import numbers
from ..operators import rollups as R
from ..session import scratch_path
from ..sources import historical, keyed, readers, schemas, sinks
from .base import ALERT_TYPES, ROUTE_IDS, Tables, query, r, route_of, sql_list, sql_route_of
from .geometry import TRACK, vertices

rd = numbers.js_round
DAYS = "year string, month string, day string"


def as_text(c, digits):
    return F.format_number(c, digits)


# ---- scans ----


@query("schedule_csv_scan", """SELECT 'T' || l_orderkey AS trip_id, l_suppkey || 'N' AS stop_id, lpad((l_quantity::INT % 30)::VARCHAR, 2, '0') || ':05:09' AS arrival_time, lpad((l_quantity::INT % 30)::VARCHAR, 2, '0') || ':06:00' AS departure_time, l_linenumber AS stop_sequence FROM lineitem""", "A1")
def schedule_csv_scan(t: Tables):
    hour = F.lpad((F.col("l_quantity").cast("int") % 30).cast("string"), 2, "0")
    path = scratch_path(t.spark, "stop_times")
    t.lineitem.select(F.col("l_linenumber").alias("stop_sequence"), F.lit("x, y").alias("note"), F.concat(F.lit(" "), hour, F.lit(":06:00")).alias("departure_time"),
                      F.concat(F.col("l_suppkey").cast("string"), F.lit("N")).alias("stop_id"), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("trip_id"),
                      F.concat(hour, F.lit(":05:09")).alias("arrival_time")).write.option("header", True).csv(path)
    return readers.read_csv_by_header(t.spark, path, schemas.STOP_TIMES)


def feed_json(t: Tables) -> str:
    """Feed entities as JSON lines; some without trip update, some without stops."""
    k, base = F.col("event_id"), F.unix_timestamp("ts")

    def stop(mark, offset, relation):
        at = F.struct((base + offset).alias("time"), (F.col("user_id") % 7).cast("int").alias("delay"))
        left = F.when(k % 4 > 0, F.struct((base + offset + 20).alias("time"), F.lit(None).cast("int").alias("delay")))
        return F.struct(F.concat(F.col("user_id").cast("string"), F.lit(mark)).alias("stopId"), F.col("event_type").alias("stopName"), at.alias("arrival"), left.alias("departure"),
                        F.lit(relation).alias("scheduleRelationship"))

    stops = F.when(k % 7 > 0, F.array(stop("N", 0, None), stop("S", 60, "SKIPPED"), stop("", 120, "SCHEDULED")))
    update = F.when(k % 10 > 0, F.struct(
        F.struct(k.cast("string").alias("tripId"), F.lower(route_of(F.col("user_id"))).alias("routeId"), F.date_format("ts", "yyyyMMdd").alias("startDate")).alias("trip"),
        F.struct(F.col("user_id").cast("string").alias("id")).alias("vehicle"), base.alias("timestamp"), stops.alias("stopTimeUpdate")))
    path = scratch_path(t.spark, "feed")
    t.events.select(k.cast("string").alias("id"), update.alias("tripUpdate")).write.json(path)
    return path


@query("feed_stop_updates", f"""WITH e AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS b FROM events WHERE event_id % 10 > 0), s AS (SELECT * FROM (VALUES (0, 'N', 0, 'SCHEDULED'), (1, 'S', 60, 'SKIPPED'), (2, '', 120, 'SCHEDULED')) v(seq, mark, off, rel))
  SELECT event_id::VARCHAR AS trip_id, {sql_route_of('user_id')} AS route_id, seq, CASE WHEN seq IS NOT NULL THEN user_id || mark END AS stop_id, b + off AS arrival_s, CASE WHEN event_id % 4 > 0 THEN b + off + 20 END AS departure_s,
   CASE WHEN seq IS NOT NULL THEN (user_id % 7)::INT END AS arrival_delay, rel AS schedule_relationship FROM e LEFT JOIN s ON event_id % 7 > 0""", "A2")
def feed_stop_updates(t: Tables):
    entities = t.spark.read.schema(schemas.FEED_ENTITY).json(feed_json(t))
    out = readers.flatten_feed(entities)
    return out.select("trip_id", "route_id", "seq", "stop_id", F.unix_timestamp("arrival_time").alias("arrival_s"), F.unix_timestamp("departure_time").alias("departure_s"),
                      "arrival_delay", "schedule_relationship")


EVENT_FIELDS = "event_id bigint, user_id bigint, event_type string, value double"


def dated_events(t: Tables) -> str:
    path = scratch_path(t.spark, "dated")
    rows = sinks.with_partitions(t.events, F.col("ts"), hour=False).select("event_id", "user_id", "event_type", "value", "year", "month", "day")
    rows.write.partitionBy("year", "month", "day").json(path)
    return path


@query("recent_days_scan", "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day FROM events WHERE ts::DATE BETWEEN DATE '2024-01-14' AND DATE '2024-01-20'", "A3 G1")
def recent_days_scan(t: Tables):
    return readers.read_recent_json(t.spark, dated_events(t), EVENT_FIELDS, "2024-01-20", 7)


@query("one_day_scan", "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day FROM events WHERE ts::DATE = DATE '2024-01-20'", "A4")
def one_day_scan(t: Tables):
    return readers.read_day_json(t.spark, dated_events(t), EVENT_FIELDS, "2024-01-20")


@query("optional_parquet_scan", "SELECT doc_id, quality, toxic FROM labels", "A5")
def optional_parquet_scan(t: Tables):
    """The missing input reads as none, so the present one stands in."""
    absent = readers.read_parquet_or_none(t.spark, scratch_path(t.spark, "absent"))
    present = readers.read_parquet_or_none(t.spark, f"{t.folder}/labels.parquet", "doc_id bigint, quality int, toxic int")
    return present if absent is None else absent


# ---- historical datasets ----


def historical_csv(t: Tables, name: str, rows) -> str:
    path = scratch_path(t.spark, name)
    rows.write.option("header", True).csv(path)
    return path


def order_day(fmt="M/d/yyyy"):
    return F.date_format("o_orderdate", fmt)


MONTH_TEXT = "strftime(o_orderdate, '%Y-%m-%d')"


@query("daily_ridership_clean", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS mode, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS count FROM orders", "A6a")
def daily_ridership_clean(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("Mode"), F.when(F.col("o_orderkey") % 11 > 0, as_text(F.floor("o_totalprice"), 0)).alias("Count"), order_day().alias("Date"))
    return historical.load(t.spark, historical_csv(t, "daily_ridership", rows), "daily_ridership")


def monthly(t, **cols):
    day = F.when(F.col("o_orderkey") % 2 == 0, order_day("M/d/yy")).otherwise(order_day("yyyy-MM-dd"))
    base = {"month": day, "division": F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")), "line": F.col("o_orderkey").cast("string")}
    return t.orders.select(*[c.alias(n) for n, c in {**base, **cols}.items()])


MONTHLY = f"SELECT {MONTH_TEXT} AS month, o_orderstatus AS division, o_orderkey::VARCHAR AS line"


def percent():
    return F.concat((F.col("o_custkey") % 1000 / 10).cast("string"), F.lit("%"))


SQL_PCT = "o_custkey % 1000 / 10.0::DOUBLE"


@query("terminal_otp_clean", f"{MONTHLY}, left(o_orderpriority, 1) AS day_type, floor(o_totalprice)::BIGINT AS num_on_time_trips, o_custkey AS num_sched_trips, {SQL_PCT} AS terminal_on_time_performance FROM orders", "A6b")
def terminal_otp_clean(t: Tables):
    rows = monthly(t, day_type=F.substring("o_orderpriority", 1, 1), num_on_time_trips=as_text(F.floor("o_totalprice"), 0), num_sched_trips=as_text("o_custkey", 0), terminal_on_time_performance=percent())
    return historical.load(t.spark, historical_csv(t, "terminal_otp", rows), "terminal_otp")


@query("major_incidents_clean", f"{MONTHLY}, left(o_orderpriority, 1) AS day_type, substr(o_orderpriority, 3) AS category, o_custkey AS incident_count FROM orders", "A6c")
def major_incidents_clean(t: Tables):
    rows = monthly(t, day_type=F.substring("o_orderpriority", 1, 1), category=F.substring("o_orderpriority", 3, 100), count=as_text("o_custkey", 0))
    return historical.load(t.spark, historical_csv(t, "major_incidents", rows), "major_incidents")


@query("fare_evasion_clean", f"SELECT o_orderkey || '-Q1' AS time_period, {SQL_PCT} AS fare_evasion_pct, 0.0::DOUBLE AS margin_of_error FROM orders", "A6d")
def fare_evasion_clean(t: Tables):
    rows = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-Q1")).alias("Time Period"), percent().alias("Fare Evasion"), F.lit("").alias("Margin of Error"))
    return historical.load(t.spark, historical_csv(t, "fare_evasion", rows), "fare_evasion")


@query("mdbf_clean", f"SELECT {MONTH_TEXT} AS month, o_orderstatus AS division, o_orderkey::VARCHAR AS car_class, floor(o_totalprice)::BIGINT AS total_miles, o_custkey % 50 AS number_of_failures, o_custkey AS number_of_cars, o_totalprice AS mdbf, floor(o_totalprice) AS twelve_month_avg_mdbf FROM orders", "A6e")
def mdbf_clean(t: Tables):
    rows = t.orders.select(order_day("yyyy-MM-dd").alias("Month"), F.col("o_orderstatus").alias("Division"), F.col("o_orderkey").cast("string").alias("Car Class"),
                           as_text(F.floor("o_totalprice"), 0).alias("Total Miles"), (F.col("o_custkey") % 50).cast("string").alias("Number of Failures"), as_text("o_custkey", 0).alias("Number of Cars"),
                           F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("MDBF"), as_text(F.floor("o_totalprice"), 0).alias("12-Month Average MDBF"))
    return historical.load(t.spark, historical_csv(t, "mdbf", rows), "mdbf")


@query("customer_journey_clean", f"""{MONTHLY}, 'peak' AS period, o_totalprice AS num_passengers, o_custkey / 8.0::DOUBLE AS additional_platform_time, o_custkey / 16.0::DOUBLE AS additional_train_time, floor(o_totalprice) AS total_apt, o_totalprice AS total_att,
  o_custkey::DOUBLE AS over_five_mins, {SQL_PCT} AS over_five_mins_pct, {SQL_PCT} AS customer_journey_time_performance FROM orders""", "A6f")
def customer_journey_clean(t: Tables):
    money = as_text("o_totalprice", 2)
    rows = monthly(t, period=F.lit("peak"), num_passengers=money, **{"additional platform time": (F.col("o_custkey") / 8).cast("string"), "additional train time": (F.col("o_custkey") / 16).cast("string"),
                   "total_apt": as_text(F.floor("o_totalprice"), 0), "total_att": money, "over_five_mins": as_text("o_custkey", 0), "over_five_mins_perc": percent(), "customer journey time performance": percent()})
    return historical.load(t.spark, historical_csv(t, "customer_journey", rows), "customer_journey")


@query("service_delivered_clean", f"{MONTHLY}, '1' AS day_type, o_custkey AS num_sched_trains, floor(o_totalprice)::BIGINT AS num_actual_trains, {SQL_PCT} AS service_delivered_pct FROM orders", "A6g")
def service_delivered_clean(t: Tables):
    rows = monthly(t, day_type=F.lit("1"), num_sched_trains=as_text("o_custkey", 0), num_actual_trains=as_text(F.floor("o_totalprice"), 0), **{"service delivered": percent()})
    path, out = historical_csv(t, "service_delivered", rows), scratch_path(t.spark, "service_delivered_parquet")
    historical.convert(t.spark, path, "service_delivered", out)
    return readers.read_parquet_or_none(t.spark, out)


# ---- alert, equipment, news, weather ----

SEVERITIES = {"Delays": "warning", "Service Change": "warning", "Detour": "warning", "Suspension": "critical", "Cancellations": "critical",
              "Planned Work": "info", "Information": "info", "Station Notice": "info"}


@query("alert_feed_parse", f"""WITH x AS (SELECT doc_id, text, lang, ({sql_list(ALERT_TYPES)})[n_chars % 8 + 1] AS k, {sql_route_of('doc_id')} AS r1 FROM documents WHERE doc_id % 9 > 0 AND (doc_id % 5 > 0))
  SELECT 'a' || doc_id AS alert_id, CASE WHEN doc_id % 4 = 0 THEN 'Information' ELSE k END AS alert_type, CASE WHEN doc_id % 4 = 0 THEN 'info' WHEN k IN ('Delays', 'Service Change', 'Detour') THEN 'warning' WHEN k IN ('Suspension', 'Cancellations') THEN 'critical' ELSE 'info' END AS severity,
    text AS header_text, '<b>' || doc_id || '</b>' AS description_html, r1 AS routes, 's' || doc_id AS stops, 1704067200 + doc_id * 60 AS start_s, CASE WHEN doc_id % 3 > 0 THEN 1704067200 + doc_id * 60 + 3600 END AS end_s, 1704067200 + doc_id AS updated_s FROM x""", "A11")
def alert_feed_parse(t: Tables):
    k, start = F.col("doc_id"), F.lit(1704067200) + F.col("doc_id") * 60
    kind = F.element_at(F.array(*[F.lit(a) for a in ALERT_TYPES]), (F.col("n_chars") % 8 + 1).cast("int"))
    route = F.when(k % 5 == 0, "BUS9").otherwise(F.lower(route_of(k)))
    none = F.lit(None).cast("string")
    informed = F.array(F.struct(F.lit("AG").alias("agency_id"), route.alias("route_id"), none.alias("stop_id")),
                       F.struct(F.lit("AG").alias("agency_id"), none.alias("route_id"), F.concat(F.lit("s"), k.cast("string")).alias("stop_id")))

    def words(*pairs):
        return F.struct(F.array(*[F.struct(w.alias("text"), F.lit(lang).alias("language")) for w, lang in pairs]).alias("translation"))

    alert = F.when(k % 9 > 0, F.struct(
        F.array(F.struct(start.alias("start"), F.when(k % 3 > 0, start + 3600).alias("end"))).alias("active_period"), informed.alias("informed_entity"),
        words((F.lit("x"), "es"), (F.col("text"), "en")).alias("header_text"),
        words((F.col("text"), "en"), (F.concat(F.lit("<b>"), k.cast("string"), F.lit("</b>")), "en-html")).alias("description_text")))
    extra = F.struct(F.when(k % 4 > 0, kind).alias("alert_type"), start.alias("created_at"), (F.lit(1704067200) + k).alias("updated_at"))
    path = scratch_path(t.spark, "alerts")
    t.documents.select(F.concat(F.lit("a"), k.cast("string")).alias("id"), alert.alias("alert"), extra.alias("transit_realtime.mercury_alert")).write.json(path)
    out = readers.parse_alerts(t.spark.read.schema(schemas.ALERT_ENTITY).json(path), ROUTE_IDS, SEVERITIES, F.lit("2024-06-01").cast("timestamp"))
    p = F.col("active_periods")[0]
    return out.select("alert_id", "alert_type", "severity", "header_text", "description_html", F.array_join("affected_routes", ",").alias("routes"), F.array_join("affected_stops", ",").alias("stops"),
                      F.unix_timestamp(p["start"]).alias("start_s"), F.unix_timestamp(p["end"]).alias("end_s"), F.unix_timestamp("updated_at").alias("updated_s"))


def outages(t: Tables):
    """orders as raw outage rows."""
    k = F.col("o_orderkey")
    yes = lambda c: F.when(c, "Y").otherwise("N")
    raw = t.orders.select(
        F.col("o_custkey").cast("string").alias("station"), F.concat(route_of(k), F.lit("/ "), route_of(F.col("o_custkey"))).alias("trainno"), F.concat(F.lit("EQ"), k.cast("string")).alias("equipment"),
        F.when(k % 3 == 0, "ES").otherwise("EL").alias("equipmenttype"), F.col("o_orderpriority").alias("serving"), yes(k % 4 == 0).alias("ADA"),
        F.when(k % 17 == 0, "soon").otherwise(F.date_format(F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int")), "MM/dd/yyyy hh:mm:ss a")).alias("outagedate"),
        F.date_format(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(9)), "MM/dd/yyyy hh:mm:ss a").alias("estimatedreturntoservice"), F.lit("Repair").alias("reason"),
        yes(k % 6 == 0).alias("isupcomingoutage"), yes(k % 2 == 0).alias("ismaintenanceoutage"), F.lit("MN").alias("borough"))
    return readers.parse_outages(raw, F.lit("1999-01-01").cast("timestamp"))


OUTAGES = f"""outages AS (SELECT 'EQ' || o_orderkey AS equipment_id, {sql_route_of('o_orderkey')} || ',' || {sql_route_of('o_custkey')} AS routes, CASE WHEN o_orderkey % 3 = 0 THEN 'escalator' ELSE 'elevator' END AS kind, o_orderkey % 4 = 0 AS is_ada,
  o_orderkey % 6 = 0 AS is_upcoming, o_orderkey % 2 = 0 AS is_maintenance, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE greatest(0, floor(epoch(TIMESTAMP '1999-01-01' - (o_orderdate + to_hours(o_orderkey % 24))) / 86400))::BIGINT END AS days_out FROM orders)"""


@query("equipment_outages", f"WITH {OUTAGES} SELECT * FROM outages", "A12")
def equipment_outages(t: Tables):
    return outages(t).select("equipment_id", F.array_join("routes", ",").alias("routes"), "kind", "is_ada", "is_upcoming", "is_maintenance", "days_out")


@query("equipment_statistics", f"""WITH {OUTAGES} SELECT count(*) FILTER (NOT is_upcoming AND kind = 'elevator') AS elevators_out, count(*) FILTER (NOT is_upcoming AND kind = 'escalator') AS escalators_out, count(*) FILTER (NOT is_upcoming AND is_ada) AS ada_out,
  count(*) FILTER (is_upcoming) AS upcoming, (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS elevators, (SELECT count(*) FROM part WHERE p_size % 2 = 1) AS escalators FROM outages""", "D31")
def equipment_statistics(t: Tables):
    equipment = t.part.select(F.when(F.col("p_size") % 2 == 0, "elevator").otherwise("escalator").alias("kind"))
    return R.equipment_stats(equipment, outages(t))


@query("news_items", r"""WITH i AS (SELECT page_id, unnest(l[1:5]) AS item, generate_subscripts(l[1:5], 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>.*?</li>') AS l FROM pages)),
  x AS (SELECT page_id, pos, regexp_extract(item, '(?s)<a(?:\s[^>]*)?>(.*?)</a>', 1) AS t, regexp_extract(item, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS d, regexp_matches(item, '(?s)<a(?:\s[^>]*)?>(.*?)</a>') AS ok FROM i)
  SELECT page_id, pos::INT AS pos, trim(regexp_replace(t, '<[^>]*>', '', 'g')) AS title, trim(substr(regexp_replace(d, '<[^>]*>', '', 'g'), 1, 100)) AS description FROM x WHERE ok""", "A13")
def news_items(t: Tables):
    return readers.news_items(t.pages, "page_id", "html", item="li", title="a", description="li")


@query("weather_rows", """WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, o_orderdate::DATE AS date, max(o_totalprice) / 5000 AS hi, min(o_totalprice) / 5000 AS lo, (count(*) % 100) AS code FROM orders GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY date) AS i FROM d)
  SELECT m::VARCHAR AS month, date::VARCHAR AS date, dayname(date) AS day, floor(hi + 0.5)::BIGINT AS high, floor(lo + 0.5)::BIGINT AS low, CASE code WHEN 0 THEN 'clear skies' WHEN 1 THEN 'mostly clear' WHEN 2 THEN 'partly cloudy' WHEN 3 THEN 'overcast' WHEN 45 THEN 'foggy'
    WHEN 48 THEN 'freezing fog' WHEN 51 THEN 'light drizzle' WHEN 53 THEN 'drizzle' WHEN 55 THEN 'heavy drizzle' WHEN 61 THEN 'light rain' WHEN 63 THEN 'rain' WHEN 65 THEN 'heavy rain' WHEN 66 THEN 'freezing rain' WHEN 67 THEN 'heavy freezing rain' WHEN 71 THEN 'light snow' WHEN 73 THEN 'snow'
    WHEN 75 THEN 'heavy snow' WHEN 77 THEN 'snow grains' WHEN 80 THEN 'light showers' WHEN 81 THEN 'showers' WHEN 82 THEN 'heavy showers' WHEN 85 THEN 'light snow showers' WHEN 86 THEN 'heavy snow showers' WHEN 95 THEN 'thunderstorms' WHEN 96 THEN 'thunderstorms with hail' WHEN 99 THEN 'severe thunderstorms' ELSE 'variable conditions' END AS description
  FROM n WHERE i BETWEEN 2 AND 6""", "A14")
def weather_rows(t: Tables):
    """A month of orders is a report: one array entry per day, so at most 31."""
    days = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.to_date("o_orderdate").alias("d")).agg(
        (F.max("o_totalprice") / 5000).alias("hi"), (F.min("o_totalprice") / 5000).alias("lo"), (F.count("*") % 100).cast("int").alias("code"))
    listed = days.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("d", "hi", "lo", "code"))).alias("x"))

    def part(field, name):
        return F.transform("x", lambda e: e[field]).alias(name)

    reports = listed.select("month", part("d", "time"), part("hi", "high"), part("lo", "low"), part("code", "code"))
    out = readers.weather_rows(reports, "month")
    return out.withColumns({"month": F.col("month").cast("string"), "date": F.col("date").cast("string")})


# ---- sinks ----


@query("feature_set_by_month", """SELECT event_id, event_type, year(ts)::INT AS year, month(ts)::INT AS month FROM events""", "A9")
def feature_set_by_month(t: Tables):
    path = scratch_path(t.spark, "features")
    rows = t.events.select("event_id", "event_type", "ts")
    sinks.write_features(rows, path, "ts")
    sinks.write_features(rows, path, "ts")
    return t.spark.read.schema("event_id bigint, event_type string, ts timestamp, year int, month int").parquet(path).drop("ts")


@query("feature_set_by_processing_date", """SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, d AS processing_date FROM events, (VALUES ('2024-02-01'), ('2024-02-02')) v(d)""", "A9")
def feature_set_by_processing_date(t: Tables):
    path = scratch_path(t.spark, "features")
    for day in ("2024-02-01", "2024-02-02", "2024-02-02"):
        sinks.write_features(t.events.select("event_id", "ts"), path, "ts", day)
    return t.spark.read.schema("event_id bigint, ts timestamp, year int, month int, processing_date string").parquet(path).drop("ts")


@query("upserted_rows", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL", "A10")
def upserted_rows(t: Tables):
    """Three overlapping batches, the second written twice, then compacted."""
    path, packed = scratch_path(t.spark, "upserts"), scratch_path(t.spark, "packed")
    schema = "user_id bigint, event_type string, value double, event_id bigint"
    rows = t.events.select("user_id", "event_type", "value", "event_id")
    cut = t.events.agg(F.max("event_id")).scalar()
    for batch_id, part in ((1, rows.filter(F.col("event_id") <= cut / 2)), (2, rows.filter(F.col("event_id") > cut / 4)), (2, rows.filter(F.col("event_id") > cut / 4)), (3, rows)):
        sinks.upsert_batch(part, path, batch_id, ["user_id", "event_type"], "event_id")
    sinks.compact(t.spark, path, packed, schema, ["user_id", "event_type"], "event_id")
    return sinks.current_rows(t.spark, packed, schema, ["user_id", "event_type"], "event_id")


@query("unexpired_rows", """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT + 10 * 86400 AS expire_at FROM events WHERE epoch(date_trunc('second', ts))::BIGINT + 10 * 86400 > epoch(TIMESTAMP '2024-01-25')""", "A15")
def unexpired_rows(t: Tables):
    return sinks.unexpired(sinks.with_expiry(t.events, F.col("ts"), 10), F.lit("2024-01-25").cast("timestamp")).select("event_id", "expire_at")


@query("keyed_table_rows", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL", "A10")
def keyed_table_rows(t: Tables):
    """Overlapping batches with compactions between them, one batch run again after it was folded in, and two not folded yet."""
    rows = t.events.select("user_id", "event_type", "value", "event_id")
    table = keyed.KeyedTable(scratch_path(t.spark, "keyed"), "user_id bigint, event_type string, value double, event_id bigint", ["user_id", "event_type"], "event_id", 16)
    cut = t.events.agg(F.max("event_id")).scalar()
    early, late = rows.filter(F.col("event_id") <= cut / 2), rows.filter(F.col("event_id") > cut / 4)
    table.upsert(early.filter(F.col("event_type") != "error"), 1)
    table.compact(t.spark)
    table.upsert(early, 2)
    table.upsert(early, 2)
    table.compact(t.spark)
    table.upsert(early.filter("event_id < 0"), 2)
    table.upsert(late, 3)
    table.upsert(rows.filter(F.col("event_id") % 2 == 0), 4)
    return table.rows(t.spark)


@query("kept_days", """SELECT event_id FROM events WHERE epoch(date_trunc('second', ts))::BIGINT + 10 * 86400 > epoch(TIMESTAMP '2024-01-25 09:30:00')""", "A15")
def kept_days(t: Tables):
    """Events by day, expired twice: whole days go as folders, the day of the limit is written anew."""
    path = scratch_path(t.spark, "days")
    sinks.with_partitions(t.events.select("event_id", "ts"), F.col("ts"), hour=False).write.partitionBy("year", "month", "day").parquet(path)
    for _ in range(2):
        keyed.expire_days(t.spark, path, "event_id bigint, ts timestamp", F.lit("2024-01-25 09:30:00").cast("timestamp"), 10)
    return t.spark.read.schema(f"event_id bigint, ts timestamp, {DAYS}").parquet(path).select("event_id")


@query("written_forecast", f"""SELECT o_orderdate::DATE::VARCHAR AS date, count(*)::DOUBLE AS forecast, {r('stddev_samp(count(*)) OVER ()', 4)} AS spread FROM orders GROUP BY 1, o_orderdate::DATE""", "A16")
def written_forecast(t: Tables):
    csv, js = scratch_path(t.spark, "forecast"), scratch_path(t.spark, "metrics")
    daily = t.orders.groupBy(F.to_date("o_orderdate").cast("string").alias("date")).agg(F.count("*").cast("double").alias("forecast"))
    sinks.write_forecast(daily, csv, daily.agg(F.stddev_samp("forecast").alias("spread")), js)
    spread = t.spark.read.schema("spread double").json(js).select(rd("spread", 4)).scalar()
    return readers.read_csv_by_header(t.spark, csv, "date string, forecast double").withColumn("spread", spread)


@query("route_geojson", f"""WITH {TRACK}, l AS (SELECT route_id % 3 AS route_id, route_id AS shape_id, list([lon, lat] ORDER BY seq) AS line FROM vertices GROUP BY ALL)
  SELECT route_id, 0::BIGINT AS part, len(list(line)) AS n_lines, {r('list_sum(list_transform(flatten(list(line)), lambda p: p[1]))', 3)} AS lon_sum, route_id || ' Train' AS name FROM l GROUP BY route_id""", "A17")
def route_geojson(t: Tables):
    shapes = vertices(t).select((F.col("route_id") % 3).alias("route_id"), F.col("route_id").alias("shape_id"), "seq", "lat", "lon")
    colours = t.nation.select(F.col("n_nationkey").alias("route_id"), F.lit("#0039A6").alias("color"))
    out = sinks.route_features(shapes, colours)
    parsed = F.from_json("feature", "type string, properties struct<route_id: string, color: string, name: string>, geometry struct<type: string, coordinates: array<array<array<double>>>>")
    points = F.flatten(parsed["geometry"]["coordinates"])
    return out.select("route_id", "part", F.size(parsed["geometry"]["coordinates"]).cast("bigint").alias("n_lines"),
                      rd(F.aggregate(points, F.lit(0.0), lambda a, p: a + p[0]), 3).alias("lon_sum"), parsed["properties"]["name"].alias("name"))


@query("catalogue_tables", """SELECT strftime(ts, '%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""", "A18")
def catalogue_tables(t: Tables):
    """A partitioned JSON table registered over files, queried by SQL."""
    path = scratch_path(t.spark, "table")
    name = "stopflow_" + path.rsplit("-", 1)[1]
    rows = sinks.with_partitions(t.events, F.col("ts"), hour=False)
    rows.select("event_id", "event_type", "year", "month", "day").write.partitionBy("year", "month", "day").json(path)
    sinks.register_table(t.spark, name, f"event_id bigint, event_type string, {DAYS}", path, "json", ["year", "month", "day"])
    return t.spark.sql(f"SELECT day, event_type, count(*) AS n FROM {name} GROUP BY day, event_type")


