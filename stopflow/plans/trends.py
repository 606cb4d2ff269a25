"""orders, lineitem and events as series, monthly tables and feature sets."""

from pyspark.sql import functions as F


from ..functions import numbers
from ..operators import features as X
from ..operators import lookups as L
from ..operators import models as M
from ..operators import series as S
from ..operators import summaries as Y
from ..operators.ordered import time_segment_of
from ..session import drop_unused
from .base import ARRIVALS, Tables, query, r
from .places import COORDS, SQL_KM, coords, sql_hav
from .service import EVENTS, METRICS, metrics, service_events

rd = numbers.js_round


def daily(t: Tables, *keys):
    return S.daily_series(t.orders, "o_orderdate", keys, {"n": F.count("*"), "price": F.sum("o_totalprice")})


DAILY = "daily AS (SELECT o_orderdate::DATE AS date, count(*) AS n, sum(o_totalprice) AS price FROM orders GROUP BY 1)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def text_date(df, c="date"):
    return df.withColumn(c, F.col(c).cast("string"))


# ---- windows ----


@query("rolling_daily_means", f"""WITH {DAILY} SELECT date::VARCHAR AS date, n, {r('avg(n) OVER (ORDER BY date ROWS 6 PRECEDING)', 4)} AS rolling_mean_7,
  {r('avg(n) OVER (ORDER BY date ROWS 29 PRECEDING)', 4)} AS rolling_mean_30, {r('stddev_samp(n) OVER (ORDER BY date ROWS 6 PRECEDING)', 4)} AS rolling_std_7,
  lag(n, 1) OVER (ORDER BY date) AS lag_1, lag(n, 28) OVER (ORDER BY date) AS lag_28, {r('n / (lag(n, 365) OVER (ORDER BY date))::DOUBLE - 1', 4)} AS change_365 FROM daily""", "E3 E4 E5")
def rolling_daily_means(t):
    out = S.calendar_features(daily(t), [], "date", "n", means=(7, 30), stds=(7,), lags=(1, 28), change=(365,))
    out = out.withColumns({c: rd(c, 4) for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7", "change_365")})
    return text_date(out.drop("price"))


@query("rolling_route_delays", f"""WITH {ARRIVALS} SELECT arrival_id, {r('avg(delay_seconds) OVER (w ROWS 2 PRECEDING)', 4)} AS delay_rolling_mean_3,
  coalesce({r('stddev_samp(delay_seconds) OVER (w ROWS 2 PRECEDING)', 4)}, 0) AS delay_rolling_std_3, lag(delay_seconds, 1) OVER w AS delay_lag_1, lag(delay_seconds, 3) OVER w AS delay_lag_3
  FROM arrivals WINDOW w AS (PARTITION BY route_id ORDER BY ts, arrival_id)""", "E3 E4")
def rolling_route_delays(t):
    out = S.rolling_features(t.arrivals, ["route_id"], ["ts", "arrival_id"], time_segment_of("ts"), "delay_seconds", means=(3,), stds=(3,),
                             lags=(1, 3), fill_std=True, block=500, prefix="delay_")
    return out.select("arrival_id", rd("delay_rolling_mean_3", 4).alias("delay_rolling_mean_3"), rd("delay_rolling_std_3", 4).alias("delay_rolling_std_3"), "delay_lag_1", "delay_lag_3")


@query("rolling_alert_flag", f"""WITH {ARRIVALS} SELECT arrival_id, (avg(delay_seconds) OVER (PARTITION BY route_id ORDER BY ts, arrival_id ROWS 9 PRECEDING) > 300)::INT AS alert_active FROM arrivals""", "E6")
def rolling_alert_flag(t):
    return S.mean_flag(t.arrivals, ["route_id"], ["ts", "arrival_id"], time_segment_of("ts"), "delay_seconds", 10, 300, block=500).select("arrival_id", "alert_active")


@query("position_trajectories", f"""WITH {COORDS}, b AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, (vec_id - lag(vec_id) OVER w) * 30000 / 3600000.0 AS h FROM coords WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
  k AS (SELECT *, {sql_hav('plat', 'plon', 'lat', 'lon')} AS a FROM b), d AS (SELECT *, {SQL_KM} AS km FROM k)
  SELECT vec_id AS position_id, label AS trip_id, {r('km', 6)} AS segment_km, {r('h', 6)} AS segment_hours, CASE WHEN h > 0.0001 THEN {r('km / h', 3)} END AS segment_speed FROM d""", "E2")
def position_trajectories(t):
    p = coords(t).select(F.col("vec_id").alias("position_id"), F.col("label").alias("trip_id"), "lat", "lon", (F.lit(1704067200000) + F.col("vec_id") * 30000).alias("captured_at"))
    out = S.trajectory(p, F.floor(F.col("position_id") / 100))
    return out.select("position_id", "trip_id", rd("segment_km", 6).alias("segment_km"), rd("segment_hours", 6).alias("segment_hours"), rd("segment_speed", 3).alias("segment_speed"))


def sql_decomposed(src, key, half, period):
    part = f"PARTITION BY {key} " if key else ""
    keys = f"{key}, " if key else ""
    return f"""s AS (SELECT *, row_number() OVER ({part}ORDER BY date) - 1 AS i, count(*) OVER ({part}) AS c FROM {src}),
  tr AS (SELECT *, CASE WHEN c >= {2 * period} AND count(v) OVER f = {2 * half + 1} THEN (sum(v) OVER f - {f'(lag(v, {half}) OVER w + lead(v, {half}) OVER w) / 2' if period % 2 == 0 else '0'}) / {float(period)} END AS trend
    FROM s WINDOW w AS ({part}ORDER BY date), f AS ({part}ORDER BY date ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
  ph AS (SELECT {keys}i % {period} AS p, avg(v - trend) AS m FROM tr GROUP BY ALL), ce AS (SELECT *, m - avg(m) OVER ({part}) AS se FROM ph)
  SELECT {'tr.' + key + ', ' if key else ''}date::VARCHAR AS date, v AS n, {r('trend', 4)} AS trend, {r('se', 4)} AS seasonal, {r('v - trend - se', 4)} AS residual,
    CASE WHEN c >= {2 * period} THEN 'ok' ELSE 'insufficient' END AS status FROM tr JOIN ce ON ce.p = tr.i % {period}{f' AND ce.{key} = tr.{key}' if key else ''}"""


@query("yearly_decomposition", f"WITH {DAILY}, x AS (SELECT date, n::DOUBLE AS v FROM daily), {sql_decomposed('x', '', 182, 365)}", "E10")
def yearly_decomposition(t):
    out = S.decompose(daily(t).withColumn("n", F.col("n").cast("double")), [], "date", "n", 365)
    return text_date(out.withColumns({c: rd(c, 4) for c in ("trend", "seasonal", "residual")}))


@query("monthly_decomposition", f"""WITH x AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate)::DATE AS date, count(*)::DOUBLE AS v FROM orders GROUP BY ALL), {sql_decomposed('x', 'priority', 6, 12)}""", "E10")
def monthly_decomposition(t):
    months = S.daily_series(t.orders, "o_orderdate", ["o_orderpriority"], {"n": F.count("*").cast("double")}, "month")
    out = S.decompose(months.withColumnRenamed("o_orderpriority", "priority"), ["priority"], "date", "n", 12)
    return text_date(out.withColumns({c: rd(c, 4) for c in ("trend", "seasonal", "residual")}))


@query("daily_fill_forward", f"""WITH d AS (SELECT user_id, ts::DATE AS date, avg(floor(value * 100 + 0.5)::BIGINT) AS v FROM events GROUP BY ALL),
  g AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM (SELECT user_id, min(date) AS a, max(date) AS b FROM d GROUP BY 1))
  SELECT user_id, date::VARCHAR AS date, {r('last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date)', 4)} AS value FROM g LEFT JOIN d USING (user_id, date)""", "E11")
def daily_fill_forward(t):
    out = S.resample_ffill(t.events.select("user_id", F.to_date("ts").alias("date"), numbers.js_round_long(F.col("value") * 100).alias("value")), ["user_id"], "date", "value")
    return text_date(out.withColumn("value", rd("value", 4)))


@query("chronological_split", """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM events""", "E12")
def chronological_split(t):
    return S.chronological_split(t.events, ["ts", "event_id"], time_segment_of("ts")).select("event_id", "part")


@query("last_days_split", f"""WITH {DAILY} SELECT date::VARCHAR AS date, n, CASE WHEN row_number() OVER (ORDER BY date) <= count(*) OVER () - 60 THEN 'train' ELSE 'test' END AS part FROM daily""", "E12")
def last_days_split(t):
    out = S.chronological_split(daily(t), ["date"], F.year("date").cast("bigint"), test_rows=60)
    return text_date(out.select("date", "n", "part"))


@query("running_distinct_stops", f"""WITH {ARRIVALS}, f AS (SELECT *, row_number() OVER (PARTITION BY trip_id, latency_ms ORDER BY ts, arrival_id) = 1 AND latency_ms IS NOT NULL AS first FROM arrivals)
  SELECT arrival_id, (sum(first::INT) OVER (PARTITION BY trip_id ORDER BY ts, arrival_id))::BIGINT AS stops_served FROM f""", "E14")
def running_distinct_stops(t):
    return S.running_distinct(t.arrivals, ["trip_id"], ["ts", "arrival_id"], "latency_ms", time_segment_of("ts"), "stops_served").select("arrival_id", "stops_served")


# ---- summaries ----


@query("price_summary", f"""SELECT o_orderpriority, count(*) AS n, {r('avg(c)', 2)} AS mean, {r('stddev_samp(c)', 2)} AS std, min(c) AS min, max(c) AS max,
  {r('quantile_cont(c, 0.25)', 3)} AS q25, {r('median(c)', 3)} AS median, {r('quantile_cont(c, 0.75)', 3)} AS q75 FROM (SELECT *, floor(o_totalprice * 100 + 0.5)::BIGINT AS c FROM orders) GROUP BY 1""", "D34")
def price_summary(t):
    out = Y.group_summary(t.orders.select("o_orderpriority", numbers.js_round_long(F.col("o_totalprice") * 100).alias("cents")), ["o_orderpriority"], "cents", F.floor(F.col("cents") / 100000))
    return out.withColumns({"mean": rd("mean", 2), "std": rd("std", 2), "q25": rd("q25", 3), "median": rd("median", 3), "q75": rd("q75", 3)})


MONTH = "strftime(o_orderdate, '%Y-%m')"
PIVOT = ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES)


@query("monthly_category_pivot", f"SELECT {MONTH} AS month, {PIVOT} FROM orders GROUP BY 1", "D35")
def monthly_category_pivot(t):
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority")
    return Y.category_pivot(rows, ["month"], "o_orderpriority", PRIORITIES, F.count(F.lit(1)))


@query("category_totals", "SELECT o_orderpriority, count(*) AS total FROM orders GROUP BY 1", "D35")
def category_totals(t):
    return Y.category_totals(t.orders, "o_orderpriority", F.count("*"))


@query("line_category_matrix", f"SELECT c_nationkey AS line, {PIVOT}, count(*) AS row_total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", "D36")
def line_category_matrix(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("line"), "o_orderpriority")
    return Y.matrix_by_total(rows, "line", "o_orderpriority", PRIORITIES, F.count(F.lit(1)))


SERVICE = "(88 + floor(l_discount * 100 + l_tax * 50)::BIGINT - (l_suppkey % 7))"


@query("service_by_line", f"""WITH x AS (SELECT l_suppkey AS line, {SERVICE} AS v, isodow(l_shipdate) >= 6 AS we FROM lineitem), y AS (SELECT line, avg(v) AS s, avg(v) FILTER (NOT we) AS a, avg(v) FILTER (we) AS b FROM x GROUP BY 1)
  SELECT line, {r('s', 4)} AS service_pct, {r('a', 4)} AS weekday_pct, {r('b', 4)} AS weekend_pct, CASE WHEN s >= 95 THEN 'good' WHEN s >= 90 THEN 'fair' ELSE 'poor' END AS band FROM y""", "D37")
def service_by_line(t):
    v = 88 + F.floor(F.col("l_discount") * 100 + F.col("l_tax") * 50) - F.col("l_suppkey") % 7
    out = Y.service_by_line(t.lineitem.select(F.col("l_suppkey").alias("line"), v.alias("v"), "l_shipdate"), "line", "v", date="l_shipdate")
    return out.withColumns({c: rd(c, 4) for c in ("service_pct", "weekday_pct", "weekend_pct")})


@query("welch_test", f"""WITH g AS (SELECT count(*) FILTER (l_linestatus = 'O') AS na, count(*) FILTER (l_linestatus = 'F') AS nb, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS ma, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS mb,
    var_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS va, var_samp(l_extendedprice) FILTER (l_linestatus = 'F') AS vb FROM lineitem),
  s AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS f FROM g),
  p AS (SELECT s.t, 1 - 2 * sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(f * pi()) - (f + 1) / 2 * ln(1 + pow(abs(t) * i / 4000, 2) / f))) * abs(t) / 4000 / 3 AS p
    FROM s, range(4001) r(i) GROUP BY s.t)
  SELECT na AS n_a, nb AS n_b, {r('s.t', 6)} AS t, {r('f', 3)} AS df, {r('p', 5)} AS p_value FROM s, p""", "D38")
def welch_test(t):
    out = Y.welch_test(t.lineitem, "l_linestatus", "O", "F", "l_extendedprice")
    return out.select("n_a", "n_b", rd("t", 6).alias("t"), rd("df", 3).alias("df"), rd("p_value", 5).alias("p_value"))


HOURS = ", ".join(f"{r(f'avg(floor(value * 100 + 0.5)::BIGINT) FILTER (hour(ts) = {h})', 4)} AS h{h:02d}" for h in range(24))


@query("route_hour_matrix", f"SELECT event_type AS route_id, {r('avg(floor(value * 100 + 0.5)::BIGINT)', 4)} AS overall, {HOURS} FROM events GROUP BY 1", "D39")
def route_hour_matrix(t):
    out = Y.hour_matrix(t.events.select(F.col("event_type").alias("route_id"), "ts", numbers.js_round_long(F.col("value") * 100).alias("cents")), "route_id", "ts", "cents")
    return out.withColumns({c: rd(c, 4) for c in out.columns if c != "route_id"})


@query("severity_by_weekday", f"""SELECT (isodow(ts) - 1)::INT AS day_of_week, {r('count(*) FILTER (value <= 20) * 100.0 / count(*)', 4)} AS on_time_pct, {r('count(*) FILTER (value > 20 AND value <= 60) * 100.0 / count(*)', 4)} AS minor_pct,
  {r('count(*) FILTER (value > 60) * 100.0 / count(*)', 4)} AS major_pct FROM events GROUP BY 1""", "D40")
def severity_by_weekday(t):
    out = Y.class_share_by_weekday(t.events, "ts", "value", 20, 60)
    return out.withColumns({c: rd(c, 4) for c in out.columns if c != "day_of_week"})


@query("weekday_and_weekend", f"""WITH {DAILY} SELECT {r('avg(n) FILTER (isodow(date) < 6)', 4)} AS weekday_mean, {r('avg(n) FILTER (isodow(date) >= 6)', 4)} AS weekend_mean,
  {r('avg(n) FILTER (isodow(date) >= 6) / avg(n) FILTER (isodow(date) < 6) * 100', 4)} AS weekend_pct FROM daily""", "D41")
def weekday_and_weekend(t):
    out = Y.weekday_weekend(daily(t), "date", "n")
    return out.select(*[rd(c, 4).alias(c) for c in out.columns])


@query("weekday_quartiles", f"""WITH {DAILY} SELECT (isodow(date) - 1)::INT AS day_of_week, count(*) AS n, {r('avg(n)', 4)} AS mean, {r('stddev_samp(n)', 4)} AS std, min(n) AS min, max(n) AS max, {r('quantile_cont(n, 0.25)', 4)} AS q25,
  {r('median(n)', 4)} AS median, {r('quantile_cont(n, 0.75)', 4)} AS q75 FROM daily GROUP BY 1""", "D41 D34")
def weekday_quartiles(t):
    out = Y.group_summary(daily(t).select(F.weekday("date").alias("day_of_week"), F.col("n").alias("v")), ["day_of_week"], "v", F.floor(F.col("v") / 100).cast("bigint"))
    return out.withColumns({c: rd(c, 4) for c in ("mean", "std", "q25", "median", "q75")})


@query("baseline_recovery", f"WITH {DAILY}, b AS (SELECT avg(n) AS b FROM daily WHERE year(date) = 1996 AND month(date) = 2) SELECT date::VARCHAR AS date, n, {r('n / b * 100', 4)} AS recovery_pct FROM daily, b", "D42")
def baseline_recovery(t):
    out = Y.recovery(daily(t).select("date", "n"), "date", "n", 1996, 2)
    return text_date(out.withColumn("recovery_pct", rd("recovery_pct", 4)))


# ---- monthly reliability ----


def month_text(c):
    return F.date_format(F.date_trunc("month", c), "yyyy-MM-dd")


def reliability_inputs(t: Tables):
    m = month_text("l_shipdate").alias("month")
    base = t.lineitem.select(m, F.col("l_returnflag").alias("division"), F.concat_ws("-", "l_linestatus", "l_linenumber").alias("car_class"), F.floor("l_extendedprice").alias("mdbf"))
    otp = t.lineitem.filter("l_linestatus = 'O'").select(m, F.col("l_returnflag").alias("division"), numbers.js_round_long(F.col("l_discount") * 1000).alias("terminal_on_time_performance"))
    incidents = t.lineitem.filter("l_quantity > 45").select(m, F.col("l_returnflag").alias("division"), (F.col("l_suppkey") % 10).alias("line"), F.col("l_quantity").cast("bigint").alias("incident_count"))
    service = t.lineitem.select(m, (F.col("l_suppkey") % 10).alias("line"), (100 - numbers.js_round_long(F.col("l_tax") * 100)).alias("service_delivered_pct"))
    return base, otp, incidents, service


RELIABILITY = """x AS (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, l_returnflag AS division, l_linestatus || '-' || l_linenumber AS car_class, l_suppkey % 10 AS line, * FROM lineitem)"""


@query("monthly_reliability", f"""WITH {RELIABILITY}, o AS (SELECT month, division, avg(floor(l_discount * 1000 + 0.5)::BIGINT) AS v FROM x WHERE l_linestatus = 'O' GROUP BY ALL),
  i AS (SELECT month, division, sum(l_quantity)::BIGINT AS v FROM x WHERE l_quantity > 45 GROUP BY ALL), s AS (SELECT month, avg(100 - floor(l_tax * 100 + 0.5)::BIGINT) AS v FROM x GROUP BY ALL)
  SELECT x.month, x.division, car_class, floor(l_extendedprice)::BIGINT AS mdbf, year(x.month::DATE)::INT AS year, month(x.month::DATE)::INT AS month_num, {r('o.v', 4)} AS otp_pct, i.v AS total_incidents, {r('s.v', 4)} AS service_pct
  FROM x LEFT JOIN o USING (month, division) LEFT JOIN i USING (month, division) LEFT JOIN s USING (month)""", "C6")
def monthly_reliability(t):
    out = L.monthly_reliability(*reliability_inputs(t))
    return out.withColumns({"otp_pct": rd("otp_pct", 4), "service_pct": rd("service_pct", 4)})


LINES = [(i, "A") for i in range(4)] + [(i, "N") for i in range(4, 8)]
DIVISIONS = f"""{RELIABILITY}, ld AS (SELECT * FROM (VALUES {', '.join(f"({a}, '{b}')" for a, b in LINES)}) v(line, d)),
  b AS (SELECT month, division, avg(floor(l_extendedprice)::BIGINT) AS mdbf_mean, min(floor(l_extendedprice)::BIGINT) AS mdbf_min, max(floor(l_extendedprice)::BIGINT) AS mdbf_max, count(DISTINCT car_class) AS n_car_classes FROM x GROUP BY ALL),
  o AS (SELECT month, division, avg(floor(l_discount * 1000 + 0.5)::BIGINT) AS otp_mean FROM x WHERE l_linestatus = 'O' GROUP BY ALL),
  i AS (SELECT month, d AS division, count(*) AS incident_count FROM x JOIN ld USING (line) WHERE l_quantity > 45 GROUP BY ALL),
  s AS (SELECT month, d AS division, avg(100 - floor(l_tax * 100 + 0.5)::BIGINT) AS service_pct_mean FROM x JOIN ld USING (line) GROUP BY ALL),
  dm AS (SELECT month, division, mdbf_mean, mdbf_min, mdbf_max, n_car_classes, otp_mean, coalesce(incident_count, 0) AS incident_count, service_pct_mean
    FROM b LEFT JOIN o USING (month, division) LEFT JOIN i USING (month, division) LEFT JOIN s USING (month, division))"""


def division_rows(t):
    base, otp, incidents, service = reliability_inputs(t)
    lines = t.spark.createDataFrame(LINES, "line bigint, division string")
    return L.division_months(base, otp, incidents.drop("division"), service, lines)


ROUNDED = ["mdbf_mean", "otp_mean", "service_pct_mean"]


@query("division_months", f"WITH {DIVISIONS} SELECT * REPLACE ({', '.join(f'{r(c, 4)} AS {c}' for c in ROUNDED)}) FROM dm", "C7")
def division_months(t):
    return division_rows(t).withColumns({c: rd(c, 4) for c in ROUNDED})


@query("reliability_features", f"""WITH {DIVISIONS}, f AS (SELECT *, avg(mdbf_mean) OVER (w ROWS 2 PRECEDING) AS m3, lag(mdbf_mean, 1) OVER w AS l1, lag(mdbf_mean, 3) OVER w AS l3 FROM dm WINDOW w AS (PARTITION BY division ORDER BY month))
  SELECT month, division, {r('mdbf_mean', 4)} AS mdbf_mean, {r('m3', 4)} AS rolling_mean_3, {r('l1', 4)} AS lag_1, {r('l3', 4)} AS lag_3, incident_count, month(month::DATE)::INT AS month_num, year(month::DATE)::INT AS year
  FROM f WHERE l3 IS NOT NULL AND otp_mean IS NOT NULL AND service_pct_mean IS NOT NULL""", "M3")
def reliability_features(t):
    out = X.reliability_features(division_rows(t))
    return out.select("month", "division", *[rd(c, 4).alias(c) for c in ("mdbf_mean", "rolling_mean_3", "lag_1", "lag_3")], "incident_count", "month_num", "year")


# ---- windowed feature sets ----


def sql_dataset(types, cols, extra=""):
    counts = ", ".join(f"count(*) FILTER (k = '{k}') AS {k.lower()}_count" for k in types)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["event_count", *[f"{k.lower()}_count" for k in types]])
    mt = METRICS.split(",\npolled AS")[1]
    return f"""WITH {EVENTS}, polled AS{mt}, b AS (SELECT route_id, window_start, {cols} FROM metrics GROUP BY ALL),
  e AS (SELECT split_part(pk, '#', 2) AS route_id, timestamp AS ms, count(*) AS event_count, {counts} FROM (SELECT *, split_part(pk, '#', 1) AS k FROM facts) GROUP BY ALL)
  SELECT b.route_id, epoch_ms(window_start) AS timestamp, hour(window_start)::INT AS hour, (dayofweek(window_start) + 1)::INT AS day_of_week, b.* EXCLUDE (route_id, window_start), {filled}{extra}
  FROM b LEFT JOIN e ON e.route_id = b.route_id AND ms = epoch_ms(window_start)"""


def stamped(df, rounded):
    out = df.withColumns({c: rd(c, 4) for c in rounded}).withColumn("timestamp", F.unix_millis("window_start"))
    return out.drop("window_start")


@query("delay_feature_windows", sql_dataset(["BUNCH", "GAP", "DELAY", "ALERT"], f"{r('avg(headway_avg_seconds)', 4)} AS headway_avg, max(train_count) AS train_count, {r('avg(avg_delay_seconds)', 4)} AS delay_seconds",
       ", (coalesce(alert_count, 0) > 0)::INT AS alert_active"), "C5 D32")
def delay_feature_windows(t):
    return stamped(X.delay_dataset(metrics(t), service_events(t)), ["headway_avg", "delay_seconds"])


@query("anomaly_feature_windows", sql_dataset(["BUNCH", "GAP", "DELAY", "ALERT", "TRIP_START", "TRIP_END"], f"{r('avg(headway_avg_seconds)', 4)} AS headway_avg, max(train_count) AS train_count, {r('avg(on_time_percent)', 4)} AS on_time_pct, {r('stddev_samp(headway_avg_seconds)', 4)} AS headway_stddev"), "D33")
def anomaly_feature_windows(t):
    return stamped(X.anomaly_dataset(metrics(t), service_events(t)), ["headway_avg", "on_time_pct", "headway_stddev"])


# ---- feature matrices ----


@query("ridership_base", """SELECT o_orderdate::DATE::VARCHAR AS date, 'Subway ' || o_orderpriority AS mode, count(*) AS count, (isodow(o_orderdate::DATE) - 1)::INT AS day_of_week, month(o_orderdate::DATE)::INT AS month, year(o_orderdate::DATE)::INT AS year,
  (isodow(o_orderdate::DATE) >= 6)::INT AS is_weekend FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL""", "M1")
def ridership_base(t):
    mode = F.concat(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Subway ").otherwise("Bus "), F.col("o_orderpriority"))
    riders = t.orders.groupBy(F.to_date("o_orderdate").alias("date"), mode.alias("mode")).agg(F.count("*").alias("count"))
    return text_date(X.ridership_base(riders))


def holidays(t: Tables):
    d = F.to_date("o_orderdate")
    return t.orders.select(d.alias("date")).filter(F.date_format("date", "MM-dd").isin("01-01", "07-04", "12-25")).distinct()


def ridership_rows(t):
    return X.ridership_features(daily(t).select("date", "n"), "date", "n", holidays(t), (1996, 2))


RIDERSHIP_COLS = ["rolling_mean_7", "rolling_mean_30", "rolling_std_7", "change_365", "recovery_pct", "dow_sin", "dow_cos", "month_sin", "month_cos"]


@query("ridership_features", f"""WITH {DAILY}, b AS (SELECT avg(n) AS b FROM daily WHERE year(date) = 1996 AND month(date) = 2),
  f AS (SELECT date, n, avg(n) OVER (ORDER BY date ROWS 6 PRECEDING) AS rolling_mean_7, avg(n) OVER (ORDER BY date ROWS 29 PRECEDING) AS rolling_mean_30, stddev_samp(n) OVER (ORDER BY date ROWS 6 PRECEDING) AS rolling_std_7,
    n / (lag(n, 365) OVER (ORDER BY date))::DOUBLE - 1 AS change_365, lag(n, 1) OVER (ORDER BY date) AS lag_1, lag(n, 7) OVER (ORDER BY date) AS lag_7, lag(n, 14) OVER (ORDER BY date) AS lag_14, lag(n, 28) OVER (ORDER BY date) AS lag_28,
    n / b * 100 AS recovery_pct, isodow(date) - 1 AS d, month(date) AS m FROM daily, b)
  SELECT date::VARCHAR AS date, n, lag_1, lag_7, lag_14, lag_28, d::INT AS day_of_week, m::INT AS month, dayofyear(date)::INT AS day_of_year, weekofyear(date)::INT AS week_of_year, (d >= 5)::INT AS is_weekend,
    (strftime(date, '%m-%d') IN ('01-01', '07-04', '12-25'))::INT AS is_holiday, {', '.join(f'{r(c, 4)} AS {c}' for c in RIDERSHIP_COLS[:5])},
    {r('sin(2 * pi() * d / 7)', 4)} AS dow_sin, {r('cos(2 * pi() * d / 7)', 4)} AS dow_cos, {r('sin(2 * pi() * m / 12)', 4)} AS month_sin, {r('cos(2 * pi() * m / 12)', 4)} AS month_cos
  FROM f WHERE change_365 IS NOT NULL AND recovery_pct IS NOT NULL AND rolling_std_7 IS NOT NULL""", "M2 H16 H17")
def ridership_features(t):
    return text_date(ridership_rows(t).withColumns({c: rd(c, 4) for c in RIDERSHIP_COLS}))


def delay_rows(t):
    return X.delay_features(t.arrivals.select("arrival_id", "route_id", "stop_id", "ts", "delay_seconds"), block=5000)


DELAY_SQL = f"""{ARRIVALS}, f AS (SELECT *, avg(delay_seconds) OVER (w ROWS 2 PRECEDING) AS m3, coalesce(stddev_samp(delay_seconds) OVER (w ROWS 2 PRECEDING), 0) AS s3, lag(delay_seconds, 1) OVER w AS l1, lag(delay_seconds, 2) OVER w AS l2, lag(delay_seconds, 3) OVER w AS l3,
    (avg(delay_seconds) OVER (PARTITION BY route_id ORDER BY ts, arrival_id ROWS 9 PRECEDING) > 300)::INT AS alert_active, dense_rank() OVER (ORDER BY route_id) - 1 AS ri, dense_rank() OVER (ORDER BY stop_id) - 1 AS si
  FROM arrivals WINDOW w AS (PARTITION BY route_id, stop_id ORDER BY ts, arrival_id)),
delay_features AS (SELECT arrival_id, delay_seconds, l1 AS delay_lag_1, l2 AS delay_lag_2, l3 AS delay_lag_3, {r('m3', 4)} AS delay_rolling_mean_3, {r('s3', 4)} AS delay_rolling_std_3, alert_active, hour(ts)::INT AS hour,
    (hour(ts) * (isodow(ts) - 1))::INT AS hour_x_dow, (isodow(ts) - 1)::INT AS day_of_week, (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19)::INT AS is_rush_hour, {r('sin(2 * pi() * hour(ts) / 24)', 4)} AS hour_sin, ri AS route_id_index, si AS stop_id_index
  FROM f WHERE l3 IS NOT NULL)"""


@query("delay_features", f"WITH {DELAY_SQL} SELECT * FROM delay_features", "M4 M5")
def delay_features(t):
    return delay_rows(t).select("arrival_id", "delay_seconds", "delay_lag_1", "delay_lag_2", "delay_lag_3", rd("delay_rolling_mean_3", 4).alias("delay_rolling_mean_3"),
                                rd("delay_rolling_std_3", 4).alias("delay_rolling_std_3"), "alert_active", "hour", "hour_x_dow", "day_of_week", "is_rush_hour", rd("hour_sin", 4).alias("hour_sin"), "route_id_index", "stop_id_index")


@query("category_index", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS source_index FROM documents", "M5")
def category_index(t):
    return S.sorted_index(t.documents.select("doc_id", "source"), "source", "source_index").select("doc_id", "source_index")


LABELLED = "labelled AS (SELECT event_id, event_type, ts, value, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS target, CASE WHEN user_id % 3 = 0 THEN 1 WHEN value < 30 THEN 0 WHEN value < 70 THEN 1 ELSE 2 END AS predicted FROM events)"


def labelled(t: Tables):
    """A known class and a rule's guess for each event."""
    v = F.col("value")
    return t.events.select("event_id", "event_type", "ts", "value", numbers.js_round_long(v * 100).alias("cents"), F.when(v < 20, 0).when(v < 60, 1).otherwise(2).alias("target"),
                           F.when(F.col("user_id") % 3 == 0, 1).when(v < 30, 0).when(v < 70, 1).otherwise(2).alias("predicted"))


@query("class_weights", f"WITH {LABELLED}, c AS (SELECT target, count(*) AS n FROM labelled GROUP BY 1) SELECT target, n, {r('(sum(n) OVER ()) / (count(*) OVER () * n)::DOUBLE', 6)} AS weight FROM c", "M6")
def class_weights(t):
    return X.class_weights(labelled(t), "target").withColumn("weight", rd("weight", 6))


@query("class_distribution", f"WITH {LABELLED}, c AS (SELECT target, count(*) AS n FROM labelled GROUP BY 1) SELECT target, n, {r('n * 100.0 / sum(n) OVER ()', 4)} AS pct FROM c", "M14")
def class_distribution(t):
    return X.class_distribution(labelled(t), "target").withColumn("pct", rd("pct", 4))


@query("regression_metrics", f"""WITH x AS (SELECT event_type, value AS y, user_id / 2.0 AS p FROM events) SELECT event_type, count(*) AS n, {r('avg(abs((y - p) / y)) FILTER (y <> 0) * 100', 3)} AS mape, {r('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse,
  {r('avg(abs(y - p))', 4)} AS mae, {r('1 - avg((y - p) * (y - p)) / var_pop(y)', 5)} AS r2 FROM x GROUP BY 1""", "M11")
def regression_metrics(t):
    out = M.regression_metrics(t.events.select("event_type", "value", (F.col("user_id") / 2.0).alias("p")), "value", "p", ["event_type"])
    return out.withColumns({"mape": rd("mape", 3), "rmse": rd("rmse", 4), "mae": rd("mae", 4), "r2": rd("r2", 5)})


@query("confusion_matrix", f"WITH {LABELLED}, c AS (SELECT target AS label, predicted AS prediction, count(*) AS n FROM labelled GROUP BY ALL) SELECT *, {r('n / sum(n) OVER (PARTITION BY label)', 6)} AS share FROM c", "M12")
def confusion_matrix(t):
    return M.confusion(labelled(t), "target", "predicted").withColumn("share", rd("share", 6))


@query("classification_report", f"""WITH {LABELLED}, k AS (SELECT unnest([0, 1, 2]) AS class), c AS (SELECT class, count(*) FILTER (target = class) AS support, count(*) FILTER (predicted = class) AS p, count(*) FILTER (target = class AND predicted = class) AS h, count(*) FILTER (target = predicted) * 1.0 / count(*) AS a FROM labelled, k GROUP BY 1)
  SELECT class, support, {r('h::DOUBLE / p', 6)} AS "precision", {r('h::DOUBLE / support', 6)} AS recall, {r('2.0 * h / (p + support)', 6)} AS f1, {r('a', 6)} AS accuracy FROM c""", "M12")
def classification_report(t):
    out = M.classification_report(labelled(t), "target", "predicted")
    return out.withColumns({c: rd(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


def sql_accuracy(key, name, having=""):
    return f"""WITH {LABELLED} SELECT {key} AS {name}, {r('avg((target = predicted)::INT)', 6)} AS accuracy, count(*) AS n, {r('avg(floor(value * 100 + 0.5)::BIGINT)', 4)} AS mean_value, {r('avg((target = 2)::INT) * 100', 4)} AS major_pct FROM labelled GROUP BY 1 {having}"""


def rounded_accuracy(df):
    return df.withColumns({"accuracy": rd("accuracy", 6), "mean_value": rd("mean_value", 4), "major_pct": rd("major_pct", 4)})


@query("accuracy_by_route", sql_accuracy("event_type", "event_type"), "M13")
def accuracy_by_route(t):
    return rounded_accuracy(M.accuracy_by(labelled(t), "event_type", "target", "predicted", "cents"))


@query("weak_hours", sql_accuracy("hour(ts)::INT", "hour", "HAVING avg((target = predicted)::INT) < 0.75"), "M13")
def weak_hours(t):
    return rounded_accuracy(M.accuracy_by(labelled(t).withColumn("hour", F.hour("ts")), "hour", "target", "predicted", "cents", 0.75))


# ---- models: iterative, so no SQL twin ----

RIDER_FEATURES = ["day_of_week", "month", "day_of_year", "week_of_year", "is_weekend", "is_holiday", "rolling_mean_7", "rolling_mean_30", "rolling_std_7",
                  "lag_1", "lag_7", "lag_14", "lag_28", "dow_sin", "dow_cos", "month_sin", "month_cos"]


@query("ridership_boosting", None, "M7")
def ridership_boosting(t):
    rows = S.chronological_split(ridership_rows(t), ["date"], F.year("date").cast("bigint"), test_rows=60)
    # rounds follow one another as Spark jobs, so this binding fits 60 of the default 500
    return M.boosted_regression(rows, RIDER_FEATURES, "n", rounds=60)[1].select("date", "n", "prediction")


@query("reliability_forest", None, "M8")
def reliability_forest(t):
    rows = X.reliability_features(division_rows(t))
    rows = S.chronological_split(rows, ["month", "division"], F.year("month").cast("bigint"))
    names = ["incident_count", "otp_mean", "service_pct_mean", "month_num", "lag_1", "lag_3", "rolling_mean_3", "mdbf_min", "mdbf_max", "n_car_classes"]
    return M.forest_regression(rows, names, "mdbf_mean")[1].select("month", "division", "mdbf_mean", "prediction")


DELAY_FEATURES = ["route_id_index", "stop_id_index", "hour", "day_of_week", "is_weekend", "minute_of_day", "hour_x_dow", "is_am_rush", "is_pm_rush", "is_rush_hour", "hour_sin", "hour_cos",
                  "delay_lag_1", "delay_lag_2", "delay_lag_3", "alert_active"]


def classified(t):
    d = F.col("delay_seconds")
    rows = delay_rows(t).select("arrival_id", "ts", F.when(d < 120, 0).when(d < 300, 1).otherwise(2).alias("target"), *DELAY_FEATURES)
    rows = S.chronological_split(rows, ["ts", "arrival_id"], time_segment_of("ts"))
    drop_unused(t.spark)
    return M.delay_classifier(X.with_class_weight(rows, "target").drop("ts"), DELAY_FEATURES, "target")


@query("delay_classification", None, "M9")
def delay_classification(t):
    return classified(t)[1].select("arrival_id", "target", F.col("prediction").cast("int").alias("prediction"))


@query("delay_feature_importance", None, "M14")
def delay_feature_importance(t):
    return M.feature_importance(classified(t)[0], t.spark, DELAY_FEATURES)


@query("ridership_forecast", None, "M10")
def ridership_forecast(t):
    return M.seasonal_forecast(daily(t).select("date", "n"), "date", "n", "1995-01-01", ["1996-07-01", "1998-01-01", "1999-07-01"], holidays(t))


