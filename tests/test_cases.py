"""Hand-computed cases for expressions, dashboards and statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stopflow import config
from stopflow.functions import numbers, text, times
from stopflow.operators import predicates as P
from stopflow.operators import rollups as R
from stopflow.operators import series as S
from stopflow.operators import summaries as Y
from stopflow.sources import historical, readers, sinks


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("x, want", [(-2.5, -2.0), (2.5, 3.0), (-0.4, 0.0), (1.45, 1.0)])
def test_rounding(spark, x, want):
    assert value(spark, numbers.js_round(F.lit(x))) == want


@pytest.mark.parametrize("clock, want", [("25:10:05", 90605), ("07:00:00", 25200), ("abc", None), ("7:5", 25500), ("", None)])
def test_clock(spark, clock, want):
    assert value(spark, times.clock_to_seconds(F.lit(clock))) == want


@pytest.mark.parametrize("raw, want", [("02/19/2026", "2026-02-19"), ("2/9/51", "1951-02-09"), ("2/9/50", "2050-02-09"), ("2015-01-01T00", "2015-01-01"), ("2018-Q1", "2018-Q1"), (" ", None)])
def test_dates(spark, raw, want):
    assert value(spark, times.normalize_date(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("4,050,989", 4050989), ("96621.9", 96621), ("", None), ("n/a", None)])
def test_whole_numbers(spark, raw, want):
    assert value(spark, numbers.parse_long(F.lit(raw))) == want


def test_percentages_and_missing(spark):
    assert value(spark, numbers.parse_double(F.lit("76.2337806%"))) == 76.2337806
    assert value(spark, numbers.parse_double(F.lit(""), True)) == 0.0


@pytest.mark.parametrize("trip, key, shape", [
    ("BFA25GEN-M093-Weekday-00_113950_M..N20R", "113950_M..N", "M..N20R"), ("113100_A..N85X003", "113100_A..N", "A..N85X003"),
    ("119650_7..N", "119650_7..N", "7..N"), ("plain", "plain", None)])
def test_trip_ids(spark, trip, key, shape):
    assert (value(spark, text.trip_key(F.lit(trip))), value(spark, text.trip_shape(F.lit(trip)))) == (key, shape)


def test_seconds_of_day_follow_daylight_saving(spark):
    for utc, want in [("2024-01-15 17:00:00", 43200), ("2024-07-15 16:00:00", 43200), ("2024-03-10 07:00:00", 10800)]:
        assert value(spark, times.seconds_of_local_day(F.lit(utc).cast("timestamp"), config.LOCAL_ZONE)) == want


def test_service_date_rolls_at_three(spark):
    early, late = (value(spark, times.service_date(F.lit(x).cast("timestamp"), config.LOCAL_ZONE)) for x in ("2024-01-15 07:59:00", "2024-01-15 08:00:00"))
    assert (early, late) == (dt.date(2024, 1, 14), dt.date(2024, 1, 15))


@pytest.mark.parametrize("seconds, want", [(-90, "1m ago"), (20, "now"), (45, "1m"), (119, "1m"), (600, "10m")])
def test_eta_text(spark, seconds, want):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    assert value(spark, times.relative_eta(F.timestamp_seconds(F.unix_timestamp(now) + seconds), now)) == want


def test_text_helpers(spark):
    assert value(spark, text.lead_sentences(F.lit("Short. This one is long enough! And this is as well. Third sentence here."))) == "This one is long enough! And this is as well."
    assert value(spark, text.truncate_text(F.lit("abcdef"), 3)) == "abc..."
    assert value(spark, text.key_part(F.lit("TRIP_START#A#N"), 1)) == "A"
    assert value(spark, text.key_part(F.lit("A"), 1)) is None
    assert value(spark, times.minutes_to_clock(F.lit(24 * 60 + 5))) == "12:05 AM"


STOPS = [("R16", "", None), ("N02", "", None), ("101N", "1", "101"), ("236", "2 3", None), ("F05", "E/F", None)]


@pytest.mark.parametrize("route, want", [("N", {"R16", "N02"}), ("5", {"236"}), ("E", {"F05"}), ("2", {"236"}), ("5X", {"236"}), ("1", {"101N"})])
def test_stops_serving_route(spark, route, want):
    df = spark.createDataFrame(STOPS, "stop_id string, routes string, parent string")
    got = P.filter_stops_by_route(df, route, config.ROUTE_PREFIXES, config.ROUTE_RANGES, config.ROUTE_ALIASES)
    assert {r.stop_id for r in got.collect()} == want


@pytest.mark.parametrize("headsign, stop, want", [(None, "101N", "Van Cortlandt Park-242 St"), ("South Ferry", "101N", "Van Cortlandt Park-242 St"),
                                                  ("Special", "101S", "Special"), (None, "101", "Unknown")])
def test_headsigns(spark, headsign, stop, want):
    df = spark.createDataFrame([(headsign, stop, "1")], "headsign string, next_stop_id string, route_id string")
    assert P.with_valid_headsign(df, config.ROUTE_TERMINALS).first().headsign_shown == want


ROLLUP = "route_id string, date string, direction string, avg_delay double, on_time_percent double, peak_train_count int, avg_headway int, median_headway int, total_bunching int, total_gaps int, total_trains int"


def test_grade_and_distribution(spark):
    one = spark.createDataFrame([("1", "2026-02-24", "N", 45.0, 82.0, 12, 360, 340, 2, 1, 150)], ROLLUP)
    got = R.grades(R.route_performance(one, "2026-01-01")).first()
    assert (round(got.score, 2), got.grade) == (84.44, "B")
    assert {r.bucket: r.share for r in R.delay_distribution(one).collect()} == {"on_time": 82, "0-2 min": 18, "2-5 min": 0, "5-10 min": 0, "10+ min": 0}
    empty = one.withColumn("on_time_percent", F.lit(None).cast("double"))
    assert {r.share for r in R.delay_distribution(empty).collect()} == {0}
    assert R.grades(R.route_performance(empty, "2026-01-01")).first().grade is None
    assert [r.place for r in R.best_and_worst(one, "2026-02-24").collect()] == ["best"]


def test_alert_speed(spark):
    alerts = spark.createDataFrame([("Delays", ["A", "B"]), ("Suspension", ["b"])], "alert_type string, affected_routes array<string>")
    routes = spark.createDataFrame([("A",), ("B",), ("C",)], "route_id string")
    assert {r.route_id: r.speed_factor for r in R.alert_speed(alerts, routes, config.ALERT_SPEED).collect()} == {"A": 0.8, "B": 0.5, "C": 1.0}


def test_active_alerts(spark):
    rows = [(1, None), (2, []), (3, [("2024-01-01", None)]), (4, [("2024-01-01", "2024-01-15 12:00:00")]), (5, [("2024-02-01", None)])]
    df = spark.createDataFrame(rows, "alert_id int, p array<struct<start:string,end:string>>").withColumn("active_periods", F.col("p").cast("array<struct<start:timestamp,end:timestamp>>"))
    assert {r.alert_id for r in P.active_alerts(df, F.lit("2024-01-15 12:00:00").cast("timestamp")).collect()} == {1, 2, 3, 4}


def test_short_series_is_insufficient(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1), float(m)) for m in range(1, 13)], "date date, n double")
    rows = S.decompose(df, [], "date", "n", 12).collect()
    assert {r.status for r in rows} == {"insufficient"} and all(r.trend is None for r in rows)


def test_student_t_tail():
    assert abs(Y.t_two_sided(2.0, 10.0) - 0.0733880) < 1e-6
    assert abs(Y.t_two_sided(0.0, 5.0) - 1.0) < 1e-12


def test_csv_by_header_and_missing_columns(spark, new_path):
    path = new_path("stops")
    spark.createDataFrame([("1.5", "A1", "x, \"y\"")], "stop_lat string, stop_id string, stop_name string").write.option("header", True).option("escape", '"').csv(path)
    row = readers.read_csv_by_header(spark, path, "stop_id string, stop_name string, stop_lat double, parent_station string").first()
    assert tuple(row) == ("A1", 'x, "y"', 1.5, None)


def test_historical_sample(spark, new_path):
    path = new_path("otp")
    names = "month string, division string, line string, day_type string, num_on_time_trips string, num_sched_trips string, terminal_on_time_performance string"
    spark.createDataFrame([("2015-01-01", "A DIVISION", "1", "1", "6,874", "9,017", "76.2337806%")], names).write.option("header", True).csv(path)
    assert tuple(historical.load(spark, path, "terminal_otp").first()) == ("2015-01-01", "A DIVISION", "1", "1", 6874, 9017, 76.2337806)


def test_recent_days_missing_base(spark, new_path):
    assert readers.read_recent_json(spark, new_path("none"), "a int", "2024-01-01") is None


def test_upsert_is_idempotent(spark, new_path):
    path, schema = new_path("u"), "k int, v int, at int"
    a, b = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], schema), spark.createDataFrame([(1, 12, 3)], schema)
    for i, batch in ((0, a), (1, b), (1, b), (0, a)):
        sinks.upsert_batch(batch, path, i, ["k"], "at")
    assert sorted(tuple(r) for r in sinks.current_rows(spark, path, schema, ["k"], "at").collect()) == [(1, 12, 3), (2, 20, 1)]


def test_geojson_parts_hold_everything(spark):
    shape = spark.createDataFrame([("A", "s", i, 40.0 + i, -74.0) for i in range(10)], "route_id string, shape_id string, seq int, lat double, lon double")
    colours = spark.createDataFrame([("A", "#123456")], "route_id string, color string")
    whole = sinks.route_features(shape, colours).collect()
    assert len(whole) == 1 and '"color":"#123456"' in whole[0].feature
    parts = sinks.route_features(shape, colours, max_vertices=4).orderBy("part").collect()
    assert len(parts) > 1
    assert {i for i in range(10)} == {i for i in range(10) if any(f",{40.0 + i}]" in p.feature for p in parts)}


def test_feed_entities(spark):
    from stopflow.sources import schemas
    lines = ['{"id": "1", "tripUpdate": {"trip": {"tripId": "t", "routeId": "a"}, "timestamp": 1700000000, "stopTimeUpdate": [{"stopId": "101N", "arrival": {"time": 1700000060, "delay": 5}}, {"stopId": "102N", "scheduleRelationship": "SKIPPED"}]}}',
             '{"id": "2"}', '{"id": "3", "tripUpdate": {"trip": {"tripId": "u", "routeId": "b"}, "stopTimeUpdate": []}}']
    df = spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", schemas.FEED_ENTITY).alias("e")).select("e.*")
    rows = sorted(((r.trip_id, r.route_id, r.seq, r.stop_id, r.schedule_relationship) for r in readers.flatten_feed(df).collect()), key=str)
    assert rows == [("t", "A", 0, "101N", "SCHEDULED"), ("t", "A", 1, "102N", "SKIPPED"), ("u", "B", None, None, None)]


def test_schedule_files_with_columns_in_different_order(spark, new_path):
    path = new_path("stop_times")
    first = spark.createDataFrame([("t1", "s1", 1)], "trip_id string, stop_id string, stop_sequence int")
    first.coalesce(1).write.option("header", True).csv(path)
    first.selectExpr("'s2' AS stop_id", "2 AS stop_sequence", "'t2' AS trip_id").coalesce(1).write.mode("append").option("header", True).csv(path)
    rows = readers.read_csv_by_header(spark, path, "trip_id string, stop_id string, stop_sequence int, note string").collect()
    assert sorted(tuple(r) for r in rows) == [("t1", "s1", 1, None), ("t2", "s2", 2, None)]


def test_only_the_folders_of_the_days_asked_for_are_read(spark, new_path):
    base = new_path("days")
    days = spark.createDataFrame([(1, "2024", "01", "02"), (2, "2024", "01", "03"), (3, "2023", "12", "31")], "v int, year string, month string, day string")
    days.write.partitionBy("year", "month", "day").json(base)
    got = readers.read_recent_json(spark, base, "v int", "2024-01-03", 3)
    assert sorted(r.v for r in got.collect()) == [1, 2] and len(got.inputFiles()) == 2
    assert readers.read_recent_json(spark, base, "v int", "2025-01-01", 7) is None


def test_index_follows_the_type_of_the_column(spark):
    rows = spark.createDataFrame([(10,), (9,), (100,), (2,), (9,), (None,)], "n int")
    assert sorted((r.n, r.i) for r in S.sorted_index(rows, "n", "i").collect() if r.n is not None) == [(2, 0), (9, 1), (9, 1), (10, 2), (100, 3)]


def test_own_shape_goes_before_the_shape_in_the_id(spark):
    from stopflow.operators import lookups
    trips = spark.createDataFrame([("x_113950_M..N20R", "M", "M..N07R", "North end"), ("y_113950_Q..N20R", "Q", None, "Other")],
                                  "trip_id string, route_id string, shape_id string, headsign string")
    live = spark.createDataFrame([("000001_M..N07R", "M"), ("000001_Q..N20R", "Q")], "trip_id string, route_id string")
    got = {r.route_id: r.headsign for r in lookups.tiered_headsign(live, trips).collect()}
    assert got == {"M": "North end", "Q": "Other"}


# ---- aggregates too large to broadcast ----


def test_large_aggregate_is_merged_and_heavy_keys_are_not(spark, monkeypatch):
    """Beyond the limit nothing is copied or broadcast but the rows of heavy keys, also where Spark expects a small table."""
    from stopflow.operators import joins, ordered

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    large = spark.sql("select if(id < 40, null, if(id < 80, 7, id)) k, id from range(200)")
    small = spark.sql("select id k, id * 2 v from range(5, 190) union all select null, -1L")
    expected = {(None if i < 40 else 7 if i < 80 else i, i, -1 if i < 40 else 14 if i < 80 else i * 2 if i < 190 else None) for i in range(200)}
    plain = joins.join_aggregate(large, small, ["k"])
    text = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text and "Generate" not in text
    assert {tuple(r) for r in plain.select("k", "id", "v").collect()} == expected
    monkeypatch.setattr(ordered, "HEAVY_ROWS", 30)
    assert len(ordered.heavy_key(large, ["k"])._jc.toString()) and {tuple(r) for r in joins.join_aggregate(large, small, ["k"]).select("k", "id", "v").collect()} == expected
