"""Streams over several micro-batches must equal the batch operators."""

import datetime as dt

import pytest
from conftest import FOLDER
from pyspark.sql import Window
from pyspark.sql import functions as F

from stopflow.operators import headways as H
from stopflow.plans.base import SCHEMAS, arrivals_of
from stopflow.plans.live import HEADWAY_SCHEMA, METRIC_SCHEMA, ROLLUP_SCHEMA
from stopflow.sources import sinks
from stopflow.streaming import carry
from stopflow.streaming import facts as X
from stopflow.streaming import lifecycle as Z
from stopflow.streaming import stateful as S

ONCE = {"availableNow": True}
LIMITS = {"bunch": 3600, "gap": 86400, "max_headway": None}


@pytest.fixture()
def sliced(spark, tmp_path):
    """The events table as four files in time order, read one file per micro-batch."""
    path = str(tmp_path / "events")
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{FOLDER}/events.parquet")
    days = F.dayofmonth("ts")
    for low, high in ((1, 8), (9, 16), (17, 24), (25, 31)):
        events.filter(days.between(low, high)).coalesce(1).write.mode("append").parquet(path)

    def read():
        return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)

    return events, read


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_headways_carry_over_batches(spark, sliced, new_path):
    events, read = sliced
    out = new_path("out")
    X.headway_stream(arrivals_of(read()), out, new_path("state"), new_path("check"), trigger=ONCE, **LIMITS).awaitTermination()
    got = carry.read_parts(spark, out, HEADWAY_SCHEMA)
    assert got.select("batch_id").distinct().count() == 4
    want = H.headways(arrivals_of(events), **LIMITS)
    cols = ["arrival_id", "headway_seconds", "is_bunch", "is_gap"]
    assert rows(got.select(cols)) == rows(want.select(cols))


def test_window_metrics(spark, sliced, new_path):
    events, _ = sliced
    observed = H.headways(arrivals_of(events), **LIMITS)
    path = new_path("observed")
    for low, high in ((1, 15), (16, 31)):
        observed.filter(F.dayofmonth("ts").between(low, high)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(HEADWAY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    metrics, facts, daily = new_path("metrics"), new_path("facts"), new_path("daily")
    X.metric_stream(stream, metrics, facts, daily, new_path("check"), "UTC", trigger=ONCE).awaitTermination()
    closed = F.col("window_start") < observed.agg((F.unix_timestamp(F.max("ts")) - 900).alias("t")).select(F.timestamp_seconds("t")).scalar()
    cols = ["route_id", "direction", "window_start", "train_count", "avg_delay_seconds", "headway_avg_seconds", "feed_status", "bunch_count"]
    got = carry.read_parts(spark, metrics, METRIC_SCHEMA).filter(closed).select(cols)
    assert rows(got) == rows(H.window_metrics(observed).filter(closed).select(cols))
    sums = X.daily_sums(carry.read_parts(spark, daily, ROLLUP_SCHEMA))
    assert sums.agg(F.sum("n_windows")).first()[0] >= got.count()


@pytest.mark.parametrize("cuts", [(1, 32), (1, 8, 16, 32), (1, 2, 30, 32)])
def test_daily_rollup_in_full(spark, tmp_path, new_path, cuts):
    """All columns of the batch roll-up, the median among them, however the stream is cut."""
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{FOLDER}/events.parquet")
    observed = H.headways(arrivals_of(events), **LIMITS)
    path, parts, counts = str(tmp_path / "observed"), new_path("parts"), new_path("counts")
    for low, high in zip(cuts, cuts[1:]):
        observed.filter(F.dayofmonth("ts").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(HEADWAY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    X.daily_stream(stream, parts, counts, new_path("check"), "America/New_York", trigger=ONCE).awaitTermination()
    got = X.daily_rollup_so_far(carry.read_parts(spark, parts, X.DAILY_PARTS), carry.read_parts(spark, counts, X.HEADWAY_COUNTS))
    end = observed.agg(F.max("ts")).scalar()
    shut = F.window("ts", "5 minutes")["end"] <= F.timestamp_millis(F.unix_millis(end)) - F.expr("interval 10 minutes")
    want = H.daily_rollup(observed.filter(shut), "America/New_York")
    assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(got.columns))) and set(got.columns) == set(want.columns)
    assert got.filter("median_headway IS NOT NULL").count() > 20


@pytest.mark.parametrize("which", ["metrics", "daily"])
def test_state_of_windows_does_not_grow_with_arrivals(spark, new_path, which):
    """A busy window's stops share a few state rows, and counts, worst and most frequent stops stay right, a NULL stop's too."""
    at = dt.datetime(2024, 1, 1, 12, 0)
    made = [(i, "A", "N", None if i % 7 == 0 else f"s{i % 40}", i, at + dt.timedelta(seconds=i % 180), i % 900, 1, "success", float(i % 50), i % 3 == 0, i % 2 == 0) for i in range(2000)]
    end = [(9000, "B", "S", "x", 1, at + dt.timedelta(hours=1), None, None, "ok", None, False, False)]
    observed = spark.createDataFrame(made + end, HEADWAY_SCHEMA)
    path, check, out = new_path("observed"), new_path("check"), [new_path(n) for n in "abc"]
    observed.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(HEADWAY_SCHEMA).parquet(path)
    query = X.metric_stream(stream, *out, check, "UTC", trigger=ONCE) if which == "metrics" else X.daily_stream(stream, *out[:2], check, "UTC", trigger=ONCE)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2 * X.SHARDS
    shut = observed.filter("route_id = 'A'")
    if which == "metrics":
        cols = ["pk", "timestamp", "stop_id", "description"]
        assert rows(carry.read_parts(spark, out[1], "pk string, timestamp bigint, stop_id string, description string").select(cols)) == rows(H.service_events(shut).select(cols))
        cols = ["route_id", "direction", "window_start", "train_count", "avg_delay_seconds", "headway_avg_seconds", "feed_status", "bunch_count"]
        assert rows(carry.read_parts(spark, out[0], METRIC_SCHEMA).select(cols)) == rows(H.window_metrics(shut).select(cols))
    else:
        got = X.daily_rollup_so_far(carry.read_parts(spark, out[0], X.DAILY_PARTS), carry.read_parts(spark, out[1], X.HEADWAY_COUNTS))
        assert rows(got.select(sorted(got.columns))) == rows(H.daily_rollup(shut, "UTC").select(sorted(got.columns)))


def test_weighted_median(spark):
    data = [("a", 1.0, 3), ("a", 90.0, 2), ("a", 70.0, 1), ("b", 5.0, 1), ("b", 200.0, 1), ("c", 7.0, 9), (None, 3.0, 2)]
    got = X.weighted_median(spark.createDataFrame(data + [("a", 1.0, 1)], "k string, v double, n bigint"), ["k"], "v", "n", "m")
    assert rows(got) == rows(spark.createDataFrame([("a", 1.0), ("b", 102.5), ("c", 7.0), (None, 3.0)], "k string, m double"))


def test_poll_changes(spark, sliced, new_path):
    events, read = sliced

    def polls(df):
        return df.select(F.col("event_type").alias("g"), F.col("user_id").alias("k"), F.to_date("ts").alias("p"))

    out, state = new_path("out"), new_path("state")
    Z.change_stream(polls(read()), "g", "k", "p", out, state, new_path("check"), ONCE).awaitTermination()
    got = Z.changes_so_far(spark, out, state, "g", "k", "p", "g string, k bigint, p date")
    assert rows(got) == rows(Z.poll_changes(polls(events), "g", "k", "p"))


@pytest.fixture()
def torn(spark, tmp_path):
    """The events table cut inside days, hours and minutes: by event number, in four files."""
    path = str(tmp_path / "torn")
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{FOLDER}/events.parquet")
    ranked = events.withColumn("_at", F.percent_rank().over(Window.orderBy("ts", "event_id")))
    for low, high in ((0.0, 0.13), (0.13, 0.4142), (0.4142, 0.777), (0.777, 2.0)):
        part = ranked.filter((F.col("_at") >= low) & (F.col("_at") < high)).drop("_at")
        part.coalesce(1).write.mode("append").parquet(path)
    return events, lambda: spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)


def test_poll_changes_do_not_depend_on_cuts(spark, torn, new_path):
    events, read = torn

    def polls(df):
        return df.select(F.col("event_type").alias("g"), F.col("user_id").alias("k"), F.to_date("ts").alias("p"))

    out, state = new_path("out"), new_path("state")
    Z.change_stream(polls(read()), "g", "k", "p", out, state, new_path("check"), ONCE).awaitTermination()
    got = Z.changes_so_far(spark, out, state, "g", "k", "p", "g string, k bigint, p date")
    assert rows(got) == rows(Z.poll_changes(polls(events), "g", "k", "p"))
    assert len(carry.part_ids(spark, state)) == 2


def test_a_poll_in_two_batches_is_one_poll(spark, new_path):
    path = new_path("in")
    for part in ([("a", 1, 1), ("a", 2, 1)], [("a", 1, 2)], [("a", 2, 2)], [("a", 2, 3), ("a", 9, 1)]):
        spark.createDataFrame(part, "g string, k int, p int").coalesce(1).write.mode("append").parquet(path)
    seen = spark.readStream.schema("g string, k int, p int").option("maxFilesPerTrigger", 1).parquet(path)
    out, state = new_path("out"), new_path("state")
    Z.change_stream(seen, "g", "k", "p", out, state, new_path("check"), ONCE).awaitTermination()
    got = Z.changes_so_far(spark, out, state, "g", "k", "p", "g string, k int, p int")
    assert rows(got) == [("a", 1, 3, "removed")]


def test_a_cycle_in_several_batches_is_one_row(spark, torn, new_path):
    events, read = torn
    path = new_path("status")
    rows_of = arrivals_of(read()).withColumn("ts", F.date_trunc("day", "ts"))
    X.status_stream(rows_of, "route_id", path, new_path("check"), ONCE).awaitTermination()
    parts = carry.read_parts(spark, path, X.STATUS_PARTS)
    want = X.feed_status(arrivals_of(events).withColumn("ts", F.date_trunc("day", "ts")), "route_id")
    assert parts.count() > want.count()
    got = X.fold_status(parts)
    assert rows(got.select(want.columns)) == rows(want)


def test_boards_merge_over_batches_and_take_parents(spark, torn, new_path):
    events, read = torn

    def due(df):
        return df.select(F.col("event_id").alias("arrival_id"), F.concat((F.col("user_id") % 3).cast("string"), F.when(F.col("user_id") % 2 == 0, "N").otherwise("S")).alias("stop_id"),
                         (F.col("event_id") % 40).alias("trip_id"), F.col("ts").cast("timestamp").alias("due"))

    path, state = new_path("boards"), new_path("state")
    wanted = spark.createDataFrame([("0N",), ("1",), ("9",)], "stop_id string")
    Z.board_stream(due(read()), wanted, path, state, new_path("check"), 5, trigger=ONCE).awaitTermination()
    got = Z.latest_boards(spark, path, "arrival_id bigint, stop_id string, trip_id bigint, due timestamp")
    want = []
    for board, platforms in (("0N", ["0N"]), ("1", ["1N", "1S"])):
        first = {}
        for r in sorted(due(events).collect(), key=lambda r: r.arrival_id):
            if r.stop_id in platforms:
                first.setdefault(r.trip_id, r)
        best = sorted(first.values(), key=lambda r: (r.due, r.arrival_id))[:5]
        want += [(board, r.arrival_id, i + 1) for i, r in enumerate(best)]
    assert sorted((r.board, r.arrival_id, r["rank"]) for r in got.collect()) == sorted(want)


def test_daily_accumulator_and_state(spark, sliced, new_path):
    events, read = sliced
    path = new_path("daily")
    X.daily_accumulator(arrivals_of(read()), path, new_path("check"), "America/New_York", trigger=ONCE).awaitTermination()
    schema = "date date, route_id string, direction string, sum_delay bigint, n_delay bigint, n_on_time bigint, n_seen bigint"
    got = sinks.current_rows(spark, path, schema, ["date", "route_id", "direction"], "n_seen")
    assert got.agg(F.sum("n_seen")).first()[0] == events.count()
    state = new_path("state")
    changes = read().select("user_id", "event_id", (F.col("event_type") == "error").alias("is_removed"))
    Z.state_stream(changes, state, new_path("check2"), ["user_id"], "event_id", ONCE).awaitTermination()
    live = sinks.current_rows(spark, state, "user_id bigint, event_id bigint, is_removed boolean", ["user_id"], "event_id")
    want = Z.latest_state(events.select("user_id", "event_id", (F.col("event_type") == "error").alias("is_removed")), ["user_id"], ["event_id"])
    assert rows(live.filter(~F.col("is_removed")).drop("is_removed")) == rows(want)


def test_sessions(spark, sliced, new_path):
    events, read = sliced
    path = new_path("sessions")
    stream = Z.session_stream(arrivals_of(read()), "1 hour", "12 hours", stop="route_id")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path("check")).outputMode("append").trigger(**ONCE).start().awaitTermination()
    got = spark.read.schema("trip_id bigint, started_at timestamp, last_seen_at timestamp, n_seen bigint, stops_served bigint").parquet(path)
    from stopflow.operators.ordered import time_segment_of
    want = Z.trip_sessions(arrivals_of(events), time_segment_of("ts"), stop="route_id", gap_seconds=43200)
    end = events.agg((F.unix_timestamp(F.max("ts")) - 3600 - 43200).alias("t")).first().t
    closed = want.filter(F.unix_timestamp("last_seen_at") < end).select(got.columns)
    assert set(rows(closed)) <= set(rows(got)) <= set(rows(want.select(got.columns)))


def test_rolling_store_keeps_the_newest(spark, sliced, new_path):
    events, read = sliced
    path = new_path("store")

    def facts(df):
        return df.select(F.concat_ws("#", "event_type", "event_id").alias("pk"), F.unix_millis("ts").alias("timestamp"))

    Z.rolling_store(facts(read()), path, new_path("check"), lambda df: df.agg(F.max("timestamp")).scalar(), hours=48, limit=50, trigger=ONCE).awaitTermination()
    got = carry.read_before(spark, path, "pk string, timestamp bigint", 2 ** 62)
    want = facts(events).orderBy(F.desc("timestamp"), "pk").limit(50)
    newest = want.agg(F.max("timestamp")).first()[0]
    assert rows(got) == rows(want.filter(F.col("timestamp") > newest - 48 * 3_600_000))


def daily_lists(df):
    """Daily polls that list trips with a stop each."""
    return df.select(F.col("event_type").alias("g"), (F.col("user_id") % 5).alias("k"), F.date_trunc("day", "ts").cast("timestamp").alias("p"),
                     (F.col("event_id") % 7).cast("string").alias("s"), F.col("event_type").alias("r"))


def test_listed_trips_by_hand(spark):
    import datetime as dt
    def at(m):
        return dt.datetime(2024, 1, 1, 0, m)

    seen = spark.createDataFrame([("g", "t", at(0), "a", "R"), ("g", "t", at(1), "b", "R"), ("g", "u", at(1), "a", "R"), ("g", "u", at(2), "a", "R"), ("g", "u", at(3), "a", "R"),
                                  ("g", "t", at(3), "c", "R"), ("g", "v", at(2), "a", "R")], "g string, k string, p timestamp, s string, r string")
    got = sorted((r.k, r.pk, r.timestamp // 60000 % 60, r.stops_served, r.duration_seconds) for r in Z.listed_trips(seen, "g", "k", "p", "s", "r").collect())
    assert got == [("t", "TRIP_END#R", 1, 2, 60), ("t", "TRIP_START#R", 0, None, None), ("t", "TRIP_START#R", 3, None, None),
                   ("u", "TRIP_START#R", 1, None, None), ("v", "TRIP_START#R", 2, None, None)]


def test_listed_trips_stream(spark, torn, new_path):
    events, read = torn
    out, state = new_path("out"), new_path("state")
    Z.listed_stream(daily_lists(read()), "g", "k", "p", "s", "r", out, state, new_path("check"), ONCE).awaitTermination()
    want = Z.listed_trips(daily_lists(events), "g", "k", "p", "s", "r")
    got = carry.read_parts(spark, out, "k bigint, pk string, timestamp bigint, stops_served bigint, duration_seconds bigint").select(want.columns)
    assert rows(got) == rows(want)
    assert want.filter("pk LIKE 'TRIP_END%'").count() > 10


# ---- state store ----


def sights(events):
    return events.select(F.col("user_id").alias("trip_id"), "ts", F.col("event_id").alias("arrival_id"), F.col("event_type").alias("route_id"))


def marked():
    return F.col("route_id") != "signup", F.col("trip_id") % 10 == 0


MARKS = {"missed_seconds": 3600, "dim_seconds": 7200, "cull_seconds": 36000, "forget_seconds": 86400}


@pytest.mark.parametrize("cuts", [(1, 8, 16, 24, 32), (1, 2, 3, 20, 32), (1, 32)])
def test_markers_do_not_depend_on_batches(spark, tmp_path, new_path, cuts):
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{FOLDER}/events.parquet")
    path, out = str(tmp_path / "cut"), new_path("out")
    for low, high in zip(cuts, cuts[1:]):
        events.filter(F.dayofmonth("ts").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
    S.marker_stream(sights(stream), out, new_path("check"), *marked(), **MARKS, trigger=ONCE).awaitTermination()
    got = carry.read_parts(spark, out, f"trip_id bigint, {S.TRANSITION}").drop("batch_id")
    want = S.marker_changes(sights(events), events.agg(F.unix_millis(F.max("ts"))).scalar(), *marked(), **MARKS)
    assert rows(got) == rows(want)


def test_markers_change_without_a_row_of_their_own(spark, tmp_path, new_path):
    """Trip 1 is seen once; the rows of trip 2 alone move the clock on."""
    path, out, check = str(tmp_path / "seen"), new_path("out"), new_path("check")
    schema = "trip_id bigint, ts timestamp, arrival_id bigint, shown boolean, last boolean"

    def feed(*rows_):
        spark.createDataFrame(list(rows_), "trip_id bigint, s long, arrival_id bigint, shown boolean, last boolean").selectExpr(
            "trip_id", "timestamp_seconds(s) AS ts", "arrival_id", "shown", "last").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        S.marker_stream(stream, out, check, F.col("shown"), F.col("last"), 30, 120, 600, 900, trigger=ONCE).awaitTermination()
        found = carry.read_parts(spark, out, f"trip_id bigint, {S.TRANSITION}").filter("trip_id <> 2").select("trip_id", "status", "at_ms")
        return {(r.trip_id, r.status, r.at_ms) for r in found.collect()}

    seen = feed((1, 1000, 1, True, False), (3, 1000, 2, False, False), (4, 1000, 3, True, True), (2, 1010, 4, True, False))
    first = {(1, "active", 1_000_000), (3, "active", 1_000_000), (4, "active", 1_000_000)}
    assert seen == first
    second = first | {(3, "removed", 1_030_001), (4, "fading", 1_030_001)}
    assert feed((2, 1031, 5, True, False)) == second
    third = second | {(1, "stale-dim", 1_120_001)}
    assert feed((2, 1300, 6, True, False)) == third
    fourth = third | {(1, "fading", 1_600_001), (1, "removed", 1_900_001), (4, "removed", 1_900_001)}
    assert feed((2, 5000, 7, True, False)) == fourth
    assert feed((1, 5001, 8, True, False)) == fourth | {(1, "active", 5_001_000)}


def test_newest_marker_status_equals_the_batch_form(spark, new_path):
    """Without forgetting, the newest change per trip is what the batch operator says of the last cycle."""
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{FOLDER}/events.parquet")
    known = sights(events)
    now = events.agg(F.max("ts")).scalar()
    got = S.marker_statuses(S.marker_changes(known, F.unix_millis(now), *marked(), 3600, 7200, 36000))
    state = known.groupBy("trip_id").agg(F.max("ts").alias("last_seen_at"), F.max_by("route_id", F.struct("ts", "arrival_id")).alias("route_id"))
    current = known.filter(F.unix_millis("ts") >= F.unix_millis(now) - 3_600_000)
    want = Z.marker_status(state, current, now, *marked(), 7200, 36000).select("trip_id", "status")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("cuts", [(0, 100, 250, 10_000), (0, 1, 2, 499, 10_000), (0, 10_000)])
def test_smoothing_equals_one_pass(spark, tmp_path, new_path, cuts):
    from stopflow.operators import track as K
    base = spark.read.schema(SCHEMAS["embeddings"]).parquet(f"{FOLDER}/embeddings.parquet")
    jump = F.when(F.col("vec_id") % 97 == 0, 50_000).otherwise(0)
    points = base.select("vec_id", "label", (F.col("vec_id") * 10 + F.col("embedding")[2].cast("double") * 100 + jump).alias("z"), (F.col("vec_id") * 10000).alias("t"))
    path, out = str(tmp_path / "points"), new_path("out")
    for low, high in zip(cuts, cuts[1:]):
        points.filter((F.col("vec_id") >= low) & (F.col("vec_id") < high)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(path)
    S.smooth_stream(stream, out, new_path("check"), "label", "vec_id", "z", "t", trigger=ONCE).awaitTermination()
    cols = ["label", "vec_id", "s", "v", "a", "restarted"]
    got = carry.read_parts(spark, out, "label int, vec_id bigint, s double, v double, a double, restarted boolean").select(cols)
    want = K.smooth(points, "label", "vec_id", "z", "t", F.floor(F.col("vec_id") / 250)).select(cols)
    assert rows(got) == rows(want)
    assert got.filter("restarted").count() > 10
