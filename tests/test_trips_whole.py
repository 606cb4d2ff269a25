"""Trips are shuffled once and whole; those of very many rows are cut, with the same results."""

import pytest
from pyspark.sql import functions as F

from stopflow.operators import lookups as L
from stopflow.operators import ordered
from stopflow.operators import schedule as S


def stop_times(spark):
    """Six stops a trip at even and odd times; trip t9 has 60."""
    rows = spark.sql("""select concat('t', t) trip_id, s stop_sequence, concat(cast((t + s) % 5 as string), if(s % 2 = 0, 'N', 'S')) stop_id,
        t * 50 + s * 100L arrival_seconds, t * 50 + s * 100L + 20 departure_seconds, 'R' route_id
        from (select id t from range(10)) lateral view explode(sequence(1, if(t = 9, 60, 6))) as s""")
    return rows


def trips(spark):
    return spark.sql("select concat('t', id) trip_id, if(id < 5, 'A', 'B') route_id, cast(id % 2 as int) direction_id from range(10)")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def both(monkeypatch, make):
    """Sorted rows with all trips whole, and with the long one cut."""
    found = []
    for limit in (1000, 20):
        monkeypatch.setattr(ordered, "HEAVY_ROWS", limit)
        found.append(sorted(map(tuple, make().collect()), key=str))
    return found


def test_heavy_keys_are_found(spark):
    assert ordered.heavy_key(stop_times(spark), ["trip_id"], 60) is None
    heavy = ordered.heavy_key(stop_times(spark), ["trip_id"], 59)
    assert {r[0] for r in stop_times(spark).filter(heavy).select("trip_id").collect()} == {"t9"}


def test_steps_shuffle_rows_once(spark, monkeypatch):
    def make():
        return S.stop_steps(stop_times(spark)).select("trip_id", "stop_sequence", "next_stop", "step_seconds")

    assert exchanges(make()) == 1
    whole, cut = both(monkeypatch, make)
    assert whole == cut and len(whole) == 9 * 5 + 59 and {r[3] for r in whole} == {80}


def test_matrix_shuffles_steps_once_before_the_means(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # stop times, trips, means
        assert exchanges(S.duration_matrix(S.stop_steps(stop_times(spark)), trips(spark))) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segment_durations_of_cut_trips(spark, monkeypatch):
    pairs = spark.sql("select 'A' route_id, '2S' from_stop, '3N' to_stop union all select 'B', '0', '1'")
    whole, cut = both(monkeypatch, lambda: L.segment_duration(pairs, S.duration_matrix(S.stop_steps(stop_times(spark)), trips(spark))))
    assert whole == cut == [("A", "2S", "3N", 80), ("B", "0", "1", 80)]


def test_patterns_read_chosen_trips_only(spark, monkeypatch):
    made = S.common_patterns(stop_times(spark), trips(spark))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    whole, cut = both(monkeypatch, lambda: S.route_segments(S.common_patterns(stop_times(spark), trips(spark)), S.stop_steps(stop_times(spark)), trips(spark)))
    assert whole == cut and whole


def test_index_covers_asked_stops_only(spark):
    rows = stop_times(spark).withColumn("trip_id", F.concat(F.lit("X-00_"), "trip_id", F.lit("_R..N1")))
    live = spark.sql("select 'none' trip_id, 'R' route_id, '3' stop_id union all select 't1_R..N1', 'R', '3S' union all select 't1_R..N1', 'R', '77N'")
    whole = L.schedule_index(rows)
    asked = L.schedule_index(rows, asked=live)
    for (_, all_of), (_, part) in zip(whole, asked):
        assert {r[0] for r in part.select("_parent").collect()} == {"3"} and all_of.select("_parent").distinct().count() == 5
    results = [sorted(map(tuple, L.tiered_schedule(live, i).select("trip_id", "stop_id", "scheduled_seconds", "tier").collect()), key=str) for i in (whole, asked)]
    assert results[0] == results[1]
    assert {r[1]: r[3] for r in results[1]} == {"3": None, "3S": 1, "77N": None}


@pytest.mark.parametrize("limit", [1000, 20])
def test_bracketing_takes_the_stop_before_in_one_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "HEAVY_ROWS", limit)
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    updates = stop_times(spark).select("trip_id", "route_id", "stop_id", F.col("stop_sequence").alias("seq"),
                                       F.timestamp_seconds(start + F.col("arrival_seconds")).alias("arrival_time"),
                                       F.timestamp_seconds(start + F.col("departure_seconds")).alias("departure_time"))
    stops = updates.select("stop_id").distinct().selectExpr("stop_id", "40.0D lat", "-74.0D lon")
    made = L.bracketing_stops(updates, stops, F.lit("2024-01-01 00:05:00").cast("timestamp"))
    got = {r["trip_id"]: (r["prev_stop_id"], r["next_stop_id"], r["next_time_ms"] - r["prev_time_ms"]) for r in made.collect()}
    # at 300 s; t2 is at stop 2 then, t5 and t9 come to their first stop later
    assert got["t0"] == ("3S", "4N", 80_000) and got["t2"] == ("4N", "0S", 80_000) and "t5" not in got and "t9" not in got
