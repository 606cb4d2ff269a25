"""Trips, snapshots, boards, latest state and the rolling anomaly store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators.ordered import latest_per_key, sessions, top_per_key
from ..session import cut_lineage
from ..sources.sinks import upsert_batch
from . import carry

# ---- trip lifecycle --------------------------------------------------------------


def trip_sessions(positions: DataFrame, segment: Column, trip: str = "trip_id", ts: str = "ts", tie: str = "arrival_id", stop: str = "stop_id",
                  gap_seconds: float = 1800) -> DataFrame:
    """Trips cut where they were not seen for the gap: start, last sight, distinct stops, last stop."""
    silent = (F.unix_micros(ts) - F.unix_micros("_seen")) / F.lit(1e6) >= gap_seconds
    numbered = sessions(positions, [trip], [ts, tie], silent, {"_seen": ts}, segment)
    return numbered.groupBy(trip, "session").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_seen_at"), F.count("*").alias("n_seen"), F.count_distinct(stop).alias("stops_served"),
        F.max_by(stop, F.struct(ts, tie)).alias("last_stop_id"))


def lifecycle_events(trips: DataFrame, now: Column, stale_seconds: float = 1800, trip: str = "trip_id", route: str = "route_id") -> DataFrame:
    """TRIP_START for every trip, TRIP_END with its last sight for those not seen for the stale time."""
    stale = (F.unix_micros(now) - F.unix_micros("last_seen_at")) / F.lit(1e6) > stale_seconds
    seconds = F.floor((F.unix_micros("last_seen_at") - F.unix_micros("started_at")) / F.lit(1e6) + 0.5)
    key = [F.col(route)] if route in trips.columns else []
    rows = F.array_compact(F.array(
        F.struct(F.concat_ws("#", F.lit("TRIP_START"), *key).alias("pk"), F.unix_millis("started_at").alias("timestamp"), F.lit(None).cast("bigint").alias("duration_seconds")),
        F.when(stale, F.struct(F.concat_ws("#", F.lit("TRIP_END"), *key).alias("pk"), F.unix_millis("last_seen_at").alias("timestamp"), seconds.alias("duration_seconds")))))
    return trips.select(trip, "stops_served", F.inline(rows))


def session_stream(positions: DataFrame, watermark: str, gap: str = "30 minutes", trip: str = "trip_id", ts: str = "ts", stop: str = "stop_id") -> DataFrame:
    """Streaming form: a session leaves when the watermark passes its end. The stop set is bounded by the stop table."""
    return positions.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), trip).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_seen_at"), F.count("*").alias("n_seen"), F.size(F.collect_set(stop)).cast("bigint").alias("stops_served")).drop("w")


def listed_trips(seen: DataFrame, group: str, trip: str, poll: str, stop: str, route: str | None = None) -> DataFrame:
    """TRIP_START at first sight, TRIP_END at last sight once a later closed poll of the group lacks the trip.

    A trip runs while every poll of its group lists it; a trip that comes back starts anew. The group's newest poll is still
    open and ends nothing. One row per event: trip, pk, timestamp (ms), stops_served and duration_seconds (of an end).
    """
    g, k, p = F.col(group).alias("g"), F.col(trip).alias("k"), F.col(poll).alias("p")
    rows = seen.select(g, k, p, F.col(stop).alias("s"), (F.col(route) if route else F.lit(None).cast("string")).alias("r"))
    order = Window.partitionBy("_g").orderBy("_p")
    polls = rows.select(F.col("g").alias("_g"), F.col("p").alias("_p")).distinct().withColumn("_i", F.row_number().over(order))
    last = polls.groupBy("_g").agg(F.max("_i").alias("_open"))
    polls = polls.join(last, "_g")
    placed = rows.join(polls, F.col("g").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_p")))
    once = placed.groupBy("g", "k", "_i").agg(F.min("p").alias("p"), F.max("_open").alias("_open"))
    run = F.col("_i") - F.row_number().over(Window.partitionBy("g", "k").orderBy("_i"))
    runs = placed.drop("_open", "_g", "_p").join(once.select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("_i").alias("_j"), run.alias("run"), "_open"),
                                                 F.col("g").eqNullSafe(F.col("_g")) & (F.col("k") == F.col("_k")) & (F.col("_i") == F.col("_j")))
    trips = runs.groupBy("g", "k", "run").agg(
        F.min("p").alias("started_at"), F.max("p").alias("last_seen_at"), F.max("_i").alias("_i"), F.max("_open").alias("_open"),
        F.count_distinct("s").alias("stops_served"), F.min("r").alias("r"))
    return _trip_events(trips, trip, F.col("_i") + 1 < F.col("_open"))


def _trip_events(trips: DataFrame, trip: str, ended: Column, started: Column | None = None) -> DataFrame:
    seconds = F.floor((F.unix_micros("last_seen_at") - F.unix_micros("started_at")) / F.lit(1e6) + 0.5).cast("bigint")
    start = F.struct(F.concat_ws("#", F.lit("TRIP_START"), "r").alias("pk"), F.unix_millis("started_at").alias("timestamp"),
                     F.lit(None).cast("bigint").alias("stops_served"), F.lit(None).cast("bigint").alias("duration_seconds"))
    end = F.struct(F.concat_ws("#", F.lit("TRIP_END"), "r").alias("pk"), F.unix_millis("last_seen_at").alias("timestamp"),
                   F.col("stops_served"), seconds.alias("duration_seconds"))
    rows = F.array_compact(F.array(start if started is None else F.when(started, start), F.when(ended, end)))
    return trips.select(F.col("k").alias(trip), F.inline(rows))


def listed_stream(seen: DataFrame, group: str, trip: str, poll: str, stop: str, route: str | None, out_path: str, state_path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Streaming form of ``listed_trips``: starts are written at first sight, ends once a closed poll lacks the trip.

    Carried are the trips that run: one row per trip, stop and open or last closed poll. Batches may cut a poll anywhere, as long as polls
    come in order; rows of closed polls come too late and are left out.
    """
    rows = seen.select(F.col(group).cast("string").alias("g"), F.col(trip).alias("k"), F.col(poll).alias("p"), F.col(stop).cast("string").alias("s"),
                       (F.col(route) if route else F.lit(None)).cast("string").alias("r"))
    schema = f"{carry.schema_text(rows)}, known boolean, started_at timestamp, closed_at timestamp"

    def each(batch: DataFrame, batch_id: int) -> None:
        carried = carry.read_before(batch.sparkSession, state_path, schema, batch_id)
        floor = carried.groupBy(F.col("g").alias("_g")).agg(F.max("closed_at").alias("_floor"))
        fresh = batch.join(floor, F.col("g").eqNullSafe(F.col("_g")), "left").filter(F.col("_floor").isNull() | (F.col("p") > F.col("_floor"))).drop("_g", "_floor")
        none = F.lit(None).cast("timestamp")
        both = cut_lineage(carried.unionByName(fresh.withColumns({"known": F.lit(False), "started_at": none, "closed_at": none})))
        order = Window.partitionBy("_g").orderBy("_p")
        polls = both.select(F.col("g").alias("_g"), F.col("p").alias("_p")).distinct().withColumn("_i", F.row_number().over(order))
        polls = polls.join(polls.groupBy("_g").agg(F.max("_i").alias("_open")), "_g")
        placed = both.join(polls, F.col("g").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_p"))).drop("_g", "_p")
        marks = placed.groupBy("g", "k", "_i").agg(F.min("p").alias("_at"))
        gap = F.col("_i") - F.row_number().over(Window.partitionBy("g", "k").orderBy("_i"))
        marks = marks.select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("_i").alias("_j"), gap.alias("run"))
        runs = cut_lineage(placed.join(marks, F.col("g").eqNullSafe(F.col("_g")) & (F.col("k") == F.col("_k")) & (F.col("_i") == F.col("_j"))).drop("_g", "_k", "_j"))
        trips = runs.groupBy("g", "k", "run").agg(
            F.coalesce(F.min("started_at"), F.min("p")).alias("started_at"), F.max("p").alias("last_seen_at"), F.max("_i").alias("_i"),
            F.max("_open").alias("_open"), F.count_distinct("s").alias("stops_served"), F.min("r").alias("r"), F.bool_or("known").alias("known"))
        trips = cut_lineage(trips)
        ended = F.col("_i") + 1 < F.col("_open")
        carry.write_part(_trip_events(trips, trip, ended, ~F.col("known")), out_path, batch_id)
        alive = trips.filter(~ended).select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("run").alias("_r"), F.col("started_at").alias("_s"), F.col("_i").alias("_last"))
        kept = runs.join(alive, F.col("g").eqNullSafe(F.col("_g")) & (F.col("k") == F.col("_k")) & (F.col("run") == F.col("_r")))
        at = kept.groupBy("g", "k", "_r").agg(F.max("p").alias("_top"))
        at = at.select(F.col("g").alias("_g2"), F.col("k").alias("_k2"), F.col("_r").alias("_r2"), "_top")
        kept = kept.join(at, F.col("g").eqNullSafe(F.col("_g2")) & (F.col("k") == F.col("_k2")) & (F.col("_r") == F.col("_r2")))
        closed = polls.filter(F.col("_i") < F.col("_open")).groupBy(F.col("_g").alias("_g3")).agg(F.max("_p").alias("_closed"))
        # earlier polls of a running trip move up to the last closed one, or to its newest
        kept = kept.join(closed, F.col("g").eqNullSafe(F.col("_g3")), "left")
        moved = F.when(F.col("_closed").isNull() | (F.col("p") >= F.col("_closed")), F.col("p")).otherwise(F.least("_top", "_closed"))
        state = kept.select("g", "k", moved.alias("p"), "s", "r", F.lit(True).alias("known"), F.col("_s").alias("started_at"), F.col("_closed").alias("closed_at"))
        carry.write_state(state.distinct(), state_path, batch_id)

    return carry.run_batches(rows, each, checkpoint, trigger)


# ---- snapshots ---------------------------------------------------------------------


def poll_changes(seen: DataFrame, group: str, key: str, poll: str) -> DataFrame:
    """Keys that came with a poll, and keys of a poll that the group's next poll lacks, stamped with that next poll.

    Only the list of distinct polls per group is ordered; keys are compared by anti joins.
    """
    rows = seen.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(poll).alias("p")).distinct()
    order = Window.partitionBy("_pg").orderBy("_at")
    polls = rows.select(F.col("g").alias("_pg"), F.col("p").alias("_at")).distinct()
    polls = polls.select("_pg", "_at", F.lead("_at").over(order).alias("next"), F.lag("_at").over(order).alias("prev"))
    placed = rows.join(polls, (F.col("g") == F.col("_pg")) & (F.col("p") == F.col("_at"))).drop("_pg", "_at")
    known = rows.select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("p").alias("_p"))
    same = (F.col("g") == F.col("_g")) & (F.col("k") == F.col("_k"))
    gone = placed.filter(F.col("next").isNotNull()).join(known, same & (F.col("next") == F.col("_p")), "left_anti")
    came = placed.filter(F.col("prev").isNotNull()).join(known, same & (F.col("prev") == F.col("_p")), "left_anti")
    out = gone.select(F.col("g").alias(group), F.col("k").alias(key), F.col("next").alias(poll), F.lit("removed").alias("change"))
    return out.unionByName(came.select(F.col("g").alias(group), F.col("k").alias(key), F.col("p").alias(poll), F.lit("new").alias("change")))


def change_stream(seen: DataFrame, group: str, key: str, poll: str, out_path: str, state_path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Streaming form: a group's newest poll stays open until a later one is seen, however the micro-batches cut it.

    Carried are the rows of each group's last closed poll and of its open poll. Rows of a poll that is closed already come too late
    and are left out. ``changes_so_far`` reads the changes including the open polls.
    """
    rows = seen.select(group, key, poll)
    schema = f"{carry.schema_text(rows)}, closed boolean"

    def each(batch: DataFrame, batch_id: int) -> None:
        carried = carry.read_before(batch.sparkSession, state_path, schema, batch_id)
        floor = carried.filter("closed").groupBy(F.col(group).alias("_g")).agg(F.max(poll).alias("_floor"))
        in_time = batch.join(floor, F.col(group).eqNullSafe(F.col("_g")), "left").filter(F.col("_floor").isNull() | (F.col(poll) > F.col("_floor")))
        both = cut_lineage(carried.drop("closed").unionByName(in_time.select(group, key, poll)).distinct())
        newest = both.groupBy(F.col(group).alias("_g")).agg(F.max(poll).alias("_open"))
        marked = both.join(newest, F.col(group).eqNullSafe(F.col("_g"))).withColumn("closed", F.col(poll) < F.col("_open")).drop("_g", "_open")
        carry.write_part(poll_changes(marked.filter("closed"), group, key, poll), out_path, batch_id)
        last = marked.groupBy(F.col(group).alias("_g"), F.col("closed").alias("_c")).agg(F.max(poll).alias("_p"))
        kept = marked.join(last, F.col(group).eqNullSafe(F.col("_g")) & (F.col("closed") == F.col("_c")) & (F.col(poll) == F.col("_p")))
        carry.write_state(kept.select(group, key, poll, "closed"), state_path, batch_id)

    return carry.run_batches(rows, each, checkpoint, trigger)


def changes_so_far(spark: SparkSession, out_path: str, state_path: str, group: str, key: str, poll: str, schema: str) -> DataFrame:
    """Changes written by ``change_stream``, and those of the open polls as seen by now. ``schema`` types group, key and poll."""
    closed = carry.read_parts(spark, out_path, f"{schema}, change string").drop("batch_id")
    state = carry.read_before(spark, state_path, f"{schema}, closed boolean", 2 ** 62)
    return closed.unionByName(poll_changes(state, group, key, poll))


# ---- boards ------------------------------------------------------------------------


def board_stream(arrivals: DataFrame, subscribed: DataFrame, path: str, state_path: str, checkpoint: str, k: int = 8,
                 now_of=None, past_seconds: float = 60, ahead_seconds: float = 1200, trigger: dict | None = None) -> StreamingQuery:
    """Boards of subscribed stops, each written whole with every micro-batch; ``latest_boards`` reads the newest.

    A subscription to a parent station takes the rows of its platforms. Each trip's first row per board is carried, so boards do not
    depend on how batches are cut. With ``now_of(rows)``, a scalar clock column, only rows due from ``past_seconds`` before to
    ``ahead_seconds`` after it are kept, which bounds what is carried.
    """
    wanted = subscribed.select(F.col("stop_id").alias("board")).distinct()
    schema = f"{carry.schema_text(arrivals)}, board {arrivals.schema['stop_id'].dataType.simpleString()}"

    def each(batch: DataFrame, batch_id: int) -> None:
        carried = carry.read_before(batch.sparkSession, state_path, schema, batch_id)
        ids = F.array_distinct(F.array(F.col("stop_id"), text.parent_stop("stop_id")))
        fresh = batch.withColumn("board", F.explode(ids)).join(wanted, "board", "left_semi")
        both = carried.unionByName(fresh)
        if now_of is not None:
            due, now = F.unix_micros("due") / F.lit(1e6), F.unix_micros(now_of(both)) / F.lit(1e6)
            both = both.filter((due >= now - past_seconds) & (due <= now + ahead_seconds))
        first = cut_lineage(latest_per_key(both.filter(F.col("trip_id").isNotNull()), ["board", "trip_id"], F.struct("arrival_id"), first=True))
        carry.write_part(top_per_key(first, ["board"], [F.col("due").asc(), F.col("arrival_id").asc()], k), path, batch_id)
        carry.write_state(first.select(*arrivals.columns, "board"), state_path, batch_id)

    return carry.run_batches(arrivals, each, checkpoint, trigger)


def latest_boards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The boards of the newest cycle. ``schema`` types the arrivals' columns."""
    return carry.read_before(spark, path, f"{schema}, board string, rank int", 2 ** 62)


# ---- latest state ---------------------------------------------------------------------


def latest_state(changes: DataFrame, keys: Sequence[str], order: Sequence[str], removed: str = "is_removed") -> DataFrame:
    """Last row per key, without keys whose last change removed them."""
    return latest_per_key(changes, list(keys), F.struct(*order)).filter(~F.col(removed)).drop(removed)


def state_stream(changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, trigger: dict | None = None) -> StreamingQuery:
    """Upserts and removals as versioned rows; read them with ``current_rows`` and drop the removed."""
    keys = list(keys)
    return carry.run_batches(changes, lambda b, i: upsert_batch(b, path, i, keys, version), checkpoint, trigger)


def marker_status(state: DataFrame, current: DataFrame, now: Column, shown: Column, at_last_stop: Column, dim_seconds: float = 120,
                  cull_seconds: float = 600, trip: str = "trip_id", seen: str = "last_seen_at") -> DataFrame:
    """Status per known trip: active when in the current cycle; else removed when filtered out, fading at
    its last stop or when old, dim after two minutes, unchanged before."""
    live = current.select(F.col(trip).alias("_live")).distinct()
    age = (F.unix_micros(now) - F.unix_micros(seen)) / F.lit(1e6)
    status = (F.when(F.col("_live").isNotNull(), "active").when(~shown, "removed").when(at_last_stop, "fading")
              .when(age > cull_seconds, "fading").when(age > dim_seconds, "stale-dim").otherwise("active"))
    return state.join(live, F.col(trip) == F.col("_live"), "left").withColumn("status", status).drop("_live")


# ---- rolling store -----------------------------------------------------------------------


def rolling_store(events: DataFrame, path: str, checkpoint: str, now_of, hours: int = 1, limit: int = 200, trigger: dict | None = None) -> StreamingQuery:
    """Newest events of the last hours, at most ``limit``, rewritten with each micro-batch.

    ``now_of(rows)`` gives the clock as a scalar column, e.g. the newest timestamp.
    """
    schema = carry.schema_text(events)

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = carry.read_before(batch.sparkSession, path, schema, batch_id)
        both = kept.unionByName(batch)
        fresh = both.filter(F.col("timestamp") > now_of(both) - hours * 3_600_000)
        carry.write_state(fresh.orderBy(F.desc("timestamp"), "pk").limit(limit), path, batch_id)

    return carry.run_batches(events, each, checkpoint, trigger)
