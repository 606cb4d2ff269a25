"""Track geometry: cumulative lengths, map matching, positions along a track, leg slices, smoothing.

A track is a long table (route_id, seq, lat, lon, cum_m); segments are rows between two vertices.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numbers import clamp
from ..session import cut_lineage, written
from .lookups import _join_folded, fold_platforms
from .joins import join_aggregate
from .ordered import _match, with_previous, with_running_sum


def longest_shape(shapes: DataFrame) -> DataFrame:
    """Vertices of the shape with most vertices per route; lowest shape id on ties."""
    counts = shapes.groupBy("route_id", "shape_id").agg(F.count("*").alias("_n"))
    best = counts.groupBy("route_id").agg(F.min_by("shape_id", F.struct(-F.col("_n"), F.col("shape_id"))).alias("shape_id"))
    return shapes.join(best, ["route_id", "shape_id"])


def with_cumulative(vertices: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq", block: int = 100_000) -> DataFrame:
    """Add metres along the line from its first vertex; long lines are cut into blocks of sequence numbers."""
    keys = list(keys)
    at = F.floor(F.col(seq) / block)
    back = with_previous(vertices, keys, [seq], {"_lat": "lat", "_lon": "lon"}, at)
    step = F.coalesce(geo.haversine_m("_lat", "_lon", "lat", "lon"), F.lit(0.0))
    return with_running_sum(back.withColumn("_step", step).drop("_lat", "_lon"), keys, [seq], {"cum_m": "_step"}, at).drop("_step")


def segments(track: DataFrame, keys: Sequence[str] = ("route_id",), seq: str = "seq", block: int = 100_000) -> DataFrame:
    """One row per consecutive vertex pair, numbered by the first vertex, with its end flag."""
    keys = list(keys)
    ahead = with_previous(track, keys, [seq], {"lat2": "lat", "lon2": "lon", "cum2_m": "cum_m", "_next": seq},
                          F.floor(F.col(seq) / block), following=True)
    last = track.groupBy(*keys).agg(F.max(seq).alias("_last"))
    return (ahead.filter(F.col("_next").isNotNull()).join(last, keys)
            .withColumn("is_last", F.col("_next") == F.col("_last")).drop("_next", "_last"))


# ---- map matching --------------------------------------------------------------


def _box_cells(metres: float) -> Column:
    """Cells that points within the distance of a segment's box lie in."""
    return geo.cells_of_box("lat", "lon", "lat2", "lon2", metres)


def _best_match(points: DataFrame, lines: DataFrame, key: str, metres: float | None) -> DataFrame:
    """Nearest segment per point among the segments of its route, within ``metres`` when given."""
    sides = lines.select(F.col("route_id").alias("_route"), "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2",
                         "cum_m", "cum2_m", *([] if metres is None else [F.inline(_box_cells(metres))]))
    cond = F.col("route_id") == F.col("_route")
    keyed = points.select(key, "route_id", "lat", "lon")
    if metres is not None:
        at = geo.grid_cell("lat", "lon", metres)
        cond = cond & (at["_cy"] == F.col("_cy")) & (at["_cx"] == F.col("_cx"))
    pairs = keyed.join(sides, cond)
    share = geo.segment_share("lat", "lon", "lat1", "lon1", "lat2", "lon2")
    placed = pairs.withColumn("_t", share).withColumns({
        "track_lat": F.col("lat1") + F.col("_t") * (F.col("lat2") - F.col("lat1")),
        "track_lon": F.col("lon1") + F.col("_t") * (F.col("lon2") - F.col("lon1")),
        "arclength_m": F.col("cum_m") + F.col("_t") * (F.col("cum2_m") - F.col("cum_m"))})
    placed = placed.withColumn("offset_m", geo.haversine_m("lat", "lon", "track_lat", "track_lon"))
    if metres is not None:
        placed = placed.filter(F.col("offset_m") <= metres)
    found = F.struct("arclength_m", "offset_m", F.col("seq").alias("segment"), "track_lat", "track_lon")
    return placed.groupBy(key).agg(F.min_by(found, F.struct("offset_m", "seq")).alias("_m")).select(key, "_m.*")


def map_match(points: DataFrame, lines: DataFrame, key: str, metres: float = 500, wider: Sequence[float] = (5000,),
              complete: bool = True) -> DataFrame:
    """Nearest point on the route's track per position: arclength, offset, segment.

    Positions are matched against the segments near their cell. Those farther than ``metres`` from
    the track are tried again with wider cells, and what is left, when ``complete``, against the
    whole track, so every position of a known route gets its exact answer.
    """
    done = cut_lineage(_best_match(points, lines, key, metres))
    left = points
    for radius in [*wider, *([None] if complete else [])]:
        left = cut_lineage(left.join(done.select(F.col(key).alias("_done")), F.col(key) == F.col("_done"), "left_anti"))
        if left.isEmpty():
            break
        done = done.unionByName(cut_lineage(_best_match(left, lines, key, radius)))
    return done


def stops_on_tracks(stops: DataFrame, lines: DataFrame, metres: float = 500) -> DataFrame:
    """Arclength of every stop on every track within the radius."""
    sides = lines.select("route_id", "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2", "cum_m", "cum2_m",
                         F.inline(_box_cells(metres)))
    at = geo.grid_cell("lat", "lon", metres)
    pairs = stops.select("stop_id", "lat", "lon").join(sides, (at["_cy"] == F.col("_cy")) & (at["_cx"] == F.col("_cx")))
    share = geo.segment_share("lat", "lon", "lat1", "lon1", "lat2", "lon2")
    placed = pairs.withColumn("_t", share).withColumns({
        "offset_m": geo.haversine_m("lat", "lon", F.col("lat1") + F.col("_t") * (F.col("lat2") - F.col("lat1")),
                                    F.col("lon1") + F.col("_t") * (F.col("lon2") - F.col("lon1"))),
        "arclength_m": F.col("cum_m") + F.col("_t") * (F.col("cum2_m") - F.col("cum_m"))})
    return placed.filter(F.col("offset_m") < metres).groupBy("stop_id", "route_id").agg(
        F.min_by("arclength_m", F.struct("offset_m", "seq")).alias("arclength_m"), F.min("offset_m").alias("offset_m"))


# ---- along the track -------------------------------------------------------------


def at_arclength(queries: DataFrame, lines: DataFrame, s: str = "s", bucket_m: float = 500.0) -> DataFrame:
    """Coordinates, heading and segment at an arclength, clamped to the track.

    Segments are listed under every length bucket they touch, so each query meets only the
    segments of its bucket.
    """
    total = lines.groupBy("route_id").agg(F.max("cum2_m").alias("_total"))
    clamped = join_aggregate(queries, total.dropna(subset=["route_id"]), ["route_id"], "inner").withColumn("_s", F.greatest(F.lit(0.0), F.least(F.col(s).cast("double"), F.col("_total"))))
    clamped = clamped.withColumn("_bucket", F.floor(F.col("_s") / bucket_m))
    listed = lines.select(F.col("route_id").alias("_route"), F.col("seq").alias("segment"), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"),
                          F.col("lat2").alias("_lat2"), F.col("lon2").alias("_lon2"), F.col("cum_m").alias("_from"), F.col("cum2_m").alias("_to"), "is_last",
                          F.explode(F.sequence(F.floor(F.col("cum_m") / bucket_m), F.floor(F.col("cum2_m") / bucket_m))).alias("_b"))
    inside = (F.col("_from") <= F.col("_s")) & ((F.col("_s") < F.col("_to")) | F.col("is_last"))
    hit = clamped.join(listed, (F.col("route_id") == F.col("_route")) & (F.col("_bucket") == F.col("_b")) & inside)
    share = F.coalesce(F.try_divide(F.col("_s") - F.col("_from"), F.col("_to") - F.col("_from")), F.lit(0.0))
    return hit.select(*queries.columns, "segment", (F.col("_lat1") + share * (F.col("_lat2") - F.col("_lat1"))).alias("lat"),
                      (F.col("_lon1") + share * (F.col("_lon2") - F.col("_lon1"))).alias("lon"),
                      geo.bearing("_lat1", "_lon1", "_lat2", "_lon2").alias("heading"))


def stop_arclength(requests: DataFrame, on_track: DataFrame) -> DataFrame:
    """Arclength of a stop on a route: exact id, else the bare id, else the N, else the S platform."""
    folded = fold_platforms(on_track, ["route_id"], "stop_id", "arclength_m", ["stop_id"])
    joined = _join_folded(requests, folded, ["route_id"], "stop_id", "a")
    d = text.direction("stop_id")
    exact = F.when(d == "N", F.col("a_n")).when(d == "S", F.col("a_s"))
    return joined.select(*requests.columns, F.coalesce(exact, "a_b", "a_n", "a_s")["value"].alias("arclength_m"))


def _stop_blocks(on_track: DataFrame, block_m: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stops cut into blocks of arclength: (numbered stops, first and last block per route, every block between with what lies before and after it).

    A block lists its own arclengths and carries the number and the last arclength of the stops before it, and the first after it.
    All three are as large as the stops and tracks, which are dimension tables.
    """
    stops = on_track.filter(F.col("arclength_m").isNotNull()).select(F.col("route_id").alias("_route"), "stop_id", "arclength_m")
    along = Window.partitionBy("_route").orderBy("arclength_m", "stop_id")
    numbered = stops.withColumn("_ordinal", F.row_number().over(along))
    per = stops.groupBy("_route", F.floor(F.col("arclength_m") / block_m).alias("_block")).agg(F.sort_array(F.collect_list("arclength_m")).alias("_ats"))
    ends = per.groupBy("_route").agg(F.min("_block").alias("_low"), F.max("_block").alias("_high"))
    every = ends.select("_route", F.explode(F.sequence("_low", "_high")).alias("_block")).join(per, ["_route", "_block"], "left")
    by_block = Window.partitionBy("_route").orderBy("_block")
    before, after = by_block.rowsBetween(Window.unboundedPreceding, -1), by_block.rowsBetween(1, Window.unboundedFollowing)
    carried = every.select("_route", "_block", F.coalesce("_ats", F.array().cast("array<double>")).alias("_ats"),
                           F.coalesce(F.sum(F.size("_ats")).over(before), F.lit(0)).alias("_n_before"), F.max(F.array_max("_ats")).over(before).alias("_before"),
                           F.min(F.array_min("_ats")).over(after).alias("_after"))
    return numbered, ends, carried


def _met_block(rows: DataFrame, at: str, ends: DataFrame, carried: DataFrame, block_m: float) -> DataFrame:
    """Each row with the one block of its route that its arclength falls in, or the nearest one."""
    placed = rows.join(ends, F.col("route_id") == F.col("_route")).drop("_route")
    placed = placed.withColumn("_at_block", F.greatest("_low", F.least("_high", F.floor(F.col(at) / block_m)))).drop("_low", "_high")
    return placed.join(carried, (F.col("route_id") == F.col("_route")) & (F.col("_at_block") == F.col("_block"))).drop("_route", "_block", "_at_block")


def stops_between(requests: DataFrame, on_track: DataFrame, key: str, block_m: float = 1000.0) -> DataFrame:
    """Stops strictly between two arclengths of a route, ranked in travel order.

    Each end meets one block of its route, which tells how many stops lie before it; the stops between are then joined by their
    number on the route, so the joins have a row per request and a row per result.
    """
    numbered, ends, carried = _stop_blocks(on_track, block_m)
    columns = requests.columns
    asked = requests.withColumns({"_from": F.least("s_from", "s_to").cast("double"), "_to": F.greatest("s_from", "s_to").cast("double")})
    for end, count in (("_from", lambda a: a <= F.col("_from")), ("_to", lambda a: a < F.col("_to"))):
        asked = _met_block(asked, end, ends, carried, block_m)
        asked = asked.withColumn(f"{end}_n", F.col("_n_before") + F.size(F.filter("_ats", count))).drop("_ats", "_n_before", "_before", "_after")
    listed = asked.filter(F.col("_to_n") > F.col("_from_n")).select(*columns, F.explode(F.sequence(F.col("_from_n") + 1, F.col("_to_n"))).alias("_n"))
    hit = listed.join(numbered, (F.col("route_id") == F.col("_route")) & (F.col("_n") == F.col("_ordinal"))).drop("_route", "_n", "_ordinal")
    forward = F.when(F.col("s_from") <= F.col("s_to"), F.col("arclength_m")).otherwise(-F.col("arclength_m"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(forward, "stop_id")))


def leg_slices(requests: DataFrame, track: DataFrame, lines: DataFrame, key: str, bucket_m: float = 500.0, nearest: float = 1e-6) -> DataFrame:
    """Vertices of a ride leg in travel order: interpolated ends, vertices between, near-duplicates dropped.

    A leg has at most the vertices of its track; rows stay rows, so no leg is held as one value.
    """
    low, high = F.least("s_from", "s_to"), F.greatest("s_from", "s_to")
    bounded = requests.withColumns({"_low": low, "_high": high})
    ends = []
    for tag, c, order in (("start", "_low", -1), ("end", "_high", 1)):
        spot = at_arclength(bounded.withColumn("_spot", F.col(c)), lines, "_spot", bucket_m)
        ends.append(spot.select(*requests.columns, F.col(c).cast("double").alias("_at"), F.lit(order).alias("_o"), "lat", "lon"))
    total = lines.groupBy("route_id").agg(F.max("cum2_m").alias("_total"))
    spans = join_aggregate(bounded, total.dropna(subset=["route_id"]), ["route_id"], "inner").select(
        *requests.columns, F.greatest(F.lit(0.0), F.least("_low", "_total")).alias("_a"), F.greatest(F.lit(0.0), F.least("_high", "_total")).alias("_z"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket_m), F.floor(F.col("_z") / bucket_m))))
    vertices = track.select(F.col("route_id").alias("_route"), F.col("lat"), F.col("lon"), F.col("cum_m").alias("_cum"), F.floor(F.col("cum_m") / bucket_m).alias("_vb"))
    middle = spans.join(vertices, (F.col("route_id") == F.col("_route")) & (F.col("_bucket") == F.col("_vb"))
                        & (F.col("_cum") > F.col("_a")) & (F.col("_cum") < F.col("_z")))
    rows = ends[0].unionByName(middle.select(*requests.columns, F.col("_cum").alias("_at"), F.lit(0).alias("_o"), "lat", "lon")).unionByName(ends[1])
    travel = Window.partitionBy(key).orderBy("_o", "_at")
    moved = F.greatest(F.abs(F.col("lat") - F.lag("lat").over(travel)), F.abs(F.col("lon") - F.lag("lon").over(travel)))
    kept = rows.withColumn("_moved", moved).filter(F.col("_moved").isNull() | (F.col("_moved") > nearest))
    sign = F.when(F.col("s_from") <= F.col("s_to"), 1).otherwise(-1)
    ordered = Window.partitionBy(key).orderBy(F.col("_o") * sign, F.col("_at") * sign)
    return kept.withColumn("position", F.row_number().over(ordered)).select(key, "route_id", "position", "lat", "lon")


def best_shape(requests: DataFrame, vertices: DataFrame, key: str, metres: float = 1000) -> DataFrame:
    """The shape whose vertices come closest to both ends, each nearer than ``metres``."""
    at = geo.grid_cell("lat", "lon", metres)
    cells = vertices.select(F.col("route_id").alias("_route"), "shape_id", "seq", "lat", "lon", at["_cy"].alias("_vy"), at["_cx"].alias("_vx"))
    sides = []
    for tag in ("from", "to"):
        grown = geo.cells_around(f"{tag}_lat", f"{tag}_lon", metres)
        asked = requests.select(key, "route_id", F.col(f"{tag}_lat").alias("_lat"), F.col(f"{tag}_lon").alias("_lon"), F.inline(grown))
        near = asked.join(cells, (F.col("route_id") == F.col("_route")) & (F.col("_cy") == F.col("_vy")) & (F.col("_cx") == F.col("_vx")))
        near = near.withColumn("_d", geo.haversine_m("_lat", "_lon", "lat", "lon")).filter(F.col("_d") < metres)
        sides.append(near.groupBy(key, "shape_id").agg(F.min("_d").alias(f"{tag}_m"), F.min_by("seq", F.struct("_d", "seq")).alias(f"{tag}_seq")))
    both = sides[0].join(sides[1], [key, "shape_id"])
    row = F.struct("shape_id", "from_seq", "to_seq", "from_m", "to_m")
    return both.groupBy(key).agg(F.min_by(row, F.struct(F.col("from_m") + F.col("to_m"), F.col("shape_id"))).alias("_b")).select(key, "_b.*")


def between_stops(positions: DataFrame, on_track: DataFrame, key: str, s: str = "arclength_m", block_m: float = 1000.0) -> DataFrame:
    """Positions with the arclengths of the last stop at or before them and of the next one, where there are both.

    A position meets one block of its route, with the stops in it and the nearest ones before and after it, so the join has one row
    per position however many stops a route has.
    """
    _, ends, carried = _stop_blocks(on_track, block_m)
    met = _met_block(positions.filter(F.col(s).isNotNull()).select(key, "route_id", F.col(s).alias("_s")), "_s", ends, carried, block_m)
    before = F.coalesce(F.array_max(F.filter("_ats", lambda a: a <= F.col("_s"))), "_before")
    after = F.coalesce(F.array_min(F.filter("_ats", lambda a: a > F.col("_s"))), "_after")
    return met.select(key, F.col("_s").alias(s), before.alias("s_prev"), after.alias("s_next")).dropna(subset=["s_prev", "s_next"])


def with_phase(df: DataFrame, s: str, s_prev: str, s_next: str, boarding: float = 20, arriving: float = 200) -> DataFrame:
    """Phase by remaining metres, and progress between the two stops."""
    left = F.abs(F.col(s_next) - F.col(s))
    phase = F.when(left <= boarding, "BOARDING").when(left <= arriving, "ARRIVING").otherwise("APPROACHING")
    span = F.col(s_next) - F.col(s_prev)
    done = F.coalesce(clamp(F.try_divide(F.col(s) - F.col(s_prev), F.when(span != 0, span)), 0.0, 1.0), F.lit(0.0))
    return df.withColumns({"phase": phase, "progress": done})


# ---- smoothing ---------------------------------------------------------------------

STATE = ["s", "v", "a", "t"]
# Neighbouring chunks of a key are smoothed together up to about so many rows.
BLOCK_ROWS = 200_000


def smooth_steps(measured, times, state, alpha, beta, gamma, vmax, amax, jump):
    """Run the filter over ordered measurements from ``state`` (None to start); returns rows and the end state."""
    rows = []
    for z, t in zip(measured, times):
        if state is None:
            state = (z, 0.0, 0.0, t)
            rows.append((z, 0.0, 0.0, True))
            continue
        s, v, a, t0 = state
        dt = max(0.001, (t - t0) / 1000.0)
        ahead = s + v * dt + 0.5 * a * dt * dt
        speed = min(vmax, max(-vmax, v + a * dt))
        push = min(amax, max(-amax, a))
        off = z - ahead
        if not abs(off) <= max(jump, vmax * dt * 1.5):  # NaN is a jump too, or no later row would come free of it
            state = (z, 0.0, 0.0, t)
            rows.append((z, 0.0, 0.0, True))
            continue
        s = ahead + alpha * off
        v = min(vmax, max(-vmax, speed + beta / dt * off))
        a = min(amax, max(-amax, push + 2 * gamma / (dt * dt) * off))
        state = (s, v, a, t)
        rows.append((s, v, a, False))
    return rows, state


def smooth(points: DataFrame, key: str, order: str, measurement: str, time_ms: str, chunk: Column, alpha: float = 0.35,
           beta: float = 0.15, gamma: float = 0.05, vmax: float = 20.0, amax: float = 1.0, jump: float = 5000.0) -> DataFrame:
    """Alpha-beta-gamma smoothing per key: predict, correct, clamp, restart on a jump.

    The filter is sequential, but a hot key must not sit in one task. Keys are cut into chunks that
    follow their order (``chunk`` must not decrease with ``order``), and neighbouring chunks are taken together up to
    BLOCK_ROWS rows and one chunk. In the first two rounds all blocks run side by side, from no state and then from the end state
    of the block before; later a block runs again only when its start state changed and the block before it is not due as well.
    When none is due, every block has run from its true start state, so the result equals one sequential pass. After a jump
    the start is forgotten; without one it hardly ever is to the last bit, and then there is one round per block of
    a key, each running and reading one block. Keys of one block take no round.
    Rows without key or measurement are left out, as in the streaming form.
    """
    clean = points.select(F.col(key).alias("k"), chunk.cast("bigint").alias("c"), F.col(order).alias("o"),
                          F.col(measurement).cast("double").alias("z"), F.col(time_ms).cast("bigint").alias("ms"))
    clean = clean.filter(F.col("k").isNotNull() & F.col("z").isNotNull())
    along = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(along), F.lit(0))
    blocks = clean.groupBy("k", "c").agg(F.count("*").alias("n")).select("k", "c", F.floor(earlier / BLOCK_ROWS).alias("b"))
    # a folder per block number, so a round reads the blocks it runs and no others
    clean = written(_match(clean, blocks, ["k", "c"]).select("k", "o", "z", "ms", F.col("b").alias("c")), "smooth", "c")
    key_type = clean.schema["k"].dataType.simpleString()
    order_type = clean.schema["o"].dataType.simpleString()
    settings = (alpha, beta, gamma, vmax, amax, jump)

    def begin(start: pd.DataFrame):
        one = start[STATE].iloc[0]
        return None if pd.isna(one["t"]) else tuple(float(x) for x in one)

    def run(rows: pd.DataFrame, start: pd.DataFrame):
        rows = rows.sort_values("o", kind="stable")
        made, end = smooth_steps(rows["z"].tolist(), rows["ms"].tolist(), begin(start), *settings)
        return rows, made, end

    def last_state(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        _, _, end = run(rows, start)
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "c": [rows["c"].iloc[0]], **{n: [float(x)] for n, x in zip(STATE, end)}})

    def all_states(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows, made, _ = run(rows, start)
        return pd.DataFrame({"k": rows["k"].to_numpy(), "o": rows["o"].to_numpy(), "s": [m[0] for m in made], "v": [m[1] for m in made],
                             "a": [m[2] for m in made], "restarted": [m[3] for m in made]})

    # One row per block: the state it ran from and the one it ended in. Names differ from those of the points they join.
    order_of = Window.partitionBy("k0").orderBy("c0")
    state = "struct<" + ",".join(f"{n}:double" for n in STATE) + ">"
    states = cut_lineage(clean.select(F.col("k").alias("k0"), F.col("c").alias("c0")).distinct())
    states = states.select("k0", "c0", F.lit(None).cast(state).alias("began"), F.lit(None).cast(state).alias("ended"),
                           F.lead("c0").over(order_of).isNull().alias("is_last"))
    states, turn = written(states, "smooth-states"), 0
    while True:
        handed = states.withColumn("handed", F.lag("ended").over(order_of))
        # the last block of a key hands no state on
        is_due = ~F.col("is_last") & (F.col("ended").isNull() | ~F.col("handed").eqNullSafe(F.col("began")))
        handed = handed.withColumn("is_due", is_due)
        if turn > 1:
            handed = handed.withColumn("is_due", F.col("is_due") & ~F.lag("is_due", 1, False).over(order_of))
        due = handed.filter("is_due").select("k0", "c0", *[F.col(f"handed.{n}").alias(n) for n in STATE])
        numbers = [row["c0"] for row in due.select("c0").distinct().collect()]
        if not numbers:
            break
        again = clean.filter(F.col("c").isin(numbers)).join(due.select("k0", "c0"), (F.col("k") == F.col("k0")) & (F.col("c") == F.col("c0")), "left_semi")
        ran = again.groupBy("k", "c").cogroup(due.groupBy("k0", "c0")).applyInPandas(
            last_state, f"k {key_type}, c bigint, s double, v double, a double, t double")
        ran = ran.select(F.col("k").alias("k0"), F.col("c").alias("c0"), F.struct(*STATE).alias("now"))
        states = handed.join(ran, ["k0", "c0"], "left").select(
            "k0", "c0", F.when(F.col("is_due"), F.col("handed")).otherwise(F.col("began")).alias("began"),
            F.coalesce("now", "ended").alias("ended"), "is_last")
        # a checkpoint would hand on size estimates that are multiplied in every round, until planning takes longer than the work
        states, turn = written(states, "smooth-states"), turn + 1
    starts = handed.select("k0", "c0", *[F.col(f"handed.{n}").alias(n) for n in STATE])
    out = clean.groupBy("k", "c").cogroup(starts.groupBy("k0", "c0")).applyInPandas(
        all_states, f"k {key_type}, o {order_type}, s double, v double, a double, restarted boolean")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "s", "v", "a", "restarted")

