"""embeddings as positions: the first two components give a place, the label a route.

Each route's track is the closed run of mean positions in 16 sectors around the route's centre, so
it has at most 16 vertices however many positions there are.
"""

import math

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import spatial as G
from ..operators import track as K
from ..session import cut_lineage, scratch_path
from ..streaming import carry
from ..streaming import stateful as S
from .base import Tables, query, r
from .places import COORDS, coords, sql_bearing, sql_hav

rd = numbers.js_round
SECTORS = 16


def centres(t: Tables):
    return coords(t).groupBy("label").agg(rd(F.avg("lat"), 6).alias("lat"), rd(F.avg("lon"), 6).alias("lon"))


def vertices(t: Tables):
    c = centres(t).select(F.col("label").alias("_l"), F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    angle = F.atan2(F.col("lat") - F.col("_y"), F.col("lon") - F.col("_x")) + F.lit(math.pi)
    sector = F.floor(angle / F.lit(2 * math.pi / SECTORS)).cast("int")
    placed = coords(t).join(c, F.col("label") == F.col("_l")).withColumn("seq", sector)
    return placed.groupBy(F.col("label").alias("route_id"), "seq").agg(rd(F.avg("lat"), 6).alias("lat"), rd(F.avg("lon"), 6).alias("lon"))


def track(t: Tables):
    return K.with_cumulative(vertices(t))


def lines(t: Tables):
    """Segments, kept once: a derived dimension table that every query of a run would reuse."""
    return cut_lineage(K.segments(track(t)))


CENTRES = f"{COORDS}, centres AS (SELECT label, {r('avg(lat)', 6)} AS lat, {r('avg(lon)', 6)} AS lon FROM coords GROUP BY 1)"


def sql_m(*p):
    a = sql_hav(*p)
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


TRACK = f"""{CENTRES}, vertices AS (SELECT c.label AS route_id, floor((atan2(c.lat - m.lat, c.lon - m.lon) + pi()) / (2 * pi() / {SECTORS}))::INT AS seq, {r('avg(c.lat)', 6)} AS lat, {r('avg(c.lon)', 6)} AS lon
    FROM coords c JOIN centres m ON m.label = c.label GROUP BY ALL),
  stepped AS (SELECT *, coalesce({sql_m('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM vertices WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
  track AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq) AS cum_m FROM stepped),
  led AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(cum_m) OVER w AS cum2_m, lead(seq, 2) OVER w IS NULL AS is_last FROM track WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
  lines AS (SELECT * FROM led WHERE lat2 IS NOT NULL)"""


@query("track_lengths", f"WITH {TRACK} SELECT route_id, seq, lat, lon, {r('cum_m', 3)} AS cum_m FROM track", "L1")
def track_lengths(t):
    return track(t).select("route_id", "seq", "lat", "lon", rd("cum_m", 3).alias("cum_m"))


@query("longest_shapes", f"""WITH {TRACK}, n AS (SELECT route_id % 3 AS route_id, route_id AS shape_id, count(*) AS n FROM vertices GROUP BY ALL),
  b AS (SELECT route_id, arg_min(shape_id, (-n, shape_id)) AS shape_id FROM n GROUP BY 1)
  SELECT b.route_id, b.shape_id, v.seq, v.lat, v.lon FROM b JOIN vertices v ON v.route_id = b.shape_id""", "L1")
def longest_shapes(t):
    shapes = vertices(t).select((F.col("route_id") % 3).alias("route_id"), F.col("route_id").alias("shape_id"), "seq", "lat", "lon")
    return K.longest_shape(shapes)


MATCH = """greatest(0, least(1, coalesce(((p.lon - l.lon) * (lon2 - l.lon) + (p.lat - l.lat) * (lat2 - l.lat)) / nullif((lon2 - l.lon) * (lon2 - l.lon) + (lat2 - l.lat) * (lat2 - l.lat), 0), 0)))"""
MATCHED = f"""pairs AS (SELECT p.vec_id, p.lat, p.lon, l.lat AS y1, l.lon AS x1, lat2, lon2, cum_m, cum2_m, seq, {MATCH} AS sh FROM points p JOIN lines l ON l.route_id = p.route_id),
  offs AS (SELECT *, {sql_m('lat', 'lon', '(y1 + sh * (lat2 - y1))', '(x1 + sh * (lon2 - x1))')} AS off FROM pairs),
  matched AS (SELECT vec_id, arg_min(cum_m + sh * (cum2_m - cum_m), (off, seq)) AS arclength_m, min(off) AS offset_m FROM offs GROUP BY 1)"""
POINTS = "points AS (SELECT vec_id, label AS route_id, lat, lon FROM coords)"


def points(t: Tables):
    return coords(t).withColumnRenamed("label", "route_id")


@query("map_matched_positions", f"WITH {TRACK}, {POINTS}, {MATCHED} SELECT vec_id, {r('arclength_m', 3)} AS arclength_m, {r('offset_m', 3)} AS offset_m FROM matched", "L2")
def map_matched_positions(t):
    out = K.map_match(points(t), lines(t), "vec_id", metres=500, wider=(3000,))
    return out.select("vec_id", rd("arclength_m", 3).alias("arclength_m"), rd("offset_m", 3).alias("offset_m"))


LOOKUP = """totals AS (SELECT route_id, max(cum2_m) AS total FROM lines GROUP BY 1),
  asked AS (SELECT p.vec_id, p.route_id, greatest(0, least((p.vec_id * 37 % 9000)::DOUBLE, total)) AS s FROM points p JOIN totals USING (route_id)),
  hits AS (SELECT a.vec_id, a.route_id, s, l.seq AS segment, l.lat AS y1, l.lon AS x1, lat2, lon2, coalesce((s - cum_m) / nullif(cum2_m - cum_m, 0), 0) AS sh
    FROM asked a JOIN lines l ON l.route_id = a.route_id AND cum_m <= s AND (s < cum2_m OR is_last))"""


def asked(t: Tables):
    return points(t).select("vec_id", "route_id", (F.col("vec_id") * 37 % 9000).alias("s"))


@query("places_along_track", f"WITH {TRACK}, {POINTS}, {LOOKUP} SELECT vec_id, segment, {r('y1 + sh * (lat2 - y1)', 6)} AS lat, {r('x1 + sh * (lon2 - x1)', 6)} AS lon, {r(sql_bearing('y1', 'x1', 'lat2', 'lon2'), 4)} AS heading FROM hits", "L3 L4")
def places_along_track(t):
    out = K.at_arclength(asked(t), lines(t))
    return out.select("vec_id", "segment", rd("lat", 6).alias("lat"), rd("lon", 6).alias("lon"), rd("heading", 4).alias("heading"))


def stops(t: Tables):
    """Every sixth part of a route's positions averaged: up to 6 stops per route, near its centre."""
    return (coords(t).groupBy("label", (F.col("vec_id") % 6).alias("k")).agg(rd(F.avg("lat"), 6).alias("lat"), rd(F.avg("lon"), 6).alias("lon"))
            .select(F.concat_ws("-", "label", "k").alias("stop_id"), "lat", "lon"))


STOPS = f"stops AS (SELECT label || '-' || vec_id % 6 AS stop_id, {r('avg(lat)', 6)} AS lat, {r('avg(lon)', 6)} AS lon FROM coords GROUP BY 1)"
ON_TRACK = f"""sp AS (SELECT p.stop_id, l.route_id, p.lat, p.lon, l.lat AS y1, l.lon AS x1, lat2, lon2, cum_m, cum2_m, seq, {MATCH} AS sh FROM stops p, lines l),
  so AS (SELECT *, {sql_m('lat', 'lon', '(y1 + sh * (lat2 - y1))', '(x1 + sh * (lon2 - x1))')} AS off FROM sp),
  on_track AS (SELECT stop_id, route_id, arg_min(cum_m + sh * (cum2_m - cum_m), (off, seq)) AS arclength_m, min(off) AS offset_m FROM so WHERE off < 900 GROUP BY ALL)"""


@query("stops_on_tracks", f"WITH {TRACK}, {STOPS}, {ON_TRACK} SELECT stop_id, route_id, {r('arclength_m', 3)} AS arclength_m, {r('offset_m', 3)} AS offset_m FROM on_track", "C12")
def stops_on_tracks(t):
    out = K.stops_on_tracks(stops(t), lines(t), 900)
    return out.withColumns({"arclength_m": rd("arclength_m", 3), "offset_m": rd("offset_m", 3)})


@query("stops_between", f"""WITH {TRACK}, {POINTS}, {STOPS}, {ON_TRACK}, a AS (SELECT vec_id, route_id, (vec_id * 37 % 9000)::DOUBLE AS f, (vec_id * 91 % 9000)::DOUBLE AS e FROM points)
  SELECT vec_id, stop_id, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN f <= e THEN arclength_m ELSE -arclength_m END, stop_id)::INT AS rank
  FROM a JOIN on_track o USING (route_id) WHERE arclength_m > least(f, e) AND arclength_m < greatest(f, e)""", "L5")
def stops_between(t):
    return K.stops_between(legs(t), K.stops_on_tracks(stops(t), lines(t), 900), "vec_id").select("vec_id", "stop_id", "rank")


def legs(t: Tables):
    k = F.col("vec_id")
    return points(t).select(k, "route_id", (k * 37 % 9000).cast("double").alias("s_from"), (k * 91 % 9000).cast("double").alias("s_to"))


@query("stop_arclengths", f"""WITH {TRACK}, {STOPS}, {ON_TRACK} SELECT route_id, stop_id, {r('arclength_m', 3)} AS arclength_m FROM on_track""", "L5")
def stop_arclengths(t):
    known = K.stops_on_tracks(stops(t), lines(t), 900)
    out = K.stop_arclength(known.select("route_id", "stop_id"), known)
    return out.withColumn("arclength_m", rd("arclength_m", 3))


@query("leg_slices", f"""WITH {TRACK}, {POINTS}, totals AS (SELECT route_id, max(cum2_m) AS total FROM lines GROUP BY 1),
  a AS (SELECT vec_id, p.route_id, f, e, greatest(0, least(least(f, e), total)) AS lo, greatest(0, least(greatest(f, e), total)) AS hi FROM (SELECT vec_id, route_id, (vec_id * 37 % 9000)::DOUBLE AS f, (vec_id * 91 % 9000)::DOUBLE AS e FROM points) p JOIN totals USING (route_id)),
  q AS (SELECT *, lo AS s, -1 AS o FROM a UNION ALL SELECT *, hi, 1 FROM a),
  ends AS (SELECT q.vec_id, q.route_id, f, e, o, s AS pos_m, l.lat + coalesce((s - cum_m) / nullif(cum2_m - cum_m, 0), 0) * (lat2 - l.lat) AS lat, l.lon + coalesce((s - cum_m) / nullif(cum2_m - cum_m, 0), 0) * (lon2 - l.lon) AS lon
    FROM q JOIN lines l ON l.route_id = q.route_id AND cum_m <= s AND (s < cum2_m OR is_last)),
  al AS (SELECT * FROM ends UNION ALL SELECT a.vec_id, a.route_id, f, e, 0, cum_m, t.lat, t.lon FROM a JOIN track t ON t.route_id = a.route_id AND cum_m > lo AND cum_m < hi),
  mv AS (SELECT *, greatest(abs(lat - lag(lat) OVER w), abs(lon - lag(lon) OVER w)) AS m FROM al WINDOW w AS (PARTITION BY vec_id ORDER BY o, pos_m))
  SELECT vec_id, route_id, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN f <= e THEN o ELSE -o END, CASE WHEN f <= e THEN pos_m ELSE -pos_m END)::INT AS position, {r('lat', 6)} AS lat, {r('lon', 6)} AS lon FROM mv WHERE m IS NULL OR m > 1e-6""", "L6")
def leg_slices(t):
    tr = track(t)
    return K.leg_slices(legs(t), tr, K.segments(tr), "vec_id").withColumns({"lat": rd("lat", 6), "lon": rd("lon", 6)})


@query("best_shapes", f"""WITH {TRACK}, sh AS (SELECT route_id % 3 AS route_id, route_id AS shape_id, seq, lat, lon FROM vertices),
  q AS (SELECT vec_id, label % 3 AS route_id, lat AS y1, lon AS x1, lat + 0.004 AS y2, lon - 0.003 AS x2 FROM coords),
  d AS (SELECT vec_id, shape_id, min({sql_m('y1', 'x1', 'lat', 'lon')}) AS a, min({sql_m('y2', 'x2', 'lat', 'lon')}) AS b FROM q JOIN sh USING (route_id) GROUP BY ALL)
  SELECT vec_id, arg_min(shape_id, (a + b, shape_id)) AS shape_id, {r('min(a + b)', 3)} AS total_m FROM d WHERE a < 1000 AND b < 1000 GROUP BY 1""", "L7")
def best_shapes(t):
    shapes = vertices(t).select((F.col("route_id") % 3).alias("route_id"), F.col("route_id").alias("shape_id"), "seq", "lat", "lon")
    asked = coords(t).select("vec_id", (F.col("label") % 3).alias("route_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"),
                             (F.col("lat") + 0.004).alias("to_lat"), (F.col("lon") - 0.003).alias("to_lon"))
    out = K.best_shape(asked, shapes, "vec_id")
    return out.select("vec_id", "shape_id", rd(F.col("from_m") + F.col("to_m"), 3).alias("total_m"))


@query("train_phases", f"""WITH {TRACK}, {POINTS}, {MATCHED}, {STOPS}, {ON_TRACK},
  x AS (SELECT p.vec_id, any_value(m.arclength_m) AS s, max(CASE WHEN o.arclength_m <= m.arclength_m THEN o.arclength_m END) AS a, min(CASE WHEN o.arclength_m > m.arclength_m THEN o.arclength_m END) AS b
    FROM points p JOIN matched m USING (vec_id) JOIN on_track o ON o.route_id = p.route_id GROUP BY p.vec_id)
  SELECT vec_id, CASE WHEN abs(b - s) <= 20 THEN 'BOARDING' WHEN abs(b - s) <= 200 THEN 'ARRIVING' ELSE 'APPROACHING' END AS phase,
   floor(coalesce(greatest(0, least(1, (s - a) / nullif(b - a, 0))), 0) * 1e6 + 0.5) / 1e6 AS progress FROM x WHERE a IS NOT NULL AND b IS NOT NULL""", "L8")
def train_phases(t):
    """Matched positions between the two stops of their route around them."""
    ways = lines(t)
    matched = K.map_match(points(t), ways, "vec_id", metres=500, wider=(3000,)).join(points(t).select("vec_id", "route_id"), "vec_id")
    placed = K.between_stops(matched, K.stops_on_tracks(stops(t), ways, 900), "vec_id")
    return K.with_phase(placed, "arclength_m", "s_prev", "s_next").select("vec_id", "phase", rd("progress", 6).alias("progress"))


SMOOTHED = f"""WITH RECURSIVE x AS (SELECT vec_id, label, vec_id * 10 + embedding[3]::DOUBLE * 100 AS z, vec_id * 10000 AS t, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
  f AS (SELECT label, vec_id, rn, z AS s, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, t FROM x WHERE rn = 1
    UNION ALL SELECT x.label, x.vec_id, x.rn, CASE WHEN jump THEN x.z ELSE p + 0.35 * off END, CASE WHEN jump THEN 0 ELSE least(20, greatest(-20, pv + 0.15 / dt * off)) END,
      CASE WHEN jump THEN 0 ELSE least(1, greatest(-1, pa + 0.1 / (dt * dt) * off)) END, x.t
    FROM f JOIN x ON x.label = f.label AND x.rn = f.rn + 1, LATERAL (SELECT (x.t - f.t) / 1000.0 AS dt), LATERAL (SELECT f.s + f.v * dt + 0.5 * f.a * dt * dt AS p, least(20, greatest(-20, f.v + f.a * dt)) AS pv, least(1, greatest(-1, f.a)) AS pa),
      LATERAL (SELECT x.z - p AS off), LATERAL (SELECT abs(off) > greatest(5000, 20 * dt * 1.5) AS jump))
  SELECT vec_id, label, {r('s', 3)} AS s, {r('v', 4)} AS v, {r('a', 5)} AS a FROM f"""


def measured(embeddings):
    return embeddings.select("vec_id", "label", (F.col("vec_id") * 10 + F.get("embedding", F.lit(2)).cast("double") * 100).alias("z"), (F.col("vec_id") * 10000).alias("t"))


def rounded(out):
    return out.select("vec_id", "label", rd("s", 3).alias("s"), rd("v", 4).alias("v"), rd("a", 5).alias("a"))


@query("smoothed_positions", SMOOTHED, "L9")
def smoothed_positions(t):
    return rounded(K.smooth(measured(t.embeddings), "label", "vec_id", "z", "t", F.floor(F.col("vec_id") / 250)))


@query("streamed_smoothed_positions", SMOOTHED, "L9")
def streamed_smoothed_positions(t):
    path, check = scratch_path(t.spark, "smoothed"), scratch_path(t.spark, "check")
    stream = S.smooth_stream(measured(t.stream("embeddings")), path, check, "label", "vec_id", "z", "t", trigger={"availableNow": True})
    stream.awaitTermination()
    return rounded(carry.read_parts(t.spark, path, "label int, vec_id bigint, s double, v double, a double, restarted boolean"))


# ---- range joins and clusters ----


@query("nearest_stations", f"""WITH {CENTRES}, d AS (SELECT vec_id, m.label AS station, {sql_m('c.lat', 'c.lon', 'm.lat', 'm.lon')} AS m FROM coords c, centres m),
  k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m, station) AS rank FROM d WHERE m <= 1500)
  SELECT vec_id, station, {r('m', 3)} AS distance_m, rank::INT AS rank FROM k WHERE rank <= 3""", "C10")
def nearest_stations(t):
    stations = centres(t).withColumnRenamed("label", "station")
    out = G.nearest_stations(coords(t), stations, "vec_id", "station", 3, 1500)
    return out.withColumn("distance_m", rd("distance_m", 3))


@query("near_any_station", f"WITH {CENTRES} SELECT vec_id FROM coords c WHERE EXISTS (SELECT 1 FROM centres m WHERE {sql_m('c.lat', 'c.lon', 'm.lat', 'm.lon')} <= 800)", "C11")
def near_any_station(t):
    return G.near_any_station(coords(t), centres(t), 800).select("vec_id")


CLUSTERS = f"""RECURSIVE {COORDS}, o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM coords),
  g AS (SELECT 0::BIGINT AS i, []::STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[] AS seeds
    UNION ALL SELECT i + 1, CASE WHEN len(list_filter(seeds, lambda s: abs(s.lat - p.lat) < 0.005 AND abs(s.lon - p.lon) < 0.005)) = 0 THEN list_append(seeds, {{'id': p.vec_id, 'lat': p.lat, 'lon': p.lon}}) ELSE seeds END
    FROM g JOIN o p ON p.rn = g.i + 1),
  fin AS (SELECT unnest(seeds) AS s FROM g WHERE i = (SELECT max(i) FROM g)),
  members AS (SELECT vec_id, lat, lon, min(s.id) AS seed FROM coords JOIN fin ON abs(s.lat - lat) < 0.005 AND abs(s.lon - lon) < 0.005 AND s.id <= vec_id GROUP BY ALL)"""


def clustered(t: Tables):
    return G.proximity_clusters(coords(t), "vec_id", 0.005)


@query("proximity_clusters", f"WITH {CLUSTERS} SELECT vec_id, seed FROM members", "L10")
def proximity_clusters(t):
    return clustered(t).select("vec_id", "seed")


@query("cluster_centres", f"WITH {CLUSTERS} SELECT seed, count(*) AS n_members, {r('avg(lat)', 6)} AS centre_lat, {r('avg(lon)', 6)} AS centre_lon FROM members GROUP BY 1", "L10")
def cluster_centres(t):
    return G.cluster_centres(clustered(t), "vec_id").withColumns({"centre_lat": rd("centre_lat", 6), "centre_lon": rd("centre_lon", 6)})


