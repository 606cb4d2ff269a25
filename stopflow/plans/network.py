"""A graph from the order flow: stations are nations, routes are order priorities.

A ride edge goes from a customer's nation to a supplier's nation on the order's priority; its
seconds are the smallest line price of that flow. Regions are the transfer complexes.
"""

from pyspark.sql import functions as F

from ..operators import graph as N
from ..session import cut_lineage
from .base import Tables, query, rl

PENALTY = 300
OPTIONS = {"penalty": PENALTY, "out_of_system": 60, "max_transfers": 2}


def station(c):
    return F.lpad(F.col(c).cast("string"), 2, "0")


def segments(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("route_id"))
    flow = (t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer.select("c_custkey", station("c_nationkey").alias("from_station")), F.col("c_custkey") == F.col("o_custkey"))
            .join(t.supplier.select("s_suppkey", station("s_nationkey").alias("to_station")), F.col("s_suppkey") == F.col("l_suppkey")))
    return flow.select("route_id", "from_station", "to_station", F.floor("l_extendedprice").alias("seconds"))


def stations(t: Tables):
    return t.nation.select(station("n_nationkey").alias("station_id"), F.col("n_name").alias("station_name"), (F.col("n_nationkey") * 0.5 + 30).alias("lat"),
                           (F.col("n_regionkey") * 2.0 - 80).alias("lon"))


def complexes(t: Tables):
    k = F.col("r_regionkey")
    members = t.nation.groupBy("n_regionkey").agg(F.collect_list(station("n_nationkey")).alias("station_ids"))
    listed = F.when(k == 0, F.slice("station_ids", 1, 1)).otherwise(F.concat("station_ids", F.array(F.lit("99"))))
    return t.region.join(members, k == F.col("n_regionkey")).select(
        F.concat(F.lit("region_"), k.cast("string")).alias("complex_id"), (F.lit(120) + k * 10).cast("bigint").alias("walk_seconds"),
        F.when(k % 2 == 0, "out-of-system").otherwise("in-system").alias("transfer_type"), listed.alias("station_ids"))


def parts(t: Tables):
    rides = cut_lineage(N.ride_edges(segments(t)))
    nodes = N.graph_nodes(rides)
    return N.materialize_graph(rides, N.transfer_members(N.complex_members(complexes(t), stations(t)), nodes), nodes)


def pairs(rides):
    """Every origin and destination that orders connect."""
    return rides.select(F.col("from_station").alias("origin"), F.col("to_station").alias("destination")).distinct()


RIDES = """flow AS (SELECT left(o_orderpriority, 1) AS route_id, lpad(c_nationkey::VARCHAR, 2, '0') AS from_station, lpad(s_nationkey::VARCHAR, 2, '0') AS to_station, min(floor(l_extendedprice))::BIGINT AS seconds
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
  rides AS MATERIALIZED (SELECT * FROM flow WHERE from_station <> to_station),
  nodes AS MATERIALIZED (SELECT from_station AS station_id, route_id FROM rides UNION SELECT to_station, route_id FROM rides),
  mem AS (SELECT 'region_' || n_regionkey AS complex_id, (120 + n_regionkey * 10)::BIGINT AS walk_seconds, CASE WHEN n_regionkey % 2 = 0 THEN 'out-of-system' ELSE 'in-system' END AS transfer_type, lpad(n_nationkey::VARCHAR, 2, '0') AS station_id
    FROM nation WHERE n_regionkey > 0),
  transfers AS MATERIALIZED (SELECT a.station_id AS from_station, x.route_id AS from_route, b.station_id AS to_station, y.route_id AS to_route, a.walk_seconds AS seconds, a.transfer_type
      FROM mem a JOIN mem b ON a.complex_id = b.complex_id AND a.station_id <> b.station_id JOIN nodes x ON x.station_id = a.station_id JOIN nodes y ON y.station_id = b.station_id AND x.route_id <> y.route_id
    UNION ALL SELECT x.station_id, x.route_id, y.station_id, y.route_id, 30, 'in-system' FROM nodes x JOIN nodes y ON x.station_id = y.station_id AND x.route_id <> y.route_id),
  edges AS MATERIALIZED (SELECT 'ride' AS kind, from_station, route_id AS from_route, to_station, route_id AS to_route, seconds, NULL AS transfer_type FROM rides
    UNION ALL SELECT 'transfer', from_station, from_route, to_station, to_route, seconds, transfer_type FROM transfers)"""


def sql_search(rounds, cost, max_transfers, name="l", sources="SELECT DISTINCT from_station AS origin, '' AS avoid FROM rides"):
    """Unrolled relaxation on explicit edges."""
    out = [f"""{name}0 AS MATERIALIZED (SELECT origin, avoid, station_id, route_id, 0 AS transfers, 0::BIGINT AS cost, 0::BIGINT AS seconds, [station_id || ':' || route_id] AS path
      FROM ({sources}) JOIN nodes ON station_id = origin WHERE route_id <> avoid)"""]
    for i in range(rounds):
        out.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT origin, avoid, station_id, route_id, transfers, min(cost) AS cost, arg_min(seconds, (cost, seconds, path)) AS seconds, arg_min(path, (cost, seconds, path)) AS path FROM (
        SELECT * FROM {name}{i} UNION ALL SELECT origin, avoid, e.to_station, e.to_route, transfers + (kind = 'transfer')::INT, cost + {cost}, l.seconds + e.seconds, list_append(path, e.to_station || ':' || e.to_route)
        FROM {name}{i} l JOIN edges e ON e.from_station = l.station_id AND e.from_route = l.route_id WHERE transfers + (kind = 'transfer')::INT <= {max_transfers} AND e.to_route <> avoid AND e.to_station <> origin) GROUP BY ALL)""")
    return ",\n".join(out), f"{name}{rounds}"


COST = f"e.seconds + CASE WHEN kind = 'transfer' THEN {PENALTY} + CASE WHEN transfer_type = 'out-of-system' THEN 60 ELSE 0 END ELSE 0 END"
SEARCH, LAST = sql_search(14, COST, 2)
PLANS = f"""{RIDES}, {SEARCH}, best AS MATERIALIZED (SELECT origin, station_id AS destination, min(cost) AS cost, arg_min(transfers, (cost, transfers, seconds, path)) AS transfers,
    arg_min(seconds, (cost, transfers, seconds, path)) AS seconds, arg_min(path, (cost, transfers, seconds, path)) AS path FROM {LAST} WHERE station_id <> origin GROUP BY ALL),
  plans AS MATERIALIZED (SELECT b.* FROM best b JOIN (SELECT DISTINCT from_station AS origin, to_station AS destination FROM rides) USING (origin, destination))"""


def path_text(c="path"):
    return F.array_join(F.transform(c, lambda n: F.concat(n["station_id"], F.lit(":"), n["route_id"])), ">")


@query("graph_ride_edges", f"WITH {RIDES} SELECT * FROM rides", "K1")
def graph_ride_edges(t):
    return N.ride_edges(segments(t))


@query("graph_reversed_edges", f"""WITH {RIDES} SELECT * FROM rides UNION ALL SELECT route_id, to_station, from_station, seconds FROM rides a WHERE NOT EXISTS (SELECT 1 FROM rides b WHERE b.route_id = a.route_id AND b.from_station = a.to_station AND b.to_station = a.from_station)""", "K1")
def graph_reversed_edges(t):
    return N.ride_edges(segments(t), bidirectional=True)


@query("transfer_members", f"WITH {RIDES} SELECT * FROM mem", "C13")
def transfer_members(t):
    return N.complex_members(complexes(t), stations(t))


@query("route_level_transfers", f"""WITH {RIDES} SELECT from_station, from_route, count(*) AS n_transfers, min(seconds) AS nearest_seconds, max(seconds) AS farthest_seconds FROM transfers GROUP BY ALL""", "C14")
def route_level_transfers(t):
    rides, members, nodes = parts(t)
    steps = N._transfer_steps(nodes, members, nodes)
    return steps.groupBy(F.col("station_id").alias("from_station"), F.col("route_id").alias("from_route")).agg(
        F.count("*").alias("n_transfers"), F.min("step_seconds").alias("nearest_seconds"), F.max("step_seconds").alias("farthest_seconds"))


@query("graph_counts", f"""WITH {RIDES} SELECT 'ride_edges' AS kind, count(*) AS n FROM rides UNION ALL SELECT 'station_routes', count(*) FROM nodes UNION ALL SELECT 'stations', count(DISTINCT station_id) FROM nodes
  UNION ALL SELECT 'transfer_edges', count(*) FROM transfers""", "K10")
def graph_counts(t):
    rides, members, nodes = parts(t)
    return N.graph_counts(rides, nodes, members)


@query("station_nodes", f"WITH {RIDES} SELECT * FROM nodes WHERE station_id = '07'", "K9")
def station_nodes(t):
    return N.station_nodes(N.graph_nodes(N.ride_edges(segments(t))), "07")


@query("node_edges", f"WITH {RIDES} SELECT kind, to_station AS station_id, to_route AS route_id, seconds FROM edges WHERE from_station = '07' AND from_route = '2'", "K9")
def node_edges(t):
    rides, members, nodes = parts(t)
    return N.node_edges(rides, members, nodes, "07", "2")


@query("known_stations", f"""WITH {RIDES}, q AS (SELECT DISTINCT lpad((l_suppkey % 40)::VARCHAR, 2, '0') AS station_id FROM lineitem)
  SELECT station_id, station_id IN (SELECT station_id FROM nodes) AS exists, n_name AS station_name FROM q LEFT JOIN nation ON lpad(n_nationkey::VARCHAR, 2, '0') = station_id""", "K9")
def known_stations(t):
    asked = t.lineitem.select(F.lpad((F.col("l_suppkey") % 40).cast("string"), 2, "0").alias("station_id")).distinct()
    return N.known_stations(asked, N.graph_nodes(N.ride_edges(segments(t))), stations(t))


@query("least_cost_paths", f"WITH {PLANS} SELECT origin, destination, cost, seconds, transfers, array_to_string(path, '>') AS path FROM plans", "K2")
def least_cost_paths(t):
    graph = parts(t)
    out = N.least_cost_paths(pairs(graph[0]), *graph, **OPTIONS)
    return out.select("origin", "destination", "cost", "seconds", "transfers", path_text().alias("path"))


AGAIN, AGAIN_LAST = sql_search(14, COST, 2, "m", "SELECT DISTINCT origin, avoid FROM used")


@query("route_alternatives", f"""WITH {PLANS}, used AS MATERIALIZED (SELECT DISTINCT origin, destination, split_part(unnest(path), ':', 2) AS avoid FROM plans), {AGAIN},
  others AS (SELECT u.origin, u.destination, min(cost) AS cost, arg_min(transfers, (cost, transfers, seconds, path)) AS transfers, arg_min(seconds, (cost, transfers, seconds, path)) AS seconds, arg_min(path, (cost, transfers, seconds, path)) AS path
    FROM used u JOIN {AGAIN_LAST} m ON m.origin = u.origin AND m.avoid = u.avoid AND m.station_id = u.destination GROUP BY u.origin, u.destination, u.avoid),
  a AS (SELECT DISTINCT origin, destination, cost, seconds, transfers, array_to_string(path, '>') AS path FROM (SELECT * FROM plans UNION ALL SELECT * FROM others))
  SELECT origin, destination, path, seconds, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY seconds, cost, path)::INT AS rank FROM a) WHERE rank <= 3""", "K3")
def route_alternatives(t):
    graph = parts(t)
    out = N.route_alternatives(pairs(graph[0]), *graph, k=3, **OPTIONS)
    return out.select("origin", "destination", path_text().alias("path"), "seconds", "cost", "rank")


HOPS, HOPS_LAST = sql_search(8, "1", 2)


@query("fewest_hop_paths", f"""WITH {RIDES}, {HOPS} SELECT origin, station_id AS destination, min(cost) AS hops, arg_min(seconds, (cost, seconds, transfers, path)) AS seconds, arg_min(transfers, (cost, seconds, transfers, path)) AS transfers
  FROM {HOPS_LAST} WHERE (origin, station_id) IN (SELECT (from_station, to_station) FROM rides) GROUP BY ALL""", "K4")
def fewest_hop_paths(t):
    graph = parts(t)
    return N.fewest_hops(pairs(graph[0]), *graph, max_transfers=2).select("origin", "destination", "hops", "seconds", "transfers")


def sql_fastest(k, per_label, group):
    """Exact enumeration of the simple paths that can be among the best: an upper bound per pair from the best ``per_label`` paths per
    state (real paths, so the k-th of them bounds the k-th fastest), then all simple paths whose least remaining seconds stay within it."""
    step = "l.seconds + e.seconds AS seconds, l.transfers + (kind = 'transfer')::INT AS transfers, list_append(l.path, e.to_station || ':' || e.to_route) AS path"
    simple = "NOT list_contains(l.path, e.to_station || ':' || e.to_route) AND l.transfers + (kind = 'transfer')::INT <= 2"
    out = ["k0 AS MATERIALIZED (SELECT station_id AS origin, station_id, route_id, 0::BIGINT AS seconds, 0 AS transfers, [station_id || ':' || route_id] AS path FROM nodes)",
           "b0 AS MATERIALIZED (SELECT station_id AS destination, station_id, route_id, 0 AS used, 0::BIGINT AS rest FROM nodes)"]
    for i in range(6):
        out.append(f"""k{i + 1} AS MATERIALIZED (SELECT * FROM (SELECT * FROM k{i} UNION SELECT l.origin, e.to_station, e.to_route, {step} FROM k{i} l JOIN edges e ON e.from_station = l.station_id AND e.from_route = l.route_id WHERE {simple})
          QUALIFY row_number() OVER (PARTITION BY origin, station_id, route_id, transfers ORDER BY seconds, path) <= {per_label})""")
    for i in range(14):
        out.append(f"""b{i + 1} AS MATERIALIZED (SELECT destination, station_id, route_id, used, min(rest) AS rest FROM (SELECT * FROM b{i} UNION ALL
          SELECT destination, e.from_station, e.from_route, used + (kind = 'transfer')::INT, rest + e.seconds FROM b{i} b JOIN edges e ON e.to_station = b.station_id AND e.to_route = b.route_id WHERE used + (kind = 'transfer')::INT <= 2) GROUP BY ALL)""")
    return f"""{RIDES}, {", ".join(out)},
  rest AS MATERIALIZED (SELECT destination, station_id, route_id, l AS spent, min(b14.rest) AS rest FROM b14, range(3) t(l) WHERE used <= 2 - l GROUP BY ALL),
  wanted AS (SELECT DISTINCT from_station AS origin, to_station AS destination FROM rides),
  grouped AS (SELECT origin, station_id AS destination, {group} AS g, min(seconds) AS seconds FROM k6 l WHERE len(path) > 1 GROUP BY ALL),
  lim AS MATERIALIZED (SELECT * FROM (SELECT w.origin, w.destination, max(seconds) AS most, count(*) AS n FROM wanted w JOIN (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY origin, destination ORDER BY seconds) <= {k}) USING (origin, destination) GROUP BY ALL)),
  open AS (SELECT origin, destination, CASE WHEN n < {k} THEN 1000000000 ELSE most END AS most FROM lim),
  walk AS (SELECT o.origin, o.destination, most, s.station_id, s.route_id, s.seconds, s.transfers, s.path FROM open o JOIN k0 s ON s.origin = o.origin
    UNION ALL SELECT l.origin, l.destination, l.most, e.to_station, e.to_route, {step} FROM walk l JOIN edges e ON e.from_station = l.station_id AND e.from_route = l.route_id
      JOIN rest r ON r.destination = l.destination AND r.station_id = e.to_station AND r.route_id = e.to_route AND r.spent = l.transfers + (kind = 'transfer')::INT
      WHERE {simple} AND len(l.path) <= 50 AND l.seconds + e.seconds + r.rest <= l.most),
  paths AS MATERIALIZED (SELECT origin, destination, seconds, transfers, path, {group} AS g FROM walk l WHERE station_id = destination AND len(path) > 1)"""


ROUTES = "array_to_string(list_filter(list_transform(l.path, lambda x: split_part(x, ':', 2)), lambda x, i: NOT list_contains(list_transform(l.path, lambda y: split_part(y, ':', 2))[1:i - 1], x)), '>')"


@query("enumerated_paths", f"WITH RECURSIVE {sql_fastest(5, 5, 'l.path')} SELECT origin, destination, seconds, transfers, array_to_string(path, '>') AS path, rank FROM (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY seconds, path)::INT AS rank FROM paths) WHERE rank <= 5", "K5")
def enumerated_paths(t):
    graph = parts(t)
    out = N.fastest_paths(pairs(graph[0]), *graph, k=5, max_transfers=2)
    return out.select("origin", "destination", "seconds", "transfers", path_text().alias("path"), "rank")


@query("distinct_route_trips", f"""WITH RECURSIVE {sql_fastest(3, 5, ROUTES)}, s AS (SELECT origin, destination, g AS routes, min(seconds) AS seconds, arg_min(array_to_string(path, '>'), (seconds, path)) AS path FROM paths GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY seconds, routes)::INT AS rank FROM s) WHERE rank <= 3""", "K6")
def distinct_route_trips(t):
    graph = parts(t)
    out = N.fastest_paths(pairs(graph[0]), *graph, k=3, max_transfers=2, distinct_routes=True)
    return out.select("origin", "destination", "routes", "seconds", path_text().alias("path"), "rank")


LEGS = f"""{PLANS}, st AS (SELECT origin, destination, unnest(path) AS node, generate_subscripts(path, 1) AS pos, len(path) AS n FROM plans),
  sp AS (SELECT origin, destination, pos, n, split_part(node, ':', 1) AS s, split_part(node, ':', 2) AS rt, lag(split_part(node, ':', 1)) OVER w AS ps, lag(split_part(node, ':', 2)) OVER w AS pr FROM st WINDOW w AS (PARTITION BY origin, destination ORDER BY pos)),
  ed AS (SELECT sp.*, CASE WHEN rt = pr THEN 'ride' ELSE 'transfer' END AS kind, CASE WHEN rt = pr THEN ri.seconds ELSE tr.seconds END AS sec, tr.transfer_type FROM sp LEFT JOIN rides ri ON rt = pr AND ri.route_id = rt AND ri.from_station = ps AND ri.to_station = s
    LEFT JOIN transfers tr ON rt <> pr AND tr.from_station = ps AND tr.from_route = pr AND tr.to_station = s AND tr.to_route = rt WHERE pos > 1),
  fl AS (SELECT *, CASE WHEN kind = 'ride' AND lag(kind) OVER w = 'ride' THEN 0 ELSE 1 END AS b FROM ed WINDOW w AS (PARTITION BY origin, destination ORDER BY pos)),
  gr AS (SELECT *, sum(b) OVER (PARTITION BY origin, destination ORDER BY pos) AS run FROM fl),
  ri AS (SELECT origin, destination, run, any_value(rt) AS route_id, min(pos) AS pos, arg_min(ps, pos) AS f, arg_max(s, pos) AS e, sum(sec)::BIGINT AS sec, count(*) AS stops FROM gr WHERE kind = 'ride' GROUP BY ALL),
  al AS (SELECT origin, destination, pos, 0 AS place, 'board' AS leg_type, route_id, f AS from_station, f AS to_station, 0::BIGINT AS seconds, NULL::BIGINT AS stop_count, NULL::VARCHAR AS transfer_type FROM ri
    UNION ALL SELECT origin, destination, pos, 1, 'ride', route_id, f, e, sec, stops, NULL FROM ri
    UNION ALL SELECT origin, destination, pos, 2, 'transfer', NULL, ps, s, sec, NULL, transfer_type FROM gr WHERE kind = 'transfer' AND NOT (s = destination AND pos = n) AND ps <> destination
    UNION ALL SELECT origin, destination, len(path) + 1, 3, 'exit', NULL, destination, destination, 0, NULL, NULL FROM plans),
  legs AS (SELECT al.*, row_number() OVER (PARTITION BY origin, destination ORDER BY pos, place)::INT AS leg, a.n_name AS from_name, b.n_name AS to_name FROM al
    LEFT JOIN nation a ON lpad(a.n_nationkey::VARCHAR, 2, '0') = from_station LEFT JOIN nation b ON lpad(b.n_nationkey::VARCHAR, 2, '0') = to_station)"""


def planned(t: Tables):
    graph = parts(t)
    return cut_lineage(N.least_cost_paths(pairs(graph[0]), *graph, **OPTIONS))


@query("trip_legs", f"WITH {LEGS} SELECT * EXCLUDE (pos, place) FROM legs", "K7")
def trip_legs(t):
    return N.trip_legs(planned(t), stations(t))


@query("trip_directions", f"""WITH {LEGS} SELECT origin, destination, leg, CASE leg_type WHEN 'board' THEN 'Board the ' || route_id || ' train at ' || from_name
  WHEN 'ride' THEN 'Ride ' || CASE WHEN stop_count = 1 THEN '1 stop' ELSE stop_count || ' stops' END || ' to ' || to_name || ' (' || {rl('seconds / 60.0')} || ' min)'
  WHEN 'transfer' THEN CASE WHEN from_station = to_station THEN 'Transfer at ' || from_name || ' (' || {rl('seconds / 60.0')} || ' min walk)' ELSE 'Walk from ' || from_name || ' to ' || to_name || ' (' || {rl('seconds / 60.0')} || ' min)' END
  ELSE 'Arrive at ' || to_name END AS direction_text FROM legs""", "K8")
def trip_directions(t):
    return N.directions(N.trip_legs(planned(t), stations(t))).select("origin", "destination", "leg", "direction_text")


@query("trip_summaries", f"""WITH {LEGS}, g AS (SELECT origin, destination, list(route_id ORDER BY leg) FILTER (leg_type = 'board') AS rs, coalesce(sum(seconds) FILTER (leg_type = 'transfer'), 0)::BIGINT AS walking_seconds FROM legs GROUP BY ALL)
  SELECT origin, destination, {rl('p.seconds / 60.0')} || ' min via ' || coalesce(array_to_string(list_filter(rs, lambda x, i: NOT list_contains(rs[1:i - 1], x)), ', '), '') || ' (' || CASE transfers WHEN 0 THEN 'no transfers' WHEN 1 THEN '1 transfer' ELSE transfers || ' transfers' END || ')' AS summary, walking_seconds
  FROM plans p JOIN g USING (origin, destination)""", "K8")
def trip_summaries(t):
    plans = planned(t)
    return N.trip_summaries(plans, N.trip_legs(plans, stations(t)))


@query("transfer_points", f"""WITH {LEGS} SELECT origin, destination, leg, from_station AS station_id, from_station::INT * 0.5::DOUBLE + 30 AS lat, (n_regionkey * 2.0::DOUBLE - 80) AS lon FROM legs JOIN nation ON lpad(n_nationkey::VARCHAR, 2, '0') = from_station WHERE leg_type = 'transfer'""", "K11")
def transfer_points(t):
    return N.transfer_points(N.trip_legs(planned(t), stations(t)), stations(t))


