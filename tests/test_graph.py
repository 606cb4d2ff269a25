"""Trip planning on a small hand-made graph: route 1 A-B-C-D, route 2 E-C-F, route 3 G-C-H, transfers at C."""

import heapq
import random

import pytest

from stopflow.operators import graph as N

LINES = {"1": ("ABCD", 60), "2": ("ECF", 90), "3": ("GCH", 120)}


@pytest.fixture(scope="module")
def parts(spark):
    rows = []
    for route, (stops, seconds) in LINES.items():
        for a, b in zip(stops, stops[1:]):
            rows += [(route, a, b, seconds), (route, b, a, seconds)]
    rides = N.ride_edges(spark.createDataFrame(rows, "route_id string, from_station string, to_station string, seconds bigint"))
    nodes = N.graph_nodes(rides)
    none = spark.createDataFrame([], "complex_id string, walk_seconds bigint, transfer_type string, station_id string")
    return N.materialize_graph(rides, N.transfer_members(none, nodes), nodes)


def plan(spark, parts, pairs, **options):
    asked = spark.createDataFrame(pairs, "origin string, destination string")
    return {(r.origin, r.destination): r for r in N.least_cost_paths(asked, *parts, **options).collect()}


def test_costs_by_hand(spark, parts):
    got = plan(spark, parts, [("A", "D"), ("E", "F"), ("A", "F"), ("E", "D"), ("A", "H")])
    seen = {k: (r.seconds, r.cost, r.transfers) for k, r in got.items()}
    assert seen == {("A", "D"): (180, 180, 0), ("E", "F"): (180, 180, 0), ("A", "F"): (240, 540, 1), ("E", "D"): (180, 480, 1), ("A", "H"): (270, 570, 1)}


def test_no_transfer_allowed_and_unknown_station(spark, parts):
    assert set(plan(spark, parts, [("A", "F"), ("A", "D"), ("A", "nowhere")], max_transfers=0)) == {("A", "D")}


def test_out_of_system_penalty_and_complex(spark, parts):
    rides, members, nodes = parts
    extra = spark.createDataFrame([("dh", 100, "out-of-system", "D"), ("dh", 100, "out-of-system", "H")], members.drop("same_station").schema)
    more = N.transfer_members(extra, nodes)
    got = plan(spark, (rides, more, nodes), [("D", "H")])[("D", "H")]
    assert (got.seconds, got.cost, got.transfers) == (100, 460, 1)


def test_legs_and_texts(spark, parts):
    asked = spark.createDataFrame([("A", "F")], "origin string, destination string")
    paths = N.least_cost_paths(asked, *parts)
    names = spark.createDataFrame([(x, f"{x} St") for x in "ABCDEF"], "station_id string, station_name string")
    legs = N.trip_legs(paths, names)
    texts = [r.direction_text for r in N.directions(legs).orderBy("leg").collect()]
    assert texts == ["Board the 1 train at A St", "Ride 2 stops to C St (2 min)", "Transfer at C St (1 min walk)",
                     "Board the 2 train at C St", "Ride 1 stop to F St (2 min)", "Arrive at F St"]
    summary = N.trip_summaries(paths, legs).collect()[0]
    assert (summary.summary, summary.walking_seconds) == ("4 min via 1, 2 (1 transfer)", 30)


def test_alternatives_avoid_used_routes(spark, parts):
    asked = spark.createDataFrame([("A", "D")], "origin string, destination string")
    assert [r.seconds for r in N.route_alternatives(asked, *parts).collect()] == [180]


def test_complex_members_drop_unknown_and_single(spark):
    complexes = spark.createDataFrame([("x", 60, "in-system", ["A", "B", "?"]), ("y", 60, "in-system", ["A", "??"])],
                                      "complex_id string, walk_seconds bigint, transfer_type string, station_ids array<string>")
    stations = spark.createDataFrame([("A",), ("B",)], "station_id string")
    got = sorted((r.complex_id, r.station_id) for r in N.complex_members(complexes, stations).collect())
    assert got == [("x", "A"), ("x", "B")]


def test_counts(spark, parts):
    rides, members, nodes = parts
    assert {r.kind: r.n for r in N.graph_counts(rides, nodes, members).collect()} == {
        "ride_edges": 14, "station_routes": 10, "stations": 8, "transfer_edges": 6}


def best_first(rides, transfers, origin, destination, max_hops, max_transfers):
    """Plain enumeration of simple paths in order of seconds, then path."""
    out = {}
    for route, a, b, seconds in rides:
        out.setdefault((a, route), []).append(((b, route), seconds, 0))
    for a, b, seconds in transfers:
        out.setdefault(a, []).append((b, seconds, 1))
    nodes = set(out) | {v for steps in out.values() for v, _, _ in steps}
    heap = [(0, (n,), 0) for n in nodes if n[0] == origin]
    heapq.heapify(heap)
    while heap:
        seconds, path, changes = heapq.heappop(heap)
        if len(path) > 1 and path[-1][0] == destination:
            yield seconds, path, changes
        if len(path) <= max_hops:
            for v, s, c in out.get(path[-1], []):
                if v not in path and changes + c <= max_transfers:
                    heapq.heappush(heap, (seconds + s, path + (v,), changes + c))


def random_graph(spark, seed, stations=6, routes=2, rides=14):
    rng = random.Random(seed)
    names = [chr(65 + i) for i in range(stations)]
    edges = {}
    while len(edges) < rides:
        a, b = rng.sample(names, 2)
        edges[str(rng.randrange(routes)), a, b] = rng.choice([60, 60, 90, 120, 300])
    rows = [(r, a, b, s) for (r, a, b), s in edges.items()]
    frame = N.ride_edges(spark.createDataFrame(rows, "route_id string, from_station string, to_station string, seconds bigint"))
    nodes = N.graph_nodes(frame)
    known = {(a, r) for r, a, _, _ in rows} | {(b, r) for r, _, b, _ in rows}
    walks = [("x", 100, "out-of-system", names[0]), ("x", 100, "out-of-system", names[-1])]
    members = spark.createDataFrame(walks, "complex_id string, walk_seconds bigint, transfer_type string, station_id string")
    graph = N.materialize_graph(frame, N.transfer_members(members, nodes), nodes)
    transfers = [(u, v, 30) for u in known for v in known if u[0] == v[0] and u[1] != v[1]]
    transfers += [(u, v, 100) for u in known for v in known if {u[0], v[0]} == {names[0], names[-1]} and u[1] != v[1]]
    return names, rows, transfers, graph


@pytest.mark.parametrize(("seed", "hops", "changes"), [(1, 50, 2), (2, 4, 3)])
def test_fastest_paths_equal_best_first(spark, seed, hops, changes):
    names, rows, transfers, graph = random_graph(spark, seed)
    asked = [(a, b) for a in names[:4] for b in names if a != b] + [(names[0], "nowhere")]
    pairs = spark.createDataFrame(asked, "origin string, destination string")
    got, distinct = {}, {}
    for r in N.fastest_paths(pairs, *graph, k=5, max_hops=hops, max_transfers=changes).collect():
        got.setdefault((r.origin, r.destination), []).append((r.rank, r.seconds, tuple((n.station_id, n.route_id) for n in r.path), r.transfers))
    for r in N.fastest_paths(pairs, *graph, k=3, max_hops=hops, max_transfers=changes, distinct_routes=True).collect():
        distinct.setdefault((r.origin, r.destination), []).append((r.rank, r.seconds, r.routes))
    longest = 0
    for a, b in asked:
        found = list(best_first(rows, transfers, a, b, hops, changes))
        top = found[:5]
        longest = max([longest, *(len(p) for _, p, _ in top)])
        assert sorted(got.get((a, b), [])) == [(i + 1, s, p, c) for i, (s, p, c) in enumerate(top)], (a, b)
        single = {}
        for s, p, _ in found:
            single.setdefault(">".join(dict.fromkeys(r for _, r in p)), s)
        first = sorted((s, r) for r, s in single.items())[:3]
        assert sorted(distinct.get((a, b), [])) == [(i + 1, s, r) for i, (s, r) in enumerate(first)], (a, b)
    assert longest > 4


def test_remaining_seconds_are_exact(spark):
    names, rows, transfers, graph = random_graph(spark, 5)
    to = spark.createDataFrame([(names[2],)], "destination string")
    got = {((r.station_id, r.route_id), r.left): r.rest for r in N.remaining_seconds(to, *graph, max_transfers=2).collect()}
    for left in range(3):
        rest = {n: 0 for n in {(a, r) for r, a, _, _ in rows} | {(b, r) for r, _, b, _ in rows} if n[0] == names[2]}
        layers = [dict(rest) for _ in range(left + 1)]
        for _ in range(60):
            for k in range(left + 1):
                for r, a, b, s in rows:
                    if (b, r) in layers[k]:
                        layers[k][a, r] = min(layers[k].get((a, r), 1 << 60), layers[k][b, r] + s)
                for u, v, s in transfers:
                    if k and v in layers[k - 1]:
                        layers[k][u] = min(layers[k].get(u, 1 << 60), layers[k - 1][v] + s)
        want = {}
        for layer in layers:
            for n, s in layer.items():
                want[n] = min(want.get(n, s), s)
        assert {n: s for (n, k), s in got.items() if k == left} == want
