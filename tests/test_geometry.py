"""Track geometry, smoothing and clusters against hand values and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stopflow.operators import spatial as G
from stopflow.operators import track as K

TRACK = [(0, 40.70, -74.0), (1, 40.71, -74.0), (2, 40.71, -73.99)]


@pytest.fixture(scope="module")
def track(spark):
    rows = [("TEST", i, y, x) for i, y, x in TRACK]
    return K.with_cumulative(spark.createDataFrame(rows, "route_id string, seq int, lat double, lon double"))


def test_cumulative_metres(track):
    m = [r.cum_m for r in track.orderBy("seq").collect()]
    assert m[0] == 0 and abs(m[1] - 1112) < 1 and 840 < m[2] - m[1] < 850


def test_places_clamped_to_the_track(spark, track):
    lines = K.segments(track)
    total = track.agg(F.max("cum_m")).first()[0]
    asked = spark.createDataFrame([(1, "TEST", -5.0), (2, "TEST", 556.0), (3, "TEST", total + 9)], "id int, route_id string, s double")
    got = {r.id: r for r in K.at_arclength(asked, lines).collect()}
    assert (got[1].lat, got[1].lon) == (40.70, -74.0)
    assert abs(got[2].lat - 40.705) < 1e-4 and abs(got[2].heading) < 1e-6
    assert abs(got[3].lon + 73.99) < 1e-9 and abs(got[3].heading - 90) < 0.1


def test_matching_finds_far_points_too(spark, track):
    points = spark.createDataFrame([(1, "TEST", 40.705, -74.001), (2, "TEST", 41.5, -74.0)], "id int, route_id string, lat double, lon double")
    got = {r.id: r for r in K.map_match(points, K.segments(track), "id", 200, wider=(1000,)).collect()}
    assert abs(got[1].arclength_m - 556) < 1 and abs(got[1].offset_m - 84.3) < 1
    assert abs(got[2].arclength_m - 1112) < 1 and got[2].offset_m > 80_000


def brute_smooth(rows):
    made, _ = K.smooth_steps([z for _, z, _ in rows], [t for _, _, t in rows], None, 0.35, 0.15, 0.05, 20.0, 1.0, 5000.0)
    return [(o, *m) for (o, _, _), m in zip(rows, made)]


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_smoothing_in_chunks_equals_one_pass(spark, chunk):
    rng = random.Random(5)
    rows = {k: [(i, i * 100.0 + rng.gauss(0, 20) + (20_000 if k == "b" and i > 25 else 0), i * 10_000) for i in range(40)] for k in "ab"}
    df = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "trip string, seq int, z double, ms bigint")
    out = K.smooth(df, "trip", "seq", "z", "ms", F.floor(F.col("seq") / chunk)).collect()
    for k in "ab":
        got = sorted((r.seq, r.s, r.v, r.a, r.restarted) for r in out if r.trip == k)
        assert got == brute_smooth(rows[k])
    assert sum(r.restarted for r in out if r.trip == "b") == 2


@pytest.mark.parametrize("limit, most", [(15, 3), (20_000, 1)])
def test_small_chunks_are_smoothed_together(spark, monkeypatch, limit, most):
    """Blocks of any size give one pass; no key has more of them than its rows ask for."""
    rng, starts = random.Random(6), []

    def cut(df, cut_lineage=K.cut_lineage):
        done = cut_lineage(df)
        if done.columns[:2] == ["k0", "c0"]:
            starts.append(done.groupBy("k0").count().agg(F.max("count")).first()[0] or 0)
        return done

    monkeypatch.setattr(K, "BLOCK_ROWS", limit, raising=False)
    monkeypatch.setattr(K, "cut_lineage", cut)
    rows = {k: [(i, i * 100.0 + rng.gauss(0, 20), i * 10_000) for i in range(40)] for k in "ab"}
    df = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "trip string, seq int, z double, ms bigint")
    out = K.smooth(df, "trip", "seq", "z", "ms", F.floor(F.col("seq") / 5)).collect()
    assert all(sorted((r.seq, r.s, r.v, r.a, r.restarted) for r in out if r.trip == k) == brute_smooth(rows[k]) for k in "ab")
    assert max(starts) <= most


def noisy(seed, n=40):
    rng = random.Random(seed)
    return [(i, i * 100.0 + rng.gauss(0, 20), i * 10_000) for i in range(n)]


def test_blocks_that_remember_their_start_run_a_few_times(spark, monkeypatch, tmp_path):
    """Without jumps no block forgets its start to the last bit; work and size estimates still don't grow with the number of rounds."""
    def counted(*args, steps=K.smooth_steps, folder=str(tmp_path)):
        import uuid
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return steps(*args)

    rows = noisy(7, 240)
    want = brute_smooth(rows)
    monkeypatch.setattr(K, "BLOCK_ROWS", 20)
    monkeypatch.setattr(K, "smooth_steps", counted)
    df = spark.createDataFrame([("a", *r) for r in rows], "trip string, seq int, z double, ms bigint")
    out = K.smooth(df, "trip", "seq", "z", "ms", F.floor(F.col("seq") / 20))
    assert sorted((r.seq, r.s, r.v, r.a, r.restarted) for r in out.collect()) == want
    assert 24 <= len(list(tmp_path.iterdir())) <= 4 * 12
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 ** 30


@pytest.mark.parametrize("limit", [10, 20_000])
def test_smoothing_gets_over_rows_without_trip_or_number(spark, monkeypatch, limit):
    """A measurement that is no number is a jump of one row, wherever the blocks are cut; rows without a trip are left out."""
    monkeypatch.setattr(K, "BLOCK_ROWS", limit)
    rows = [(i, math.nan if i in (9, 23) else z, t) for i, z, t in noisy(8)]
    df = spark.createDataFrame([(k, *r) for k in ("a", None) for r in rows], "trip string, seq int, z double, ms bigint")
    got = sorted((r.seq, r.s, r.v, r.a, r.restarted) for r in K.smooth(df, "trip", "seq", "z", "ms", F.floor(F.col("seq") / 5)).collect())
    parts = [row for low, high in ((0, 9), (10, 23), (24, 40)) for row in brute_smooth(rows[low:high])]
    assert [g for g in got if g[0] not in (9, 23)] == parts
    assert [g[2:] for g in got if g[0] in (9, 23)] == [(0.0, 0.0, True)] * 2


def brute_clusters(points, t):
    seeds, owner = [], {}
    for i, y, x in points:
        hit = next((s for s in seeds if abs(s[1] - y) < t and abs(s[2] - x) < t), None)
        if hit is None:
            seeds.append((i, y, x))
            hit = seeds[-1]
        owner[i] = hit[0]
    return owner


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    hot = [(40.7581, -73.9851)] * 30
    spread = [(40.758 + rng.uniform(-0.002, 0.002), -73.985 + rng.uniform(-0.002, 0.002)) for _ in range(120)]
    points = [(i, y, x) for i, (y, x) in enumerate(rng.sample(hot + spread, 150))]
    df = spark.createDataFrame(points, "id bigint, lat double, lon double")
    got = {r.id: r.seed for r in G.proximity_clusters(df, "id").collect()}
    assert got == brute_clusters(points, 0.0005)


def test_nearest_with_many_at_one_spot(spark):
    stations = spark.createDataFrame([(i, 40.0, -74.0) for i in range(50)] + [(99, 40.01, -74.0)], "station int, lat double, lon double")
    points = spark.createDataFrame([(1, 40.001, -74.0), (2, 45.0, -74.0)], "id int, lat double, lon double")
    got = G.nearest_stations(points, stations, "id", "station", 3, 2000).collect()
    assert [(r.id, r.station, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert all(math.isclose(r.distance_m, 111.19, abs_tol=0.1) for r in got)


@pytest.mark.parametrize("lat, lon", [(75.0, 10.0), (-84.9, -120.0), (0.0, 179.999), (60.0, -179.99), (89.95, 0.0), (51.0, 0.0)])
def test_nearest_at_every_latitude_and_across_the_antimeridian(spark, lat, lon):
    rng = random.Random(int(lat * 10))
    spread = 0.05 / max(math.cos(math.radians(lat)), 0.003)
    spots = []
    for i in range(300):
        x = lon + rng.uniform(-spread, spread)
        spots.append((i, max(-90.0, min(90.0, lat + rng.uniform(-0.03, 0.03))), (x + 180) % 360 - 180))
    points, stations = spots[:60], [(f"s{i:03}", y, x) for i, y, x in spots[60:]]

    def metres(a, b):
        p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(p[0], r + 1, s) for p in points for r, (_, s) in enumerate(sorted((metres(p, s), s[0]) for s in stations if metres(p, s) <= 2000)[:3])}
    ask = spark.createDataFrame(points, "id int, lat double, lon double")
    near = spark.createDataFrame(stations, "sid string, lat double, lon double")
    got = {(r["id"], r["rank"], r["sid"]) for r in G.nearest_stations(ask, near, "id", "sid").collect()}
    assert got == want and want
    some = {r["id"] for r in G.near_any_station(ask, near, 2000).collect()}
    assert some == {p for p, _, _ in want}


def test_stops_around_and_between_by_blocks(spark):
    """Empty blocks, ends beyond the first and last stop, several stops at one place, and unknown routes."""
    rng = random.Random(3)
    stops = [(r, f"s{i:02d}", rng.choice([0.0, 5.0, 999.5, 1000.0, 7000.0, 7000.0, 7400.0, float(rng.randrange(20_000))])) for r in (1, 2) for i in range(12)]
    on_track = spark.createDataFrame(stops, "route_id int, stop_id string, arclength_m double")
    asked = [(i, rng.choice([1, 2, 3]), float(rng.choice([-50, 0, 5, 1000, 7000, 7400, 30_000, rng.randrange(20_000)])), float(rng.randrange(21_000))) for i in range(300)]
    requests = spark.createDataFrame(asked, "id int, route_id int, s_from double, s_to double")
    got = sorted((r.id, r["rank"], r.stop_id, r.arclength_m) for r in K.stops_between(requests, on_track, "id").collect())
    want = []
    for i, route, a, b in asked:
        hit = [(x, s) for r, s, x in stops if r == route and min(a, b) < x < max(a, b)]
        hit.sort(key=lambda h: (h[0] if a <= b else -h[0], h[1]))
        want += [(i, n + 1, s, x) for n, (x, s) in enumerate(hit)]
    assert got == sorted(want) and len(want) > 300
    around = {r.id: (r.s_prev, r.s_next) for r in K.between_stops(requests.withColumnRenamed("s_from", "arclength_m"), on_track, "id").collect()}
    for i, route, a, _ in asked:
        before, after = [x for r, _, x in stops if r == route and x <= a], [x for r, _, x in stops if r == route and x > a]
        assert around.get(i) == ((max(before), min(after)) if before and after else None)


def test_nearest_in_dense_and_sparse_places(spark):
    """Rings: the result is that of the plain search, and points in the dense place are done in a small ring."""
    rng = random.Random(8)
    near = [(i, 40.7 + rng.gauss(0, 0.002), -74.0 + rng.gauss(0, 0.002)) for i in range(3000)] + [(3000 + i, 40.7 + rng.uniform(-0.1, 0.1), -74.0 + rng.uniform(-0.1, 0.1)) for i in range(60)]
    asked = [(i, 40.7 + rng.gauss(0, 0.003), -74.0 + rng.gauss(0, 0.003)) for i in range(60)] + [(60 + i, 40.7 + rng.uniform(-0.1, 0.1), -74.0 + rng.uniform(-0.1, 0.1)) for i in range(60)]
    stations = spark.createDataFrame(near, "sid int, lat double, lon double")
    points = spark.createDataFrame(asked, "id int, lat double, lon double")
    assert len(G._rings(stations, 3, 2000)) > 2 and G._rings(stations.filter("sid >= 3000"), 3, 2000) == [2000]
    got = sorted((r.id, r["rank"], r.sid) for r in G.nearest_stations(points, stations, "id", "sid").collect())

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = []
    for i, lat, lon in asked:
        best = sorted((m, sid) for sid, y, x in near if (m := metres(lat, lon, y, x)) <= 2000)[:3]
        want += [(i, n + 1, sid) for n, (_, sid) in enumerate(best)]
    assert got == sorted(want)
