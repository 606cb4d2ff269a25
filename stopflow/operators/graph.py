"""Transit graph and batch trip planning.

A node is (station, route). Ride edges are rows; transfers are not: stations that share a transfer
complex are listed once per complex (``members``), and every station is its own complex for
changes of route on the spot. A search step goes from a node to its complexes and out to their
other nodes, so transfer data stays linear in the number of stations and no pair list is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import js_round_long
from ..session import cut_lineage, scratch_path
from .ordered import top_per_key

# ---- building -------------------------------------------------------------------


def ride_edges(segments: DataFrame, bidirectional: bool = False) -> DataFrame:
    """One ride edge per (route, from, to), shortest first; missing reverse edges copy the forward time."""
    one = segments.filter(F.col("from_station") != F.col("to_station")).groupBy("route_id", "from_station", "to_station").agg(
        F.min("seconds").alias("seconds"))
    if not bidirectional:
        return one
    back = one.select("route_id", F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), "seconds")
    return one.unionByName(back.join(one.select("route_id", "from_station", "to_station"), ["route_id", "from_station", "to_station"], "left_anti"))


def graph_nodes(rides: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("from_station").alias("station_id"), "route_id"), F.struct(F.col("to_station").alias("station_id"), "route_id"))
    return rides.select(F.inline(ends)).distinct()


def complex_members(complexes: DataFrame, stations: DataFrame) -> DataFrame:
    """Valid stations per transfer complex; complexes left with fewer than two are dropped."""
    listed = complexes.select("complex_id", "walk_seconds", "transfer_type", F.explode(F.array_distinct("station_ids")).alias("station_id"))
    valid = listed.join(stations.select("station_id").distinct(), "station_id", "left_semi")
    sizes = valid.groupBy("complex_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2)
    return valid.join(sizes.select("complex_id"), "complex_id", "left_semi")


def transfer_members(members: DataFrame, nodes: DataFrame, same_station_seconds: int = 30) -> DataFrame:
    """Complex members plus every station as a complex of its own for changes on the spot."""
    own = nodes.select("station_id").distinct().select(
        F.concat(F.lit("same_station_"), "station_id").alias("complex_id"), F.lit(same_station_seconds).cast("bigint").alias("walk_seconds"),
        F.lit("in-system").alias("transfer_type"), "station_id", F.lit(True).alias("same_station"))
    cols = ["complex_id", "walk_seconds", "transfer_type", "station_id", "same_station"]
    return members.withColumn("same_station", F.lit(False)).withColumn("walk_seconds", F.col("walk_seconds").cast("bigint")).select(cols).unionByName(own.select(cols))


def materialize_graph(rides: DataFrame, members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the three graph tables once; searches read them in every round."""
    return cut_lineage(rides), cut_lineage(members), cut_lineage(nodes)


def graph_counts(rides: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Rows per node kind and edge kind; transfer edges are counted from member sizes, not listed.

    A complex gives its ordered node pairs less those that share a station or a route; the change on
    the spot gives the ordered route pairs of each station.
    """
    at = members.join(nodes, "station_id")
    per = at.groupBy("complex_id", "same_station")
    all_nodes = per.agg(F.count("*").alias("n"))

    def squares(column):
        return at.groupBy("complex_id", column).agg(F.count("*").alias("c")).groupBy("complex_id").agg(F.sum(F.col("c") * F.col("c")).alias("s"))

    sized = all_nodes.join(squares("station_id").withColumnRenamed("s", "by_station"), "complex_id").join(
        squares("route_id").withColumnRenamed("s", "by_route"), "complex_id")
    pairs = F.when(F.col("same_station"), F.col("n") * F.col("n") - F.col("n")).otherwise(
        F.col("n") * F.col("n") - F.col("by_station") - F.col("by_route") + F.col("n"))
    transfers = sized.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n")).select(F.lit("transfer_edges").alias("kind"), "n")
    return (rides.agg(F.count("*").alias("n")).select(F.lit("ride_edges").alias("kind"), "n")
            .unionByName(nodes.agg(F.count("*").alias("n")).select(F.lit("station_routes").alias("kind"), "n"))
            .unionByName(nodes.select("station_id").distinct().agg(F.count("*").alias("n")).select(F.lit("stations").alias("kind"), "n"))
            .unionByName(transfers))


def station_nodes(nodes: DataFrame, station: str) -> DataFrame:
    return nodes.filter(F.col("station_id") == station)


def node_edges(rides: DataFrame, members: DataFrame, nodes: DataFrame, station: str, route: str) -> DataFrame:
    """Ride and transfer edges out of one node."""
    out = rides.filter((F.col("from_station") == station) & (F.col("route_id") == route)).select(
        F.lit("ride").alias("kind"), F.col("to_station").alias("station_id"), "route_id", "seconds")
    here = nodes.filter((F.col("station_id") == station) & (F.col("route_id") == route))
    steps = _transfer_steps(here, members, nodes)
    return out.unionByName(steps.select(F.lit("transfer").alias("kind"), F.col("to_station").alias("station_id"), F.col("to_route").alias("route_id"), F.col("step_seconds").alias("seconds")))


def known_stations(requests: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Whether a requested station is in the graph, with its name."""
    inside = nodes.select("station_id").distinct().withColumn("_in", F.lit(True))
    return (requests.join(inside, "station_id", "left").join(names.select("station_id", "station_name"), "station_id", "left")
            .select(*requests.columns, F.coalesce("_in", F.lit(False)).alias("exists"), "station_name"))


# ---- steps ----------------------------------------------------------------------


def _ride_steps(at: DataFrame, rides: DataFrame) -> DataFrame:
    edges = rides.select(F.col("from_station").alias("_fs"), F.col("route_id").alias("_fr"), F.col("to_station"), F.col("route_id").alias("to_route"),
                         F.col("seconds").cast("bigint").alias("step_seconds"))
    return at.join(edges, (F.col("station_id") == F.col("_fs")) & (F.col("route_id") == F.col("_fr"))).drop("_fs", "_fr").withColumns(
        {"step_kind": F.lit("ride"), "step_type": F.lit(None).cast("string")})


def _transfer_steps(at: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out of a node into its complexes, and on to their nodes on another route."""
    doors = members.select(F.col("station_id").alias("_ds"), F.col("complex_id").alias("_dc"))
    exits = members.join(nodes, "station_id").select(
        F.col("complex_id").alias("_xc"), F.col("station_id").alias("to_station"), F.col("route_id").alias("to_route"),
        F.col("walk_seconds").alias("step_seconds"), F.col("transfer_type").alias("step_type"), F.col("same_station").alias("_same"))
    out = at.join(doors, F.col("station_id") == F.col("_ds")).join(
        exits, (F.col("_dc") == F.col("_xc")) & (F.col("to_route") != F.col("route_id")) & (F.col("_same") | (F.col("to_station") != F.col("station_id"))))
    return out.drop("_ds", "_dc", "_xc", "_same").withColumn("step_kind", F.lit("transfer"))


def _steps(at: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    return _ride_steps(at, rides).unionByName(_transfer_steps(at, members, nodes))


def _node(station: Column, route: Column, kind: Column, seconds: Column, kind_of_transfer: Column) -> Column:
    return F.struct(station.alias("station_id"), route.alias("route_id"), kind.alias("kind"), seconds.alias("seconds"),
                    kind_of_transfer.alias("transfer_type"))


def _start_path() -> Column:
    none = F.lit(None).cast("string")
    return F.array(_node(F.col("station_id"), F.col("route_id"), F.lit("start"), F.lit(0).cast("bigint"), none))


def _longer_path() -> Column:
    return F.concat("path", F.array(_node(F.col("to_station"), F.col("to_route"), F.col("step_kind"), F.col("step_seconds"), F.col("step_type"))))


# ---- least-cost paths --------------------------------------------------------------

KEY = ["origin", "avoid", "station_id", "route_id", "transfers"]


def avoided(routes: Sequence[str]) -> Column:
    """Routes not to be used, as searches key them: upper case, sorted, each once."""
    return F.array(*[F.lit(r) for r in sorted({r.upper() for r in routes})]).cast("array<string>")


def search(wanted: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame, penalty: int = 300, out_of_system: int = 60,
           max_transfers: int = 3, by_hops: bool = False, max_hops: int | None = None) -> DataFrame:
    """Best label per source, node and number of transfers, as far as the asked destinations need it.

    ``wanted`` has (origin, avoid, destination), avoid being the list of routes not to be used (``avoided``). All sources advance
    together: each round extends the labels that improved, keeps the smallest (cost, seconds, path) per state, and ends when nothing
    improves, or after ``max_hops`` rounds where that is the limit asked for. Once all destinations of a source are reached,
    labels dearer than the dearest of them are not extended. Each round is written to the shared folder.
    """
    wanted = cut_lineage(wanted.select("origin", "avoid", F.col("destination").alias("_to")).distinct())
    asked = wanted.groupBy("origin", "avoid").agg(F.count("*").alias("_asked"))
    free = ~F.array_contains("avoid", F.upper("route_id"))
    starts = asked.select("origin", "avoid").join(nodes, F.col("origin") == F.col("station_id")).filter(free)
    zero = F.lit(0).cast("bigint")
    labels = cut_lineage(starts.select("origin", "avoid", "station_id", "route_id", F.lit(0).alias("transfers"),
                                       F.struct(zero.alias("cost"), zero.alias("seconds"), _start_path().alias("path")).alias("best"), F.lit(True).alias("changed")))
    is_transfer = F.col("step_kind") == "transfer"
    extra = F.when(is_transfer, F.lit(penalty) + F.when(F.col("step_type") == "out-of-system", out_of_system).otherwise(0)).otherwise(0)
    step_cost = F.lit(1).cast("bigint") if by_hops else (F.col("step_seconds") + extra).cast("bigint")
    rounds = 0
    while max_hops is None or rounds < max_hops:
        rounds += 1
        reached = labels.join(wanted.withColumnRenamed("_to", "station_id"), ["origin", "avoid", "station_id"]).groupBy(
            "origin", "avoid", "station_id").agg(F.min("best.cost").alias("_cost"))
        limits = reached.groupBy("origin", "avoid").agg(F.count("*").alias("_found"), F.max("_cost").alias("_limit")).join(
            asked, ["origin", "avoid"]).filter("_found = _asked").select("origin", "avoid", "_limit")
        active = labels.filter("changed").join(limits, ["origin", "avoid"], "left").filter(
            F.col("_limit").isNull() | (F.col("best.cost") <= F.col("_limit"))).select("origin", "avoid", "station_id", "route_id", "transfers", "best.*")
        moved = _steps(active, rides, members, nodes).filter(~F.array_contains("avoid", F.upper("to_route")) & (F.col("to_station") != F.col("origin")))
        moved = moved.withColumn("transfers", F.col("transfers") + is_transfer.cast("int")).filter(F.col("transfers") <= max_transfers)
        offered = moved.select("origin", "avoid", F.col("to_station").alias("station_id"), F.col("to_route").alias("route_id"), "transfers",
                               F.struct((F.col("cost") + step_cost).alias("cost"), (F.col("seconds") + F.col("step_seconds")).alias("seconds"),
                                        _longer_path().alias("path")).alias("best"), F.lit(False).alias("_old"))
        both = labels.select(*KEY, "best", F.lit(True).alias("_old")).unionByName(offered)
        merged = both.groupBy(*KEY).agg(F.min("best").alias("best"), F.min(F.when(F.col("_old"), F.col("best"))).alias("_was"))
        labels = cut_lineage(merged.select(*KEY, "best", (F.col("_was").isNull() | (F.col("best") < F.col("_was"))).alias("changed")))
        if labels.filter("changed").isEmpty():
            break
    return labels.select("origin", "avoid", "station_id", "route_id", "transfers", "best.*")


def _arrivals(labels: DataFrame) -> DataFrame:
    """Best label per source and destination station: by cost, transfers, seconds, path."""
    row = F.struct("cost", "transfers", "seconds", "path")
    return labels.groupBy("origin", "avoid", F.col("station_id").alias("destination")).agg(F.min(row).alias("b")).select(
        "origin", "avoid", "destination", "b.*")


def least_cost_paths(pairs: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame, avoid: Sequence[str] = (), **options) -> DataFrame:
    """Best path per (origin, destination) without the routes of ``avoid``. Pairs of one origin share a search."""
    wanted = pairs.select("origin", "destination").distinct().withColumn("avoid", avoided(avoid))
    found = _arrivals(search(wanted, rides, members, nodes, **options)).drop("avoid")
    return pairs.select("origin", "destination").distinct().join(found, ["origin", "destination"])


def route_alternatives(pairs: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame, k: int = 3, avoid: Sequence[str] = (),
                       **options) -> DataFrame:
    """Best path, and the best paths that avoid each of its routes in turn besides ``avoid``; equal paths once, fastest k kept."""
    first = cut_lineage(least_cost_paths(pairs, rides, members, nodes, avoid, **options))
    used = first.select("origin", "destination", F.explode(F.array_distinct(F.transform("path", lambda n: F.upper(n["route_id"])))).alias("_route"))
    used = used.select("origin", "destination", F.array_sort(F.array_union(avoided(avoid), F.array("_route"))).alias("avoid"))
    again = search(used, rides, members, nodes, **options)
    others = used.join(_arrivals(again), ["origin", "avoid", "destination"]).drop("avoid")
    every = first.unionByName(others.select(first.columns))
    stops = F.array_join(F.transform("path", lambda n: F.concat(n["station_id"], F.lit(":"), n["route_id"])), ">")
    single = every.withColumn("_stops", stops).groupBy("origin", "destination", "_stops").agg(F.min(F.struct(*first.columns)).alias("b")).select("b.*", "_stops")
    return top_per_key(single, ["origin", "destination"], [F.asc("seconds"), F.asc("cost"), F.asc("_stops")], k).drop("_stops")


def fewest_hops(pairs: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame, max_transfers: int = 3, max_hops: int = 50,
                avoid: Sequence[str] = ()) -> DataFrame:
    """Fewest edges per pair (then fewest seconds), up to ``max_hops``, if its transfers stay within the limit."""
    wanted = pairs.select("origin", "destination").distinct().withColumn("avoid", avoided(avoid))
    labels = search(wanted, rides, members, nodes, by_hops=True, max_transfers=max_transfers, max_hops=max_hops)
    row = F.struct(F.col("cost").alias("hops"), "seconds", "transfers", "path")
    best = labels.groupBy("origin", F.col("station_id").alias("destination")).agg(F.min(row).alias("b")).select("origin", "destination", "b.*")
    return pairs.select("origin", "destination").distinct().join(best, ["origin", "destination"])


# ---- k fastest simple paths -----------------------------------------------------------

PAIR = ["origin", "destination"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back in the shared folder: cuts lineage, and joins know the table's true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remaining_seconds(destinations: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame, max_transfers: int) -> DataFrame:
    """Least seconds from every node to each destination with at most ``left`` transfers: destination, station_id, route_id, left, rest.

    One backward search serves all destinations: rides are turned round, transfers go both ways. Rounds extend only the labels
    that improved, and end when none does.
    """
    back = rides.select(F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), "route_id", "seconds")
    state = ["destination", "station_id", "route_id", "left"]
    front = destinations.select("destination").distinct().join(nodes, F.col("destination") == F.col("station_id")).select(
        "destination", "station_id", "route_id", F.lit(0).alias("left"), F.lit(0).cast("bigint").alias("rest"))
    best = _stored(front.withColumn("new", F.lit(True)), "graph-rest")
    while True:
        moved = _steps(best.filter("new").drop("new"), back, members, nodes)
        moved = moved.withColumn("left", F.col("left") + (F.col("step_kind") == "transfer").cast("int")).filter(F.col("left") <= max_transfers)
        offered = moved.select("destination", F.col("to_station").alias("station_id"), F.col("to_route").alias("route_id"), "left",
                               (F.col("rest") + F.col("step_seconds")).alias("rest"), F.lit(True).alias("new"))
        # a tie keeps the label that is there
        both = best.withColumn("new", F.lit(False)).unionByName(offered)
        best = _stored(both.groupBy(*state).agg(F.min(F.struct("rest", "new")).alias("b")).select(*state, "b.*"), "graph-rest")
        if best.filter("new").isEmpty():
            break
    allowed = best.withColumn("left", F.explode(F.sequence(F.col("left"), F.lit(max_transfers))))
    return allowed.groupBy(*state).agg(F.min("rest").alias("rest"))


def _route_list() -> Column:
    return F.array_join(F.array_distinct(F.transform("path", lambda n: n["route_id"])), ">")


def fastest_paths(pairs: DataFrame, rides: DataFrame, members: DataFrame, nodes: DataFrame, k: int, max_hops: int = 50, max_transfers: int = 3,
                  distinct_routes: bool = False, width: int = 4) -> DataFrame:
    """The ``k`` fastest simple paths per pair, of up to ``max_hops`` edges: origin, destination, routes, seconds, transfers, path, rank.

    A path starts at any node of the origin, ends at one of the destination, and visits no node twice. With ``distinct_routes``
    only the fastest path of each combination of routes (in order of first use) counts. Ties go to the smaller path (or combination).

    Best-first search of all pairs together. A started path is bounded below by its seconds plus the least seconds that remain
    (``remaining_seconds``). Each round orders the started and finished paths of a pair by bound, and extends by one edge the started ones among
    the first ``width`` times k (and all as good as the k-th). Started paths beyond the k-th finished one are dropped, and a pair is done
    when none is left. So a pair extends about width * k paths a round, whatever the number of paths in the graph. Each
    round is written to the shared folder. Pairs without a path give no rows.
    """
    rides, members, nodes = (_stored(x, "graph") for x in (rides, members, nodes))
    wanted = _stored(pairs.select(*PAIR).distinct(), "graph-pairs")
    rest = _stored(remaining_seconds(wanted.select("destination"), rides, members, nodes, max_transfers), "graph-rest")
    held = [*PAIR, "done", "station_id", "route_id", "seconds", "transfers", "path", "bound"]
    group = F.when(F.col("done"), _route_list()) if distinct_routes else F.lit(None).cast("string")
    whole, by_kind = Window.partitionBy(*PAIR), Window.partitionBy(*PAIR, "done")

    def bounded(started: DataFrame) -> DataFrame:
        """With the lower bound of the whole path; those that can't reach their destination go."""
        left = F.lit(max_transfers) - F.col("transfers")
        return started.withColumn("left", left).join(rest, ["destination", "station_id", "route_id", "left"]).withColumn("bound", F.col("seconds") + F.col("rest"))

    def judged(table: DataFrame) -> DataFrame:
        """The first k finished paths, the started ones that may still be among them, and which of those to extend now."""
        rows = table.repartition(*PAIR).withColumn("_group", group)
        if distinct_routes:
            first = F.row_number().over(Window.partitionBy(*PAIR, "done", "_group").orderBy("seconds", "path"))
            rows = rows.withColumn("_first", first).filter("NOT done OR _first = 1")
        rows = rows.withColumn("_at", F.row_number().over(by_kind.orderBy("seconds", "_group", "path"))).filter(F.expr("NOT done") | (F.col("_at") <= k))
        rows = rows.withColumn("_last", F.max(F.when(F.col("done") & (F.col("_at") == k), F.col("seconds"))).over(whole))
        rows = rows.filter(F.col("done") | F.col("_last").isNull() | (F.col("bound") <= F.col("_last")))
        rows = rows.withColumn("_order", F.row_number().over(whole.orderBy("bound")))
        limit = F.max(F.when(F.col("_order") == k, F.col("bound"))).over(whole)
        return rows.select(*held, (~F.col("done") & ((F.col("_order") <= width * k) | (F.col("bound") <= limit))).alias("go"))

    begun = wanted.join(nodes, F.col("origin") == F.col("station_id")).select(
        *PAIR, "station_id", "route_id", F.lit(0).cast("bigint").alias("seconds"), F.lit(0).alias("transfers"), _start_path().alias("path"))
    table = _stored(judged(bounded(begun).withColumn("done", F.lit(False)).select(held)), "graph-paths")
    while not table.filter("go").isEmpty():
        moved = _steps(table.filter(F.col("go") & (F.size("path") <= max_hops)).drop("go", "done", "bound"), rides, members, nodes)
        new = ~F.exists("path", lambda n: (n["station_id"] == F.col("to_station")) & (n["route_id"] == F.col("to_route")))
        moved = moved.filter(new).withColumn("transfers", F.col("transfers") + (F.col("step_kind") == "transfer").cast("int")).filter(F.col("transfers") <= max_transfers)
        moved = bounded(moved.select(*PAIR, F.col("to_station").alias("station_id"), F.col("to_route").alias("route_id"), (F.col("seconds") + F.col("step_seconds")).alias("seconds"),
                                     "transfers", _longer_path().alias("path")))
        # a path that ends at its destination is finished, and may also go on from there
        finished = F.when(F.col("station_id") == F.col("destination"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        table = _stored(judged(table.filter("NOT go").select(held).unionByName(moved.withColumn("done", F.explode(finished)).select(held))), "graph-paths")
    order = ["seconds", "routes", "path"] if distinct_routes else ["seconds", "path"]
    ranked = table.withColumn("routes", _route_list()).withColumn("rank", F.row_number().over(whole.orderBy(*order)))
    return ranked.select(*PAIR, "routes", "seconds", "transfers", "path", "rank")


# ---- legs --------------------------------------------------------------------------


def trip_legs(paths: DataFrame, names: DataFrame, keys: Sequence[str] = ("origin", "destination")) -> DataFrame:
    """Board, ride, transfer and exit legs of each path, numbered.

    Consecutive rides on a route become one leg with its stop count. Transfers that start or, as the
    last step, end at the destination are left out.
    """
    keys = list(keys)
    steps = paths.select(*keys, F.posexplode("path").alias("pos", "n")).select(*keys, "pos", "n.*")
    order = Window.partitionBy(*keys).orderBy("pos")
    steps = steps.withColumns({"from_station": F.lag("station_id").over(order), "from_kind": F.lag("kind").over(order),
                               "from_route": F.lag("route_id").over(order), "is_last": F.lead("pos").over(order).isNull()})
    steps = steps.filter(F.col("pos") > 0)
    ride = F.col("kind") == "ride"
    begins = ride & ~((F.col("from_kind") == "ride") & (F.col("from_route") == F.col("route_id")))
    steps = steps.withColumns({"_begin": begins, "_run": F.sum((begins | ~ride).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rides = steps.filter(ride).groupBy(*keys, "_run", "route_id").agg(
        F.min("pos").alias("pos"), F.min_by("from_station", "pos").alias("from_station"), F.max_by("station_id", "pos").alias("to_station"),
        F.sum("seconds").alias("seconds"), F.count("*").alias("stop_count"))
    none_text, none_long = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    shape = [*keys, "pos", "place", "leg_type", "route_id", "from_station", "to_station", "seconds", "stop_count", "transfer_type"]
    board = rides.withColumns({"place": F.lit(0), "leg_type": F.lit("board"), "to_station": F.col("from_station"), "seconds": F.lit(0).cast("bigint"), "stop_count": none_long, "transfer_type": none_text})
    riding = rides.withColumns({"place": F.lit(1), "leg_type": F.lit("ride"), "transfer_type": none_text})
    destination = F.col(keys[-1])
    walk = steps.filter(~ride & ~((F.col("station_id") == destination) & F.col("is_last")) & (F.col("from_station") != destination))
    walk = walk.withColumns({"to_station": F.col("station_id"), "place": F.lit(2), "leg_type": F.lit("transfer"), "route_id": none_text, "stop_count": none_long})
    ends = paths.select(*keys, F.size("path").alias("pos")).withColumns({
        "place": F.lit(3), "leg_type": F.lit("exit"), "route_id": none_text, "from_station": destination, "to_station": destination,
        "seconds": F.lit(0).cast("bigint"), "stop_count": none_long, "transfer_type": none_text})
    legs = board.select(shape).unionByName(riding.select(shape)).unionByName(walk.select(shape)).unionByName(ends.select(shape))
    numbered = legs.withColumn("leg", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "place"))).drop("pos", "place")
    label = names.select(F.col("station_id").alias("_sid"), F.col("station_name").alias("_name"))
    for side in ("from", "to"):
        numbered = numbered.join(label, F.col(f"{side}_station") == F.col("_sid"), "left").withColumn(
            f"{side}_name", F.coalesce("_name", F.col(f"{side}_station"))).drop("_sid", "_name")
    return numbered


def directions(legs: DataFrame) -> DataFrame:
    """One sentence per leg."""
    minutes = js_round_long(F.col("seconds") / 60).cast("string")
    stops = F.when(F.col("stop_count") == 1, "1 stop").otherwise(F.concat(F.col("stop_count").cast("string"), F.lit(" stops")))
    sentence = (F.when(F.col("leg_type") == "board", F.concat(F.lit("Board the "), "route_id", F.lit(" train at "), "from_name"))
                .when(F.col("leg_type") == "ride", F.concat(F.lit("Ride "), stops, F.lit(" to "), "to_name", F.lit(" ("), minutes, F.lit(" min)")))
                .when((F.col("leg_type") == "transfer") & (F.col("from_station") == F.col("to_station")),
                      F.concat(F.lit("Transfer at "), "from_name", F.lit(" ("), minutes, F.lit(" min walk)")))
                .when(F.col("leg_type") == "transfer", F.concat(F.lit("Walk from "), "from_name", F.lit(" to "), "to_name", F.lit(" ("), minutes, F.lit(" min)")))
                .otherwise(F.concat(F.lit("Arrive at "), "to_name")))
    return legs.withColumn("direction_text", sentence)


def trip_summaries(paths: DataFrame, legs: DataFrame, keys: Sequence[str] = ("origin", "destination")) -> DataFrame:
    """``12 min via A, C (1 transfer)`` with walking seconds; a trip's routes are a short list."""
    keys = list(keys)
    parts = legs.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("leg_type") == "board", F.struct("leg", "route_id")))), lambda x: x["route_id"]).alias("_routes"),
        F.sum(F.when(F.col("leg_type") == "transfer", F.col("seconds")).otherwise(0)).alias("walking_seconds"))
    count = F.when(F.col("transfers") == 0, "no transfers").when(F.col("transfers") == 1, "1 transfer").otherwise(
        F.concat(F.col("transfers").cast("string"), F.lit(" transfers")))
    routes = F.array_join(F.array_distinct("_routes"), ", ")
    text = F.concat(js_round_long(F.col("seconds") / 60).cast("string"), F.lit(" min via "), routes, F.lit(" ("), count, F.lit(")"))
    return paths.select(*keys, "seconds", "transfers").join(parts, keys).select(*keys, text.alias("summary"), "walking_seconds")


def transfer_points(legs: DataFrame, places: DataFrame, keys: Sequence[str] = ("origin", "destination")) -> DataFrame:
    """Where each trip changes, with coordinates; unknown stations are left out."""
    spots = places.select(F.col("station_id").alias("_sid"), "lat", "lon")
    return legs.filter(F.col("leg_type") == "transfer").join(spots, F.col("from_station") == F.col("_sid")).select(
        *keys, "leg", F.col("from_station").alias("station_id"), "lat", "lon")
