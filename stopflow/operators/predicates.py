"""Filters, flags and corrections on stops, routes, trips, alerts and arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import lookup


def parent_stations(stops: DataFrame, stop: str = "stop_id", parent: str = "parent_station") -> DataFrame:
    return stops.filter((F.col(parent).isNull() | (F.col(parent) == "")) & ~F.col(stop).rlike("[NS]$"))


def with_canonical_route(df: DataFrame, aliases: dict[str, str], route: str = "route_id") -> DataFrame:
    return df.withColumn("canonical_route", text.canonical_route(route, aliases))


def filter_routes(df: DataFrame, wanted: Sequence[str], aliases: dict[str, str], route: str = "route_id") -> DataFrame:
    """Rows whose route, raw or canonical, is wanted; an empty list keeps all."""
    if not wanted:
        return df
    upper = [w.upper() for w in wanted]
    return df.filter(F.upper(F.col(route)).isin(upper) | text.canonical_route(route, aliases).isin(upper))


def serves_route(stop: str, routes: str, route_id: str, prefixes, ranges, aliases: dict[str, str]) -> Column:
    """Whether a stop serves one route: by token, id prefix, or numeric range (plain or after R)."""
    wanted = aliases.get(route_id.upper(), route_id.upper())
    sid = F.upper(F.col(stop))
    hit = F.array_contains(text.route_tokens(routes), wanted)
    for owner, prefix in prefixes:
        if owner == wanted:
            hit = hit | sid.startswith(prefix)
    number = F.regexp_extract(sid, r"^R?(\d+)", 1).try_cast("int")
    for owner, low, high in ranges:
        if owner == wanted:
            hit = hit | F.coalesce(number.between(low, high), F.lit(False))
    return hit


def filter_stops_by_route(stops: DataFrame, route_id: str, prefixes, ranges, aliases) -> DataFrame:
    return stops.filter(serves_route("stop_id", "routes", route_id, prefixes, ranges, aliases))


def routes_of_stops(stops: DataFrame, prefixes) -> DataFrame:
    """Distinct routes per stop: its tokens, then routes implied by its id prefix."""
    sid = F.upper(F.col("stop_id"))
    implied = F.array_compact(F.array(*[F.when(sid.startswith(p), F.lit(r)) for r, p in prefixes]))
    return stops.withColumn("all_routes", F.array_union(text.route_tokens("routes"), implied))


def with_feed_group(df: DataFrame, groups: dict[str, list[str]], route: str = "route_id") -> DataFrame:
    """Feed group of the route, one trailing X ignored; NULL when unknown."""
    owner = {r: g for g, members in groups.items() for r in members}
    return df.withColumn("feed_group", lookup(owner, F.regexp_replace(F.upper(F.col(route)), "X$", "")))


def search_stops(stops: DataFrame, term: str, route: str | None = None, limit: int | None = None) -> DataFrame:
    """Stops whose name or id contains the term, ignoring case; optional route token and limit."""
    needle = term.lower()
    out = stops.filter(F.lower("stop_name").contains(needle) | F.lower("stop_id").contains(needle))
    if route:
        out = out.filter(F.array_contains(text.route_tokens("routes"), route.upper()))
    return out if limit is None else out.orderBy("stop_name", "stop_id").limit(limit)


def alerts_for_routes(alerts: DataFrame, routes: Sequence[str]) -> DataFrame:
    return alerts.filter(F.arrays_overlap("affected_routes", F.array(*[F.lit(r) for r in routes])))


def active_alerts(alerts: DataFrame, now: Column, periods: str = "active_periods") -> DataFrame:
    """Alerts without periods, or with one that holds ``now``; ends may be open and count as inside."""
    inside = F.exists(periods, lambda p: (p["start"] <= now) & (p["end"].isNull() | (now <= p["end"])))
    return alerts.filter(F.col(periods).isNull() | (F.size(periods) == 0) | inside)


def upcoming_arrivals(updates: DataFrame, now: Column, wanted: DataFrame | None = None, back_seconds: int = 60,
                      ahead_seconds: int = 1200) -> DataFrame:
    """Stop updates due between a minute ago and the horizon, optionally for given stops or parents."""
    due = F.coalesce("arrival_time", "departure_time")
    s = (F.unix_micros(due) - F.unix_micros(now)) / F.lit(1e6)
    out = updates.withColumn("due", due).filter(F.col("stop_id").isNotNull() & s.between(-back_seconds, ahead_seconds))
    return out if wanted is None else arrivals_for_stops(out, wanted)


def arrivals_for_stops(updates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose stop or parent stop is wanted, as two hashable joins."""
    ids = wanted.select(F.col("stop_id").alias("_w")).distinct()
    exact = updates.join(ids, F.col("stop_id") == F.col("_w"), "left_semi")
    rest = updates.join(ids, F.col("stop_id") == F.col("_w"), "left_anti")
    return exact.unionByName(rest.join(ids, text.parent_stop("stop_id") == F.col("_w"), "left_semi"))


def positions_on_route(positions: DataFrame, route: str) -> DataFrame:
    return positions.filter(F.upper("route_id") == route.upper())


def positions_near_stop(positions: DataFrame, stop: str) -> DataFrame:
    """Positions whose next stop is the given stop or one of its platforms."""
    return positions.filter(F.col("next_stop_id").isin(stop, f"{stop}N", f"{stop}S"))


def with_failed_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Names of the rules a row breaks; a rule that is NULL counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed_rules", F.array_compact(F.array(*broken)))


def id_rules(route: str, stop: str, station: str, group: str, groups: Sequence[str]) -> dict[str, Column]:
    def shaped(c, pattern, size):
        return F.col(c).rlike(pattern) & F.length(c).between(1, size)
    return {
        "route_id": shaped(route, "(?i)^[A-Z0-9]{1,3}$", 3),
        "stop_id": shaped(stop, "(?i)^[A-Z0-9]+[NS]?$", 10),
        "station_id": shaped(station, r"(?i)^[A-Z]?\d+$", 10),
        "feed_group": F.col(group).isin(*groups),
    }


def with_valid_headsign(df: DataFrame, terminals, headsign: str = "headsign", next_stop: str = "next_stop_id",
                        route: str = "route_id") -> DataFrame:
    """Replace a missing headsign, or one that names the opposite terminal, by the terminal ahead."""
    north = {r: n for r, n, _ in terminals}
    south = {r: s for r, _, s in terminals}
    going = text.direction(next_stop)
    key = F.upper(F.col(route))
    ahead = F.when(going == "N", lookup(north, key)).when(going == "S", lookup(south, key))
    behind = F.when(going == "N", lookup(south, key)).when(going == "S", lookup(north, key))
    mark = F.split(F.split(F.lower(behind), "-")[0], " ")[0]
    named = F.col(headsign)
    missing = named.isNull() | (named == "")
    fixed = F.when(ahead.isNotNull() & (missing | F.lower(named).contains(mark)), ahead)
    return df.withColumn("headsign_shown", F.coalesce(fixed, F.when(missing, "Unknown").otherwise(named)))
