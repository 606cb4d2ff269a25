"""Identifiers, keys and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, lookup


def direction(stop_id: Column | str, unknown: str | None = None) -> Column:
    """N or S from the id suffix, else ``unknown``."""
    c = col(stop_id)
    return F.when(c.endswith("N"), "N").when(c.endswith("S"), "S").otherwise(F.lit(unknown))


def direction_label(d: Column | str) -> Column:
    return F.when(col(d) == "N", "Northbound").when(col(d) == "S", "Southbound").otherwise("Unknown")


def parent_stop(stop_id: Column | str) -> Column:
    c = col(stop_id)
    return F.when(c.endswith("N") | c.endswith("S"), F.left(c, F.length(c) - 1)).otherwise(c)


def canonical_route(route_id: Column | str, aliases: dict[str, str]) -> Column:
    upper = F.upper(col(route_id))
    return lookup(aliases, upper, upper)


def route_tokens(routes: Column | str) -> Column:
    """Upper-case route tokens of a space, comma or slash separated list."""
    return F.filter(F.split(F.upper(F.coalesce(col(routes), F.lit(""))), r"[\s,/]+"), lambda t: t != "")


def trip_suffix(trip_id: Column | str) -> Column:
    c = col(trip_id)
    at = F.instr(c, "-00_")
    return F.when((at > 0) & (F.length(c) > at + 3), F.substr(c, at + 4))


def trip_shape(trip_id: Column | str) -> Column:
    found = F.regexp_extract(col(trip_id), r"(?i)_([A-Z0-9]+\.\.[NS][A-Z0-9]*)$", 1)
    return F.when(found != "", found)


def shape_direction(shape: Column | str) -> Column:
    found = F.upper(F.regexp_extract(col(shape), r"(?i)\.\.([NS])", 1))
    return F.when(found != "", found)


def trip_key(trip_id: Column | str) -> Column:
    """Trip id (after its schedule prefix) cut after its ``..N`` or ``..S`` mark; ids without the mark are kept."""
    # one expression that uses its input once: a derived id is not copied into the plan several times
    return F.regexp_extract(col(trip_id), r"^(?:.*?-00_)?(.*?\.\..|.*)", 1)


def key_part(key: Column | str, index: int, sep: str = "#") -> Column:
    """Part ``index`` (from 0) of a composite key, NULL when absent or empty."""
    part = F.try_element_at(F.split(col(key), sep), F.lit(index + 1))
    return F.when(part != "", part)


def compose_key(*parts: Column | str, sep: str = ":") -> Column:
    return F.concat_ws(sep, *[col(p).cast("string") for p in parts])


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]*>", "")


def truncate_text(c: Column | str, size: int) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def preferred_text(translations: Column | str, prefer_html: bool = False) -> Column:
    """Text of the wanted language from ``array<struct<text, language>>``."""
    items = col(translations)

    def of(language: str) -> Column:
        hit = F.try_element_at(F.filter(items, lambda t: t["language"] == language), F.lit(1))["text"]
        return F.when(hit != "", hit)

    first = F.try_element_at(items, F.lit(1))["text"]
    order = [of("en-html"), of("en")] if prefer_html else [of("en"), of("en-html")]
    return F.coalesce(*order, first, F.lit(""))


def content_id(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def lead_sentences(c: Column | str, count: int = 2, min_length: int = 10) -> Column:
    """First ``count`` sentences longer than ``min_length`` characters."""
    parts = F.split(col(c), r"(?<=[.!?])\s+")
    return F.concat_ws(" ", F.slice(F.filter(parts, lambda s: F.length(F.trim(s)) > min_length), 1, count))


def natural_order(c: Column | str) -> list[Column]:
    """Sort keys that put numbers first by value, then letters."""
    return [col(c).try_cast("int").asc_nulls_last(), col(c).asc()]
