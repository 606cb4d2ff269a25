"""Rounding, text-to-number and literal-map helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: Column | str, digits: int = 0) -> Column:
    """Round half towards plus infinity, so -2.5 becomes -2."""
    scale = 10.0 ** digits
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def js_round_long(c: Column | str) -> Column:
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def mean_tenths(c: Column | str) -> Column:
    """Mean, to one decimal, of values that have one decimal; summed as whole tenths, so exact."""
    return F.floor(F.avg(js_round_long(col(c) * 10)) + F.lit(0.5)).cast("double") / F.lit(10.0)


def blank_to_null(c: Column | str) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)), F.lit(""))


def _plain(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(c)), "[,%]", "")


def parse_long(c: Column | str, null_as_zero: bool = False) -> Column:
    """Whole number with thousands separators; a fraction is cut, blank is NULL (or 0)."""
    parsed = F.expr("double(null)") if c is None else _plain(c).try_cast("double").cast("bigint")
    return F.coalesce(parsed, F.lit(0).cast("bigint")) if null_as_zero else parsed


def parse_double(c: Column | str, null_as_zero: bool = False) -> Column:
    """Decimal number with thousands separators or a trailing percent sign."""
    parsed = _plain(c).try_cast("double")
    return F.coalesce(parsed, F.lit(0.0)) if null_as_zero else parsed


def lookup(mapping: dict, c: Column | str, default: Column | None = None) -> Column:
    """Constant map lookup; ``default`` (or NULL) where the key is unknown."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.create_map(*entries)[col(c)]
    return found if default is None else F.coalesce(found, default)


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def interpolate(start: Column | str, end: Column | str, progress: Column | str) -> Column:
    """Linear interpolation; progress is clamped to [0, 1]."""
    return col(start) + (col(end) - col(start)) * clamp(progress, 0.0, 1.0)


def progress(now: Column, start: Column, end: Column) -> Column:
    """Clamped share of the way from start to end; NULL when the span is not positive."""
    return F.when(end > start, clamp((now - start) / (end - start), 0.0, 1.0))


def seconds_to_minutes(c: Column | str) -> Column:
    return js_round(col(c) / F.lit(60.0), 1)


def cyclic(c: Column | str, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    angle = col(c) * F.lit(2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def delay_class(c: Column | str, minor: float = 120.0, major: float = 300.0) -> Column:
    return (F.when(col(c) < minor, "on_time").when(col(c) < major, "minor")
            .when(col(c).isNotNull(), "major"))
