"""Clock text, service days, local time and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, js_round_long

UTC = "UTC"


def clock_to_seconds(c: Column | str, truncate_minutes: bool = False) -> Column:
    """``HH:MM:SS`` with hours that may pass 24 to seconds; malformed text is NULL."""
    parts = F.split(F.trim(col(c)), ":")
    ok = F.trim(col(c)).rlike("^[0-9]{1,3}:[0-9]{1,2}(:[0-9]{1,2})?$")
    hours, minutes = parts[0].try_cast("bigint"), parts[1].try_cast("bigint")
    seconds = F.lit(0) if truncate_minutes else F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("bigint"), F.lit(0))
    return F.when(ok, hours * 3600 + minutes * 60 + seconds)


def local_time(ts: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def local_date(ts: Column | str, zone: str) -> Column:
    return F.to_date(local_time(ts, zone))


def seconds_of_local_day(ts: Column | str, zone: str) -> Column:
    """Wall-clock seconds since local midnight, by real zone rules."""
    return F.pmod(F.floor(F.unix_micros(local_time(ts, zone)) / F.lit(1_000_000)), F.lit(86400)).cast("bigint")


def epoch_to_timestamp(c: Column | str) -> Column:
    """Epoch seconds or milliseconds (told apart by size) to timestamp; negative is NULL."""
    n = col(c).cast("bigint")
    return F.when(n >= 0, F.timestamp_millis(F.when(n < F.lit(100_000_000_000), n * 1000).otherwise(n)))


def service_day_type(date: Column | str) -> Column:
    day = F.weekday(col(date))
    return F.when(day == 5, "Saturday").when(day == 6, "Sunday").otherwise("Weekday")


def service_date(ts: Column | str, zone: str, roll_hours: int = 3) -> Column:
    """Local date where the first hours after midnight belong to the day before."""
    return F.to_date(local_time(ts, zone) - F.make_dt_interval(hours=F.lit(roll_hours)))


def normalize_date(c: Column | str, pivot_year: int = 50) -> Column:
    """``M/D/YY(YY)`` or ISO text to an ISO date; other text is kept, blank is NULL."""
    text = F.trim(col(c))
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
    year_text = F.regexp_extract(text, slash, 3)
    year = year_text.try_cast("int")
    full_year = F.when(F.length(year_text) == 2, F.when(year > pivot_year, year + 1900).otherwise(year + 2000)).otherwise(year)
    parts = [F.lpad(F.regexp_extract(text, slash, i), 2, "0") for i in (1, 2)]
    return (F.when(text == "", None)
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))
            .when(text.rlike(slash), F.concat_ws("-", full_year.cast("string"), *parts))
            .otherwise(text))


def relative_eta(when: Column | str, now: Column) -> Column:
    """``3m``, ``now`` or ``2m ago``; a dash when unknown."""
    seconds = js_round_long((F.unix_micros(col(when)) - F.unix_micros(now)) / F.lit(1e6))
    minutes = F.floor(seconds / 60).cast("bigint")
    ago = F.abs(js_round_long(seconds / 60))
    return (F.when(col(when).isNull(), "—")
            .when(seconds < -30, F.concat(ago.cast("string"), F.lit("m ago")))
            .when(seconds <= 30, "now")
            .when(minutes <= 1, "1m")
            .otherwise(F.concat(minutes.cast("string"), F.lit("m"))))


def eta_minutes_text(when: Column | str, now: Column, long: bool = False) -> Column:
    minutes = js_round_long((F.unix_micros(col(when)) - F.unix_micros(now)) / F.lit(6e7))
    unit = "minute" if long else "min"
    return (F.when(col(when).isNull(), "Unknown")
            .when(minutes <= 0, "Arriving now" if long else "Arriving")
            .when(minutes == 1, f"1 {unit}")
            .otherwise(F.concat(minutes.cast("string"), F.lit(f" {unit}s"))))


def local_clock(ts: Column | str, zone: str) -> Column:
    """``3:45 PM`` in the given zone."""
    return F.coalesce(F.date_format(local_time(ts, zone), "h:mm a"), F.lit("--:--"))


def minutes_to_clock(c: Column | str) -> Column:
    """Minutes of day (may pass 24 h) to ``h:mm AM``."""
    minutes = col(c).cast("bigint")
    hour = F.pmod(F.floor(minutes / 60).cast("bigint"), F.lit(24))
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    half = F.when(hour >= 12, "PM").otherwise("AM")
    return F.concat(twelve.cast("string"), F.lit(":"), F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"), F.lit(" "), half)


def period_text(periods: Column | str, zone: str) -> Column:
    """First active period as text; ``Ongoing`` without periods."""
    first = F.try_element_at(col(periods), F.lit(1))
    fmt = "MMM d, h:mm a"
    start = F.date_format(local_time(first["start"], zone), fmt)
    end = F.date_format(local_time(first["end"], zone), fmt)
    return (F.when(F.coalesce(F.size(col(periods)), F.lit(0)) <= 0, "Ongoing")
            .when(first["end"].isNull(), F.concat(F.lit("Starting "), start))
            .otherwise(F.concat(start, F.lit(" - "), end)))


def age_text(ts: Column | str, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(col(ts))) / F.lit(6e7)).cast("bigint")
    return (F.when(minutes < 1, "just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
            .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))))


def calendar_features(ts: Column | str) -> dict[str, Column]:
    """Calendar columns with Monday as day 0."""
    c = col(ts)
    dow = F.weekday(c)
    return {
        "day_of_week": dow, "month": F.month(c), "day_of_month": F.dayofmonth(c),
        "day_of_year": F.dayofyear(c), "week_of_year": F.weekofyear(c), "year": F.year(c),
        "is_weekend": (dow >= 5).cast("int"),
    }


def rush_flags(ts: Column | str, am: tuple[int, int] = (7, 9), pm: tuple[int, int] = (17, 19)) -> dict[str, Column]:
    """Hour-based flags on the clock of ``ts``; both ends of a rush period are included."""
    c = col(ts)
    hour, dow = F.hour(c), F.weekday(c)
    in_am, in_pm = hour.between(*am), hour.between(*pm)
    return {
        "hour": hour, "minute_of_day": hour * 60 + F.minute(c), "hour_x_dow": hour * dow,
        "is_am_rush": in_am.cast("int"), "is_pm_rush": in_pm.cast("int"),
        "is_rush_hour": (in_am | in_pm).cast("int"),
    }
