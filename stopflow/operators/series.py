"""Time series: grids, rolling and lag features, decomposition, splits, trajectories.

Two forms of row windows are offered. ``calendar_*`` functions expect series with one row per key
and calendar step, whose length the calendar bounds, and use plain windows. ``rolling_features``
takes raw rows of any number per key and cuts keys into overlapping blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage
from .joins import join_aggregate
from .ordered import framed, with_position, with_previous, with_rank_of_values, with_running_sum


def daily_series(df: DataFrame, ts: str, keys: Sequence[str], measures: dict[str, Column], step: str = "day") -> DataFrame:
    return df.groupBy(*keys, F.to_date(F.date_trunc(step, ts)).alias("date")).agg(*[c.alias(n) for n, c in measures.items()])


def resample_ffill(series: DataFrame, keys: Sequence[str], date: str, value: str, step: str = "day") -> DataFrame:
    """Mean per calendar step on a gap-free grid per key, missing steps filled forward."""
    stepped = series.groupBy(*keys, F.to_date(F.date_trunc(step, date)).alias(date)).agg(F.avg(value).alias(value))
    grid = stepped.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).select(
        *keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval 1 {step}"))).alias(date))
    ordered = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return (grid.join(stepped, [*keys, date], "left")
            .withColumn(value, F.last(value, ignorenulls=True).over(ordered)))


def rolling_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, value: str,
                     means: Sequence[int] = (), stds: Sequence[int] = (), lags: Sequence[int] = (),
                     fill_std: bool = False, block: int = 100_000, prefix: str = "") -> DataFrame:
    """Rolling means and deviations over the last k rows and lags, for keys of any length."""
    placed = with_position(df, keys, order, segment, "_pos")
    made = {}

    def last(k, window):
        return window.rowsBetween(-(k - 1), 0)

    for k in means:
        made[f"{prefix}rolling_mean_{k}"] = lambda w, k=k: F.avg(value).over(last(k, w))
    for k in stds:
        made[f"{prefix}rolling_std_{k}"] = lambda w, k=k: F.stddev_samp(value).over(last(k, w))
    for n in lags:
        made[f"{prefix}lag_{n}"] = lambda w, n=n: F.lag(value, n).over(w)
    reach = max([k - 1 for k in (*means, *stds)] + list(lags) + [0])
    out = framed(placed, keys, "_pos", reach, 0, made, block)
    if fill_std:
        out = out.fillna(0.0, subset=[f"{prefix}rolling_std_{k}" for k in stds])
    return out.drop("_pos")


def calendar_features(series: DataFrame, keys: Sequence[str], date: str, value: str, means: Sequence[int] = (),
                      stds: Sequence[int] = (), lags: Sequence[int] = (), change: Sequence[int] = ()) -> DataFrame:
    """Rolling, lag and relative-change columns of a calendar series, by row offset."""
    w = Window.partitionBy(*keys).orderBy(date)
    out = {}
    for k in means:
        out[f"rolling_mean_{k}"] = F.avg(value).over(w.rowsBetween(-(k - 1), 0))
    for k in stds:
        out[f"rolling_std_{k}"] = F.stddev_samp(value).over(w.rowsBetween(-(k - 1), 0))
    for n in lags:
        out[f"lag_{n}"] = F.lag(value, n).over(w)
    for n in change:
        out[f"change_{n}"] = F.try_divide(F.col(value), F.lag(value, n).over(w)) - 1
    return series.withColumns(out)


def mean_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, value: str, k: int,
              threshold: float, name: str = "alert_active", block: int = 100_000) -> DataFrame:
    """1 where the mean of the last k rows passes the threshold."""
    placed = with_position(df, keys, order, segment, "_pos")
    flag = {name: lambda w: (F.avg(value).over(w.rowsBetween(-(k - 1), 0)) > threshold).cast("int")}
    return framed(placed, keys, "_pos", k - 1, 0, flag, block).drop("_pos")


def decompose(series: DataFrame, keys: Sequence[str], date: str, value: str, period: int) -> DataFrame:
    """Additive trend, seasonal and residual of a gap-free calendar series.

    The trend is a centred moving average (half weights at both ends when the period is even), empty
    near the borders. Series shorter than two periods are returned as ``insufficient``.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    whole = Window.partitionBy(*keys)
    half = period // 2
    around = w.rowsBetween(-half, half)
    total = F.sum(value).over(around)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    full = F.count(value).over(around) == 2 * half + 1
    placed = series.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    trended = placed.withColumn("trend", F.when((F.col("_n") >= 2 * period) & full, total / period))
    phased = trended.withColumn("_phase", F.col("_i") % period)
    phase = phased.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    centred = phase.withColumn("_s", F.col("_s") - F.avg("_s").over(Window.partitionBy(*keys)))
    on = [*keys, "_phase"]
    return phased.join(centred, on).select(
        *keys, date, value, "trend", F.when(F.col("_n") >= 2 * period, F.col("_s")).alias("seasonal"),
        F.when(F.col("_n") >= 2 * period, F.col(value) - F.col("trend") - F.col("_s")).alias("residual"),
        F.when(F.col("_n") >= 2 * period, "ok").otherwise("insufficient").alias("status"))


def chronological_split(df: DataFrame, order: Sequence[str], segment: Column, test_rows: int | None = None,
                        train_share: float = 0.8) -> DataFrame:
    """Mark rows ``train`` or ``test`` by global position, without one partition holding all rows.

    The rows are read three times here and again by whatever weighs or trains on them, so they are computed once and written.
    """
    df = cut_lineage(df)
    placed = with_position(df, [], order, segment, "_pos")
    n = df.agg(F.count("*")).scalar()
    cut = F.floor(n * F.lit(train_share)) if test_rows is None else n - test_rows
    return placed.withColumn("part", F.when(F.col("_pos") <= cut, "train").otherwise("test")).drop("_pos")


def running_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, segment: Column | str,
                     name: str = "distinct_so_far") -> DataFrame:
    """Distinct values seen so far per key: a running sum over first sightings, which are found by aggregation."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    renamed = first.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col(value).alias("_f_value"), "_first")
    cond = (F.col(value) == F.col("_f_value")) & (F.struct(*order) == F.col("_first"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    marked = df.join(renamed, cond, "left").withColumn("_new", F.col("_first").isNotNull().cast("bigint"))
    marked = marked.drop("_first", "_f_value", *[f"_f_{k}" for k in keys])
    return with_running_sum(marked, keys, order, {name: "_new"}, segment).drop("_new")


def trajectory(positions: DataFrame, segment: Column, trip: str = "trip_id", at: str = "captured_at", tie: str = "position_id",
               min_hours: float = 0.0001) -> DataFrame:
    """Distance, hours and speed from the previous point of the trip; no speed for tiny steps."""
    clean = positions.filter(F.col(trip).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(at).isNotNull())
    back = with_previous(clean, [trip], [at, tie], {"_lat": "lat", "_lon": "lon", "_at": at}, segment)
    hours = (F.col(at) - F.col("_at")) / F.lit(3_600_000.0)
    km = geo.haversine_km("_lat", "_lon", "lat", "lon")
    return back.withColumns({"segment_km": km, "segment_hours": hours,
                             "segment_speed": F.when(hours > min_hours, km / hours)}).drop("_lat", "_lon", "_at")


def sorted_index(df: DataFrame, column: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Index of each value in the sorted order of its own type, from 0; NULL has none.

    ``source`` is a cheaper table with the same values, so a long chain behind ``df`` does not run for them once more.
    """
    values = (df if source is None else source).select(column).filter(F.col(column).isNotNull()).distinct()
    return join_aggregate(df, with_rank_of_values(values, column, name), [column])
