"""Group summaries, pivots, shares and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import _match, exact_quantiles


def group_summary(df: DataFrame, keys: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per group."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                 F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, bucket)
    return _match(base, quartiles, list(keys))


def category_pivot(df: DataFrame, row: Sequence[str], category: str, values: Sequence[str], measure: Column) -> DataFrame:
    """Rows by category, zero filled."""
    return df.groupBy(*row).pivot(category, list(values)).agg(measure).fillna(0)


def category_totals(df: DataFrame, category: str, measure: Column, name: str = "total") -> DataFrame:
    return df.groupBy(category).agg(measure.alias(name))


def matrix_by_total(df: DataFrame, row: str, category: str, values: Sequence[str], measure: Column) -> DataFrame:
    """Row by category matrix, largest row total first."""
    wide = category_pivot(df, [row], category, values, measure)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return wide.withColumn("row_total", total).orderBy(F.desc("row_total"), row)


def service_by_line(df: DataFrame, line: str, value: str, date: str | None = None, day_type: str | None = None,
                    good: float = 95, fair: float = 90) -> DataFrame:
    """Mean per line, by weekday and weekend, with a band; the day type is derived from the date when absent."""
    kind = F.col(day_type) if day_type else F.when(F.weekday(date) >= 5, "Weekend").otherwise("Weekday")
    out = df.groupBy(line).agg(F.avg(value).alias("service_pct"), F.avg(F.when(kind == "Weekday", F.col(value))).alias("weekday_pct"),
                               F.avg(F.when(kind == "Weekend", F.col(value))).alias("weekend_pct"))
    band = F.when(F.col("service_pct") >= good, "good").when(F.col("service_pct") >= fair, "fair").otherwise("poor")
    return out.withColumn("band", band).orderBy(F.desc("service_pct"), line)


def hour_matrix(df: DataFrame, row: str, ts: str, value: str) -> DataFrame:
    """Row by hour means, ordered by the row's overall mean, highest first."""
    hours = df.select(row, F.hour(ts).alias("_h"), F.col(value).alias("_v"))
    cells = [F.avg(F.when(F.col("_h") == h, F.col("_v"))).alias(f"h{h:02d}") for h in range(24)]
    return hours.groupBy(row).agg(F.avg("_v").alias("overall"), *cells).orderBy(F.desc("overall"), row)


def class_share_by_weekday(df: DataFrame, ts: str, value: str, minor: float = 120, major: float = 300) -> DataFrame:
    """Percent of each delay class per weekday (0 = Monday); bounds belong to the lower class."""
    v = F.col(value)
    kind = F.when(v <= minor, "on_time").when(v <= major, "minor").when(v.isNotNull(), "major")
    counts = df.groupBy(F.weekday(ts).alias("day_of_week")).agg(
        F.count(kind).alias("_n"), *[F.count_if(kind == k).alias(k) for k in ("on_time", "minor", "major")])
    return counts.select("day_of_week", *[(F.col(k) * 100.0 / F.col("_n")).alias(f"{k}_pct") for k in ("on_time", "minor", "major")])


def weekday_weekend(df: DataFrame, date: str, value: str) -> DataFrame:
    weekend = F.weekday(date) >= 5
    out = df.agg(F.avg(F.when(~weekend, F.col(value))).alias("weekday_mean"), F.avg(F.when(weekend, F.col(value))).alias("weekend_mean"))
    return out.withColumn("weekend_pct", F.col("weekend_mean") / F.col("weekday_mean") * 100)


def recovery(df: DataFrame, date: str, value: str, year: int, month: int) -> DataFrame:
    """Each value as percent of the mean of a baseline month."""
    base = df.filter((F.year(date) == year) & (F.month(date) == month)).agg(F.avg(value)).scalar()
    return df.withColumn("recovery_pct", F.col(value) / base * 100)


# ---- Welch's test -----------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def welch_test(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """Welch's t statistic, degrees of freedom and p-value; one aggregation, one result row."""
    aggs = []
    for tag, name in (("a", first), ("b", second)):
        v = F.when(F.col(group) == name, F.col(value))
        aggs += [F.count(v).alias(f"n_{tag}"), F.avg(v).alias(f"mean_{tag}"), F.var_samp(v).alias(f"var_{tag}")]
    se = [F.col(f"var_{x}") / F.col(f"n_{x}") for x in "ab"]
    total = se[0] + se[1]
    out = df.agg(*aggs).withColumns({
        "t": (F.col("mean_a") - F.col("mean_b")) / F.sqrt(total),
        "df": total * total / (se[0] * se[0] / (F.col("n_a") - 1) + se[1] * se[1] / (F.col("n_b") - 1))})

    @F.pandas_udf("double")
    def p_value(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, f in parts:
            yield pd.Series([t_two_sided(x, y) for x, y in zip(t, f)])

    return out.withColumn("p_value", p_value("t", "df"))


