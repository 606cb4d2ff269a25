"""Seven historical CSV datasets cleaned and typed by one table-driven operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_double, parse_long, text_or_empty
from ..functions.times import normalize_date
from .readers import read_csv_by_header


@dataclass(frozen=True)
class Dataset:
    """Output columns in order: (name, source header, kind)."""

    name: str
    columns: tuple[tuple[str, str, str], ...]

    @property
    def source_schema(self) -> str:
        return ", ".join(f"`{header}` string" for _, header, _ in self.columns)


MONTHLY = (("month", "month", "date"), ("division", "division", "text"), ("line", "line", "text"))

DATASETS = {d.name: d for d in (
    Dataset("daily_ridership", (("date", "Date", "date"), ("mode", "Mode", "text"), ("count", "Count", "long"))),
    Dataset("terminal_otp", (*MONTHLY, ("day_type", "day_type", "text"), ("num_on_time_trips", "num_on_time_trips", "long"),
                             ("num_sched_trips", "num_sched_trips", "long"),
                             ("terminal_on_time_performance", "terminal_on_time_performance", "double"))),
    Dataset("major_incidents", (*MONTHLY, ("day_type", "day_type", "text"), ("category", "category", "text"), ("incident_count", "count", "long"))),
    Dataset("fare_evasion", (("time_period", "Time Period", "text"), ("fare_evasion_pct", "Fare Evasion", "double"),
                             ("margin_of_error", "Margin of Error", "double"))),
    Dataset("mdbf", (("month", "Month", "date"), ("division", "Division", "text"), ("car_class", "Car Class", "text"), ("total_miles", "Total Miles", "long"),
                     ("number_of_failures", "Number of Failures", "long"), ("number_of_cars", "Number of Cars", "long"), ("mdbf", "MDBF", "double"),
                     ("twelve_month_avg_mdbf", "12-Month Average MDBF", "double"))),
    Dataset("customer_journey", (*MONTHLY, ("period", "period", "text"), ("num_passengers", "num_passengers", "double"),
                                 ("additional_platform_time", "additional platform time", "double"), ("additional_train_time", "additional train time", "double"),
                                 ("total_apt", "total_apt", "double"), ("total_att", "total_att", "double"), ("over_five_mins", "over_five_mins", "double"),
                                 ("over_five_mins_pct", "over_five_mins_perc", "double"),
                                 ("customer_journey_time_performance", "customer journey time performance", "double"))),
    Dataset("service_delivered", (*MONTHLY, ("day_type", "day_type", "text"), ("num_sched_trains", "num_sched_trains", "long"),
                                  ("num_actual_trains", "num_actual_trains", "long"), ("service_delivered_pct", "service delivered", "double"))),
)}


def clean(rows: DataFrame, dataset: Dataset, null_as_zero: bool = True) -> DataFrame:
    """Typed columns from text: dates to ISO, numbers without separators, missing numbers 0 unless told otherwise."""
    def typed(header: str, kind: str) -> Column:
        source = F.col(f"`{header}`")
        if kind == "date":
            return F.coalesce(normalize_date(source), F.lit(""))
        if kind == "long":
            return parse_long(source, null_as_zero)
        if kind == "double":
            return parse_double(source, null_as_zero)
        return text_or_empty(source)

    return rows.select(*[typed(header, kind).alias(name) for name, header, kind in dataset.columns])


def load(spark: SparkSession, path: str, name: str, null_as_zero: bool = True) -> DataFrame:
    dataset = DATASETS[name]
    return clean(read_csv_by_header(spark, path, dataset.source_schema), dataset, null_as_zero)


def convert(spark: SparkSession, csv_path: str, name: str, out_path: str) -> None:
    """CSV to Parquet."""
    load(spark, csv_path, name).write.mode("overwrite").parquet(out_path)
