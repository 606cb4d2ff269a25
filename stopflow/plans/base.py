"""Registry of bound queries, the input tables, and the derived tables the bindings share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import js_round_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Lazy readers for the input tables, with explicit schemas and UTC as session zone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    # ---- shared derived tables; the SQL twins below must say the same ----

    @cached_property
    def arrivals(self) -> DataFrame:
        return arrivals_of(self.events)

    def stream(self, name: str) -> DataFrame:
        """The table as a file stream."""
        reader = self.spark.readStream.schema(SCHEMAS[name])
        table = f"{self.folder}/{name}.parquet"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            return reader.parquet(table)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    @cached_property
    def stops(self) -> DataFrame:
        """customers as stops of mixed id shapes, two route tokens each."""
        c = F.col("c_custkey")
        base = (F.when(c % 2 == 0, (c % 700).cast("string"))
                .otherwise(F.concat(F.char(F.lit(65) + c % 26), F.lpad((c % 100).cast("string"), 2, "0"))))
        suffix = F.when(c % 3 == 0, "N").when(c % 3 == 1, "S").otherwise("")
        return self.customer.select(
            c.alias("stop_key"), F.concat(base, suffix).alias("stop_id"), F.col("c_name").alias("stop_name"),
            F.concat_ws(" ", route_of(F.col("c_nationkey")), route_of(c)).alias("routes"),
            F.when(c % 3 < 2, base).alias("parent_station"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """documents as service alerts; severity from the labels."""
        n = F.col("n_chars")
        judged = self.documents.join(self.labels, "doc_id", "left")
        seconds = F.lit(1704067200) + (F.col("doc_id") % 720) * 3600
        return judged.select(
            F.col("doc_id").alias("alert_id"),
            F.element_at(F.array(*[F.lit(a) for a in ALERT_TYPES]), (n % len(ALERT_TYPES) + 1).cast("int")).alias("alert_type"),
            F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 1, "warning").otherwise("info").alias("severity"),
            F.col("text").alias("header_text"), F.array(route_of(F.col("doc_id")), route_of(n)).alias("affected_routes"),
            F.timestamp_seconds(seconds).alias("captured_at"),
            F.timestamp_seconds(seconds + n * 60).alias("updated_at"),
        )


def arrivals_of(events: DataFrame) -> DataFrame:
    """events as observed arrivals: route, direction, stop, time, delay, latency and status."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    stop = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "N").otherwise("S"))
    return events.select(
        F.col("event_id").alias("arrival_id"), F.col("event_type").alias("route_id"),
        text.direction(stop).alias("direction"), stop.alias("stop_id"), F.col("user_id").alias("trip_id"),
        "ts", js_round_long((F.col("value") - 20) * 15).alias("delay_seconds"), k.alias("latency_ms"),
        F.when(k < 3, "error").when(k < 6, "timeout").otherwise("success").alias("status"),
    )


# Alert kinds used by the bindings.
ALERT_TYPES = ["Delays", "Service Change", "Detour", "Suspension", "Cancellations", "Planned Work", "Information",
               "Station Notice"]

# The route ids used by the bindings.
ROUTE_IDS = ["1", "2", "3", "4", "5", "5X", "6", "6X", "7", "7X", "A", "B", "C", "D", "E", "F", "FS", "FX", "G",
             "GS", "H", "J", "L", "M", "N", "Q", "R", "S", "SI", "W", "Z"]


def route_of(n):
    return F.element_at(F.array(*[F.lit(r) for r in ROUTE_IDS]), (n % len(ROUTE_IDS) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_route_of(expr: str) -> str:
    return f"({sql_list(ROUTE_IDS)})[({expr}) % {len(ROUTE_IDS)} + 1]"


def r(expr: str, digits: int = 0) -> str:
    """SQL for rounding half up, as double."""
    return f"(floor(({expr})::DOUBLE * {float(10 ** digits)!r} + 0.5) / {float(10 ** digits)!r})"


def rl(expr: str) -> str:
    return f"floor(({expr})::DOUBLE + 0.5)::BIGINT"


def mt(expr: str, extra: str = "") -> str:
    """SQL for the exact mean of one-decimal values."""
    return f"(floor(avg(floor({expr} * 10.0 + 0.5)::BIGINT) {extra} + 0.5) / 10.0)"


def values_sql(rows, names: str, alias: str) -> str:
    def lit(v):
        return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({names})"


ARRIVALS = """arrivals AS (
  SELECT event_id AS arrival_id, event_type AS route_id,
         CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END AS direction,
         user_id::VARCHAR || CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END AS stop_id,
         user_id AS trip_id, ts, floor((value - 20) * 15 + 0.5)::BIGINT AS delay_seconds, k AS latency_ms,
         CASE WHEN k < 3 THEN 'error' WHEN k < 6 THEN 'timeout' ELSE 'success' END AS status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

STOPS = f"""stops AS (
  SELECT stop_key, base || suffix AS stop_id, c_name AS stop_name,
         {sql_route_of('c_nationkey')} || ' ' || {sql_route_of('stop_key')} AS routes,
         CASE WHEN stop_key % 3 < 2 THEN base END AS parent_station
  FROM (SELECT c_custkey AS stop_key, c_name, c_nationkey,
          CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 700)::VARCHAR
               ELSE chr((65 + c_custkey % 26)::INTEGER) || lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS base,
          CASE c_custkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS suffix
        FROM customer))"""

ALERTS = f"""alerts AS (
  SELECT d.doc_id AS alert_id, ({sql_list(ALERT_TYPES)})[n_chars % {len(ALERT_TYPES)} + 1] AS alert_type,
         CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 1 THEN 'warning' ELSE 'info' END AS severity,
         text AS header_text, [{sql_route_of('d.doc_id')}, {sql_route_of('n_chars')}] AS affected_routes,
         TIMESTAMP '2024-01-01' + to_hours(d.doc_id % 720) AS captured_at,
         TIMESTAMP '2024-01-01' + to_hours(d.doc_id % 720) + to_minutes(n_chars) AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def query(name: str, sql: str | None = None, covers: str = ""):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
