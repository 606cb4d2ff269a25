"""Sinks: partitioned archives, feature sets, keyed upserts, expiry, catalogue tables, GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest_per_key

# ---- time-partitioned files ------------------------------------------------------


def with_partitions(df: DataFrame, ts: Column, hour: bool = True) -> DataFrame:
    """Zero-padded UTC partition columns."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", **({"hour": "HH"} if hour else {})}
    return df.withColumns({name: F.date_format(ts, pattern) for name, pattern in parts.items()})


def stamped_positions(positions: DataFrame, captured_at: Column, feed_group: Column) -> DataFrame:
    """Capture time (not write time) and feed group, with the hour partitions of the capture."""
    stamped = positions.withColumns({"capturedAt": captured_at.cast("bigint"), "feedGroupId": feed_group})
    return with_partitions(stamped, F.timestamp_millis("capturedAt"))


def archive_positions(positions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stream of stamped positions to gzip JSON lines by hour. The file sink commits each batch once."""
    return (positions.writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("year", "month", "day", "hour").outputMode("append").trigger(**(trigger or {"processingTime": "60 seconds"})).start())


def change_kind(image: str = "image") -> Column:
    """``metrics`` or ``events`` by the fields an item has; NULL for others."""
    i = F.col(image)
    return F.when(i["routeId"].isNotNull() & i["trainCount"].isNotNull(), "metrics").when(i["pk"].isNotNull(), "events")


def classified_changes(changes: DataFrame) -> DataFrame:
    """Inserted or modified items with their kind; others are dropped."""
    kept = changes.filter(F.col("eventName").isin("INSERT", "MODIFY") & F.col("image").isNotNull())
    return kept.withColumn("kind", change_kind()).filter(F.col("kind").isNotNull())


def change_rows(changes: DataFrame, kind: str, written_at: Column, columns: Sequence[str]) -> DataFrame:
    """Items of one kind with the partition columns of its layout (metrics by hour, events by day)."""
    rows = classified_changes(changes).filter(F.col("kind") == kind).select(*[F.col(f"image.{c}").alias(c) for c in columns], written_at.alias("_at"))
    return with_partitions(rows, F.col("_at"), hour=kind == "metrics").drop("_at")


def write_changes(changes: DataFrame, kind: str, path: str, checkpoint: str, written_at: Column, columns: Sequence[str],
                  trigger: dict | None = None) -> StreamingQuery:
    """One file-sink stream per kind, so each commits its files exactly once."""
    rows = change_rows(changes, kind, written_at, columns)
    parts = [c for c in ("year", "month", "day", "hour") if c in rows.columns]
    return (rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*parts)
            .outputMode("append").trigger(**(trigger or {"processingTime": "60 seconds"})).start())


# ---- feature sets -----------------------------------------------------------------


def write_features(df: DataFrame, path: str, ts: str, processing_date: str | None = None) -> None:
    """By (year, month), replacing the months written; or appended by (year, month, processing_date).

    An append replaces its own processing date in the months it touches, so a rerun adds nothing twice.
    """
    parts = ["year", "month"]
    out = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    if processing_date is not None:
        out = out.withColumn("processing_date", F.lit(processing_date))
        parts.append("processing_date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_forecast(forecast: DataFrame, csv_path: str, metrics: DataFrame, json_path: str) -> None:
    forecast.write.mode("overwrite").option("header", True).csv(csv_path)
    metrics.write.mode("overwrite").json(json_path)


# ---- keyed upserts ------------------------------------------------------------------


def upsert_batch(batch: DataFrame, path: str, batch_id: int, keys: Sequence[str], version: str) -> None:
    """Write the batch's last row per key into its own partition; running a batch again replaces it."""
    last = latest_per_key(batch, list(keys), F.col(version))
    last.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def current_rows(spark: SparkSession, path: str, schema: str, keys: Sequence[str], version: str) -> DataFrame:
    """Last row per key over all batches: by version, later batches first on ties."""
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    return latest_per_key(rows, list(keys), F.struct(version, "batch_id")).drop("batch_id")


def compact(spark: SparkSession, path: str, out_path: str, schema: str, keys: Sequence[str], version: str) -> None:
    """Write the current rows as batch 0 of a new table."""
    rows = current_rows(spark, path, schema, keys, version).withColumn("batch_id", F.lit(0).cast("bigint"))
    rows.write.mode("errorifexists").partitionBy("batch_id").parquet(out_path)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, trigger: dict | None = None) -> StreamingQuery:
    keys = list(keys)
    return (rows.writeStream.foreachBatch(lambda batch, batch_id: upsert_batch(batch, path, batch_id, keys, version))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start())


# ---- expiry --------------------------------------------------------------------------


def with_expiry(df: DataFrame, now: Column, days: int) -> DataFrame:
    """``expire_at`` in epoch seconds."""
    return df.withColumn("expire_at", (F.floor(F.unix_micros(now) / F.lit(1_000_000)) + days * 86400).cast("bigint"))


def unexpired(df: DataFrame, now: Column, column: str = "expire_at") -> DataFrame:
    return df.filter(F.col(column) > F.floor(F.unix_micros(now) / F.lit(1_000_000)))


# ---- catalogue -------------------------------------------------------------------------


def register_table(spark: SparkSession, name: str, schema: str, path: str, file_format: str = "parquet", partitions: Sequence[str] = ()) -> None:
    """External table with explicit columns; a partitioned one picks up the partitions present."""
    by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING {file_format}{by} LOCATION '{path}'")
    if partitions:
        refresh_partitions(spark, name)


def refresh_partitions(spark: SparkSession, name: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE {name}")


# ---- GeoJSON ----------------------------------------------------------------------------


def route_features(vertices: DataFrame, colours: DataFrame, fallback: str = "#888888", max_vertices: int = 50_000) -> DataFrame:
    """GeoJSON features with one MultiLineString per route, lines in shape order.

    A feature holds at most about ``max_vertices`` vertices. Shapes are cut into lines of that length
    that share their end vertex, and a route with more gets several features, numbered by ``part``,
    that together hold all of it.
    """
    blocks = vertices.withColumn("_block", F.explode(F.array_distinct(F.array(
        F.floor(F.col("seq") / max_vertices), F.floor(F.greatest(F.col("seq") - 1, F.lit(0)) / max_vertices)))))
    lines = blocks.groupBy("route_id", "shape_id", "_block").agg(F.count("*").alias("_n"), F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"])).alias("_line"))
    order = Window.partitionBy("route_id").orderBy("shape_id", "_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.withColumn("part", F.floor(F.coalesce(F.sum("_n").over(order), F.lit(0)) / max_vertices))
    packed = parts.groupBy("route_id", "part").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("shape_id", "_block", "_line"))), lambda x: x["_line"]).alias("_coords"))
    named = packed.join(colours, "route_id", "left")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(
        F.col("route_id").cast("string").alias("route_id"), F.coalesce("color", F.lit(fallback)).alias("color"),
        F.concat(F.col("route_id").cast("string"), F.lit(" Train")).alias("name")).alias("properties"),
        F.struct(F.lit("MultiLineString").alias("type"), F.col("_coords").alias("coordinates")).alias("geometry"))
    return named.select("route_id", "part", F.to_json(feature).alias("feature"))
