"""Live service facts: headways, window metrics with events, daily sums, feed status, metric feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import js_round, js_round_long
from ..operators import headways as H
from ..operators.ordered import _match, latest_per_key, with_running_sum
from ..sources.sinks import upsert_batch
from . import carry

KEYS = ("route_id", "direction")


def headway_stream(arrivals: DataFrame, out_path: str, state_path: str, checkpoint: str, keys: Sequence[str] = (*KEYS, "stop_id"),
                   ts: str = "ts", tie: str = "arrival_id", trigger: dict | None = None, **limits) -> StreamingQuery:
    """Headways of a stream of arrivals.

    The state is the last arrival per key, so its size is the number of route, direction and stop
    combinations. Arrivals older than the carried one get no headway from it.
    """
    schema = carry.schema_text(arrivals)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carried = carry.read_before(spark, state_path, schema, batch_id)
        both = carried.withColumn("_carried", F.lit(True)).unionByName(batch.withColumn("_carried", F.lit(False)))
        made = H.headways(both, keys, ts, tie, **limits)
        carry.write_part(made.filter(~F.col("_carried")).drop("_carried"), out_path, batch_id)
        carry.write_state(latest_per_key(both.drop("_carried"), list(keys), F.struct(ts, tie)), state_path, batch_id)

    return carry.run_batches(arrivals, each, checkpoint, trigger)


# A window's rows of one key lie in so many state rows, by stop: few, since each costs a read and a write, and none holds all of a busy window.
SHARDS = 4


def _shard():
    return F.pmod(F.xxhash64("stop_id"), F.lit(SHARDS)).alias("shard")


def _n_polls():
    return F.size(F.array_distinct(F.flatten(F.collect_list("polls"))))


def window_partials(observed: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes", poll: str = "minute",
                    keys: Sequence[str] = KEYS, on_time: float = 300) -> DataFrame:
    """Streaming sums per window, key and shard of stops; a window's rows leave together when the watermark passes its end.

    ``polls`` are the polls seen, ``worst`` the largest delay and its stop, ``bunches`` and ``gaps`` one stop per flag.
    """
    delay, stop = F.col("delay_seconds"), F.struct("stop_id")
    late = observed.withWatermark("ts", watermark)
    return late.groupBy(F.window("ts", window).alias("w"), *keys, _shard()).agg(
        F.count("*").alias("n"), F.sum(delay).alias("sum_delay"), F.count(delay).alias("n_delay"),
        F.count_if(F.abs(delay) < on_time).alias("n_on_time"), F.sum("headway_seconds").alias("sum_headway"),
        F.count("headway_seconds").alias("n_headway"), F.sum("latency_ms").alias("sum_latency"), F.count("latency_ms").alias("n_latency"),
        F.max(F.struct("ts", "arrival_id", "status")).alias("last"), F.count_if("is_bunch").alias("n_bunch"), F.count_if("is_gap").alias("n_gap"),
        F.collect_set(F.date_trunc(poll, "ts")).alias("polls"), F.min(F.when(delay.isNotNull(), F.struct((-delay).alias("early"), "stop_id"))).alias("worst"),
        F.collect_list(F.when(F.col("is_bunch"), stop)).alias("bunches"), F.collect_list(F.when(F.col("is_gap"), stop)).alias("gaps"),
    ).select(F.col("w.start").alias("window_start"), "*").drop("w", "shard")


def fold_metrics(partials: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Window metrics from closed windows' partial rows."""
    sums = partials.groupBy("window_start", *keys).agg((F.sum("n") / _n_polls()).alias("n"), *[F.sum(c).alias(c) for c in (
        "sum_delay", "n_delay", "n_on_time", "sum_headway", "n_headway", "sum_latency", "n_latency", "n_bunch", "n_gap")], F.max("last").alias("last"))
    return sums.select(
        *keys, "window_start", js_round_long("n").alias("train_count"),
        js_round(F.try_divide("sum_delay", "n_delay"), 1).alias("avg_delay_seconds"),
        js_round(F.try_divide(F.col("n_on_time") * 100.0, "n_delay"), 1).alias("on_time_percent"),
        js_round_long(F.try_divide("sum_headway", "n_headway")).alias("headway_avg_seconds"),
        js_round_long(F.try_divide("sum_latency", "n_latency")).alias("feed_latency_ms"), F.col("last.status").alias("feed_status"),
        F.col("n_bunch").alias("bunch_count"), F.col("n_gap").alias("gap_count"))


def fold_events(partials: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 300) -> DataFrame:
    """DELAY, BUNCH and GAP events from closed windows' partial rows."""
    def seen(stop, delay, bunch, gap):
        return F.struct(stop.alias("stop_id"), delay.alias("max_delay"), F.lit(bunch).alias("n_bunch"), F.lit(gap).alias("n_gap"))

    late = -F.col("worst.early")
    none = F.lit(None).cast(partials.select(late).schema[0].dataType)
    each = F.concat(F.array(seen(F.col("worst.stop_id"), late, 0, 0)), F.transform("bunches", lambda x: seen(x["stop_id"], none, 1, 0)),
                    F.transform("gaps", lambda x: seen(x["stop_id"], none, 0, 1)))
    stops = partials.select("window_start", *keys, F.inline(each)).groupBy("window_start", *keys, "stop_id").agg(
        F.max("max_delay").alias("max_delay"), F.sum("n_bunch").alias("n_bunch"), F.sum("n_gap").alias("n_gap"))
    return H.events_of_stops(stops, keys, threshold)


def metric_stream(observed: DataFrame, metrics_path: str, events_path: str, rollup_path: str, checkpoint: str, zone: str,
                  trigger: dict | None = None, **options) -> StreamingQuery:
    """Closed windows to three sinks: window metrics, service events, and additive daily sums."""
    partials = window_partials(observed, **options)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        metrics = fold_metrics(batch)
        carry.write_part(metrics, metrics_path, batch_id)
        carry.write_part(fold_events(batch), events_path, batch_id)
        daily = metrics.groupBy(F.to_date(F.from_utc_timestamp("window_start", zone)).alias("date"), *KEYS).agg(
            F.sum("train_count").alias("total_trains"), F.max("train_count").alias("peak_train_count"), F.count("*").alias("n_windows"),
            F.sum("bunch_count").alias("total_bunching"), F.sum("gap_count").alias("total_gaps"))
        carry.write_part(daily, rollup_path, batch_id)
        batch.unpersist()

    return carry.run_batches(partials, each, checkpoint, trigger)


def daily_sums(parts: DataFrame) -> DataFrame:
    """Daily totals from the parts the metric stream wrote."""
    return parts.groupBy("date", *KEYS).agg(F.sum("total_trains").alias("total_trains"), F.max("peak_train_count").alias("peak_train_count"),
                                            F.sum("n_windows").alias("n_windows"), F.sum("total_bunching").alias("total_bunching"), F.sum("total_gaps").alias("total_gaps"))


DAILY_PARTS = ("date date, route_id string, direction string, sum_delay double, n_delay bigint, n_on_time bigint, sum_headway double, n_headway bigint, total_bunching bigint, "
               "total_gaps bigint, peak_train_count bigint, total_trains bigint, n_windows bigint")
HEADWAY_COUNTS = "date date, route_id string, direction string, headway_seconds double, n bigint"


def daily_stream(observed: DataFrame, parts_path: str, counts_path: str, checkpoint: str, zone: str, watermark: str = "10 minutes", window: str = "5 minutes",
                 poll: str = "minute", on_time: float = 300, trigger: dict | None = None) -> StreamingQuery:
    """The whole daily roll-up as additive parts of closed windows: sums per local day and key, and counts per headway.

    The counts are an exact histogram that merges by adding, so a day's median needs no row of its own; a window's rows hold the
    headways of one shard of stops. ``daily_rollup_so_far`` reads the roll-up. A batch that runs again replaces its parts.
    """
    delay = F.col("delay_seconds")
    late = observed.withWatermark("ts", watermark)
    partials = late.groupBy(F.window("ts", window).alias("w"), *KEYS, _shard()).agg(
        F.count("*").alias("n"), F.sum(delay).alias("sum_delay"), F.count(delay).alias("n_delay"), F.count_if(F.abs(delay) < on_time).alias("n_on_time"),
        F.collect_set(F.date_trunc(poll, "ts")).alias("polls"), F.collect_list("headway_seconds").alias("headways"), F.count_if("is_bunch").alias("n_bunch"), F.count_if("is_gap").alias("n_gap"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("date", F.to_date(F.from_utc_timestamp("w.start", zone))).persist()
        headways = F.aggregate("headways", F.lit(0.0), lambda a, x: a + x)
        sums = [F.sum(c).alias(c) for c in ("sum_delay", "n_delay", "n_on_time", "sum_headway", "n_headway", "n_bunch", "n_gap")]
        shards = batch.withColumns({"sum_delay": F.col("sum_delay").cast("double"), "sum_headway": headways, "n_headway": F.size("headways")})
        windows = shards.groupBy("date", "w", *KEYS).agg(js_round_long(F.sum("n") / _n_polls()).alias("train_count"), *sums)
        daily = windows.groupBy("date", *KEYS).agg(
            *sums[:5], F.sum("n_bunch").alias("total_bunching"), F.sum("n_gap").alias("total_gaps"), F.max("train_count").alias("peak_train_count"),
            F.sum("train_count").alias("total_trains"), F.count("*").alias("n_windows"))
        carry.write_part(daily, parts_path, batch_id)
        counts = batch.select("date", *KEYS, F.explode("headways").alias("headway_seconds")).groupBy("date", *KEYS, "headway_seconds").agg(F.count("*").alias("n"))
        carry.write_part(counts, counts_path, batch_id)
        batch.unpersist()

    return carry.run_batches(partials, each, checkpoint, trigger)


def weighted_median(counts: DataFrame, keys: Sequence[str], value: str, n: str, name: str, bucket: float = 60.0) -> DataFrame:
    """Exact median per key from counts per value; even totals take the mean of the two values in the middle."""
    merged = counts.groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    upto = with_running_sum(merged, keys, [value], {"_upto": "_n"}, F.floor(F.col(value) / bucket))
    totals = merged.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    placed = _match(upto, totals, keys)
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)

    def at(place):
        return F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col(value)))

    return placed.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(name))


def daily_rollup_so_far(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """The columns of ``headways.daily_rollup`` from the parts that ``daily_stream`` wrote."""
    by_day = ["date", *KEYS]
    daily = parts.groupBy(*by_day).agg(
        js_round(F.try_divide(F.sum("sum_delay"), F.sum("n_delay")), 1).alias("avg_delay"),
        js_round(F.try_divide(F.sum("n_on_time") * 100.0, F.sum("n_delay")), 1).alias("on_time_percent"),
        js_round_long(F.try_divide(F.sum("sum_headway"), F.sum("n_headway"))).alias("avg_headway"), F.sum("total_bunching").alias("total_bunching"),
        F.sum("total_gaps").alias("total_gaps"), F.max("peak_train_count").alias("peak_train_count"), F.sum("total_trains").alias("total_trains"), F.sum("n_windows").alias("n_windows"))
    medians = weighted_median(counts, by_day, "headway_seconds", "n", "median_headway")
    return _match(daily, medians.withColumn("median_headway", js_round_long("median_headway")), by_day)


def daily_accumulator(arrivals: DataFrame, path: str, checkpoint: str, zone: str, watermark: str = "1 day", on_time: float = 300,
                      trigger: dict | None = None) -> StreamingQuery:
    """Running daily sums per route and direction on local days; each batch upserts the days it changed."""
    local = arrivals.withColumn("local_ts", F.from_utc_timestamp("ts", zone)).withWatermark("local_ts", watermark)
    delay = F.col("delay_seconds")
    sums = local.groupBy(F.window("local_ts", "1 day").alias("w"), *KEYS).agg(
        F.sum(delay).alias("sum_delay"), F.count(delay).alias("n_delay"), F.count_if(F.abs(delay) < on_time).alias("n_on_time"), F.count("*").alias("n_seen"))
    rows = sums.select(F.to_date("w.start").alias("date"), *KEYS, "sum_delay", "n_delay", "n_on_time", "n_seen")
    return (rows.writeStream.outputMode("update").foreachBatch(lambda b, i: upsert_batch(b, path, i, ["date", *KEYS], "n_seen"))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start())


def feed_status(rows: DataFrame, group: str, poll: str = "minute", ts: str = "ts") -> DataFrame:
    """Per feed group and cycle: rows, worst latency, status, failed rows. Runs on batches and in micro-batches."""
    return rows.groupBy(F.col(group).alias("feed_group"), F.date_trunc(poll, ts).alias("cycle")).agg(
        F.count("*").alias("n_rows"), F.max("latency_ms").alias("latency_ms"),
        F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"), F.count_if(F.col("status") != "success").alias("n_failed"))


STATUS_PARTS = "feed_group string, cycle timestamp, n_rows bigint, latency_ms bigint, n_error bigint, n_failed bigint"


def status_parts(rows: DataFrame, group: str, poll: str = "minute", ts: str = "ts") -> DataFrame:
    """Additive sums per feed group and cycle; a cycle may come in several parts."""
    return rows.groupBy(F.col(group).alias("feed_group"), F.date_trunc(poll, ts).alias("cycle")).agg(
        F.count("*").alias("n_rows"), F.max("latency_ms").alias("latency_ms"), F.count_if(F.col("status") == "error").alias("n_error"),
        F.count_if(F.col("status") != "success").alias("n_failed"))


def fold_status(parts: DataFrame) -> DataFrame:
    """One row per feed group and cycle from the parts that ``status_stream`` wrote."""
    return parts.groupBy("feed_group", "cycle").agg(
        F.sum("n_rows").alias("n_rows"), F.max("latency_ms").alias("latency_ms"),
        F.when(F.sum("n_error") > 0, "error").otherwise("ok").alias("status"), F.sum("n_failed").alias("n_failed"))


def status_stream(rows: DataFrame, group: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parts per micro-batch, however the batches cut a cycle; read them with ``fold_status``."""
    return carry.run_batches(rows, lambda b, i: carry.write_part(status_parts(b, group), path, i), checkpoint, trigger)


def metric_feed(metrics: DataFrame, path: str, checkpoint: str, route_id: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Live metric rows, of one route when given."""
    rows = metrics if route_id is None else metrics.filter(F.col("route_id") == route_id)
    return (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"processingTime": "15 seconds"})).start())
