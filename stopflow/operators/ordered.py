"""Ordered computations per key that hold up when one key owns a large share of the rows.

A key is always cut into segments that follow its order (an hour, a block of sequence numbers), at every size of input.
Rows are windowed inside (key, segment), and only one summary row per (key, segment) crosses segment borders. The
number of segments of a key is bounded by the calendar or by its sequence numbers, not by its rows.

Ordering is given as column names, ascending, and must be total within a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SEG = "_segment"
# A key of more rows than this does not stay whole where a choice is made by key.
HEAVY_ROWS = 200_000


def time_segment_of(ts: str) -> Column:
    """The hour of a timestamp, counted from the epoch."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)


day_segment_of = time_segment_of


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _segmented(df: DataFrame, segment: Column | str) -> DataFrame:
    """Add the segment column; a name stands for one that is there already."""
    return df if isinstance(segment, str) else df.withColumn(SEG, segment.cast("bigint"))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                  segment: Column | str, following: bool = False) -> DataFrame:
    """Add the previous (or following) row's values: ``{new column: source column}``."""
    df = _segmented(df, segment)
    source = F.struct(*[F.col(v).alias(n) for n, v in values.items()])
    inside = Window.partitionBy(*keys, SEG).orderBy(*order)
    step, back = (F.lead, F.lag) if following else (F.lag, F.lead)
    near = df.select("*", step(source).over(inside).alias("_near"), back(F.lit(1)).over(inside).isNull().alias("_at_edge"))
    # the row at the border of each segment is handed on to the next segment of its key
    across = Window.partitionBy(*keys).orderBy(SEG)
    edges = near.filter("_at_edge").select(*keys, SEG, source.alias("_edge"))
    edges = edges.withColumn("_edge", step("_edge").over(across)).filter(F.col("_edge").isNotNull())
    joined = _match(near, edges, [*keys, SEG])
    found = F.coalesce("_near", "_edge")
    return joined.select(*[c for c in df.columns if c != SEG], *[found[n].alias(n) for n in values])


def heavy_key(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> Column | None:
    """Condition that holds for the rows of every key with more than ``limit`` rows (HEAVY_ROWS); None when there is no such key.

    Keys are counted by hash in a job of their own, and at most rows / limit hashes come to the driver. A small key whose hash
    meets a heavy one's counts as heavy.
    """
    hashed = F.xxhash64(*keys)
    counts = df.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("_n"))
    found = [row["_hash"] for row in counts.filter(F.col("_n") > (HEAVY_ROWS if limit is None else limit)).select("_hash").collect()]
    return hashed.isin(found) if found else None


def whole_or_cut(df: DataFrame, keys: Sequence[str], limit: int | None, whole, cut) -> DataFrame:
    """``whole`` of the rows, in one union with ``cut`` of the rows of heavy keys."""
    heavy = heavy_key(df, keys, limit)
    return whole(df) if heavy is None else whole(df.filter(~heavy)).unionByName(cut(df.filter(heavy)))


def with_previous_of_many(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], segment: Column,
                          following: bool = False, limit: int | None = None) -> DataFrame:
    """``with_previous`` for many keys of few rows, such as trips: one shuffle; only keys above ``limit`` rows are cut into segments."""
    step, window = F.lead if following else F.lag, Window.partitionBy(*keys).orderBy(*order)
    return whole_or_cut(df, keys, limit, lambda rows: rows.select("*", *[step(v).over(window).alias(n) for n, v in values.items()]),
                         lambda rows: with_previous(rows, keys, order, values, segment, following))


def with_position_of_many(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str = "position",
                          limit: int | None = None) -> DataFrame:
    """``with_position`` for many keys of few rows: one shuffle; only keys above ``limit`` rows are cut into segments."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint").alias(name)
    return whole_or_cut(df, keys, limit, lambda rows: rows.select("*", place), lambda rows: with_position(rows, keys, order, segment, name))


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column | str],
                     segment: Column | str) -> DataFrame:
    """Add inclusive running sums per key."""
    df = _segmented(df, segment)
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", F.col(value) if isinstance(value, str) else value)
    inside = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, SEG).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(*keys, SEG, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    running = df.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in sums])
    joined = _match(running, offsets, [*keys, SEG])
    keep = [c for c in df.columns if c != SEG and not c.startswith("_v_")]
    return joined.select(*keep, *[(F.col(f"_i_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums])


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column | str,
                  name: str = "position") -> DataFrame:
    """Add the 1-based position of each row within its key."""
    df = _segmented(df, segment)
    inside = Window.partitionBy(*keys, SEG).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys, SEG).agg(F.count("*").alias("_n"))
               .select(*keys, SEG, F.sum("_n").over(before).alias("_o")))
    ranked = df.withColumn("_i", F.row_number().over(inside))
    joined = _match(ranked, offsets, [*keys, SEG])
    return joined.select(*[c for c in df.columns if c != SEG],
                         (F.col("_i") + F.coalesce(F.col("_o"), F.lit(0))).cast("bigint").alias(name))


def framed(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int,
           columns: dict[str, callable], block: int = 100_000) -> DataFrame:
    """Row-frame window columns over positions, with keys cut into blocks.

    Rows near a border are copied into the neighbouring block, so every frame of up to ``before``
    rows back and ``after`` rows ahead is whole. ``columns`` maps a name to a function of the
    block's window (ordered, without frame).
    """
    home = F.floor((F.col(position) - 1) / block)
    lowest = F.greatest(F.floor((F.col(position) - 1 - after) / block), F.lit(0))
    highest = F.floor((F.col(position) - 1 + before) / block)
    copied = df.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(lowest, highest)))
    window = Window.partitionBy(*keys, "_block").orderBy(position)
    made = copied.select("*", *[make(window).alias(name) for name, make in columns.items()])
    return made.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_session: Column,
             values: dict[str, str], segment: Column | str, name: str = "session") -> DataFrame:
    """Number runs of rows per key; ``new_session`` may use the previous row's ``values``.

    A NULL condition (the first row) also starts a run.
    """
    kept = _segmented(df, segment).withColumn("_keep_seg", F.col(SEG))
    lagged = with_previous(kept, keys, order, values, SEG)
    started = lagged.withColumn("_start", F.when(F.coalesce(new_session, F.lit(True)), 1).otherwise(0))
    started = started.withColumnRenamed("_keep_seg", SEG)
    return with_running_sum(started, keys, order, {name: "_start"}, SEG).drop("_start", *values)


def with_rank_of_values(values: DataFrame, column: str, name: str) -> DataFrame:
    """Add each row's place from 0 in the order of a column of distinct values, on the column's own type.

    Rows are range-partitioned by the column and written, then ranked inside each range; the counts of the ranges before are added.
    """
    ranged = cut_lineage(values.repartitionByRange(column).withColumn(SEG, F.spark_partition_id().cast("bigint")))
    return with_position(ranged, [], [column], SEG, "_place").withColumn(name, F.col("_place") - 1).drop("_place")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
                    bucket: Column) -> DataFrame:
    """Exact interpolated quantiles per key by counting, without holding a key in one task.

    ``bucket`` must not decrease with ``value``; it cuts a key's value range into pieces.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value, bucket.alias(SEG))
              .agg(F.count("*").alias("_n")))
    summed = with_running_sum(counts, keys, [value], {"_cum": "_n"}, SEG)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = _match(summed, totals, list(keys)) if keys else summed.withColumn("_all", totals.scalar())
    parts = []
    for name, p in probabilities.items():
        spot = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        holds = [(F.col("_cum") - F.col("_n") <= r) & (F.col("_cum") > r) for r in (low, high)]
        lo = F.max(F.when(holds[0], F.col(value)))
        hi = F.max(F.when(holds[1], F.col(value)))
        share = F.max(spot - low)
        parts.append((lo + (hi - lo) * share).alias(name))
    return ranked.groupBy(*keys).agg(*parts)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column, first: bool = False) -> DataFrame:
    """One row per key: the last (or first) by ``order``. Combines before the shuffle."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key; the rank filter is applied before the shuffle too."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
