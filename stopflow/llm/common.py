"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.session import scratch_path

# White space of the word contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

# A key is heavy above this share of all rows, so there are fewer than 1 / HEAVY_SHARE heavy keys at any size.
HEAVY_SHARE = 1 / 1000


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: str | Column) -> Column:
    """Array of maximal runs of non-space characters; empty for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def null_key(column: str) -> Column:
    """A never-NULL string that tells NULL from every string, and sorts as the strings do."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def settle(spark) -> None:
    """Give back the driver's memory between stages of a long job: Python's and Arrow's garbage, and the heap's, upon which Spark also
    drops the broadcasts and shuffle files of tables that nothing refers to any more. Results don't depend on it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def join_skewed(rows: DataFrame, small: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """Inner join where a few keys may own most rows. ``small`` has one row per key, ``n`` its number of ``rows``.

    Keys above ``HEAVY_SHARE`` of all rows (under 1,000 of them, so the broadcast is bounded) meet
    their rows where those are; all other keys are joined as Spark sees fit.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) > total * HEAVY_SHARE
    heavy_side = F.broadcast(small.filter(heavy).drop(n))
    rare = rows.join(F.broadcast(small.filter(heavy).select(key)), key, "left_anti")
    return rows.join(heavy_side, key).unionByName(rare.join(small.filter(~heavy).drop(n), key))


def with_positions(rows: DataFrame, key: str, level: str, bucket: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add each row's position from 0 within ``key``, ordered by level, bucket, then ``order``.

    Rows are ranked inside (key, level, bucket) only; counts are summed over buckets, then over levels,
    so no task holds a whole key. Level and bucket must take few values per key, independent of the data's size.
    """
    counts = rows.groupBy(key, level, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key, level).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(key).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    in_level = counts.select(key, level, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    levels = counts.groupBy(key, level).agg(F.sum("_n").alias("_n"))
    levels = levels.select(key, level, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_l"))
    offsets = in_level.join(levels, [key, level]).select(key, level, bucket, (F.col("_b") + F.col("_l")).alias("_offset"))
    inside = Window.partitionBy(key, level, bucket).orderBy(*order)
    ranked = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    return (ranked.join(offsets, [key, level, bucket])
            .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint")).drop("_inside", "_offset"))
