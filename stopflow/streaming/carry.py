"""Small tables carried from one micro-batch to the next in the shared folder.

Every batch writes its own partition and reads the newest one before it, so a batch that is run
again after a failure starts from the same state and replaces its own output.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_part(rows: DataFrame, path: str, batch_id: int, more: tuple[str, ...] = ()) -> None:
    (rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *more).parquet(path))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All parts; an empty table when nothing was written."""
    try:
        return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch_id bigint")


def part_ids(spark: SparkSession, path: str) -> list[int]:
    """Batches that have written a part, from the list of folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def read_before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows of the newest part before this batch."""
    earlier = [i for i in part_ids(spark, path) if i < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={earlier[-1]}")


def write_state(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the state after this batch; only it and the one before, from which the batch may run again, are kept.

    An empty state is a part too, so a later batch never goes back to an older one.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [i for i in part_ids(spark, path) if i < batch_id][:-1]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={old}"), True)


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def run_batches(stream: DataFrame, each, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a stream that hands (batch, batch_id) to ``each``."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "15 seconds"})).start()
