"""Keyed tables: upserts whose reads cost the live rows and the last few batches, and expiry that frees storage.

A keyed table is a folder. ``delta`` holds one part per batch since the last compaction, ``base-*`` folders hold live rows by bucket of the
key, and numbered ``pointer`` files say which folder holds each bucket and which batches are folded in. The highest pointer counts.
A compaction writes the buckets that changed into a new folder and then renames a finished pointer file into place, so readers
see the table before or after it, and a crash in between leaves a folder that nothing names. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest_per_key


class Files:
    """Folder operations on whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def rename(self, name: str, to: str) -> None:
        parent = self._at(to).getParent()
        if not self._fs.exists(parent):
            self._fs.mkdirs(parent)
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{name} in {self.root} can't become {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def write(self, name: str, text: str) -> None:
        """Under another name first, so the file is whole when it can be seen."""
        made = f"_{uuid.uuid4().hex}"
        out = self._fs.create(self._at(made), False)
        out.write(text.encode())
        out.close()
        self.rename(made, name)

    def read(self, name: str) -> str:
        source = self._fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


@dataclass(frozen=True)
class KeyedTable:
    """Rows with one version per key. ``schema`` types all columns; on equal versions the later batch wins."""

    path: str
    schema: str
    keys: Sequence[str]
    version: str
    buckets: int = 64

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, list(self.keys), F.struct(self.version, "batch_id"))

    def pointer(self, spark: SparkSession) -> dict:
        """Folder of each bucket and the highest batch folded in."""
        found = Files(spark, self.path).names("pointer")
        return json.loads(Files(spark, self.path).read(f"pointer/{found[-1]}")) if found else {"folded": -1, "buckets": {}}

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """The batch's last row per key as a part of its own; running a batch again replaces it, one that is folded in stays as it is."""
        if batch_id <= self.pointer(batch.sparkSession)["folded"]:
            return
        last = latest_per_key(batch, list(self.keys), F.col(self.version))
        last.write.mode("overwrite").parquet(f"{self.path}/delta/batch_id={batch_id}")

    def _pending(self, spark: SparkSession, folded: int) -> list[int]:
        return sorted(i for i in (int(n.removeprefix("batch_id=")) for n in Files(spark, self.path).names("delta")) if i > folded)

    def _delta(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        read = spark.read.schema(f"{self.schema}, batch_id bigint").option("basePath", f"{self.path}/delta")
        return read.parquet(*[f"{self.path}/delta/batch_id={i}" for i in batches])

    def _base(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(f"{self.schema}, batch_id bigint").parquet(*[f"{self.path}/{f}" for f in folders])

    def rows(self, spark: SparkSession) -> DataFrame:
        """The live row per key: the buckets of the newest pointer and the batches after it. An unwritten table is empty."""
        now = self.pointer(spark)
        parts = [self._base(spark, list(now["buckets"].values()))] if now["buckets"] else []
        pending = self._pending(spark, now["folded"])
        if not pending:  # every key is there once
            return (parts[0] if parts else spark.createDataFrame([], f"{self.schema}, batch_id bigint")).drop("batch_id")
        both = self._delta(spark, pending)
        return self._latest(both.unionByName(parts[0]) if parts else both).drop("batch_id")

    def compact(self, spark: SparkSession) -> int:
        """Fold the batches so far into the buckets they touch; the other buckets stay where they are. Returns the buckets written.

        What the pointer before the new one still names is kept, for readers that have just read it; older folders and batches are removed.
        """
        files, before = Files(spark, self.path), self.pointer(spark)
        pending = self._pending(spark, before["folded"])
        if not pending:
            return 0
        changed = self._bucketed(self._delta(spark, pending))
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        old = [f for b, f in before["buckets"].items() if int(b) in set(touched)]
        merged = self._latest(changed.unionByName(self._bucketed(self._base(spark, old))) if old else changed)
        base = f"base-{uuid.uuid4().hex}"
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{base}")
        self._swap(files, before, {"folded": pending[-1], "buckets": before["buckets"] | {str(b): f"{base}/bucket={b}" for b in touched}})
        return len(touched)

    def _swap(self, files: Files, before: dict, after: dict) -> None:
        numbers = files.names("pointer")
        files.write(f"pointer/{int(numbers[-1]) + 1 if numbers else 0:012d}", json.dumps(after))
        for old in numbers[:-1]:
            files.delete(f"pointer/{old}")
        named = {*before["buckets"].values(), *after["buckets"].values()}
        for base in (n for n in files.names() if n.startswith("base-")):
            kept = [b for b in files.names(base) if f"{base}/{b}" in named]
            for bucket in (b for b in files.names(base) if b.startswith("bucket=") and b not in kept):
                files.delete(f"{base}/{bucket}")
            if not kept:
                files.delete(base)
        for batch in files.names("delta"):
            if int(batch.removeprefix("batch_id=")) <= before["folded"]:
                files.delete(f"delta/{batch}")


def keyed_stream(rows: DataFrame, table: KeyedTable, checkpoint: str, every: int = 20, trigger: dict | None = None) -> StreamingQuery:
    """Upsert every micro-batch, and compact after each ``every`` batches. A batch that runs again changes nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)
        if batch_id % every == every - 1:
            table.compact(batch.sparkSession)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()


# ---- expiry of files -------------------------------------------------------------------


def day_folders(files: Files) -> dict[str, str]:
    """Folders of a year/month/day layout by their date; one per calendar day."""
    found = {}
    for y in (n for n in files.names() if n.startswith("year=")):
        for m in (n for n in files.names(y) if n.startswith("month=")):
            for d in (n for n in files.names(f"{y}/{m}") if n.startswith("day=")):
                found["-".join(p.split("=")[1] for p in (y, m, d))] = f"{y}/{m}/{d}"
    return found


def expire_days(spark: SparkSession, path: str, schema: str, now: Column, days: int, ts: str = "ts", table: str | None = None) -> dict[str, int]:
    """Remove what is ``days`` old from a Parquet table laid out by the UTC day of ``ts`` (year, month, day): {removed, rewritten} folders.

    Whole days before the limit are dropped as folders (and, with ``table``, from the catalogue); the day of the limit is written anew with the
    rows that are still to be kept, next to it, and swapped in by renames. A run that was cut off is finished by the next one, and
    a run that finds nothing to expire changes nothing. ``schema`` types the columns in the files. Rows expire at the second
    given by ``with_expiry``: those whose time plus ``days`` is not after ``now``.
    """
    files = Files(spark, path)
    # a swap that was cut off: the new day stands ready and the old one is gone
    for ready in files.names("_border"):
        folder = ready.replace("+", "/")
        if files.exists(f"_border/{ready}/_SUCCESS") and not files.exists(folder):
            files.rename(f"_border/{ready}", folder)
    files.delete("_border")
    files.delete("_expired")
    second = F.floor(F.unix_micros(now) / F.lit(1_000_000)) - days * 86400
    limit = spark.range(1).select(second.alias("s"), F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd").alias("d")).first()
    folders = day_folders(files)
    done = {"removed": 0, "rewritten": 0}
    for day, folder in folders.items():
        if day < limit["d"]:
            files.delete(folder)
            if table:
                y, m, d = day.split("-")
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (year='{y}', month='{m}', day='{d}')")
            done["removed"] += 1
    border = folders.get(limit["d"])
    if border:
        rows = spark.read.schema(schema).parquet(f"{path}/{border}")
        kept = F.floor(F.unix_micros(ts) / F.lit(1_000_000)) > limit["s"]
        if not rows.filter(~kept).isEmpty():
            ready = border.replace("/", "+")
            rows.filter(kept).write.parquet(f"{path}/_border/{ready}")
            files.rename(border, f"_expired/{uuid.uuid4().hex}")
            files.rename(f"_border/{ready}", border)
            files.delete("_expired")
            done["rewritten"] += 1
    if table:
        spark.sql(f"REFRESH TABLE {table}")
    return done
