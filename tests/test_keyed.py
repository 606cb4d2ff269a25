"""Keyed tables, expiry of files, and the session's shared folder."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stopflow.sources import keyed, sinks

SCHEMA = "k bigint, at bigint, v string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, table):
    return sorted(tuple(r) for r in table.rows(spark).collect())


def test_upserts_equal_a_dictionary(spark, new_path):
    rng = random.Random(4)
    table = keyed.KeyedTable(new_path("t"), SCHEMA, ["k"], "at", buckets=4)
    assert content(spark, table) == [] and table.compact(spark) == 0
    live = {}
    for i in range(7):
        rows = [(rng.randrange(30), rng.randrange(50), f"{i}-{j}") for j in range(20)]
        rows = list({(k, at): (k, at, v) for k, at, v in rows}.values())  # no two versions of a batch are equal
        for k, at, v in rows:
            if k not in live or (at, i) >= live[k][0]:
                live[k] = ((at, i), v)
        table.upsert(batch(spark, rows), i)
        if i in (1, 2, 4):
            assert table.compact(spark) <= 4
        assert content(spark, table) == sorted((k, at, v) for k, ((at, _), v) in live.items())


def test_only_touched_buckets_are_written_and_old_parts_go(spark, new_path):
    table = keyed.KeyedTable(new_path("t"), SCHEMA, ["k"], "at", buckets=8)
    files = keyed.Files(spark, table.path)
    table.upsert(batch(spark, [(k, 1, "a") for k in range(200)]), 0)
    assert table.compact(spark) == 8
    first = table.pointer(spark)["buckets"]
    table.upsert(batch(spark, [(3, 2, "b")]), 1)
    assert table.compact(spark) == 1
    second = table.pointer(spark)["buckets"]
    assert sum(first[b] != second[b] for b in first) == 1 and files.names("delta") == ["batch_id=1"]
    table.upsert(batch(spark, [(3, 3, "c")]), 2)
    table.compact(spark)
    # two pointers are kept, with what they name; nothing else is
    assert len(files.names("pointer")) == 2 and files.names("delta") == ["batch_id=2"]
    assert len([n for n in files.names() if n.startswith("base-")]) == 3
    # a live read now takes no batch at all, and every key once
    assert table.rows(spark).count() == 200 and table._pending(spark, table.pointer(spark)["folded"]) == []


def test_a_crash_before_the_swap_changes_nothing(spark, new_path, monkeypatch):
    table = keyed.KeyedTable(new_path("t"), SCHEMA, ["k"], "at", buckets=2)
    table.upsert(batch(spark, [(1, 1, "a"), (2, 1, "b")]), 0)
    table.compact(spark)
    table.upsert(batch(spark, [(1, 2, "c")]), 1)

    def crash(self, name, text):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(keyed.Files, "write", crash)
        with pytest.raises(OSError):
            table.compact(spark)
    assert content(spark, table) == [(1, 2, "c"), (2, 1, "b")]
    table.upsert(batch(spark, [(2, 5, "d")]), 2)
    assert table.compact(spark) > 0 and content(spark, table) == [(1, 2, "c"), (2, 5, "d")]
    files = keyed.Files(spark, table.path)
    named = {f.split("/")[0] for f in table.pointer(spark)["buckets"].values()}
    assert named <= {n for n in files.names() if n.startswith("base-")}


def test_a_batch_that_is_folded_in_is_not_taken_again(spark, new_path):
    table = keyed.KeyedTable(new_path("t"), SCHEMA, ["k"], "at", buckets=2)
    table.upsert(batch(spark, [(1, 1, "a")]), 0)
    table.compact(spark)
    table.upsert(batch(spark, [(1, 9, "again")]), 0)
    assert content(spark, table) == [(1, 1, "a")]


def test_keyed_stream(spark, tmp_path, new_path):
    path = str(tmp_path / "in")
    for i in range(5):
        batch(spark, [(k, i, f"{i}") for k in range(i, 8)]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    table = keyed.KeyedTable(new_path("t"), SCHEMA, ["k"], "at", buckets=3)
    keyed.keyed_stream(stream, table, new_path("check"), every=2, trigger={"availableNow": True}).awaitTermination()
    assert content(spark, table) == [(k, min(k, 4), str(min(k, 4))) for k in range(8)]
    assert table.pointer(spark)["folded"] == 3


DAYS = "id bigint, ts timestamp"


def days(spark, path):
    rows = spark.range(0, 96).selectExpr("id", "timestamp_seconds(1704067200 + id * 3600) AS ts")  # four days from 2024-01-01
    sinks.with_partitions(rows, F.col("ts"), hour=False).write.partitionBy("year", "month", "day").parquet(path)


def ids(spark, path):
    return sorted(r.id for r in spark.read.schema(f"{DAYS}, year string, month string, day string").parquet(path).collect())


def test_expired_days_are_gone_and_the_border_day_is_right(spark, new_path):
    path = new_path("days")
    days(spark, path)
    now = F.lit("2024-01-12 05:00:00").cast("timestamp")
    assert keyed.expire_days(spark, path, DAYS, now, 10) == {"removed": 1, "rewritten": 1}
    assert ids(spark, path) == list(range(30, 96))  # ten days before: 2024-01-02 05:00, that second included
    files = keyed.Files(spark, path)
    assert sorted(keyed.day_folders(files)) == ["2024-01-02", "2024-01-03", "2024-01-04"] and files.names("_expired") == []
    assert keyed.expire_days(spark, path, DAYS, now, 10) == {"removed": 0, "rewritten": 0}
    assert ids(spark, path) == list(range(30, 96))


@pytest.mark.parametrize("step", [1, 2])
def test_a_cut_off_swap_is_finished(spark, new_path, monkeypatch, step):
    path = new_path("days")
    days(spark, path)
    now, renames, real = F.lit("2024-01-12 05:00:00").cast("timestamp"), [], keyed.Files.rename

    def crash(self, name, to):
        renames.append(name)
        if len(renames) == step:
            raise OSError("gone")
        real(self, name, to)

    with monkeypatch.context() as m:
        m.setattr(keyed.Files, "rename", crash)
        with pytest.raises(OSError):
            keyed.expire_days(spark, path, DAYS, now, 10)
    keyed.expire_days(spark, path, DAYS, now, 10)
    assert ids(spark, path) == list(range(30, 96))


def test_catalogue_drops_expired_partitions(spark, new_path):
    path = new_path("days")
    days(spark, path)
    sinks.register_table(spark, "stopflow_expiring", f"{DAYS}, year string, month string, day string", path, "parquet", ["year", "month", "day"])
    keyed.expire_days(spark, path, DAYS, F.lit("2024-01-12 05:00:00").cast("timestamp"), 10, table="stopflow_expiring")
    assert spark.sql("SELECT count(*) AS n FROM stopflow_expiring").first().n == 66
    assert spark.sql("SHOW PARTITIONS stopflow_expiring").count() == 3
    spark.sql("DROP TABLE stopflow_expiring")


def test_a_session_without_a_checkpoint_folder_gets_one(tmp_path):
    code = ("from stopflow.session import build_session, cut_lineage, shared_dir; "
            "s = build_session(master='local[1]', **{'spark.ui.enabled': 'false', 'spark.driver.bindAddress': '127.0.0.1', 'spark.driver.host': '127.0.0.1'}); "
            "assert s.conf.get('spark.checkpoint.dir', None) is None; "
            "a = shared_dir(s); assert a == shared_dir(s); assert cut_lineage(s.range(3)).count() == 3; print('made', a)")
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}  # no defaults of this machine
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=env)
    assert "made" in done.stdout, done.stderr[-2000:]
