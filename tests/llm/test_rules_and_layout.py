"""Quality rules, mixing and sharding against brute force and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest
from compare import compare
from conftest import FOLDER
from pyspark.sql import functions as F

from stopflow.llm import mixing, quality_rules, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_n` int, size int, `group` string, host string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, "g", "h") for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "x y z", "b"), (5, "same words here " * 9, "b"), (5, "same words here " * 9, "b"),
       (7, "w%d " * 40 % tuple(range(40)), None), (8, " nbsp wide\x1c" * 12 + "\n#*\n#*\n \n \n", "a"), (9, "long " + " ".join(map(str, range(60_000))), "c")]


def repeats(words, size=5):
    seen = Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return len({i + k for i in range(len(words) - size + 1) if seen[tuple(words[i:i + size])] > 1 for k in range(size)})


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_against_sql(spark, duck, name):
    ok, message, _ = compare(spark, duck, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_rules_on_odd_rows(spark):
    got = quality_rules.host_verdicts(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = []
    for i, t, s in ODD:
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = repeats(words)
        want.append((i, s, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r,
                     len(words) < 10 or 100 * r > 20 * len(words)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.host, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_bad_host_rejects_its_clean_documents(spark):
    clean = " ".join(f"w{i}" for i in range(50))
    rows = [(i, "bad", "spam") for i in range(200)] + [(1000, clean, "spam")] + [(2000 + 100 * h + i, clean, f"h{h}") for h in range(8) for i in range(40)]
    got = {r.doc_id: r for r in quality_rules.host_verdicts(docs_of(spark, rows)).collect()}
    assert not got[1000].base_failed and not got[1000].kept
    assert all(got[k].kept for k in got if k >= 2000)


def test_a_small_host_is_drawn_to_the_others(spark):
    clean = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "bad", "tiny"), (2, clean, "tiny2")] + [(10 + 100 * h + i, clean if i else "bad", f"h{h}") for h in range(8) for i in range(50)]
    got = {r.host: r.host_rate for r in quality_rules.host_verdicts(docs_of(spark, rows)).collect()}
    assert got["tiny"] < 0.6 and got["h0"] < 0.1


def targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, left, out = share * sum(sizes.values()), set(names), {}
    while left:
        level = budget / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > ceiling * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in left}
        for s in over:
            out[s] = ceiling * sizes[s]
            budget -= out[s]
        left -= over
    return out


def test_mixing_targets_and_draws(spark):
    rng = random.Random(5)
    names = ["a", "b", "c", "é", "Z", None, "d"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 50, 51, 52, 400])), rng.choice(names + ["a"] * 5)) for i in range(3000)]
    rows += [(7, "w " * 50, "a"), (None, "w w", "b"), (None, None, "b"), (9000, "w " * 9000, "d"), (9001, "w " * 4000, "d")]
    docs = docs_of(spark, rows)
    plan = mixing.mix(docs)
    got = plan.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 800 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(13)).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in got if r.doc_id not in (7, None)}
    emitted = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert sum(emitted[i] != n for i, n in copies.items()) <= 2


def test_rows_that_share_an_id_get_their_own_copies(spark):
    rows = [(5, "w " * (40 + i % 7), "a") for i in range(700)] + [(None, "w " * 45, "a") for _ in range(700)] + [(9, "w " * 45, "b")] * 700
    docs = docs_of(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in mixing.mixed(docs).collect():
        got[r.source] += len(WORD.findall(r.text))
    assert set(got) == {"a", "b"} and all(abs(got[s] - want[s]) <= 100 for s in got)


def test_mixing_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    only = mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
    assert quality_rules.host_verdicts(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n, copies", [(4000, 1), (4000, 1300), (30, 3)])
def test_shards(spark, n, copies):
    rng = random.Random(n + copies)
    rows = [(i, "x" * rng.randint(0, 900) + str(i), "a") for i in range(n)]
    rows += [(n + i, "the same text", "a") for i in range(copies)] + [(None, None, "a"), (None, "", "a"), (0, rows[0][1], "a")]
    plan = sharding.shard(docs_of(spark, rows)).collect()
    assert len(plan) == len(rows)
    texts = {}
    bytes_of, slots = Counter(), {}
    sizes = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sizes == Counter((r["size"], r.text_crc32) for r in plan)
    for r in plan:
        assert texts.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
        bytes_of[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(bytes_of.values()) / 24
    if copies < 10 and n > 100:
        assert max(bytes_of.values()) < 1.02 * mean and min(bytes_of[s] for s in range(24)) > 0.98 * mean
    assert max(bytes_of.values()) <= max(1.5 * mean, max(Counter({k: k[0] * c for k, c in sizes.items()}).values()) + mean)


def test_shard_files(spark, tmp_path):
    docs = docs_of(spark, [(i, f"text {i}", "a") for i in range(100)])
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, sharding.shard(docs, 4), path, "doc_id")
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
    assert sharding.shard(docs_of(spark, [])).count() == 0


def test_positions_do_not_depend_on_partitions(spark):
    from stopflow.llm.common import with_positions
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 5).alias("level"), (F.col("id") % 7).alias("bucket"))
    got = {r.id: (r.k, r.at) for r in with_positions(rows, "k", "level", "bucket", ["id"], "at").collect()}
    for k in range(3):
        order = sorted((i for i in range(500) if i % 3 == k), key=lambda i: (i % 5, i % 7, i))
        assert [got[i] for i in order] == [(k, p) for p in range(len(order))]
