"""Hard negatives, periodic runs and substring dedup against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from stopflow.llm import hard_negatives, periodic_runs, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = "doc_id bigint, text string, part int, row int, `range` bigint, cells string, h1 bigint, n int, runs int, best int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "c", 4, 5, 6, 7) for i, t in rows], TEXTS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- hard negatives ----


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (40, 64, 70), (33, 17, 65), (64, 100, 130), (5, 0, 7), (128, 128, 128)])
def test_strassen_equals_the_plain_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m * n)
    a, b = rng.integers(-1000, 1000, (m, k)), rng.integers(-1000, 1000, (k, n))
    for leaf in (1, 4, 16):
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_is_exact_where_its_sums_wrap():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 28), 1 << 28, (32, 32)), rng.integers(-(1 << 28), 1 << 28, (32, 32))
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a])
    assert (hard_negatives.strassen(a, b, 1) == exact).all()
    wide = np.full((32, 32), 1 << 31)
    assert (hard_negatives.strassen(wide, wide, 1).view(np.uint64) == np.uint64((32 << 62) % (1 << 64))).all()


def test_bounds_of_the_window_are_exact():
    for p in (*range(-300, 300), (1 << 55) + 7):
        least, most = hard_negatives.bounds(p)
        assert 100 * least >= 30 * p > 100 * (least - 1) and 100 * most <= 90 * p < 100 * (most + 1)


def brute_negatives(rows, every=100):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known.setdefault(i, []).append((label, [float(x) for x in v]))
    known = {i: min(found) for i, found in known.items()}
    ints = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a, (label, v) in ints.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in ints.items() if i != a and len(w) == len(v)}
        near = sorted((i for i in scores if ints[i][0] == label), key=lambda i: (-scores[i], i))[:5]
        others = sorted((i for i in scores if ints[i][0] != label), key=lambda i: (-scores[i], i))
        for p in near:
            fit = [i for i in others if 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]][:10]
            out += [(a, p, r + 1, n, scores[p], scores[n]) for r, n in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, kind="array<double>", **options):
    frame = spark.createDataFrame([(i, label, v, 0, 1, None) for i, label, v in rows], f"vec_id bigint, label int, embedding {kind}, block int, kind int, v string")
    return sorted(tuple(r) for r in hard_negatives.mine(frame, **options).collect())


@pytest.mark.parametrize("block_rows", [10_000, 60])
def test_hard_negatives_equal_brute_force(spark, block_rows):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) + 0.6 for _ in range(7)]) for i in range(400)]
    rows += [(i, rng.randrange(3), [round(rng.uniform(0, 1), 1) for _ in range(3)]) for i in range(400, 700)]  # ties, another length
    got = mined(spark, rows, block_rows=block_rows)
    assert got == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.7, 0.1]), (3, 2, [0.7, 0.1]), (4, 2, None), (5, None, [0.5, 0.5]), (None, 2, [0.5, 0.5]),
            (6, 2, [nan, 0.5]), (7, 2, [inf, 0.5]), (8, 2, [None, 0.5]), (9, 2, [0.5]), (10, 2, []), (100, 3, []), (200, 2, [0.5]), (2, 2, [0.7, 0.1]), (2, 3, [9.0, 9.0]),
            (300, 1, [-1.0, -1.0]), (301, 2, [0.0, 0.0])]
    got = mined(spark, rows)
    assert got == brute_negatives(rows)
    assert {r[3] for r in got} == {2, 3}
    assert mined(spark, []) == []


def test_wide_components_keep_their_digits(spark):
    rows = [(0, 1, [1e6 + 0.25, 1.0]), (1, 1, [1e6, 1.0]), (2, 2, [5e5 + 0.5, 0.0]), (3, 2, [5e5 + 0.25, 0.0])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_query_relabels(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in frame.collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op11_hard_negatives"](spark, FOLDER).collect()) == brute_negatives(rows)


# ---- periodic runs ----


def brute_runs(s):
    found = set()
    for q in range(1, len(s)):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(s[i + x] == s[i + x + d] for x in range(length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def cases(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.randint(0, 45), rng.choice([1, 2, 2, 3, 6])
        s = [rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 2)):
            if size:
                a, p = rng.randrange(size), rng.randint(1, 7)
                b = min(size, a + rng.randint(1, 30))
                s = [s[a + (i - a) % p] if a <= i < b and a + (i - a) % p < size else s[i] for i in range(size)]
        yield s


def test_lyndon_arrays_by_definition():
    for s in cases(1, 800):
        want = []
        for i in range(len(s)):
            j = i + 1
            while j < len(s) and s[j:] > s[i:]:
                j += 1
            want.append(j - i)
        assert periodic_runs.lyndon_array(s) == want


def test_runs_equal_brute_force():
    for s in cases(2, 1500):
        want = brute_runs(s)
        assert periodic_runs.runs([str(x).encode() for x in s]) == want, s
        if s:  # the stretches hold all runs: without them the sorter finds the same
            assert sorted(periodic_runs.runs_within(np.array(s)), key=lambda r: (r[0], r[2])) == want, s


def test_long_sequences_take_linear_work():
    assert periodic_runs.runs([b"a"] * 150_000) == [(0, 150_000, 1)]
    assert periodic_runs.runs([b"%d" % (i % 5_000) for i in range(60_000)]) == [(0, 60_000, 5_000)]
    parity = [b"%d" % (bin(i).count("1") % 2) for i in range(1 << 14)]
    assert periodic_runs.runs(parity) == []


def test_greatest_run_by_exact_ratio():
    assert periodic_runs.greatest([(0, 9, 2), (1, 13, 3), (5, 18, 4), (7, 9, 2)]) == (0, 9, 2)
    assert periodic_runs.greatest([]) is None


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if n < 2000 else None
    return words, found


def test_periodic_runs_query(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert set(got) == set(texts)
    checked = with_runs = 0
    for i, text in texts.items():
        words, _ = brute_row(i, text)
        if len(words) > 500:
            continue
        found = brute_runs(words)
        checked, with_runs = checked + 1, with_runs + bool(found)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert checked > 50 and with_runs > 3


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 9), (3, " \n\t"), (4, "x y " * 7), (4, "x y " * 7), (5, "go " * 70_000), (6, "a b c d e")]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in periodic_runs.find(docs_of(spark, rows)).collect())
    assert got == [(0, 18, [(0, 18, 2)], (0, 18, 2), "a b"), (1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (4, 7, [(0, 7, 1)], (0, 7, 1), "x y"),
                   (4, 7, [(0, 7, 1)], (0, 7, 1), "x y"), (5, 70_000, [(0, 70_000, 1)], (0, 70_000, 1), "go"), (6, 5, [], None, "a b c d e")]
    assert periodic_runs.find(docs_of(spark, [])).count() == 0


def test_planted_repeats_follow_the_checksum(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b c")]
    for r in periodic_runs.planted(docs_of(spark, rows)).collect():
        assert WORD.findall(r.text or "") == brute_row(r.doc_id, dict(rows)[r.doc_id])[0]


# ---- substring dedup ----


def brute_dedup(rows, window=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def deduped(spark, rows, **options):
    return sorted((tuple(r) for r in substrings.without_repeats(docs_of(spark, rows), **options).collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["中文", "été", "x" * 90, "x" * 91]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 80))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("part_bytes", [1 << 23, 4_000])
def test_dedup_equals_brute_force(spark, part_bytes):
    rows = corpus(1)
    rows += [(500 + i, rows[7][1] + " tail") for i in range(30)] + [(None, rows[3][1]), (None, rows[3][1]), (3, rows[3][1])]
    got = deduped(spark, rows, part_bytes=part_bytes)
    assert got == brute_dedup(rows) and sum(r[2] for r in got) > 500


@pytest.mark.parametrize("window", [1, 2, 5])
def test_dedup_of_short_windows(spark, window):
    rows = [(i, t[:200]) for i, t in corpus(4, 40)]
    assert deduped(spark, rows, window=window) == brute_dedup(rows, window)


def test_dedup_of_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(34))
    long = " ".join(f"v{i}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, line), (5, line), (6, "a " * 35), (7, "b " * 36), (8, line + " end"), (9, "start " + line), (10, long), (11, "x " * 50 + long[:2000])]
    assert deduped(spark, rows) == brute_dedup(rows)
    assert deduped(spark, []) == []


def test_a_loose_sketch_loses_no_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CELLS_A_BYTE", 1e-9)
    rows = [(i, t + " " + t) for i, t in corpus(6, 60)]
    assert deduped(spark, rows) == brute_dedup(rows)


def test_sketch_bounds_every_window_from_above():
    """A gram counted for a window is counted at every place of that window."""
    words = [b"w%d" % random.Random(9).randrange(40) for _ in range(50)] * 3
    data = np.frombuffer(b" ".join(words), np.uint8)
    w = substrings.Windows(data, np.array([0, len(data)]), 10)
    counts = Counter(w.counted().tolist())
    _, least = w.grams()
    h1, h2 = w.hashes()
    places = Counter(zip(h1.tolist(), h2.tolist()))
    assert all(counts[g] >= places[x, y] for g, x, y in zip(least.tolist(), h1.tolist(), h2.tolist()))


def test_word_hashes_do_not_depend_on_place_or_chunk(monkeypatch):
    texts = [b"one two  three", b"", b"three\tone " + b"y" * 200, b" two"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    h1, h2, first = substrings.hash_words(data, bounds)
    assert first.tolist() == [0, 3, 3, 6, 7]
    assert h1[0] == h1[4] and h2[2] == h2[3] and h1[1] == h1[6] and len(set(h1.tolist())) == 4
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4)
    again = substrings.hash_words(data, bounds)
    assert (again[0] == h1).all() and (again[1] == h2).all()
