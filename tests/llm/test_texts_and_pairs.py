"""BPE, SimHash, WARC and nearest neighbours against brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from stopflow.llm import ann, bpe, components, queries, simhash, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, `_bpe` int, fp bigint, `_key` string, least int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return bpe.Automaton(bpe.read_vocabulary(PATH))


def test_automaton_equals_the_library(machine, library):
    rng = random.Random(3)
    pools = ["'tsx 1a", "ab'stvl 0.\n", "abcdefgh", "aaab ", "é中文\U0001f600 \t\n\x1c\x85 'sdmlvt", "0123-=_#*   ", "<|endoftext|> "]
    for _ in range(3000):
        pool = rng.choice(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) + rng.choice(["", "<|endoftext|>", "<|endoftext|>ab"])
        ids = machine.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert machine.decode(ids) == text == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_classed_alike(machine, library):
    for low in range(0, 0x110000, 256):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(low, low + 256) if not 0xD800 <= c < 0xE000)
        assert machine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_words(machine, library):
    for text in ("ab" * 30_000, "=-" * 20_000 + "x" * 20_000, " " * 5000 + "a", "é" * 10_000):
        assert machine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_toy_automaton_accepts_only_what_merging_makes(tmp_path):
    """All token strings over a toy vocabulary: accepted exactly if merging their bytes gives them back."""
    import itertools
    spec = {"bytes": [(i, b) for i, b in enumerate(b"ab")], "merges": [(0, 0, 2), (2, 1, 3), (2, 2, 4), (1, 0, 5), (3, 4, 6)], "added": []}
    toy = bpe.Automaton(spec)

    def merged(data):
        word = [0 if c == ord("a") else 1 for c in data]
        for a, b, c in spec["merges"]:
            out, i = [], 0
            while i < len(word):
                if word[i:i + 2] == [a, b]:
                    out.append(c)
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            word = out
        return word

    for n in range(1, 5):
        for tokens in itertools.product(toy.born, repeat=n):
            accepted = all(toy.arc(u, v) for u, v in itertools.pairwise(tokens))
            assert accepted == (merged(b"".join(toy.label[t] for t in tokens)) == list(tokens)), tokens
    for n in range(1, 12):
        for data in map(bytes, itertools.product(b"ab", repeat=n)):
            assert toy.word(data) == merged(data)


def test_files_that_are_not_plain_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_digests_and_round_trip(spark, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, "long word " * 40_000), (5, "<|endoftext|>x")]
    got = bpe.digests(docs_of(spark, rows), PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    full = bpe.tokenize(docs_of(spark, rows), PATH, decoded="again")
    assert full.filter("again <> coalesce(text, '')").count() == 0 and full.filter("_bpe = 1").count() == len(rows)
    assert bpe.digests(docs_of(spark, []), PATH).count() == 0


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints, distance=4):
    """Component index of each fingerprint, by all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= distance)[0]:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def test_simhash_query(spark):
    from conftest import FOLDER
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d.text) for d in docs]
    want = [(d.doc_id, f"{p:016x}", docs[c].doc_id) for d, p, c in zip(docs, prints, classes_of(prints), strict=True)]
    assert want == sorted(tuple(r) for r in queries.op8_simhash(spark, FOLDER).collect())


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(9, None), (3, " \n"), (4, "A b"), (5, "a  B"), (5, "a  B"), (None, "a b"), (7, long), (6, long.upper()), (8, "É a b c"), (None, "none")]
    got = simhash.classes(docs_of(spark, rows)).collect()
    by = sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None)
    assert by == [(3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 3)]
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [4, None]
    kept = simhash.representatives(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 6, 8, None, None]
    assert simhash.classes(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("piece", [8, 1024])
def test_links_of_crowded_cells(spark, monkeypatch, piece):
    """Clusters of fingerprints a few bits apart, with cells cut into pieces or not: same components as all pairs."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(piece)
    prints = set()
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(60):
            near = at
            for _ in range(rng.randint(0, 4)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
            if rng.random() < 0.2:
                at = near
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1, (1 << 63), 0b11110, 0b111110})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    root = {r.node: r.root for r in components.components(simhash.edges(frame, 4)).collect()}
    want = classes_of(prints)
    groups = {}
    for p, c in zip(signed, want, strict=True):
        groups.setdefault(c, []).append(p)
    for members in groups.values():
        if len(members) > 1:
            assert len({root[m] for m in members}) == 1
        else:
            assert members[0] not in root
    assert len(set(root.values())) == sum(len(m) > 1 for m in groups.values())


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000), (None, 5), (2001, 2002)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == 1000 and {got[i] for i in (2000, 2001, 2002)} == {2000}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id bigint, url string, html string, row int, record string")


def test_archives(spark):
    big, tricky = "é<p>" * 5000, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:0>\r\n" * 30
    rows = [(1, "http://a/\r\nx: y", big), (5, "http://b", big), (3, None, big), (4, "u", None), (6, "u", ""), (7, "u", "small"), (8, "v", "small"),
            (9, "t: q", tricky), (2, "t", tricky), (None, "n", "z" * 2000), (None, "n2", big), (-4, "neg", "q" * 999)]
    got = warc.round_trip(pages_of(spark, rows), chunk=1000).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        ids = [j for j, _, g in rows if g == h and j is not None]
        head = max(ids) if ids else None
        first = len(data) < 1000 or i == head
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else head))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_archive_files_are_plain_records(spark, new_path):
    path = new_path("warc")
    pages = pages_of(spark, [(1, "http://a", "x" * 2500), (2, "http://a", "x" * 2500)]).coalesce(1)
    info = warc.write_archives(pages, path, chunk=1000)
    records = warc.read_records(spark, path, info).collect()
    assert sorted((r.record, r.kind, r.chunk, len(r.part)) for r in records) == [
        (1, "revisit", 0, 0), (2, "continuation", 1, 1000), (2, "continuation", 2, 500), (2, "response", 0, 1000)]
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    at = 0
    while at < len(text):  # walk by Content-Length alone, as any reader of the format does
        assert text.startswith("WARC/1.1\r\n", at)
        head, _, _ = text[at:].partition("\r\n\r\n")
        length = int(re.search(r"Content-Length: (\d+)", head)[1])
        at += len(head) + 4 + length
        assert text[at:at + 4] == "\r\n\r\n"
        at += 4


def test_every_revisit_names_a_response_of_the_archive(spark, new_path):
    path = new_path("warc")
    rows = [(i, f"http://{i}", "x" * (1000 + i % 3)) for i in range(40)] + [(39, "again", "x" * 1000), (None, "none", "x" * 1001), (7, "s", "small")]
    warc.write_archives(pages_of(spark, rows), path, chunk=600)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    heads = [dict(line.split(": ", 1) for line in h.split("\r\n")[1:]) for h in re.findall(r"WARC/1\.1\r\nWARC-Warcinfo-ID.*?(?=\r\n\r\n)", text, re.S)]
    responses = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 42 - 1 - 3 and all(responses[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in revisits)


def test_a_damaged_chunk_is_noticed(spark):
    chunks = spark.createDataFrame([(1, 0, 2, b"a"), (1, 2, 2, b"b")], "row bigint, chunk int, chunks int, part binary")
    with pytest.raises(Exception, match="chunk 2 of record 1"):
        warc.running_digests(chunks).collect()


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q, v in good.items():
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good.items() if i != q)[:k]
    return out


def test_neighbours_recall(spark):
    from conftest import FOLDER
    folder = FOLDER.replace("sf0.001", "sf0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, 10, 100)
    got = {}
    for r in ann.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), shard_rows=2000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda x: (x[2], x[1]))
        hit += len({i for _, i in best} & {i for _, i, _ in mine})
    assert hit >= 0.9 * 10 * len(want)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 60)] + [(100 + i, same) for i in range(80)]
    rows += [(300, None), (400, [0.0] * 8), (500, [float("nan")] + [1.0] * 7), (600, [None] + [1.0] * 7), (None, same), (700, [1.0, 2.0]), (101, same),
             (800, [float("inf")] + [1.0] * 7)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, shard string, kind int")
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 8], 10, 100)  # the only query of another length has no candidate
    got = {}
    for r in ann.nearest(frame, shard_rows=50).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == {100}
    assert [i for _, i in sorted(got[100])] == [i for _, i in want[100]]
    assert ann.nearest(frame.limit(0)).count() == 0
    few = ann.nearest(frame.filter("vec_id IN (100, 1, 2)")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


def test_neighbours_keep_original_digits_and_lengths(spark):
    rows = [(100, [1e8 + 0.25, 1.0]), (1, [1e8 + 1.5, 1.0]), (2, [1e8 + 0.25, 1.0]), (3, [1e300, 1e300]), (200, [1.0, 2.0, 3.0]), (300, [1.0, 2.0, 3.5]),
            (4, [1.0, 2.0, 3.25]), (400, [5e-324]), (5, [1e-323]), (4, [0.5, 2.0, 3.25])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {100, 200, 300, 400}
    assert sorted(got[100])[:2] == [(1, 2, 0.0), (2, 1, 1.25)] and len(got[100]) == 3
    assert sorted(got[200]) == [(1, 300, 0.5), (2, 4, float(np.sqrt(0.25 + 0.0625)))] and [i for _, i, _ in got[400]] == [5]


def test_neighbours_of_mixed_lengths_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(3, 5, 8)[i % 3]).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, shard_rows=200).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hit = 0
    for q, v in rows[::100]:
        want = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))[:10]
        assert len(got[q]) == 10
        hit += len(set(want) & set(got[q]))
    assert hit >= 85


def test_registered_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_fingerprints_use_the_whole_text(spark):
    base = " ".join(f"w{i}" for i in range(50_000))
    other = " ".join(f"v{i}" for i in range(50_000))
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs_of(spark, [(1, base), (2, base + " " + other)])).collect()}
    assert got[1] != got[2]
