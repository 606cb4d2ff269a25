"""Substring dedup: words covered by a window of words that starts anywhere else are removed.

A count-min sketch decides which windows may repeat, and only those are grouped exactly.

* Documents are dealt once to parts of bounded size, in a bucketed table, so the three passes read a part without a shuffle.
* A window is counted under the least hash of its inner grams: equal windows have equal least grams at different places,
  so a gram's count is never below that of a window, and only about one gram in ten is counted.
* Every part sketches its grams. The sketch is never held in one place: each range of its cells is merged by one task, and a
  part gets back those of its own cells that were hit twice or more. Width and ranges follow the input.
* Windows whose gram is estimated to repeat are grouped by a hash of 128 bits of their words, one row per part and window with
  its count, so a passage in any number of documents makes at most one row per part. Parts get back their repeated windows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.session import scratch_path

from .common import written

WINDOW = 35
PART_BYTES = 8 << 20  # text of a part
PARTS_A_BUCKET = 4
MAX_BUCKETS = 50_000  # Spark takes at most 100,000; beyond, a bucket holds more parts
CHUNK_BYTES = 1 << 20  # text hashed at a time
CELLS_A_BYTE = 1 / 8  # cells a row of the sketch per byte of text: about eight per counted gram
RANGE_BITS = 22  # cells merged by one task, while there are fewer than MAX_RANGES ranges
MAX_RANGES = 1 << 13
LONG_WORD = 64

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
WINDOW_BASES = (U(0xC2B2AE3D27D4EB4F), U(0xA0761D6478BD642F))
GRAM_BASE = U(0xE7037ED1A0B428DB)
ROWS = (U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3))  # one multiplier per row of the sketch
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _inverse(odd: np.uint64) -> np.uint64:
    """The inverse modulo 2^64."""
    return U(pow(int(odd), -1, 1 << 64))


class Powers:
    """Powers of a base modulo 2^64 and of its inverse, made as far as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            made = []
            for base in (self.base, _inverse(self.base)):
                factors = np.full(size, base, U)
                factors[0] = 1
                made.append(np.multiply.accumulate(factors))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_POWERS: dict[int, Powers] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(int(base), Powers(base)).upto(n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (a bijection)."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


def rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(base, len(h))
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up, out=sums[1:])
    return (sums[size:] - sums[:n]) * down[:n]


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``size`` consecutive values, by doubling."""
    have, out = 1, values
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes per word of adjacent texts (``bounds`` are their byte offsets in ``data``), and the number of each text's first word."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    starts = np.nonzero(word & (~before | edge[:-1]))[0]
    ends = np.nonzero(word & (~after | edge[1:]))[0] + 1
    first = np.searchsorted(starts, bounds)
    lengths = ends - starts
    hashes = []
    for base in BASES:
        h = np.empty(len(starts), U)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
            low, high = int(starts[at]), int(ends[to - 1])
            up, down = powers(base, high - low)
            sums = np.zeros(high - low + 1, U)
            np.cumsum((data[low:high].astype(U) + U(1)) * up, out=sums[1:])
            h[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * down[starts[at:to] - low]
            at = to
        hashes.append(mix(h + lengths.astype(U) * U(0xA3B195354A39B70D)))
    for i in np.nonzero(lengths > LONG_WORD)[0].tolist():
        whole = xxhash.xxh3_128_intdigest(data[starts[i]:ends[i]].tobytes())
        hashes[0][i], hashes[1][i] = whole & (1 << 64) - 1, whole >> 64
    return hashes[0], hashes[1], first


def chunks(texts: pa.ChunkedArray | pa.Array):
    """Runs of rows with at most CHUNK_BYTES of text (or one row): (first row, bytes, byte offsets of rows)."""
    row = 0
    for piece in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        piece = piece.cast(pa.large_binary()).fill_null(b"")
        if not len(piece):
            continue
        offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset:piece.offset + len(piece) + 1]
        data = np.frombuffer(piece.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(piece):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            yield row + at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to
        row += len(piece)


class Windows:
    """Hashes of the windows of a run of texts; ``valid`` marks windows inside one text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, window: int):
        self.window, self.gram = window, max(1, (window + 1) // 2)
        self.h1, self.h2, self.first = hash_words(data, bounds)
        n = max(0, len(self.h1) - window + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))  # the end of each word's text
        self.valid = np.arange(n) + window <= last[:n]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every gram, least one of every window, 0 where the window is not valid)."""
        grams = mix(rolling(self.h1, self.gram, GRAM_BASE)) | U(1)
        least = sliding(grams, self.window - self.gram + 1, np.minimum)
        return grams, np.where(self.valid, least, U(0))

    def counted(self) -> np.ndarray:
        """Hashes of the grams that are least in some valid window, once per place."""
        if not self.valid.any():
            return np.empty(0, U)
        grams, least = self.grams()
        reach = self.window - self.gram
        padded = np.concatenate([np.zeros(reach, U), least, np.zeros(reach, U)])
        return grams[sliding(padded, reach + 1, np.maximum)[:len(grams)] == grams]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return rolling(self.h1, self.window, WINDOW_BASES[0]), rolling(self.h2, self.window, WINDOW_BASES[1])


def _cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(grams * ROWS[row]) >> U(64 - bits)


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _sketch(bits: int, range_bits: int, window: int):
    """A part's sketch: per row and range, the cells hit, those hit twice or more listed twice."""

    def run(docs: pa.Table) -> pa.Table:
        found = [Windows(data, bounds, window).counted() for _, data, bounds in chunks(docs.column("text"))]
        grams = np.concatenate([np.empty(0, U), *found])
        part = docs.column("part")[0].as_py()
        out: tuple[list, list, list] = ([], [], [])
        for row in range(len(ROWS)):
            cells = np.sort(_cells(grams, row, bits))
            third = np.concatenate([np.zeros(min(2, len(cells)), bool), cells[2:] == cells[:-2]])
            cells = cells[~third]
            ranges, at = np.unique(cells >> U(range_bits), return_index=True)
            pieces = np.split((cells & U((1 << range_bits) - 1)).astype(np.uint32), at[1:]) if len(ranges) else []
            for number, piece in zip(ranges.tolist(), pieces, strict=True):
                out[0].append(row), out[1].append(number), out[2].append(piece)
        return pa.table({"row": pa.array(out[0], pa.int32()), "range": pa.array(out[1], pa.int64()),
                         "part": pa.array([part] * len(out[0]), pa.int32()), "cells": _binary(out[2])})

    return run


def _merge(batches):
    """Of each part's cells in a range, those that all parts together hit twice or more."""
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        lists = batch.column(2)
        offsets, inner = lists.offsets.to_numpy(), lists.values
        for k in range(batch.num_rows):
            part = inner.slice(offsets[k], offsets[k + 1] - offsets[k])
            numbers = part.field(0).to_numpy()
            pieces = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.field(1)]
            ends = np.cumsum([len(p) for p in pieces])
            cells = np.concatenate(pieces)
            order = np.argsort(cells, kind="stable")
            equal = cells[order][1:] == cells[order][:-1]
            again = np.zeros(len(cells), bool)
            again[order] = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            for number, piece, mine in zip(numbers.tolist(), pieces, np.split(again, ends[:-1]), strict=True):
                if mine.any():
                    out[0].append(number), out[1].append(batch.column(0)[k].as_py()), out[2].append(batch.column(1)[k].as_py())
                    out[3].append(np.unique(piece[mine]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), _binary(out[3])],
                                         names=["part", "row", "range", "cells"])


class Members:
    """Membership in a sorted set of 64-bit values, with a table of bits before the search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.shift = U(64 - max(10, int(8 * len(values)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[mix(values) >> self.shift] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``asked`` that are members, their places among the values)."""
        maybe = np.nonzero(self.table[mix(asked) >> self.shift])[0]
        place = np.searchsorted(self.values, asked[maybe])
        place[place == len(self.values)] = 0
        hit = self.values[place] == asked[maybe] if len(self.values) else np.zeros(0, bool)
        return maybe[hit], place[hit]


def _estimated(bits: int, range_bits: int, window: int):
    """A part's windows whose gram is estimated to occur twice or more: hash, part, count in the part."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        found1, found2 = [np.empty(0, U)], [np.empty(0, U)]
        if docs.num_rows and replies.num_rows:
            rows, ranges = replies.column("row").to_numpy(), replies.column("range").to_numpy()
            cells = [np.frombuffer(x.as_buffer(), np.uint32).astype(U) + (U(n) << U(range_bits))
                     for x, n in zip(replies.column("cells"), ranges.tolist(), strict=True)]
            known = [Members(np.sort(np.concatenate([np.empty(0, U), *(c for c, r in zip(cells, rows, strict=True) if r == row)])))
                     for row in range(len(ROWS))]
            for _, data, bounds in chunks(docs.column("text")):
                w = Windows(data, bounds, window)
                if not w.valid.any():
                    continue
                _, least = w.grams()
                new = np.concatenate([[True], least[1:] != least[:-1]])  # neighbouring windows mostly share their gram
                grams = least[new]
                maybe = np.nonzero(grams)[0]
                for row, members in enumerate(known):
                    maybe = maybe[members.find(_cells(grams[maybe], row, bits))[0]]
                chosen = np.zeros(len(grams), bool)
                chosen[maybe] = True
                chosen = chosen[np.cumsum(new) - 1] & w.valid
                if chosen.any():
                    h1, h2 = w.hashes()
                    found1.append(h1[chosen]), found2.append(h2[chosen])
        h1, h2 = np.concatenate(found1), np.concatenate(found2)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.concatenate([np.ones(min(1, len(h1)), bool), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        counts = np.diff(np.append(np.nonzero(new)[0], len(h1)))
        part = docs.column("part")[0].as_py() if docs.num_rows else 0
        return pa.table({"h1": h1[new].view(np.int64), "h2": h2[new].view(np.int64), "part": pa.array(np.full(len(counts), part, np.int32)),
                         "n": np.minimum(counts, 2).astype(np.int32)})

    return run


def _removed(window: int):
    """Per document of a part: its words, those covered by repeated windows, and the text of the others."""

    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        h1, h2 = (repeated.column(c).to_numpy().view(U) if repeated.num_rows else np.empty(0, U) for c in ("h1", "h2"))
        order = np.argsort(h1)
        h1, h2 = h1[order], h2[order]
        members = Members(h1)
        n_words, n_removed, kept = [], [], []
        for _, data, bounds in chunks(docs.column("text")):
            w = Windows(data, bounds, window)
            covered = np.zeros(len(w.h1), bool)
            if len(h1) and w.valid.any():
                x1, x2 = w.hashes()
                at, place = members.find(x1)
                at = at[(h2[place] == x2[at]) & w.valid[at]]
                change = np.zeros(len(covered) + 1, np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                covered = np.cumsum(change[:-1]) > 0
            drops = np.concatenate([[0], np.cumsum(covered)])[w.first]
            for i, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                words = data[begin:end].tobytes().split()
                lost = int(drops[i + 1] - drops[i])
                if lost:
                    stay = (~covered[w.first[i]:w.first[i + 1]]).tolist()
                    words = [x for x, s in zip(words, stay, strict=True) if s]
                n_words.append(len(words) + lost), n_removed.append(lost), kept.append(b" ".join(words))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "kept": pa.array(kept, pa.binary())})

    return run


def dealt(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """Rows (part, doc_id, text) in a table bucketed by part, in the shared folder."""
    spark = docs.sparkSession
    row = F.xxhash64(F.monotonically_increasing_id())
    rows = docs.select(F.pmod(row, F.lit(parts)).cast("int").alias("part"), F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    buckets = min(-(-parts // PARTS_A_BUCKET), MAX_BUCKETS)
    name = f"substrings_{uuid.uuid4().hex}"
    (rows.repartition(buckets, "part").write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, name))
     .bucketBy(buckets, "part").saveAsTable(name))
    return spark.table(name)


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each document without the words that a repeated window covers.

    A window is ``window`` consecutive words of one document; it is repeated if its words also start anywhere else, in another row or
    in the same one. All windows are judged on the input. ``kept`` holds the other words, joined by one space.

    Every input row is a document, also one that repeats another or has no doc_id: equal rows lose all windows. NULL and empty texts
    have no words; texts shorter than a window lose nothing; an empty table gives no rows; other columns are ignored. A text
    is processed as a whole, in arrays of its own size.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    table = dealt(docs, doc_id, text, max(1, -(-total // part_bytes)))
    bits = max(16, int(total * CELLS_A_BYTE).bit_length())
    range_bits = max(RANGE_BITS, bits - MAX_RANGES.bit_length() + 1)
    by_part = table.groupBy("part")
    partial = by_part.applyInArrow(_sketch(bits, range_bits, window), "row int, range bigint, part int, cells binary")
    lists = partial.groupBy("row", "range").agg(F.collect_list(F.struct("part", "cells")).alias("m"))
    cells = written(lists.mapInArrow(_merge, "part int, row int, range bigint, cells binary"), "substrings-cells")
    seen = by_part.cogroup(cells.groupBy("part")).applyInArrow(_estimated(bits, range_bits, window), "h1 bigint, h2 bigint, part int, n int")
    total_n = F.sum("n").over(Window.partitionBy("h1", "h2"))
    repeated = written(seen.withColumn("_all", total_n).filter("_all > 1").select("part", "h1", "h2"), "substrings-windows")
    kept = by_part.cogroup(repeated.groupBy("part")).applyInArrow(_removed(window), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return kept.withColumn("kept", F.col("kept").cast("string"))


# The same rows by SQL over all windows, as texts.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
  h AS MATERIALIZED (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
  a AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
  c AS (SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM h WHERE h IN (SELECT h FROM a) GROUP BY r),
  g AS (SELECT r, list_sort(gone) AS gone, len(gone) AS n FROM c),
  u AS (SELECT d.r, unnest(d.w) AS word, generate_subscripts(d.w, 1) AS i FROM d),
  k AS (SELECT u.r, string_agg(u.word, ' ' ORDER BY u.i) AS kept FROM u
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS i FROM g) x WHERE x.r = u.r AND x.i = u.i) GROUP BY u.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)"""
