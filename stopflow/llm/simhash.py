"""SimHash near-duplicates: fingerprints, a grid join on segment bit counts, exact check, and connected components.

A fingerprint is embedded as the bit counts of 32 segments of two bits. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints. The vector is cut into 9 blocks of 3 or 4 segments; within Manhattan
distance 4, at least 5 blocks are equal, so all links meet in one of the 126 cells (which 5 blocks, their counts). Members of a
cell are filtered by Manhattan distance, then by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_skewed, written
from .components import components

BITS = 64
SEGMENTS = 32
BLOCKS = 9
# A cell's members are compared in groups of about this many; larger cells are cut, and each pair of pieces is a group.
PIECE = 1024
LOW = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text: bit set if over half of its shingle hashes (XXH64) set it. 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65536):
        h = np.array([digest(line[i:j], seed) for i, j in zip(starts[at:at + 65536], stops[at:at + 65536], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each whole text as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Each 2-bit segment replaced by its bit count (0 to 2)."""
    return (fp & LOW) + ((fp >> np.uint64(1)) & LOW)


def cells(prints: DataFrame, distance: int) -> DataFrame:
    """Rows (cell, fp): every cell of the grid that a fingerprint lies in. The cell is a hash of the equal blocks."""
    if not 0 <= distance < BLOCKS:
        raise ValueError(f"distance must be below {BLOCKS}")
    low = F.lit(int(LOW))
    even, odd = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # even + odd in each segment
    edge = [round(SEGMENTS * b / BLOCKS) * 2 for b in range(BLOCKS + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - distance)):
        mask = sum((1 << edge[b + 1]) - (1 << edge[b]) for b in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(k), F.col("_counts").bitwiseAND(F.lit(mask).cast("bigint"))))
    return prints.select("fp", counts.alias("_counts")).select("fp", F.explode(F.array(*keys)).alias("cell"))


def linked(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs within Hamming ``distance``: Manhattan distance of the segment counts first, then exact."""
    a, b = segment_counts(left), segment_counts(right)
    # |x - y| of counts 0..2 per segment, without borrows: as bits of (x xor y) weighed, 1 apart: 1, 2 apart: 2
    x = a[:, None] ^ b[None, :]
    both = (x & (x >> np.uint64(1))) & LOW  # segment xor is 3: counts 1 and 2, one apart
    near = np.bitwise_count(x & LOW).astype(np.int16) + 2 * np.bitwise_count((x >> np.uint64(1)) & LOW) - 2 * np.bitwise_count(both)
    i, j = np.nonzero(near <= distance)
    exact = np.bitwise_count(left[i] ^ right[j]) <= distance
    return i[exact], j[exact]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A forest that connects what the pairs connect: fewer than n pairs."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def edges(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``distance``, never all pairs of a group."""
    # A fingerprint makes 126 rows, so the small table of fingerprints is dealt over all tasks first.
    wide = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    member = cells(prints.repartition(wide, "fp"), distance)
    crowded = member.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = written(crowded.select("cell", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "simhash-crowded")
    # A sort-merge join at every size, so a cell that owns many rows is split by skew handling.
    met = member.join(crowded.hint("merge"), "cell")
    met = met.withColumn("i", F.pmod(F.xxhash64("fp", "cell"), F.col("pieces")).cast("int"))
    other = F.sequence(F.lit(0), F.col("pieces") - 1)
    met = met.withColumn("j", F.explode(other))
    groups = met.groupBy("cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(
        F.collect_list(F.struct("i", "fp")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            lists, lo, hi = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets = lists.offsets.to_numpy()
            inner = lists.values
            piece, fp = inner.field(0).to_numpy(), inner.field(1).to_numpy().view(np.uint64)
            for k in range(batch.num_rows):
                part = slice(offsets[k], offsets[k + 1])
                f, p = fp[part], piece[part]
                if lo[k] == hi[k]:
                    i, j = linked(f, f, distance)
                    i, j = i[i < j], j[i < j]
                    for x, y in spanning(i, j, len(f)):
                        a.append(f[x]), b.append(f[y])
                else:
                    left, right = f[p == lo[k]], f[p == hi[k]]
                    i, j = linked(left, right, distance)
                    for x, y in spanning(i, j + len(left), len(left) + len(right)):
                        a.append(left[x]), b.append(right[y - len(left)])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))],
                                             names=["a", "b"])

    found = groups.select("lo", "hi", "m").mapInArrow(run, "a bigint, b bigint")
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-edges")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id): documents linked, directly or over others, by fingerprints within ``distance`` bits.

    component_id is the smallest doc_id of the component. Texts are lower-cased in A-Z; NULL and empty texts have
    fingerprint 0 and are linked like any other. Repeated rows are each returned; a NULL doc_id is never the smallest (a
    component of only such rows has component_id NULL). An empty table gives no rows, other columns are ignored.
    """
    slim = written(fingerprints(docs, doc_id, text, shingle), "simhash-prints")
    prints = written(slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "simhash-distinct")
    root = components(edges(prints.select("fp"), distance))
    rooted = prints.join(root, prints["fp"] == root["node"], "left").select("fp", "least", F.col("_n").alias("_rows"), F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    labelled = join_skewed(rooted, written(smallest, "simhash-smallest"), "root")
    labelled = written(labelled.select("fp", F.col("_rows").alias("_n"), "component_id"), "simhash-labels")
    return join_skewed(slim, labelled, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """The documents that represent their component: those with its smallest doc_id. Rows without doc_id stay only in a
    component of such rows; rows that repeat a doc_id are one document and stay or go together."""
    found = classes(docs, doc_id, text, distance)
    key = fresh(docs, "_key")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(first, F.col(doc_id).eqNullSafe(F.col(key)), "left_semi")
