"""Hard negatives: exact integer scores of anchors against all rows by Strassen products of tiles, kept in bounded heaps that merge.

Candidates are dealt to blocks by a hash of their id and every anchor meets every block, in tiles. A tile's scores are one product
of int64 matrices. The first pass keeps each anchor's best rows of its own label (heaps of k that merge by taking the best k of
two); the second computes the tiles again and keeps, per anchor and positive, the best rows of other labels in the score window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 4096
TILE_ROWS = 256
LEAF = 16
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score


def _padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), np.int64)
    out[:a.shape[0], :a.shape[1]] = a
    return out


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = a.shape[0] // 2, a.shape[1] // 2
    return a[:r, :c], a[:r, c:], a[r:, :c], a[r:, c:]


def _multiply(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    a11, a12, a21, a22 = _halves(a)
    b11, b12, b21, b22 = _halves(b)
    levels -= 1
    m1 = _multiply(a11 + a22, b11 + b22, levels)
    m2 = _multiply(a21 + a22, b11, levels)
    m3 = _multiply(a11, b12 - b22, levels)
    m4 = _multiply(a22, b21 - b11, levels)
    m5 = _multiply(a11 + a12, b22, levels)
    m6 = _multiply(a21 - a11, b11 + b12, levels)
    m7 = _multiply(a12 - a22, b21 + b22, levels)
    out = np.empty((a.shape[0], b.shape[1]), np.int64)
    c11, c12, c21, c22 = _halves(out)
    c11[:] = m1 + m4 - m5 + m7
    c12[:] = m3 + m5
    c21[:] = m2 + m4
    c22[:] = m1 - m2 + m3 + m6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices by Strassen's recursion down to blocks of about ``leaf``.

    Sides are padded with zeros to a multiple of 2^levels. Sums and products are those of 64-bit integers, so the result is exact
    wherever it fits in 64 bits, whatever the intermediate sums do.
    """
    (m, k), n = a.shape, b.shape[1]
    levels = max(0, (min(m, k, n) // leaf).bit_length() - 1) if min(m, k, n) else 0
    step = 1 << levels
    m2, k2, n2 = (-(-x // step) * step for x in (m, k, n))
    return _multiply(_padded(a, m2, k2), _padded(b, k2, n2), levels)[:m, :n]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.nonzero(scores >= least)[0]
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], ~scores[places]))[:k]]


def bounds(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score within ``low`` and ``high`` percent of a positive's score."""
    return -(-low * positive // 100), high * positive // 100


class Block:
    """Candidates of a block: one row per id, columns by vector length."""

    def __init__(self, batches: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(batches).combine_chunks()
        ids = whole.column("vec_id").to_numpy()
        _, first = np.unique(ids, return_index=True)  # rows come sorted by id, label and vector
        whole = whole.take(pa.array(first))
        self.ids, self.labels = whole.column("vec_id").to_numpy(), whole.column("label").to_numpy()
        self.sizes, values, starts = _vectors(whole.column("v").combine_chunks())
        self.groups = {}
        for size in np.unique(self.sizes).tolist():
            rows = np.nonzero(self.sizes == size)[0]
            self.groups[size] = rows, _rows(values, starts, rows, size).T.copy()


def _vectors(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), lists.values.to_numpy(), offsets[:-1]


def _rows(values: np.ndarray, starts: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return values[starts[rows][:, None] + np.arange(size)[None, :]].reshape(len(rows), size)


def tiles(batches: Iterator[pa.RecordBatch]):
    """(anchors of a tile, ids and labels of candidates, scores) from rows sorted by block, candidates first."""
    number, parts, block = None, [], None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        borders = np.nonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0))[0] + 1
        for begin, end in zip([0, *borders.tolist()], [*borders.tolist(), len(blocks)], strict=True):
            if begin == end:
                continue
            if blocks[begin] != number:
                number, parts, block = blocks[begin], [], None
            if kinds[begin] == 0:
                parts.append(batch.slice(begin, end - begin))
                continue
            if not parts:
                continue
            block = block or Block(parts)
            for at in range(begin, end, TILE_ROWS):
                anchors = batch.slice(at, min(TILE_ROWS, end - at))
                sizes, values, starts = _vectors(anchors.column("v"))
                for size in np.unique(sizes).tolist():
                    if size in block.groups:
                        of = np.nonzero(sizes == size)[0]
                        rows, columns = block.groups[size]
                        yield anchors.take(pa.array(of)), block.ids[rows], block.labels[rows], strassen(_rows(values, starts, of, size), columns)


def _positives(k: int):
    def run(batches):
        for anchors, ids, labels, scores in tiles(batches):
            out: tuple[list, list, list] = ([], [], [])
            for anchor, label, row in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), scores, strict=True):
                mine = np.nonzero((labels == label) & (ids != anchor))[0]
                top = mine[best(row[mine], ids[mine], k)]
                out[0].extend([anchor] * len(top)), out[1].extend(ids[top].tolist()), out[2].extend(row[top].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(k: int, low: int, high: int):
    def run(batches):
        for anchors, ids, labels, scores in tiles(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for anchor, label, found, row in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "found")), scores, strict=True):
                others = np.nonzero(labels != label)[0]
                others = others[np.lexsort((ids[others], ~row[others]))]
                falling = ~row[others]  # ascending where scores fall
                for p in found:
                    least, most = bounds(p["positive_score"], low, high)
                    begin = int(np.searchsorted(falling, ~most, "left"))
                    end = min(int(np.searchsorted(falling, ~least, "right")), begin + k)
                    top = others[begin:end]
                    out[0].extend([anchor] * len(top)), out[1].extend([p["positive_id"]] * len(top)), out[2].extend(ids[top].tolist())
                    out[3].extend([p["positive_score"]] * len(top)), out[4].extend(row[top].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                             names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
    return run


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """Rows (vec_id, label, v) that take part, with components as integers, ``floor(scale * x)``."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                          F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.filter(~bad).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale))))


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor and positive.

    Anchors are rows whose id is divisible by ``every``. A score is the inner product of integer components; an anchor's positives
    are its ``positives`` best other rows of its label, and its negatives for each of them the ``negatives`` best rows of other
    labels whose score is between ``low`` and ``high`` percent of the positive's. Ties go to the smaller id.

    Rows with a NULL id, label or vector, or a NULL or non-finite component, take no part; rows that repeat an id are one row, the
    first by label and vector; vectors of different lengths do not meet; components and scores are 64-bit integers (components
    beyond them end at their bounds, and sums wrap). A positive score of zero or below admits only what the two bounds leave. Anchors
    without positives, or positives without negatives, give no rows; an empty table gives none; other columns are ignored.
    """
    rows = written(usable(vectors, vec_id, embedding, label, scale), "negatives-rows")
    blocks = max(1, -(-rows.count() // block_rows))
    none = F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>")
    home = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    candidates = rows.select(home.alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "v", none.alias("found"))
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")

    def met(asked: DataFrame) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        copies = asked.select(at, F.lit(1).alias("kind"), "vec_id", "label", "v", "found")
        return candidates.unionByName(copies).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id", "label", "v")

    near = met(anchors.withColumn("found", none)).mapInArrow(_positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= positives)
    found = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))
    asked = written(anchors.join(found, "vec_id"), "negatives-anchors")
    far = met(asked).mapInArrow(_negatives(negatives, low, high),
                                "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """The labels of the bound query: where vec_id is divisible by 7, the next one of ten."""
    return vectors.withColumn(label, F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)))


ORACLE = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id,
  positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
