"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_skewed, null_key, with_positions, words, written

BUCKETS = 64
LARGE_SHARE = 0.01
# Size levels: each holds sizes within 5 percent of one another, so a corpus has a few hundred.
LEVEL_RATIO = 1.05


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Targets of sources (key, source_size): weights by key order, repeating, sharing ``share`` of all words.

    No target exceeds ``ceiling`` times its source's size; what is cut off goes to the others by weight until
    none is above. Sources sorted by ceiling per weight are cut off in that order, so the level of the last
    round follows from running sums. The table of sources is the list of components of the mixture (one row
    per source), and is ordered as a whole.
    """
    by_key = Window.orderBy("key")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("w", F.get(listed, (F.row_number().over(by_key) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * float(ceiling))
    up = Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_budget", F.sum("source_size").over(whole) * float(share))
    s = s.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(onward))
    s = s.withColumn("_fits", F.col("_level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("_final", F.max(F.when(F.col("_fits"), F.col("_level"))).over(whole))
    return s.select("key", "source_size", F.least("cap", F.col("_final") * F.col("w")).alias("target"), F.col("_n"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5, ceiling: float = 2.0, seed: int = 20240501) -> DataFrame:
    """How often each document goes into the mix: systematic sampling over each source's documents.

    All documents of a source expect the same number of copies, its target over its size. Those are summed
    along the source, large documents first, one random offset per source (a hash of ``seed``) is added, and
    a document is emitted once per integer crossed. Neighbours in that order are of nearly equal size. Documents above LARGE_SHARE of
    their source are drawn first; the rate of the others makes up for what that draw took too much or too little, so the words taken
    stay within about one smaller document of the target. Returns one row per input row: doc_id, source, size (words), source_size,
    target, copies, taken (copies * size).

    NULL text has size 0, NULL sources form one source, sorted last; sources without words have target 0 and
    no copies; repeated rows are drawn separately, an empty table gives no rows, other columns are ignored.
    """
    made = _plan(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), null_key(source).alias("_key"),
                             F.size(words(text)).cast("bigint").alias("size")), weights, share, ceiling, seed)
    return made.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def _plan(slim: DataFrame, weights: Sequence[float], share: float, ceiling: float, seed: int) -> DataFrame:
    """Copies of each row of (doc_id, source, _key, size), which may hold further columns."""
    slim = written(slim, "mix-sizes")
    sources = slim.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    order_key = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    targets = source_targets(sources.select(order_key.alias("key"), "source_size", "_n"), weights, share, ceiling)
    targets = written(targets.select(F.coalesce(F.concat(F.lit("="), F.col("key.source")), F.lit("")).alias("_key"),
                                     "source_size", "target", "_n"), "mix-targets")
    rows = join_skewed(slim, targets, "_key")
    rows = rows.withColumn("_stratum", F.concat(F.when(_large(), "L").otherwise("S"), "_key"))
    level = F.when(F.col("size") > 0, -F.floor(F.log(LEVEL_RATIO, F.col("size").cast("double")))).otherwise(1)
    rows = rows.withColumn("_level", level.cast("int"))
    # rows without an id are told apart by their number, where they have one
    number = ["_row"] if "_row" in slim.columns else []
    drawn = F.xxhash64(F.lit(seed), "doc_id")
    if number:
        drawn = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "_row")).otherwise(drawn)
    rows = rows.withColumn("_bucket", F.pmod(drawn, F.lit(BUCKETS)).cast("int"))
    placed = written(with_positions(rows, "_stratum", "_level", "_bucket", [F.col("size").desc(), F.col("doc_id"), *number], "_at"), "mix-places")
    placed = placed.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 52)) / float(1 << 52))

    def copies(rate: Column) -> Column:
        return (F.floor(rate * (F.col("_at") + 1) + F.col("_u")) - F.floor(rate * F.col("_at") + F.col("_u"))).cast("bigint")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = placed.filter(_large()).groupBy("_key").agg(F.sum(copies(rate) * F.col("size")).alias("_took"), F.sum("size").alias("_size"))
    left = targets.join(drawn, "_key", "left").fillna(0, subset=["_took", "_size"])
    others = F.try_divide(F.col("target") - F.col("_took"), F.col("source_size") - F.col("_size"))
    left = left.select("_key", "_n", F.least(F.greatest(F.coalesce(others, F.lit(0.0)), F.lit(0.0)), F.lit(float(ceiling))).alias("_rest"))
    joined = join_skewed(placed, written(left, "mix-rates"), "_key")
    return joined.withColumn("copies", copies(F.when(_large(), rate).otherwise(F.col("_rest"))))


def _large() -> Column:
    """A source has fewer than 1 / LARGE_SHARE large documents."""
    return F.col("size") > F.col("source_size") * LARGE_SHARE


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
          share: float = 1.5, ceiling: float = 2.0, seed: int = 20240501) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` draws them, with the columns of ``docs``.

    Rows are numbered in a table of their own, so each gets its own copies, also rows that share a doc_id or have none.
    """
    row, n, copy = fresh(docs, "_row"), fresh(docs, "_copies"), fresh(docs, "_copy")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    made = _plan(numbered.select(F.col(row).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), null_key(source).alias("_key"),
                                 F.size(words(text)).cast("bigint").alias("size")), weights, share, ceiling, seed)
    times = made.filter("copies > 0").select(F.col("_row").alias(row), F.col("copies").cast("int").alias(n))
    return numbered.join(times, row).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(n))).alias(copy)).select(*docs.columns)
