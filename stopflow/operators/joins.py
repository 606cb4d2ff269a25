"""Joins of a large table with an aggregate that is usually small, whatever the shares of its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import _match, heavy_key

# An aggregate of at most this many rows is broadcast.
BROADCAST_ROWS = 100_000


def join_aggregate(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; ``small`` has one row per key, is computed once and its rows are counted.

    Up to BROADCAST_ROWS rows it is broadcast, so the large table stays where it is. Beyond, both sides are sorted and merged,
    whatever size Spark expects of them, and only the rows of keys that are heavy in the large table meet a broadcast of their rows.
    """
    small = cut_lineage(small)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _match(large, F.broadcast(small), keys, how)
    typed = all(large.schema[k].dataType == small.schema[k].dataType for k in keys)  # hashes differ between types
    heavy = heavy_key(large, keys) if typed else None
    if heavy is None:
        return _match(large, small.hint("merge"), keys, how)
    merged = _match(large.filter(~heavy), small.filter(~heavy).hint("merge"), keys, how)
    return merged.unionByName(_match(large.filter(heavy), F.broadcast(small.filter(heavy)), keys, how))
