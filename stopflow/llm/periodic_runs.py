"""Periodic runs of words: Lyndon arrays by Baier's grouping under both orders, Lyndon roots extended to runs.

Every run has a root that is the longest Lyndon word at its place under one of the two orders of the words (the one in which the
word after the run is smaller than the word a period before it). The first phase of Baier's suffix sorter groups suffixes by just those
Lyndon words, so its groups' lengths are the Lyndon array. Each entry (place, length) is a root; roots that recur twice more are extended
both ways by longest common extensions, and long enough ones are the runs.

A run of at least four periods and six words recurs with all its five-word grams a period away, so the sorter works on the stretches
of a text where such grams recur at most a quarter of the stretch away; the rest of a text can't hold a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

LEAST_PERIODS = 4
LEAST_WORDS = 6
GRAM = 5  # a run of LEAST_WORDS words or more recurs with at least so many a period away

U = np.uint64
MIXERS = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place, by the grouping phase of Baier's suffix sorter.

    Suffixes are grouped by their first letter. Groups are finished from the highest down: when a group with word v is finished, the
    nearest unfinished suffix to the left of a member (over finished ones) has a word u < v that is followed by c times v, so
    u v^c is Lyndon; suffixes of u's group are split by c and put right above it, more repeats higher.
    """
    n = len(ranks)
    places: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        places.setdefault(r, []).append(i)
    order = sorted(places)
    members = [places[r] for r in order]
    number = {r: g for g, r in enumerate(order)}
    group = [number[r] for r in ranks]
    size = [1] * len(order)
    below = list(range(-1, len(order) - 1))
    above = [*range(1, len(order)), -1]
    left = list(range(-1, n - 1))  # of finished suffixes: a place to the left, at or right of the nearest unfinished one
    done = bytearray(n)
    out = [0] * n
    g = len(order) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        length = size[g]
        for i in mine:
            out[i] = length
            done[i] = 1
        repeats: dict[int, int] = {}
        for i in mine:
            j = left[i]
            while j >= 0 and done[j]:
                k = left[j]
                if k >= 0 and done[k]:
                    left[j] = left[k]
                j = k
            left[i] = j
            if j >= 0:
                repeats[j] = repeats.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, c in repeats.items():
            moved.setdefault((-c, group[j]), []).append(j)
        for c, old in sorted(moved) if len(moved) > 1 else moved:
            new = len(size)
            some = moved[c, old]
            some.sort()
            for j in some:
                group[j] = new
            members.append(some)
            size.append(size[old] - c * length)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        members[g] = []
        g = below[g]
    return out


def _hash(ids: np.ndarray, mixer: np.uint64) -> np.ndarray:
    h = (ids.astype(U) + U(1)) * mixer
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts [begin, end) of a sequence that hold all its runs: where grams recur within a quarter of the part's length."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    h = _hash(ids, MIXERS[0])
    grams = h[GRAM - 1:].copy()
    for back in range(1, GRAM):
        grams *= MIXERS[1]
        grams += h[GRAM - 1 - back:n - back]
    at, limit = np.arange(n - GRAM + 1), np.full(n - GRAM + 1, n // LEAST_PERIODS)
    while True:
        order = np.argsort(grams[at], kind="stable")
        place = at[order]
        same = grams[place][1:] == grams[place][:-1]
        gap = np.where(same, place[1:] - place[:-1], n)
        near = np.full(len(at), n)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        stay = near <= limit
        changed = not stay.all()
        at = at[stay]
        if not len(at):
            return []
        cuts = np.nonzero(np.diff(at) > GRAM)[0] + 1
        begins, ends = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])] + GRAM
        of = np.repeat(np.arange(len(begins)), np.diff(np.concatenate([[0], cuts, [len(at)]])))
        length = (ends - begins)[of]
        before = limit[stay]
        limit = np.where(length >= LEAST_WORDS, np.maximum(1, length // LEAST_PERIODS), 0)
        if not changed and (limit == before).all():
            return list(zip(begins.tolist(), ends.tolist(), strict=True))


def _agree(ids: np.ndarray, i: int, period: int, step: int) -> int:
    """How many places from ``i`` on (``step`` 1) or before ``i`` (-1) equal the ones a period later."""
    last = len(ids) - period
    have, look = 0, 64
    while True:
        if step > 0:
            low, high = i + have, min(last, i + have + look)
            differ = np.nonzero(ids[low:high] != ids[low + period:high + period])[0] if low < high else np.empty(0)
            if len(differ):
                return have + int(differ[0])
        else:
            low, high = max(0, i - have - look), i - have
            differ = np.nonzero(ids[low:high] != ids[low + period:high + period])[0] if low < high else np.empty(0)
            if len(differ):
                return have + high - low - 1 - int(differ[-1])
        if low >= high:
            return have
        have += high - low
        look *= 2


def runs_within(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of at least LEAST_PERIODS periods and LEAST_WORDS words in one stretch."""
    n = len(ids)
    sums = np.zeros(n + 1, U)
    base = MIXERS[1]
    factors = np.full(n, base, U)
    factors[0] = 1
    factors = np.multiply.accumulate(factors)
    np.cumsum(_hash(ids, MIXERS[0]) * factors, out=sums[1:])
    roots = []
    for ranks in (ids, -ids):
        length = np.array(lyndon_array(ranks.tolist()), np.int64)
        at = np.nonzero(np.arange(n) + 3 * length <= n)[0]
        q = length[at]
        # two periods from the root on equal the two a period later
        same = (sums[at + 2 * q] - sums[at]) * factors[q] == sums[at + 3 * q] - sums[at + q]
        roots.append(np.stack([at[same], q[same]], axis=1))
    found, ends = [], {}
    for i, q in np.unique(np.concatenate(roots), axis=0).tolist():
        if i + q <= ends.get(q, -1):
            continue  # a root of the run found last with this period
        start, end = i - _agree(ids, i, q, -1), i + q + _agree(ids, i, q, 1)
        ends[q] = end
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.append((start, end - start, q))
    return found


def runs(tokens: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in tokens], np.int64)
    found = []
    for begin, end in stretches(ids):
        found += [(begin + s, length, q) for s, length, q in runs_within(ids[begin:end])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length over period; ties go to the smaller start, then period."""
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def collapsed(tokens: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(tokens)
    change = np.zeros(len(tokens) + 1, np.int64)
    for s, length, q in found:
        change[s + q] += 1
        change[s + length] -= 1
    gone = np.cumsum(change) > 0
    return b" ".join([w for w, g in zip(tokens, gone.tolist(), strict=False) if not g])


RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed binary"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, best, collapsed) for every row of ``docs``.

    A run is a stretch of consecutive words of smallest period q with at least four periods and six words that no neighbouring word
    extends. ``runs`` lists them by start, then period, ``best`` is the one of the greatest length over period (NULL if none), ``collapsed``
    the text without the words that a run contains after its first period, joined by one space.

    Texts are processed whole, each by itself, where they are (no shuffle). NULL and empty texts have no words and no run; repeated
    rows are each returned; an empty table gives no rows; other columns are ignored.
    """
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, tops, texts = [], [], [], []
            for value in batch.column(1):
                tokens = (value.as_py() or b"").split()
                found = runs(tokens)
                top = greatest(found)
                counts.append(len(tokens))
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                tops.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                texts.append(collapsed(tokens, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(triple)), pa.array(tops, triple), pa.array(texts, pa.binary())],
                                             names=["doc_id", "n_words", "runs", "best", "collapsed"])

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def _periodic(w: Column, g: Column) -> Column:
    n = F.size(w).cast("bigint")
    a = F.pmod(g, n)
    p = F.floor((n - a) / (F.lit(3) + g % 8)) + 1
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, F.when(i < a, i.cast("bigint")).otherwise(a + (i - a) % p).cast("int"))), " ")


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of the bound query: in about a tenth of the documents, chosen by a checksum of the id, the words from some place on repeat.

    With h = crc32(doc_id) and g = h div 10, where h is divisible by 10 and there are n words, words from a = g mod n on repeat those of the
    p = 1 + (n - a) div (3 + g mod 8) words there. Other texts, and those of rows without doc_id, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    repeated = let(words(text), lambda w: F.when(F.size(w) > 0, _periodic(w, F.floor(h / 10))))
    return docs.select(F.col(doc_id).alias("doc_id"), F.when(h % 10 == 0, F.coalesce(repeated, F.lit(""))).otherwise(F.col(text)).alias("text"))
