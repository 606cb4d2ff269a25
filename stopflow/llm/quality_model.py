"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text, one per language.

The tokens are the characters themselves, in n-grams of ORDER. Nothing of the model is held in one place, and it grows with the
corpus: counts are summed in tasks and sharded by n-gram, and contexts, continuation counts and discounts follow by joins of shards.

* Documents are dealt once to parts of bounded size, in a bucketed table.
* Each part asks for its own distinct n-grams only, whatever the number of its documents. Requests meet the sharded model in one
  join by n-gram, and the part scores its documents with what it gets back. An n-gram has one request per part at most, so the
  commonest one is a small share of all requests.
* Labels fall into three splits by doc_id: TRAIN for the counts, TUNE for the thresholds, and the rest, which nothing has seen.
* A language's threshold is a quantile of its trusted documents in TUNE; labels of both kinds choose the level of the quantile.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from stopflow.operators.joins import join_aggregate
from stopflow.session import scratch_path

from .common import HEAVY_SHARE, discard, fresh, join_skewed, null_key, settle, written

ORDER = 5
PAD = ORDER - 1
EDGE = chr(0x10FFFF) * PAD  # stands before each text; a code point that no text has
POINTS = 0x110000  # below all n-grams, every code point is equally likely
# Weight of the language's mean, in characters, in a document's mean: short texts are judged with care.
SHRINK = 200.0
LEVELS = (0.97, 0.98, 0.985, 0.99, 0.995, 0.999, 1.0)  # quantiles of trusted documents that a threshold may be
MARGIN = 0.05  # bits added to the quantile
DIGITS = 3  # quantiles are taken over mean bits of so many digits, so a language takes few values
SPLITS = 5
TUNE, TEST = 0, 1
PART_BYTES = 16 << 20  # text of a part
DEALS = 3  # documents are dealt in so many turns, to keep the shuffled texts of one turn on disk only
WAVES = 6  # parts are scored in so many turns, to keep requests and replies of one turn on disk only
MAX_BUCKETS = 50_000  # Spark takes at most 100,000; beyond, a bucket holds several parts
PIECE = 1_000_000  # characters worked on at a time

U = np.uint64
MULTIPLIERS = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))
SPREAD = U(0x9FB21C651E98DF25)
SLOT_BITS = 18


def split_of(doc_id: Column) -> Column:
    """0 to SPLITS - 1: TUNE, TEST, or else TRAIN."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % SPLITS


def rated(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, good, split) of labelled documents; of repeated labels the highest counts."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("quality") == 1).alias("good")).withColumn("split", split_of(F.col("doc_id")))


# ---- texts to n-grams, inside tasks

def stretches(texts: list[str], most: int = PIECE) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number of the text, slice with the PAD characters before it), together about ``most`` characters; long texts are cut."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), most):
            piece = t[at:at + most]
            held.append((i, (EDGE + t[max(0, at - PAD):at])[-PAD:] + piece))
            size += len(piece)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


class Stretch:
    """The n-grams of some slices: ``h`` has a hash for each place, ``real`` tells which places end in a character of a slice."""

    def __init__(self, held: list[tuple[int, str]]):
        self.points = np.frombuffer("".join(s for _, s in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(s) for _, s in held], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        n = len(self.points) - PAD
        self.real = np.ones(n, bool)
        for k in range(PAD):
            self.real[np.maximum(self.starts[1:] + k - PAD, 0)] = False
        self.h = np.zeros(n, U)
        for k in range(ORDER):
            self.h += self.points[k:n + k].astype(U) * MULTIPLIERS[k]

    def grams(self, at: np.ndarray) -> np.ndarray:
        """The code points of the n-grams at some places, one row each."""
        return self.points[at[:, None] + np.arange(ORDER)]


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * SPREAD) >> U(64 - bits)).astype(np.int64)


def distinct_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts: sorted hashes and code points. A table of the last hash per slot drops most repeats early."""
    last, hashes, grams = np.zeros(1 << SLOT_BITS, U), [np.empty(0, U)], [np.empty((0, ORDER), np.uint32)]
    for held in stretches(texts):
        s = Stretch(held)
        slots = slot(s.h, SLOT_BITS)
        at = np.nonzero(s.real & (last[slots] != s.h))[0]
        last[slots[at]] = s.h[at]
        found, first = np.unique(s.h[at], return_index=True)
        hashes.append(found)
        grams.append(s.grams(at[first]))
    found, first = np.unique(np.concatenate(hashes), return_index=True)
    return found, np.concatenate(grams)[first]


def counted_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts as code points, and how often each occurs."""
    hashes, grams, counts = [np.empty(0, U)], [np.empty((0, ORDER), np.uint32)], [np.empty(0, np.int64)]
    for held in stretches(texts):
        s = Stretch(held)
        at = np.nonzero(s.real)[0]
        found, first, n = np.unique(s.h[at], return_index=True, return_counts=True)
        hashes.append(found), grams.append(s.grams(at[first])), counts.append(n)
    _, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return np.concatenate(grams)[first], total


def as_strings(grams: np.ndarray) -> pa.Array:
    """Rows of code points as strings of that many characters."""
    width = grams.shape[1]
    data = np.ascontiguousarray(grams).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    starts = np.nonzero(lead)[0][::width] if len(grams) else np.empty(0, np.int64)
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def keys(lang: str, grams: np.ndarray) -> np.ndarray:
    """A 64-bit key of each n-gram (a row of code points, of any one length) of a language."""
    h = np.full(len(grams), xxhash.xxh3_64_intdigest(lang) ^ grams.shape[1], U)
    for k in range(grams.shape[1]):
        h = (h ^ (h >> U(32))) * MULTIPLIERS[0] + grams[:, k].astype(U) * MULTIPLIERS[1]
        h = (h ^ (h >> U(29))) * SPREAD
    return h ^ (h >> U(32))


def by_language(langs: list[str], texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """(language, numbers of its rows, its texts); NULL is the empty text."""
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang in sorted(rows):
        yield lang, np.array(rows[lang]), [texts[i] or "" for i in rows[lang]]


# ---- the model, in shards

def count_part(text: str, key: str, doc_id: str, sure: str):
    """Counts of the n-grams of a part's trusted texts; ``trusted`` has the ids of the part, ``sure`` marks rows known before."""

    def run(docs: pa.Table, trusted: pa.Table) -> pa.Table:
        out: list[tuple[str, pa.Array, np.ndarray]] = []
        if docs.num_rows:
            ids = docs.column(doc_id).to_pandas()
            mine = ids.isin(trusted.column("doc_id").to_pylist() if trusted.num_rows else []).to_numpy() & ids.notna().to_numpy()
            chosen = docs.select([key, text]).filter(pa.array(mine | docs.column(sure).to_numpy(zero_copy_only=False).astype(bool)))
            for lang, _, texts in by_language(chosen.column(0).to_pylist(), chosen.column(1).to_pylist()):
                grams, n = counted_grams(texts)
                out.append((lang, as_strings(grams), n))
        return pa.table({"lang": pa.array([x for lang, g, _ in out for x in [lang] * len(g)], pa.string()),
                         "gram": pa.concat_arrays([pa.array([], pa.string()), *(g for _, g, _ in out)]),
                         "c": pa.array(np.concatenate([np.empty(0, np.int64), *(n for _, _, n in out)]), pa.int64())})

    return run


def discounts(counts: DataFrame) -> DataFrame:
    """Rows (lang, d1, d2, d3): the three discounts from the counts of counts of one order; 0.5, 1 and 1.5 where those are lacking."""
    n = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    rows = counts.groupBy("lang").agg(*n)

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        usable = (F.col("n1") > 0) & (F.col(f"n{k}") > 0)
        return F.greatest(F.least(F.when(usable, value).otherwise(k / 2), F.lit(float(k))), F.lit(0.05))

    return rows.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Rows (lang, gram, share, back) of all orders, from counts of the highest order (lang, gram, c).

    ``share`` is the discounted share of an n-gram in its context. Rows with ``back`` instead are contexts: gram is the context,
    back the weight that it leaves to the next lower order. Lower orders count the distinct symbols seen before.
    """
    parts, level = [], counts
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            level = written(level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
        spread = level.withColumn("ctx", F.substring("gram", 1, n - 1))
        contexts = spread.groupBy("lang", "ctx").agg(F.sum("c").alias("t"), *[F.sum((which).cast("bigint")).alias(f"n{k}") for k, which in
                                                                             ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))])
        contexts = join_aggregate(contexts, discounts(level), ["lang"], "inner").withColumn("left", sum(F.col(f"d{k}") * F.col(f"n{k}") for k in (1, 2, 3)))
        of = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        shares = spread.join(contexts, ["lang", "ctx"]).select("lang", "gram", ((F.col("c") - of) / F.col("t")).cast("float").alias("share"), F.lit(None).cast("float").alias("back"))
        backs = contexts.select("lang", F.col("ctx").alias("gram"), F.lit(None).cast("float").alias("share"), (F.col("left") / F.col("t")).cast("float").alias("back"))
        parts += [shares, backs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Column ranges of an n-gram that the model is asked for: its ends of every order, and their contexts.
ASKED = [(ORDER - n, end) for n in range(1, ORDER + 1) for end in (ORDER - 1, ORDER)]


def request_part(text: str, key: str, part: str):
    """The distinct keys a part asks for."""

    def run(docs: pa.Table) -> pa.Table:
        found = [np.empty(0, U)]
        for lang, _, texts in by_language(docs.column(key).to_pylist(), docs.column(text).to_pylist()):
            _, grams = distinct_grams(texts)
            if len(grams):
                found += [np.unique(keys(lang, grams[:, a:b])) for a, b in ASKED]
        unique = np.unique(np.concatenate(found))
        return pa.table({"part": pa.array(np.full(len(unique), docs.column(part)[0].as_py(), np.int32)), "key": pa.array(unique.view(np.int64))})

    return run


class Answers:
    """What the model holds of the keys a part asked for."""

    def __init__(self, found: np.ndarray, share: np.ndarray, back: np.ndarray):
        self.tables = []
        for values in (share, back):
            there = ~np.isnan(values)
            order = np.argsort(found[there])
            self.tables.append((found[there][order], values[there][order].astype(np.float64)))

    def get(self, which: int, wanted: np.ndarray, missing: float) -> np.ndarray:
        known, values = self.tables[which]
        if not len(known):
            return np.full(len(wanted), missing)
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[place] == wanted, values[place], missing)

    def knows(self, lang: str) -> bool:
        return bool(len(self.tables[1][0])) and not np.isnan(self.get(1, keys(lang, np.empty((1, 0), np.uint32)), np.nan)[0])

    def bits(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """-log2 P(last character | those before) of each n-gram, by interpolation from the lowest order up."""
        p = np.full(len(grams), 1 / POINTS)
        for n in range(1, ORDER + 1):
            own = keys(lang, grams[:, ORDER - n:])
            context = keys(lang, grams[:, ORDER - n:ORDER - 1])
            p = self.get(0, own, 0.0) + self.get(1, context, 1.0) * p
        return -np.log2(p)


def text_bits(answers: Answers, lang: str, texts: list[str]) -> np.ndarray:
    """Total bits of each text; NaN without a model of the language."""
    out = np.zeros(len(texts))
    if not answers.knows(lang):
        return np.full(len(texts), np.nan)
    known, grams = distinct_grams(texts)
    values = answers.bits(lang, grams)
    bits = max(10, int(4 * len(known)).bit_length())
    places = np.zeros(1 << bits, np.int64)
    places[slot(known, bits)] = np.arange(len(known))
    for held in stretches(texts):
        s = Stretch(held)
        place = places[slot(s.h, bits)]
        lost = np.nonzero(known[place] != s.h)[0]
        place[lost] = np.minimum(np.searchsorted(known, s.h[lost]), len(known) - 1)
        spent = np.where(s.real, values[place], 0.0)
        # A slice is summed from its own first place, so its sum does not depend on its neighbours.
        sums = np.add.reduceat(spent, np.maximum(s.starts - PAD, 0))
        np.add.at(out, [i for i, _ in held], sums)
    return out


def score_part(text: str, key: str, kept: Sequence[str], chars_name: str, bits_name: str):
    """Some columns of the part's rows with the length of their text and its bits."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = docs.select(kept)
        if not docs.num_rows:
            return out.append_column(chars_name, pa.array([], pa.int64())).append_column(bits_name, pa.array([], pa.float64()))
        found = [replies.column(c).to_numpy() if replies.num_rows else np.empty(0, t) for c, t in (("key", np.int64), ("share", np.float32), ("back", np.float32))]
        answers = Answers(found[0].view(U), *found[1:])
        chars, bits = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows)
        for lang, rows, texts in by_language(docs.column(key).to_pylist(), docs.column(text).to_pylist()):
            chars[rows] = [len(t) for t in texts]
            bits[rows] = text_bits(answers, lang, texts)
        return out.append_column(chars_name, pa.array(chars)).append_column(bits_name, pa.array(bits))

    return run


def keyed(model: DataFrame) -> DataFrame:
    """Rows (key, share, back) of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, U)
            groups: dict[tuple[str, int], list[int]] = {}
            grams = batch.column(1).to_pylist()
            for i, (lang, gram) in enumerate(zip(batch.column(0).to_pylist(), grams, strict=True)):
                groups.setdefault((lang, len(gram)), []).append(i)
            for (lang, n), rows in groups.items():
                points = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
                out[rows] = keys(lang, points)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column(2), batch.column(3)], names=["key", "share", "back"])

    return model.select("lang", "gram", "share", "back").mapInArrow(run, "key bigint, share float, back float")


# ---- scores and verdicts

def dealt(docs: DataFrame, labels: DataFrame, text: str, lang: str, doc_id: str, part: str, sure: str) -> tuple[DataFrame, DataFrame]:
    """The documents by part in a bucketed table, and the ids of trusted ones of TRAIN by part.

    Rows of one id share a part, to which its label goes. Ids of more than HEAVY_SHARE of all rows (under 1 / HEAVY_SHARE of them,
    so a broadcast of them is bounded) and NULL are spread over all parts, their label in the column ``sure``. A row's turn
    follows from its id and text alone, so each row is dealt once even where another read would send it to another part.
    """
    spark = docs.sparkSession
    total, n = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    parts = max(1, -(-(total or 0) // PART_BYTES))
    trusted = rated(labels).filter(F.col("good") & ~F.col("split").isin(TUNE, TEST)).select("doc_id")
    ids = docs.select(F.col(doc_id).cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    heavy = written(ids.filter(F.col("n") > max(1000, n * HEAVY_SHARE)).select("doc_id").join(trusted.withColumn("sure", F.lit(True)), "doc_id", "left"), "kn-heavy")
    own = heavy.select(F.col("doc_id").alias("_heavy_id"), F.coalesce("sure", F.lit(False)).alias(sure))
    rows = docs.join(F.broadcast(own), F.col(doc_id).cast("bigint") == F.col("_heavy_id"), "left")
    spread = F.col("_heavy_id").isNotNull() | F.col(doc_id).cast("bigint").isNull()
    place = F.when(spread, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(doc_id).cast("bigint")))
    rows = rows.withColumn(part, F.pmod(place, F.lit(parts)).cast("int")).withColumn(sure, F.coalesce(sure, F.lit(False))).drop("_heavy_id")
    buckets = min(parts, MAX_BUCKETS)
    name = f"quality_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    turn = F.pmod(F.xxhash64(F.col(doc_id).cast("bigint"), text), F.lit(DEALS))
    for now in range(DEALS):
        (rows.filter(turn == now).repartition(buckets, part).write.mode("append").format("parquet").option("compression", "zstd").option("path", path)
         .bucketBy(buckets, part).saveAsTable(name))
        settle(spark)
    by_part = trusted.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias(part), "doc_id")
    return spark.table(name), by_part


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
           hand_on: Sequence[str] | None = None) -> tuple[DataFrame, str, str, str]:
    """``docs`` with columns for the language key, characters and bits, in a table of the shared folder; and those columns' names.

    The table has the columns ``hand_on`` of the documents, or all: texts that nobody reads again would only fill the disk.
    """
    key, part, sure = (fresh(docs, c) for c in ("_lang", "_part", "_sure"))
    table, trusted = dealt(docs.withColumn(key, null_key(lang)), labels, text, lang, doc_id, part, sure)
    by_part = table.groupBy(part)
    counts = by_part.cogroup(trusted.groupBy(part)).applyInArrow(count_part(text, key, doc_id, sure), "lang string, gram string, c bigint")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "kn-counts")
    grown = kneser_ney(counts)
    model = written(keyed(grown), "kn-model")
    discard(grown)  # the counts of all orders; the model replaces them
    chars, bits = fresh(table, "_chars"), fresh(table, "_bits")
    kept = [*(docs.columns if hand_on is None else hand_on), key]
    schema = StructType([*(table.schema[c] for c in kept), StructField(chars, LongType()), StructField(bits, DoubleType())])
    score = score_part(text, key, kept, chars, bits)

    def turn(wave: int) -> DataFrame:
        own = table.filter(F.pmod(part, F.lit(WAVES)) == wave).groupBy(part)
        requests = own.applyInArrow(request_part(text, key, part), "part int, key bigint")
        replies = requests.join(model.hint("merge"), "key")
        settle(docs.sparkSession)
        return written(own.cogroup(replies.groupBy("part")).applyInArrow(score, schema), "kn-scores")

    out = turn(0)
    for wave in range(1, WAVES):
        out = out.unionByName(turn(wave))
    return out, key, chars, bits


def judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per language key: (_lang, mean bits, threshold, _n). ``rows`` has (doc_id, _lang, chars, bits).

    A threshold is a quantile of the shrunken mean bits of the language's trusted documents in TUNE, plus MARGIN. Of LEVELS that with the fewest
    wrong verdicts on TUNE's documents of both kinds is taken, of equals the highest.
    """
    known = rows.join(rated(labels).filter(F.col("split") == TUNE), "doc_id").filter(F.col("bits").isNotNull() & ~F.isnan("bits"))
    known = written(known, "kn-tune")
    means = known.filter("good").groupBy("_lang").agg((F.sum(F.round(F.col("bits") * 64).cast("bigint")) / F.sum("chars") / 64).alias("mean")).filter("mean IS NOT NULL")
    values = join_aggregate(known, means, ["_lang"], "inner").withColumn("value", F.ceil(shrunken() * 10 ** DIGITS) / 10 ** DIGITS)
    values = values.groupBy("_lang", "mean", "value").agg(F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad"))
    values = written(values, "kn-values")
    cuts = values.filter("good > 0").groupBy("_lang", "mean").agg(F.expr(f"percentile(value, array({', '.join(f'{x}D' for x in LEVELS)}), good)").alias("cuts"))
    cuts = cuts.select("_lang", "mean", F.posexplode("cuts").alias("level", "cut")).withColumn("threshold", F.col("cut") + MARGIN)
    over = F.col("value") > F.col("threshold")
    wrong = values.drop("mean").join(cuts, "_lang").groupBy("_lang", "mean", "level", "threshold").agg(
        F.sum(F.when(over, F.col("good")).otherwise(F.col("bad"))).alias("wrong"))
    best = wrong.groupBy("_lang", "mean").agg(F.min_by("threshold", F.struct("wrong", -F.col("level"))).alias("threshold"))
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    return written(sizes.join(best, "_lang", "left"), "kn-limits")


def shrunken() -> Column:
    return (F.col("bits") + F.col("mean") * SHRINK) / (F.col("chars") + SHRINK)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, n_chars, perplexity, threshold, kept) for every document of (doc_id, lang, text).

    perplexity is per character. A document is kept if the bits per character, drawn towards the mean of its language by
    SHRINK characters, stay within the language's threshold. NULL and empty texts have no perplexity and are kept, as are
    documents of languages without trusted text (NULL is a language of its own), for which threshold is NULL. Repeated rows are
    each judged; labels that are NULL or have no document are ignored; an empty table gives no rows. Very long texts are worked on in pieces.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    table, key, chars, bits = scored(docs, labels, hand_on=["doc_id", "lang"])
    rows = table.select("doc_id", "lang", F.col(key).alias("_lang"), F.col(chars).alias("chars"), F.col(bits).alias("bits"))
    known = F.col("bits").isNotNull() & ~F.isnan("bits") & F.col("threshold").isNotNull()
    return join_skewed(rows, judged(rows, labels), "_lang").select(
        "doc_id", "lang", F.col("chars").alias("n_chars"),
        F.when(known & (F.col("chars") > 0), F.round(F.pow(F.lit(2.0), F.col("bits") / F.col("chars")), 6)).alias("perplexity"),
        F.round(F.pow(F.lit(2.0), F.col("threshold")), 6).alias("threshold"),
        F.when(known, shrunken() <= F.col("threshold")).otherwise(True).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``verdicts`` keeps, in their own columns."""
    table, key, chars, bits = scored(docs, labels)
    slim = table.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(key).alias("_lang"), F.col(chars).alias("chars"), F.col(bits).alias("bits"))
    limits = judged(slim, labels).select(F.col("_lang").alias(key), F.struct("mean", "threshold").alias(fresh(table, "_limit")), F.col("_n").alias(fresh(table, "_rows")))
    limit, n = limits.columns[1:]
    value = (F.col(bits) + F.col(limit)["mean"] * SHRINK) / (F.col(chars) + SHRINK)
    bad = ~F.isnan(bits) & (value > F.col(limit)["threshold"])
    return join_skewed(table, limits, key, n).filter(~F.coalesce(bad, F.lit(False))).select(*docs.columns)
