"""Toxicity by weak supervision: mined lexicons and patterns vote, a label model weighs the votes, a linear classifier learns from it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

# Labelled rows used for mining terms and anchoring the label model: at most this many, taken by a hash of doc_id.
MAX_LABELLED = 20_000
PREFIXES = (3, 4, 5, 6)
LEXICONS = 3  # the mined whole words are dealt over this many voters by rank
HELD_OUT = 5
# Voters, one bit each: LEXICONS word lexicons, one prefix pattern lexicon per length, then these.
PATTERNS = ("several", "shouting", "exclaiming", "symbols")
VOTERS = LEXICONS + len(PREFIXES) + len(PATTERNS)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
find_words = re.compile(r"\w+").findall


def held_out(doc_id: str | Column) -> Column:
    """Rows never learned from: crc32 of the id as text divisible by 5. NULL ids count as the text ''."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % HELD_OUT == 0


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words, and their beginnings of set lengths, marked with a star."""
    distinct = set(find_words(text.lower()))
    found = set(distinct)
    for n in PREFIXES:
        found |= {w[:n] + "*" for w in distinct if len(w) > n}
    return found


@dataclass
class Lexicon:
    """Mined terms in rank order; a term's place is its feature."""

    terms: list[str]

    def __post_init__(self):
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.words = {t for t in self.terms if t[-1] != "*"}
        self.starts = {n: {t[:-1] for t in self.terms if t[-1] == "*" and len(t) == n + 1} for n in PREFIXES}
        whole = [t for t in self.terms if t[-1] != "*"]
        self.bit = {t: 1 << (i % LEXICONS) for i, t in enumerate(whole)}
        self.bit |= {t: 1 << (LEXICONS + PREFIXES.index(len(t) - 1)) for t in self.terms if t[-1] == "*"}

    def read(self, text: str) -> tuple[list[int], int]:
        """(features present, votes as bits) of a text."""
        distinct = set(find_words(text.lower()))
        hits = distinct & self.words
        for n, known in self.starts.items():
            if known:
                hits |= {s + "*" for s in {w[:n] for w in distinct if len(w) > n} & known}
        votes = 0
        for t in hits:
            votes |= self.bit[t]
        letters = max(len(text) - text.count(" "), 1)
        upper = sum(map(text.count, UPPER))
        marks = (len({w for w in hits if w[-1] != "*"}) > 1, 2 * upper > letters, text.count("!!") * 10 > text.count(" ") + 1,
                 sum(map(text.count, "#*$%&|<>")) * 10 > letters)
        for i, on in enumerate(marks):
            votes |= on << (LEXICONS + len(PREFIXES) + i)
        return sorted(self.place[t] for t in hits), votes


def labelled(labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """At most ``bound`` learning rows (doc_id, toxic): not held out, label known, chosen by a hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def mine(docs: DataFrame, sample: DataFrame, least: int = 5) -> Lexicon:
    """Terms that mark toxic documents: all with smoothed log odds over 3 at a z-score over 2.5, of those in ``least`` toxic texts.

    ``docs`` has (doc_id, text), ``sample`` is bounded and broadcast, which bounds the terms too. Equal texts count once, by the
    highest of their labels, so copies add nothing. Each task counts its own terms before the shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                seen[toxic.as_py()].update(terms_of(text.as_py()) | {""})  # the term "" counts the texts
            rows = [(t, 0, n) for t, n in seen[1].items()] + [(t, n, 0) for t, n in seen[0].items()]
            for at in range(0, len(rows), 100_000):
                part = rows[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()),
                                                  pa.array([r[2] for r in part], pa.int64())], names=["term", "clean", "toxic"])

    chosen = docs.join(F.broadcast(sample), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    texts = chosen.groupBy(F.sha2("text", 256).alias("_hash")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    counts = texts.select("text", "toxic").mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter((F.col("toxic") >= least) | (F.col("term") == ""))
    counts = written(counts, "toxic-terms")
    total = counts.filter("term = ''").first()
    bad, good = (total["toxic"] + 1.0, total["clean"] + 1.0) if total else (1.0, 1.0)
    odds = (F.log((F.col("toxic") + 0.5) / (bad - F.col("toxic"))) - F.log((F.col("clean") + 0.5) / (good - F.col("clean"))))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    z = counts.filter("term <> ''").select("term", (odds / spread).alias("z"), odds.alias("odds")).filter("z > 2.5 AND odds > 3")
    return Lexicon([r["term"] for r in z.orderBy(F.desc("odds"), F.desc("z"), "term").collect()])


def blocks_of(patterns: np.ndarray, weight: np.ndarray, given: np.ndarray, most: float = 0.15, largest: int = 4) -> list[list[int]]:
    """Voters grouped so that strongly dependent ones, given the label, are modelled jointly."""
    x = (patterns[:, None] >> np.arange(VOTERS)) & 1
    strength = np.zeros((VOTERS, VOTERS))
    for y in (0, 1):
        w = weight * (given if y else 1 - given)
        if w.sum() <= 0:
            continue
        mean = (w[:, None] * x).sum(axis=0) / w.sum()
        cov = (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        strength = np.maximum(strength, np.abs(cov / np.outer(sd, sd)))
    blocks = [[v] for v in range(VOTERS)]
    for i, j in sorted(combinations(range(VOTERS), 2), key=lambda p: (-strength[p], p)):
        if strength[i, j] < most:
            break
        a, b = (next(k for k in blocks if v in k) for v in (i, j))
        if a is not b and len(a) + len(b) <= largest:
            blocks.remove(b)
            a += b
    return [sorted(b) for b in blocks]


def label_model(votes: list[tuple[int, int]], anchors: list[tuple[int, int, int]], rounds: int = 50) -> dict[int, float]:
    """Posterior of toxic per vote pattern, by EM over P(y) times one table per block of voters.

    ``votes`` counts all documents per pattern, ``anchors`` (pattern, label, n) the labelled learning rows, whose labels stay
    fixed. Accuracies are the tables of single voters; correlated voters share a table. Blocks are found from the
    posteriors of a first, independent fit. There are at most 2 ** VOTERS patterns.
    """
    known = Counter()
    for pattern, y, n in anchors:
        known[pattern, y] += n
    patterns = np.array(sorted({p for p, _ in votes} | {p for p, _ in known}), dtype=np.int64)
    if not len(patterns):
        return {}
    index = {int(p): i for i, p in enumerate(patterns)}
    weight = np.zeros(len(patterns))
    for p, n in votes:
        weight[index[p]] += n
    fixed = np.zeros((2, len(patterns)))
    for (p, y), n in known.items():
        fixed[y, index[p]] += n
    free = np.maximum(weight - fixed.sum(axis=0), 0)
    # Start from the anchors, smoothed by the share of voters that vote toxic.
    share = ((patterns[:, None] >> np.arange(VOTERS)) & 1)[:, :LEXICONS + len(PREFIXES)].any(axis=1)
    given = (fixed[1] + np.where(share, 0.5, 0.01)) / (fixed.sum(axis=0) + 1)

    def fit(given: np.ndarray, blocks: list[list[int]]) -> np.ndarray:
        codes = [sum(((patterns >> v) & 1) << i for i, v in enumerate(b)) for b in blocks]
        for _ in range(rounds):
            mass = np.stack([free * (1 - given) + fixed[0], free * given + fixed[1]])
            score = np.log(mass.sum(axis=1) + 1)[:, None] * np.ones(len(patterns))
            for b, code in zip(blocks, codes, strict=True):
                table = np.stack([np.bincount(code, m, 1 << len(b)) for m in mass]) + 0.05
                table /= table.sum(axis=1, keepdims=True)
                score += np.log(table[:, code])
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
            if np.abs(new - given).max() < 1e-9:
                break
            given = new
        return given

    given = fit(given, [[v] for v in range(VOTERS)])
    given = fit(given, blocks_of(patterns, weight, given))
    return {int(p): float(g) for p, g in zip(patterns, given, strict=True)}


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self, features: str | Column) -> Column:
        """The classifier's probability, rounded to 9 digits, from the features of a text."""
        # One text literal, folded once: weights are as many as terms.
        listed = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>") if self.weights else F.array().cast("array<double>")
        total = F.aggregate(features, F.lit(float(self.bias)), lambda a, f: a + F.get(listed, f))
        return F.round(1 / (1 + F.exp(-total)), 9)


def read_features(lexicon: Lexicon):
    """A column function text -> struct(features, votes)."""
    @F.pandas_udf("struct<features:array<int>,votes:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [lexicon.read(t or "") for t in texts]
            yield pd.DataFrame({"features": [r[0] for r in rows], "votes": [r[1] for r in rows]})

    return lambda text: run(F.coalesce(F.col(text), F.lit("")))


def features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc_id, held_out, features, votes), written once."""
    read = read_features(lexicon)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held_out"), read("text").alias("_r"))
    return written(rows.select("doc_id", "held_out", F.col("_r.features").alias("features"), F.col("_r.votes").alias("votes")), "toxic-features")


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[Model, DataFrame]:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); returns the model and the features of all documents.

    Votes of all documents enter the label model; the classifier is fitted on the posterior labels of all that are not held out,
    grouped by equal features. Without labels of both kinds, or without any term found, the model is a constant: the share of
    toxic labels, or 0.
    """
    sample = written(labelled(labels, bound), "toxic-labels")
    lexicon = mine(docs, sample)
    rows = features(docs, lexicon)
    votes = [(r["votes"], r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    known = rows.join(F.broadcast(sample), "doc_id").groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()
    anchors = [(r["votes"], r["toxic"], r["n"]) for r in known]
    toxic, total = sum(n for _, y, n in anchors if y), sum(n for _, _, n in anchors)
    if not lexicon.terms or toxic in (0, total):
        share = min(max(toxic / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Model(lexicon, [0.0] * len(lexicon.terms), float(np.log(share / (1 - share)))), rows
    posterior = label_model(votes, anchors)
    table = docs.sparkSession.createDataFrame(list(posterior.items()), "votes int, p double")  # at most 2 ** VOTERS rows
    soft = rows.filter(~F.col("held_out")).join(F.broadcast(table), "votes").groupBy("features").agg(
        F.sum("p").alias("p"), F.count("*").alias("n"))
    soft = written(soft, "toxic-soft")
    both = soft.select("features", F.lit(1.0).alias("label"), F.col("p").alias("w")).union(
        soft.select("features", F.lit(0.0), F.col("n") - F.col("p"))).filter("w > 0")
    # Sparse vectors, made in the JVM: a row holds only the terms that it has.
    sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(lexicon.terms))], "_places", "features", minTF=0.0, binary=True)
    vectors = sparse.transform(both.select("label", "w", F.col("features").cast("array<string>").alias("_places")))
    fitted = LogisticRegression(weightCol="w", regParam=1e-5, maxIter=60, standardization=False).fit(vectors.drop("_places"))
    return Model(lexicon, fitted.coefficients.toArray().tolist(), float(fitted.intercept)), rows


def scores(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document.

    NULL and empty texts have no term and get the score of the bias. NULL labels and labels without a document teach
    nothing; of repeated labels the highest counts; repeated documents are each scored; an empty table gives no rows.
    """
    model, rows = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), bound)
    return rows.select("doc_id", "held_out", model.score("features").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The documents predicted not to be toxic, in their own columns. Texts are read again, so rows keep their place."""
    model, _ = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), bound)
    read = read_features(model.lexicon)
    found = fresh(docs, "_features")
    return docs.withColumn(found, read("text")["features"]).filter(model.score(found) < 0.5).select(*docs.columns)
