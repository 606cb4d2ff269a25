"""Document rules whose failures are pooled by host, with shrunken host rates joined back as verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_skewed, let, null_key, words, written

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_window_words(w: Column, size: int = WINDOW) -> Column:
    """Words covered by ``size``-word windows that occur twice or more in the array, the first occurrence included.

    Windows are told apart by a 64-bit hash of their words; only texts with a repeat are sorted.
    """
    hashes = F.when(F.size(w) >= size, F.transform(
        F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    )).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.coalesce(F.least(F.get(starts, j + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts_of(s: Column) -> Column:
        def same(x, j):
            return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def count(v: Column) -> Column:
        ranked = F.array_sort(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(
            let(let(ranked, starts_of), covered))

    return let(hashes, count)


def base_measures(text: str = "text") -> dict[str, Column]:
    """The base measures of a text as columns; NULL counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SPACES, "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    counted = let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_window_words(w).cast("bigint").alias("r")))
    return {
        "_words": counted,
        "word_chars": F.length(bare).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior (a, b) of host failure rates by moments, from rows (n, k).

    Between-host variance is the variance of the rates less what binomial noise explains. Without any
    left, hosts are pooled fully (weight 1e6); the weight is at least 1. No host gives (1, 1).
    """
    rate = F.col("k") / F.col("n")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("noise")).first()
    if row["m"] is None:
        return 1.0, 1.0
    mean = min(max(row["m"], 1e-6), 1 - 1e-6)
    spread = mean * (1 - mean)
    left = row["v"] - spread * row["noise"]
    weight = 1e6 if left <= spread * 1e-6 else max(spread / left - 1, 1.0)
    return mean * weight, (1 - mean) * weight


def host_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  max_rate: float = 0.5, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """Rule measures per document, and the verdict of its host.

    A document fails the base rules with fewer than ``min_words`` words, or when more than ``max_repeat_pct``
    percent of them lie in repeated five-word windows. A host is rejected when its failure rate, shrunk
    towards a beta prior fitted over all hosts, exceeds ``max_rate``. Returns one row per input row: doc_id,
    host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    NULL text counts as empty (and fails), NULL hosts form one host, repeated rows each count and are each
    returned, an empty table gives no rows, other columns are ignored.
    """
    measures = base_measures(text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), *[c.alias(n) for n, c in measures.items()])
    slim = slim.select("doc_id", "host", null_key("host").alias("_host"), F.col("_words.n").alias("n_words"), "word_chars", "n_symbols",
                       "n_dup_lines", F.col("_words.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    slim = written(slim.withColumn("base_failed", failed), "quality-rules")
    hosts = written(slim.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("k")), "host-rules")
    a, b = beta_prior(hosts)
    rated = hosts.select("_host", F.col("n").alias("_n"), ((F.col("k") + a) / (F.col("n") + a + b)).alias("host_rate"))
    joined = join_skewed(slim, rated, "_host")
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"))


ORACLE = """
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
m AS (SELECT row_number() OVER () AS r, *, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
pos AS (SELECT r, unnest(range(n_words - 4)) AS i, ws FROM m WHERE n_words >= 5),
win AS (SELECT r, i, list_slice(ws, i + 1, i + 5) AS g FROM pos),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(5)) AS k) GROUP BY r),
base AS (SELECT doc_id, source, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  (n_words < 10 OR 100 * coalesce(cov.n, 0) > 20 * n_words) AS base_failed FROM m LEFT JOIN cov USING (r)),
host AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM base GROUP BY source),
mom AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, var_pop(k / n) AS v, avg(1 / n) AS noise FROM host),
pri AS (SELECT m, CASE WHEN v - m * (1 - m) * noise <= m * (1 - m) * 1e-6 THEN 1e6 ELSE greatest(m * (1 - m) / (v - m * (1 - m) * noise) - 1, 1) END AS s FROM mom)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  (NOT base_failed AND (k + m * s) / (n + s) <= 0.5) AS kept
FROM base JOIN host ON base.source IS NOT DISTINCT FROM host.source, pri
"""
