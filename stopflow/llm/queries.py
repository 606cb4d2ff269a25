"""The bound queries of this subpackage, one per operator, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, hard_negatives, mixing, periodic_runs, quality_model, quality_rules, sharding, simhash, substrings, toxicity, url_filters, warc
from .common import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    rated = quality_rules.host_verdicts(table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op1_quality_rules"] = quality_rules.ORACLE


@query
def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_simhash(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op7_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality_model(spark, sf_dir):
    return quality_model.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_url_filters(spark, sf_dir):
    captures, log = url_filters.bound(spark, sf_dir)
    found = url_filters.evaluate(captures, log)
    return found.select("page_id", "url", F.unix_micros("fetched_at").alias("fetched_us"), "n_entries", "first_entry", "blocked")


ORACLES["op5_url_filters"] = url_filters.ORACLE


@query
def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


ORACLES["op11_hard_negatives"] = hard_negatives.ORACLE


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.find(periodic_runs.planted(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_substring_dedup(spark, sf_dir):
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = substrings.ORACLE
