"""Dated URL lists, applied to captures as they stood when each was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.operators.ordered import day_segment_of, with_previous

from .common import table

SALTS = 8
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), PATH, 1)


def keys_of(url: Column) -> Column:
    """Every list key that covers a url: its host, the host's domains of two labels or more, and its path prefixes by segment.

    NULL or a url without a host has none.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.array_remove(F.split(path_of(url), "/"), "")
    prefixes = F.transform(parts, lambda _, i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))


def intervals(log: DataFrame) -> DataFrame:
    """Times (key, since, until) in which a key is listed, from log rows (key, at, seq, listed); until NULL: still.

    A row holds from its time up to that of the key's next row; of rows at one time, that with the highest seq holds (the others
    hold for no time). Rows without key or time are left out.
    """
    rows = log.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", "at", "seq", "listed")
    nexts = with_previous(rows, ["key"], ["at", "seq"], {"until": "at"}, day_segment_of("at"), following=True)
    return nexts.filter("listed").select("key", F.col("at").alias("since"), "until").filter("until IS NULL OR until > since")


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_at) with the entries that were listed at fetch time: n_entries, first_entry, blocked.

    An interval is cut at day borders, so captures meet only pieces of their own day, by key and day; the pieces are copied to
    SALTS salts, over which the captures of a common key are spread. One row per input row. NULL urls or times match nothing;
    repeated rows are each returned; an empty log blocks nothing; other columns are ignored.
    """
    rows = captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("_copies"))
    last = captures.agg(F.max("fetched_at")).first()[0]
    listed = intervals(log)
    upto = F.least(F.coalesce("until", F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    days = F.sequence(F.to_date("since"), F.to_date(upto))
    pieces = listed.filter(F.col("since") <= upto).select("key", "since", "until", F.explode(days).alias("day"))
    pieces = pieces.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    asked = rows.select("*", F.to_date("fetched_at").alias("_day"), salt.alias("_salt"), F.explode_outer(keys_of(F.col("url"))).alias("_key"))
    meet = ((F.col("_key") == F.col("key")) & (F.col("_day") == F.col("day")) & (F.col("_salt") == F.col("salt"))
            & (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    met = asked.join(pieces, meet, "left")
    found = met.groupBy("page_id", "url", "fetched_at", "_copies").agg(F.count("key").alias("n_entries"), F.min("key").alias("first_entry"))
    each = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return each.select("page_id", "url", "fetched_at", "n_entries", "first_entry", (F.col("n_entries") > 0).alias("blocked"))


def bound(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Captures and list log from the tables: page p was fetched at event p; each error event lists, each signup event delists
    the host, domain or first path prefix (by event_id mod 3) of the page that its user_id names."""
    pages, events = table(spark, folder, "pages").select("page_id", "url"), table(spark, folder, "events")
    captures = pages.join(events.select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("fetched_at")), "page_id", "left")
    url = F.col("url")
    host, kind = host_of(url), F.col("event_id") % 3
    first = F.get(F.array_remove(F.split(path_of(url), "/"), ""), F.lit(0))
    parent = F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    key = (F.when(kind == 0, F.concat(F.lit("host:"), host)).when(kind == 1, F.concat(F.lit("domain:"), parent))
           .otherwise(F.concat(F.lit("prefix:"), host, F.lit("/"), first)))
    changes = events.filter(F.col("event_type").isin("error", "signup")).select("event_id", "ts", "event_type", F.col("user_id").alias("page_id"))
    log = changes.join(pages, "page_id").select(key.alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
                                                (F.col("event_type") == "error").alias("listed"))
    return captures, log


ORACLE = """
WITH p AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
  list_filter(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages),
cap AS (SELECT p.*, ts AS fetched_at FROM p LEFT JOIN events ON event_id = page_id),
log AS (SELECT CASE event_id % 3 WHEN 0 THEN 'host:' || host
    WHEN 1 THEN 'domain:' || CASE WHEN len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END
    ELSE 'prefix:' || host || '/' || seg[1] END AS key, ts AS at_, event_id AS seq, event_type = 'error' AS listed
  FROM events JOIN p ON p.page_id = user_id WHERE event_type IN ('error', 'signup')),
iv AS (SELECT key, at_ AS since_at, lead(at_) OVER (PARTITION BY key ORDER BY at_, seq) AS until_at, listed FROM log WHERE key IS NOT NULL),
keys AS (SELECT page_id, 'host:' || host AS key FROM cap WHERE host <> ''
  UNION SELECT page_id, 'domain:' || array_to_string(string_split(host, '.')[i:], '.') FROM cap, LATERAL (SELECT unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i) WHERE host <> ''
  UNION SELECT page_id, 'prefix:' || host || '/' || array_to_string(seg[1:i], '/') FROM cap, LATERAL (SELECT unnest(range(1, len(seg) + 1)) AS i) WHERE host <> ''),
hit AS (SELECT page_id, count(*) AS n, min(key) AS k FROM cap JOIN keys USING (page_id) JOIN iv USING (key)
  WHERE listed AND since_at <= fetched_at AND (until_at IS NULL OR fetched_at < until_at) GROUP BY page_id)
SELECT page_id, url, epoch_us(fetched_at) AS fetched_us, coalesce(n, 0) AS n_entries, k AS first_entry, n IS NOT NULL AS blocked FROM cap LEFT JOIN hit USING (page_id)
"""
