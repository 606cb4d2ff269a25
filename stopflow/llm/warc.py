"""WARC archives written and read as tables of record chunks.

A payload is never one value on the way: it is cut into chunks, rows of (record, chunk number), and a digest runs along
them. In the archive each chunk is a record of its own: the first one of the record's type, further ones of type
continuation with the segment headers of the format.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.session import scratch_path

from .common import discard, join_skewed, let, written

CHUNK = 1 << 18
FILE_RECORDS = 20_000
MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"


def chunk_table(pages: DataFrame, page_id: str, url: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """Rows (row, record, url, chunk, chunks, part), written once, so ``row`` numbers the input rows for good.

    NULL payload: one empty chunk. Line breaks are taken out of urls, as they go into headers.
    """
    data = F.col("data")
    n = F.greatest(F.ceil(F.octet_length(data) / chunk), F.lit(1)).cast("int")
    parts = let(data, lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(d, i * chunk + 1, F.lit(chunk))))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("bigint").alias("record"),
                        F.regexp_replace(F.col(url), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("data"))
    return written(rows.select("row", "record", "url", n.alias("chunks"), F.posexplode(parts).alias("chunk", "part")), "warc-chunks")


def running_digests(chunks: DataFrame) -> DataFrame:
    """Rows (row, payload_bytes, payload_digest) of chunk rows (row, chunk, chunks, part).

    Only records of several chunks are brought together and sorted. One hash state is carried from chunk to chunk and from
    batch to batch; a chunk is all that is held. A missing or doubled chunk raises ValueError.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size, at, key = None, 0, 0, None
        for batch in batches:
            keys, numbers, totals = (batch.column(i).to_pylist() for i in range(3))
            parts, out = batch.column(3), []
            for i in range(batch.num_rows):
                if state is None:
                    state, size, at, key = hashlib.sha1(), 0, 0, keys[i]
                if numbers[i] != at or keys[i] != key:
                    raise ValueError(f"chunk {numbers[i]} of record {keys[i]} where chunk {at} of {key} was expected")
                data = parts[i].as_buffer()
                state.update(data)
                size, at = size + data.size, at + 1
                if at == totals[i]:
                    out.append((key, size, state.hexdigest()))
                    state = None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                             names=["row", "payload_bytes", "payload_digest"])
        if state is not None:
            raise ValueError(f"record {key} ends after {at} chunks")

    slim = chunks.select("row", "chunk", "chunks", "part")
    several = slim.filter("chunks > 1").repartition("row").sortWithinPartitions("row", "chunk")
    schema = "row bigint, payload_bytes bigint, payload_digest string"
    return slim.filter("chunks = 1").mapInArrow(run, schema).unionByName(several.mapInArrow(run, schema))


def plan_records(digests: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add record_type, refers_to and refers_row (the row of one record with that id) to rows (row, record, payload_bytes, payload_digest).

    Of equal payloads of at least ``min_bytes``, the largest record id is the response and the others revisit it;
    a NULL id is never the largest. Smaller payloads are all responses.
    """
    large = digests.filter(F.col("payload_bytes") >= min_bytes)
    heads = large.groupBy("payload_digest").agg(F.max(F.struct("record", "row")).alias("_head"), F.count("*").alias("_n"))
    heads = written(heads.select("payload_digest", F.col("_head.record").alias("head"), F.col("_head.row").alias("head_row"), "_n"), "warc-heads")
    known = join_skewed(large, heads, "payload_digest")
    first = F.col("record").eqNullSafe(F.col("head"))
    known = known.withColumn("record_type", F.when(first, "response").otherwise("revisit"))
    known = known.withColumns({"refers_to": F.when(~first, F.col("head")), "refers_row": F.when(~first, F.col("head_row"))}).drop("head", "head_row")
    small = digests.filter(F.col("payload_bytes") < min_bytes)
    return known.unionByName(small.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"),
                                           F.lit(None).cast("bigint").alias("refers_row")))


def _urn(record: Column, row: Column, chunk: Column) -> Column:
    return F.concat_ws(":", F.lit("<urn:page"), F.coalesce(record.cast("string"), F.lit("none")), row.cast("string"), F.concat(chunk.cast("string"), F.lit(">")))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write one logical record per page below ``path``: the payload in chunks, or a revisit record without payload.

    Files are gzipped WARC/1.1 of at most FILE_RECORDS records. Every record starts with the WARC-Warcinfo-ID made for this call, which is
    returned: ``read_archives`` finds the borders of records by it, and no payload can hold it.
    """
    info = f"<urn:uuid:{uuid.uuid4()}>"
    chunks = chunk_table(pages, page_id, url, payload, chunk)
    heads = chunks.filter("chunk = 0").select("row", "record")
    digests = written(running_digests(chunks).join(heads, "row"), "warc-digests")
    plan = written(plan_records(digests, min_bytes).drop("record"), "warc-plan")
    rows = chunks.join(plan, "row").filter((F.col("record_type") == "response") | (F.col("chunk") == 0))
    response, first = F.col("record_type") == "response", F.col("chunk") == 0
    part = F.when(response, F.col("part")).otherwise(F.lit(b""))
    segmented = response & (F.col("chunks") > 1)
    whole_bytes = F.col("payload_bytes").cast("string")
    headers = [
        ("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        ("WARC-Record-ID", _urn(F.col("record"), F.col("row"), F.col("chunk"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        ("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(~response, _urn(F.col("refers_to"), F.col("refers_row"), F.lit(0)))),
        ("WARC-Segment-Number", F.when(segmented, (F.col("chunk") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(segmented & ~first, _urn(F.col("record"), F.col("row"), F.lit(0)))),
        ("WARC-Segment-Total-Length", F.when(segmented & (F.col("chunk") == F.col("chunks") - 1), whole_bytes)),
        ("X-Segments", F.when(response & first, F.col("chunks").cast("string"))),
        ("X-Payload-Length", F.when(first, whole_bytes)),
        ("Content-Type", F.when(response, F.lit("text/html"))),
        ("Content-Length", F.octet_length(part).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    start = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {info}{CRLF}"
    text = F.concat(F.lit(start), *lines, F.lit(CRLF), part.cast("string"))
    (rows.select(text.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))
    discard(chunks)
    return info


def read_records(spark: SparkSession, path: str, info: str) -> DataFrame:
    """The chunk records of archives: (row, record, kind, chunk, chunks, part, and the headers as a map)."""
    start = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {info}{CRLF}"
    raw = spark.read.option("lineSep", CRLF + CRLF + start).text(path)
    value = F.when(F.startswith("value", F.lit(start)), F.substr("value", F.lit(len(start) + 1))).otherwise(F.col("value"))
    head = F.substring_index("value", CRLF + CRLF, 1)
    rows = raw.select(value.alias("value")).select(F.octet_length(head).alias("at"), F.str_to_map(head, F.lit(CRLF), F.lit(": ")).alias("headers"),
                                                   F.col("value").cast("binary").alias("data"))
    length = F.col("headers")["Content-Length"].cast("int")
    ids = F.split(F.regexp_replace(F.col("headers")["WARC-Record-ID"], "[<>]", ""), ":")
    return rows.select(F.get(ids, F.lit(3)).cast("bigint").alias("row"), F.expr("try_cast(get(split(regexp_replace(headers['WARC-Record-ID'], '[<>]', ''), ':'), 2) AS bigint)").alias("record"),
                       F.col("headers")["WARC-Type"].alias("kind"), F.get(ids, F.lit(4)).cast("int").alias("chunk"),
                       F.substring(F.col("data"), F.col("at") + 5, length).alias("part"), length.alias("length"), "headers")


def read_archives(spark: SparkSession, path: str, info: str) -> DataFrame:
    """Logical records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are digested anew from their chunks; one that differs from its header, or a chunk that is cut off,
    raises. A revisit has no payload of its own: length and digest are those of its header.
    """
    rows = read_records(spark, path, info)
    cut = F.octet_length("part") < F.col("length")
    part = F.when(cut, F.raise_error(F.concat(F.lit("cut-off record "), F.col("headers")["WARC-Record-ID"])).cast("binary")).otherwise(F.col("part"))
    body = rows.filter("kind <> 'revisit'")
    # the number of chunks stands on the first; others of the record are recognised as such by their origin
    chunks = body.select("row", "record", "chunk", F.coalesce(F.col("headers")["X-Segments"].cast("int"), F.lit(-1)).alias("chunks"), part.alias("part"), "headers")
    sizes = chunks.filter("chunk = 0 AND chunks > 1").select("row", F.col("chunks").alias("all"))
    single = chunks.filter("chunks = 1")
    several = chunks.filter("chunks <> 1").drop("chunks").join(sizes, "row").withColumnRenamed("all", "chunks")
    found = running_digests(single.unionByName(several, allowMissingColumns=True))
    stated = chunks.filter("chunk = 0").select("row", "record", F.substring(F.col("headers")["WARC-Payload-Digest"], 6, 40).alias("stated"))
    same = F.col("stated") == F.col("payload_digest")
    responses = found.join(stated, "row").select(
        F.col("record").alias("page_id"), "payload_bytes",
        F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload and digest differ"))).alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    h = F.col("headers")
    revisits = rows.filter("kind = 'revisit'").select(
        F.col("record").alias("page_id"), h["X-Payload-Length"].cast("bigint").alias("payload_bytes"),
        F.substring(h["WARC-Payload-Digest"], 6, 40).alias("payload_digest"), F.lit("revisit").alias("record_type"),
        F.regexp_extract(h["WARC-Refers-To"], r"(-?\d+)", 1).cast("bigint").alias("refers_to"))
    return responses.unionByName(revisits)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write archives into the shared folder and read them back.

    NULL payloads are empty, NULL urls have no header, NULL page ids are kept and never referred to unless all rows of a payload
    have none; repeated rows are records of their own (all with the largest id of a payload are responses); an empty table gives
    no records; other columns are ignored.
    """
    path = scratch_path(pages.sparkSession, "warc")
    info = write_archives(pages, path, page_id, url, payload, chunk=chunk)
    return read_archives(pages.sparkSession, path, info)
