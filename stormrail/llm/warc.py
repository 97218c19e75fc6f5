"""WARC archives by way of a chunked record table.

A payload travels as rows (record, chunk number, bytes). Each chunk row carries the digest of the payload up to and
including itself, so a digest is never computed over a whole payload, neither writing nor reading: a task holds one chunk
of it and the state of the digest. In the archive an oversized payload is a response record followed by continuation
records (WARC segmentation), one for each chunk; the last one states the total length.

A record is one row of Spark's text writer, whose commit protocol makes a lost executor cost its tasks only. Records are
read back by the text reader with the beginning of a record as separator, so files split; the writer cuts chunks within
that byte sequence, so no payload can hold it whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail.llm.common import slices, written

#: Bytes of a chunk at most.
CHUNK_BYTES = 64 << 10
#: Payloads from this size on are written once; records with an equal payload refer to it.
LEAST_REVISIT = 1000
# Fixed values of the format.
VERSION = "WARC/1.0"
SEPARATOR = f"\r\n\r\n{VERSION}\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_CHUNK = "record string, chunk long, chunks long, bytes binary, running string, total long"


def chunk_bytes(payload: bytes, most: int) -> list[bytes]:
    """Pieces of at most ``most`` bytes, one at least, such that no record that holds one shows the separator of the
    archive, neither inside the piece nor where it meets the blank lines around it."""
    out, at, sign, blank = [], 0, SEPARATOR.encode(), b"\r\n\r\n"
    while at < len(payload) or not out:
        piece = payload[at:at + most]
        found = (blank + piece + blank).find(sign)
        if found >= 0:  # cut within it
            piece = piece[:found + len(sign) // 2 - len(blank)]
        out.append(piece)
        at += len(piece)
    return out


def chunks(records: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of (record, payload): a null payload is an empty one. ``running`` is the hex SHA-1 of the payload up
    to the end of the chunk, ``chunks`` and ``total`` its number of chunks and bytes."""

    def run(batches):
        for batch in slices(batches, "payload"):
            cols = {n: [] for n in ("record", "chunk", "chunks", "bytes", "running", "total")}
            for record, payload in zip(batch.column("record").to_pylist(), batch.column("payload")):
                raw = payload.as_py() or b""
                digest = hashlib.sha1()
                pieces = chunk_bytes(raw, most)
                for k, piece in enumerate(pieces):
                    digest.update(piece)
                    for name, value in zip(cols, (record, k, len(pieces), piece, digest.hexdigest(), len(raw))):
                        cols[name].append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))

    return records.select("record", "payload").mapInArrow(run, _CHUNK)


def reassembled(parts: DataFrame) -> DataFrame:
    """(record, header, payload_bytes, payload_digest, whole) from chunk rows (record, chunk, header, bytes, running,
    total): digests of the payloads from their chunks in order, never holding more than one chunk.

    ``header`` is that of chunk 0. ``whole``: every chunk is there once, its running digest is right, and the lengths
    add up to ``total`` (null other than on the last chunk). Records are dealt by name and sorted by chunk number; no
    chunks at all give no rows.
    """
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    names = ["record", "header", "payload_bytes", "payload_digest", "whole"]

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names=names)

    def run(batches):
        done, state = [], None  # state: record, header, size, digest, whole, next chunk, total

        def closed(x):
            return x[0], x[1], x[2], x[3].hexdigest(), bool(x[4] and x[6] == x[2])

        for batch in slices(batches, "bytes"):
            columns = [batch.column(c).to_pylist() for c in ("record", "chunk", "header", "running", "total")]
            for record, k, header, running, total, raw in zip(*columns, batch.column("bytes")):
                if state is None or record != state[0]:
                    if state:
                        done.append(closed(state))
                    state = [record, header, 0, hashlib.sha1(), True, 0, None]
                piece = raw.as_buffer()
                state[3].update(piece)
                state[2] += piece.size
                state[4] = state[4] and k == state[5] and running == state[3].hexdigest()
                state[5] += 1
                state[6] = total if total is not None else state[6]
            if len(done) > 1000:
                yield out(done)
                done = []
        yield out(done + ([closed(state)] if state else []))

    rows = (parts.select("record", "chunk", "header", "running", "total", "bytes")
            .repartition("record").sortWithinPartitions("record", "chunk"))
    return rows.mapInArrow(run, "record string, header string, payload_bytes long, payload_digest string, whole boolean")


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; line ends and percent signs in the value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "%", "%25"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _header(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "%0A", "\n"), "%0D", "\r"), "%25", "%")
    return F.when(header.rlike(rf"(?:^|\n){name}: "), plain)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          most: int = CHUNK_BYTES, least_revisit: int = LEAST_REVISIT) -> None:
    """Write a record for each row of ``pages`` as WARC text files under ``path``.

    Of rows with equal payloads of ``least_revisit`` bytes or more the one with the largest id is a response (each of
    them, if that row repeats), the others are revisits of it without payload. A null id, which is never the largest,
    has no id header; a null url no target header. A null payload is an empty one.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long"))
    large = rows.filter((F.col("size") >= least_revisit) & F.col("id").isNotNull()).select(
        "id", "size", F.sha1("payload").alias("digest"))
    # only payloads that occur more than once are looked up; the table is written, so its size is known to the planner
    again = written(large.groupBy("digest", "size").agg(F.max("id").alias("response"), F.min("id").alias("least"))
                    .filter("response != least"), "copies").select("digest", F.col("size").alias("s"), "response")
    rows = rows.withColumn("digest", F.sha1("payload")).join(
        again.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    rows = rows.withColumn("refers", F.when(F.col("response") != F.col("id"), F.col("response")))
    name = F.concat(F.lit("urn:record:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"),
                    F.monotonically_increasing_id().cast("string"))
    meta = F.concat(
        _line("WARC-Page-ID", F.col("id").cast("string")), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("refers").isNotNull(), F.concat(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
            F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">\r\n"))))
        .otherwise(F.lit("")))
    # name and headers travel in one string, so that they come out of the chunking as they went in
    kind = F.when(F.col("refers").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    record = F.concat_ws("\n\n", name, kind, meta)
    body = F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b""))
    parts = F.split("record", "\n\n", 3)
    table = chunks(rows.select(record.alias("record"), body.alias("payload")), most).select(
        parts[0].alias("name"), parts[1].alias("kind"), parts[2].alias("meta"), "chunk", "chunks", "bytes", "running",
        "total")
    more = F.col("chunk") > 0
    segment = F.when(F.col("chunks") > 1, F.concat(
        F.lit("WARC-Segment-Number: "), (F.col("chunk") + 1).cast("string"), F.lit("\r\n"),
        F.when(more, F.concat(F.lit("WARC-Segment-Origin-ID: <"), F.col("name"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.when(F.col("chunk") + 1 == F.col("chunks"), F.concat(
            F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    )).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(more, F.lit("continuation")).otherwise(F.col("kind")),
        F.lit("\r\nWARC-Record-ID: <"), F.col("name"),
        F.when(more, F.concat(F.lit(":"), F.col("chunk").cast("string"))).otherwise(F.lit("")), F.lit(">\r\n"),
        F.when(more, F.lit("")).otherwise(F.col("meta")), segment,
        F.lit("WARC-Running-Digest: sha1:"), F.col("running"),
        F.lit("\r\nContent-Length: "), F.length("bytes").cast("string"), F.lit("\r\n\r\n"))
    # the writer's own line end completes the blank lines after the record
    table.select(F.concat(head.cast("binary"), F.col("bytes"), F.lit(b"\r\n")).cast("string").alias("value")).write.option(
        "lineSep", "\r\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: (record, page, url, record_type, refers_to, payload_bytes,
    payload_digest, whole), one row for each response and revisit record.

    Bytes and digests of responses come from their payloads as read, those of revisits from their headers. ``whole``
    tells whether a payload is complete and fits its digests. Truncated records are rows that are not whole.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))
    # the header of a record ends at the first blank line
    text = F.col("value").cast("string")
    upto = F.octet_length(F.substring(text, F.lit(1), F.locate("\r\n\r\n", text) - 1))
    rows = raw.withColumn("upto", upto).filter("upto > 0").withColumn(
        "header", F.substring("value", F.lit(1), F.col("upto")).cast("string"))
    header = F.col("header")
    number = _header(header, "WARC-Segment-Number").cast("long")
    body = F.expr("substring(value, upto + 5, int(regexp_extract(header, 'Content-Length: ([0-9]+)', 1)))")
    rows = rows.select("header", number.alias("number"), body.alias("bytes"),
                       _header(header, "Content-Length").cast("long").alias("length"))
    name = F.regexp_extract("header", r"WARC-Record-ID: <([^>]*)>", 1)
    alone = rows.filter("number is null").select(
        name.alias("record"), "header", F.length("bytes").cast("long").alias("payload_bytes"),
        F.sha1("bytes").alias("payload_digest"), (F.length("bytes") == F.col("length")).alias("whole"))
    origin = F.regexp_extract("header", r"WARC-Segment-Origin-ID: <([^>]*)>", 1)
    parts = rows.filter("number is not null").select(
        F.when(origin != "", origin).otherwise(name).alias("record"), (F.col("number") - 1).alias("chunk"), "header",
        F.regexp_extract("header", r"WARC-Running-Digest: sha1:([0-9a-f]*)", 1).alias("running"),
        _header(header, "WARC-Segment-Total-Length").cast("long").alias("total"), "bytes")
    found = alone.union(reassembled(parts))
    kind = _header(header, "WARC-Type")
    stated = F.regexp_extract("header", r"WARC-Payload-Digest: sha1:([0-9a-f]*)", 1)
    refers = F.expr("try_cast(regexp_extract(header, 'WARC-Refers-To: <urn:page:([0-9-]+)>', 1) as long)")
    revisit = kind == "revisit"
    return found.select(
        "record", _header(header, "WARC-Page-ID").cast("long").alias("page"),
        _header(header, "WARC-Target-URI").alias("url"), kind.alias("record_type"), refers.alias("refers_to"),
        F.when(revisit, _header(header, "WARC-Payload-Length").cast("long")).otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("payload_digest")).alias("payload_digest"),
        (F.col("whole") & (revisit | (stated == F.col("payload_digest")))).alias("whole"))
