"""WARC archives: exact round trips, also of oversized payloads and of payloads that look like archives."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stormrail.llm import warc
from stormrail.llm.common import shared_folder


def expected(rows, least=1000):
    out = []
    largest = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= least and i is not None:
            largest[raw] = max(largest.get(raw, i), i)
    for i, u, h in rows:
        raw = (h or "").encode()
        refers = largest.get(raw) if i is not None and largest.get(raw) != i else None
        out.append((i, u, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def round_trip(spark, rows, most, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "page_id long, url string, html string, record string, size int").repartition(3)
    path = shared_folder(spark, "warc-test")
    warc.write(df, path, most=most, **options)
    got = warc.read(spark, path).collect()
    assert all(r.whole for r in got)
    return path, sorted(((r.page, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got),
                        key=str)


def pages(seed, n=60):
    rng = random.Random(seed)
    tricky = ["\r\n\r\nWARC/1.0\r\n", "\r\n\r\n", "\n", "é", "😀", "WARC-Type: revisit\r\n", "a" * 50, " ", "\r", "%0D"]
    rows = [(i, f"http://x/{i}?a=%41\n", "".join(rng.choice(tricky) for _ in range(rng.randint(0, 120))))
            for i in range(n)]
    rows += [(n + i, None, rows[rng.randrange(n)][2]) for i in range(n // 2)]
    return rows + [(500, "u", None), (501, "u", ""), (None, "u", "q" * 2000), (502, "v", "q" * 2000), (503, "", "q" * 2000),
                   (503, "", "q" * 2000)]


@pytest.mark.parametrize("most", [7, 100, 1 << 16])
def test_round_trip(spark, most):
    rows = pages(most)
    assert round_trip(spark, rows, most)[1] == expected(rows)


def test_files_are_read_in_splits(spark):
    rows = pages(9)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert round_trip(spark, rows, 500)[1] == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archive_is_plain_warc(spark):
    path, _ = round_trip(spark, [(1, "http://a/", "hällo"), (2, "http://b/", "x" * 30)], 10)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option(
        "pathGlobFilter", "part-*").load(path).collect())
    at, kinds, bodies = 0, [], []
    while at < len(raw):  # version line, headers, blank line, payload, two line ends
        head_end = raw.index(b"\r\n\r\n", at)
        head = raw[at:head_end].decode().split("\r\n")
        assert head[0] == "WARC/1.0"
        fields = dict(line.split(": ", 1) for line in head[1:])
        size = int(fields["Content-Length"])
        bodies.append(raw[head_end + 4:head_end + 4 + size])
        kinds.append(fields["WARC-Type"])
        at = head_end + 4 + size
        assert raw[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert sorted(kinds) == ["continuation"] * 2 + ["response"] * 2
    assert sorted(bodies) == sorted(["hällo".encode()] + [b"x" * 10] * 3)


def test_missing_chunk_is_not_whole(spark):
    parts = warc.chunks(spark.createDataFrame([("r", bytearray(b"0123456789" * 5)), ("s", bytearray(b"abc" * 9))],
                                              "record string, payload binary"), 8)
    total = F.when(F.col("chunk") + 1 == F.col("chunks"), F.col("total"))
    parts = parts.withColumn("total", total).withColumn("header", F.lit("h"))
    got = {r.record: (r.whole, r.payload_bytes) for r in warc.reassembled(
        parts.filter("record = 's' or chunk != 2")).collect()}
    assert got["s"] == (True, 27) and got["r"][0] is False


def test_empty_table(spark):
    assert round_trip(spark, [(1, None, None)], 10)[1] == expected([(1, None, None)])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared_folder(spark, "warc-test")
    warc.write(none, path)
    assert warc.read(spark, path).count() == 0
