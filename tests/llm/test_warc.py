import base64
import hashlib
import io

import pytest
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from kindred.llm import warc
from kindred.llm.runtime import fresh


def rows():
    same = "<p>equal</p>"
    return [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (1, "http://a/1\r\nX: y", "<p>ünï</p>"), (2, "u", None), (4, "u", ""), (7, "u", "x" * 600_000), (None, "u", same), (3, "http://a/3", same), (8, "u", "WARC/1.1\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame(rows(), "page_id long, url string, html string").withColumnRenamed("html", "html")


@pytest.mark.parametrize("most", [warc.MOST_BROADCAST, 1, 0])
def test_round_trip(spark, most):
    """Digests by broadcast, and, beyond the bound, those of large groups by broadcast and the others by a join."""
    folder = fresh(spark, "test")
    index = warc.write_warc(pages(spark).withColumn("payload", F.lit("other")).withColumn("id", F.lit(0)), folder, most_broadcast=most)
    assert index.count() == len(rows())
    first = {}
    for i, _, h in rows():
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows():
        raw = (h or "").encode()
        revisit = None if first[h or ""] == i else first[h or ""]
        want.append((-1 if i is None else i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if revisit is None else "revisit", revisit))
    got = [(-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fetch_reads_one_frame(spark):
    folder = fresh(spark, "test")
    warc.write_warc(pages(spark), folder)
    ids = spark.createDataFrame([("urn:page:7",), ("urn:page:1",), ("urn:page:404",)], "id string")
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.fetch(spark, folder, ids).collect()}
    assert got == {"urn:page:7": b"x" * 600_000, "urn:page:1": "<p>ünï</p>".encode()}


def test_bundles_are_one_zstandard_stream(spark):
    folder = fresh(spark, "test")
    index = warc.write_warc(pages(spark).coalesce(1), folder)
    files, root = pafs.FileSystem.from_uri(folder)
    for (name,) in index.select("bundle").distinct().collect():
        raw = files.open_input_file(f"{root}/{name}").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        reader = warc.BundleReader(files.open_input_file(f"{root}/{name}"))
        assert len(reader.frames) > 1
        assert b"".join(reader.frame(k) for k in range(len(reader.frames))) == plain
        assert plain.startswith(b"WARC/1.1\r\n")


def test_empty(spark):
    folder = fresh(spark, "test")
    assert warc.write_warc(pages(spark).filter("false"), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0
