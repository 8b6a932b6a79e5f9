"""WARC bundles in seekable Zstandard.

A bundle is a run of independent Zstandard frames, each with whole records,
followed by a seek table in a skippable frame at the end of the file: any
Zstandard tool reads the bundle as one stream, and a reader that knows the
table decompresses only the frame it wants.  An index in Parquet maps record
ids to bundle, frame and offset within the decompressed frame.

Of records with equal payloads that of the smallest id is a response and the
others revisit it.  Only payload digests that occur more than once are joined
back to the pages, by broadcast up to MOST_BROADCAST of them.  Beyond it those
of the largest groups are broadcast, and of the other pages only those that
pass a filter of the rest are shuffled, so that no large group lands in one
task.  A bundle is written by the task that has its pages.

A task writes bundles under names of its own attempt, and the index, written by
Spark, names the bundles of the attempts that counted.

Defined cases: a null payload is empty; a null URL leaves its header out, and
control characters in one are percent-encoded; rows of equal id and payload are
all responses; a row without an id has none in its record, and revisits only if
an equal payload has an id; an empty table gives an empty index.  A record over
FRAME bytes is a frame of its own; a payload has less than 2 GiB, as a string of
Spark has, so that a frame's sizes fit its 32 bits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.runtime import bounded, marked_by, written

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME, BUNDLE = 256 << 10, 512 << 20
PREFIX = "urn:page:"
#: Most digests that occur more than once and are broadcast (60 bytes each).
MOST_BROADCAST = 200_000
INDEX = "bundle string, record_id string, frame long, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """A response with the payload, or a revisit with its digest and length only."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class BundleWriter:
    """Frames and the seek table of one bundle."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.frames, self.written = [], 0, [], 0

    def add(self, blob: bytes) -> tuple[int, int]:
        """Frame and offset at which the record lies."""
        place = len(self.frames), self.size
        self.held.append(blob)
        self.size += len(blob)
        if self.size >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.stream.close()


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, file):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self.read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        entry = 12 if flags & 0x80 else 8
        table = self.read(size - 9 - entry * n, entry * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, entry * k)
            self.frames.append((at, packed, plain))
            at += packed

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.unpacker.decompress(self.read(at, packed), max_output_size=plain)


def parse(frame: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at ``at``, and where the next one starts."""
    end = frame.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
    low = end + 4
    high = low + int(head["Content-Length"])
    return head, frame[low:high], high + 4


def page_of(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(PREFIX)
    return int(text) if text else None


def decided(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``pages`` with ``__first``: the smallest id among rows of an equal payload that occurs more than once."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.withColumn("__sha", F.when(F.length(payload) >= least_bytes, F.sha1(payload)))
    often = keyed.filter("__sha is not null").groupBy("__sha").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n"))
    often = written(often.filter("n > 1 and __first is not null"), "payloads")
    facts = often.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows")).first()
    if facts["n"] <= most_broadcast:
        return keyed.join(F.broadcast(often.drop("n")), "__sha", "left").drop("__sha")
    heavy = F.col("n") * max(most_broadcast, 1) >= facts["rows"]  # most_broadcast groups at most
    found = keyed.join(F.broadcast(often.filter(heavy).drop("n")), "__sha", "left")
    rest = often.filter(~heavy).drop("n").withColumn("__key", F.xxhash64("__sha"))
    marked = marked_by(found.withColumn("__key", F.xxhash64("__sha")), rest, "__key")
    open_ = F.col("__maybe") & F.col("__first").isNull() & F.col("__sha").isNotNull()
    joined = marked.filter(open_).drop("__first", "__key").join(rest.drop("__key"), "__sha", "left")
    return marked.filter(~open_).drop("__key").unionByName(joined).drop("__sha", "__maybe")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2025-01-01T00:00:00Z", least_bytes: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Writes ``pages`` as bundles below ``folder`` and returns the index."""
    bounded(pages.sparkSession)
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = decided(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")), "id", "payload", least_bytes, most_broadcast)

    def run(batches):
        out, _ = pafs.FileSystem.from_uri(folder)
        bundle = None
        for batch in batches:
            got = {"bundle": [], "record_id": [], "frame": [], "offset": []}
            ids, urls, payloads, firsts = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "url", "payload", "__first"))
            for page, url, payload, first in zip(ids, urls, payloads, firsts, strict=True):
                page, first = page.as_py(), first.as_py()
                if bundle is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(out.open_output_stream(f"{root}/{name}", compression=None))
                place = bundle.add(record(page, url.as_py(), (payload.as_py() or "").encode(), None if first == page else first, date))
                for k, v in zip(got, (name, f"{PREFIX}{'' if page is None else page}", *place), strict=True):
                    got[k].append(v)
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_pydict(got)
        if bundle is not None:
            bundle.close()

    rows.select("id", "url", "payload", "__first").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of all bundles; a response's digest and length are taken from its payload."""
    bundles = [r[0] for r in spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct().orderBy("bundle").collect()]  # one row a file
    shared = spark.sparkContext.broadcast(bundles)

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in (shared.value[k] for k in batch.column(0).to_pylist()):
                with files.open_input_file(f"{root}/{name}") as f:
                    reader = BundleReader(f)
                    for k in range(len(reader.frames)):
                        frame, at, rows = reader.frame(k), 0, []
                        while at < len(frame):
                            head, payload, at = parse(frame, at)
                            if head["WARC-Type"] == "response":
                                size, sha = len(payload), digest(payload)
                                if head["WARC-Payload-Digest"] != "sha1:" + sha:
                                    raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
                            else:
                                size, sha = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                            rows.append((page_of(head["WARC-Record-ID"]), size, sha, head["WARC-Type"], page_of(head.get("WARC-Refers-To"))))
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.range(0, len(bundles), 1, max(1, len(bundles))).mapInArrow(run, RECORD)  # a task for each bundle


def fetch(spark: SparkSession, folder: str, record_ids: DataFrame) -> DataFrame:
    """(record_id, url, payload) of the records named in the first column; each wanted frame alone is decompressed."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    wanted = index.join(record_ids.select(F.col(record_ids.columns[0]).alias("record_id")).distinct(), "record_id")
    wanted = wanted.select("bundle", "frame", "offset", "record_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        name, reader, at, frame = None, None, None, b""
        for batch in batches:
            rows = []
            for bundle, k, offset, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, at, reader = bundle, None, BundleReader(files.open_input_file(f"{root}/{bundle}"))
                if k != at:
                    at, frame = k, reader.frame(k)
                head, payload, _ = parse(frame, offset)
                rows.append((key, head.get("WARC-Target-URI"), payload))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], ["record_id", "url", "payload"])

    return wanted.mapInArrow(run, "record_id string, url string, payload binary")
