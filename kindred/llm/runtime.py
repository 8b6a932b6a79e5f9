"""Shared folders, written intermediate tables and row identity.

Intermediate results are cut by writing Parquet below the folder in
``spark.checkpoint.dir``, which all executors and the driver share, so a lost
executor costs the tasks it ran and nothing that was already written.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.llm.kernels import chunks
from kindred.shared import drop, shared_dir, table, written  # noqa: F401  (for the operators)


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Columns that operators add to tell rows apart; a caller's column of the same name is kept aside.
ROW_KEY = "__kindred_text_hash"


#: log2 of the bits of a filter that is broadcast: 4 MB, whatever it was made from.
FILTER_BITS = 25


def filter_words(keys: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """(__word, __bits) of a filter of hashes: 2^FILTER_BITS / 64 rows at most."""
    bit = F.shiftrightunsigned(F.col(key), 64 - FILTER_BITS)
    words = keys.select(F.shiftright(bit, 6).alias("__word"), (bit % 64).cast("int").alias("bit"))
    return words.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__bits"))


def key_filter(keys: DataFrame, key: str = ROW_KEY) -> np.ndarray:
    """Packed bits of a filter that every hash in ``keys`` passes; others pass the less, the fewer hashes there are."""
    rows = filter_words(keys, key).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    if rows.num_rows:
        out[rows["__word"].to_numpy()] = rows["__bits"].to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit hash passes the filter."""
    at = key.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marked_by(docs: DataFrame, keys: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """``docs`` with ``__maybe``: whether ``key`` passes the filter of ``keys``.  In DataFrame functions: the filter is a broadcast table of bounded size."""
    bit = F.shiftrightunsigned(F.col(key), 64 - FILTER_BITS)
    joined = docs.withColumn("__word", F.shiftright(bit, 6)).join(F.broadcast(filter_words(keys, key)), "__word", "left")
    hit = F.expr(f"shiftrightunsigned(__bits, cast(shiftrightunsigned({key}, {64 - FILTER_BITS}) % 64 as int)) & 1L")
    return joined.withColumn("__maybe", F.coalesce(hit == 1, F.lit(False))).drop("__word", "__bits")


def without(docs: DataFrame, losers: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text) is not in ``losers`` (id column and ``ROW_KEY``).

    Null ids and null texts compare as equal.  A filter of fixed size, made
    from the losers, lets most other rows through where they are; only rows
    that pass it are joined, exactly, so that few texts are shuffled as long
    as losers are few for its bits (beyond some ten millions of them most rows
    pass it, and the join alone decides).
    """
    keyed = docs.withColumn(ROW_KEY, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    marked = marked_by(keyed, losers)
    left = marked.filter("__maybe")
    right = losers.select(F.col(id_col).alias("__loser_id"), F.col(ROW_KEY).alias("__loser_key"))
    on = left[id_col].eqNullSafe(right["__loser_id"]) & (left[ROW_KEY] == right["__loser_key"])
    return marked.filter("not __maybe").unionByName(left.join(right, on, "left_anti")).drop(ROW_KEY, "__maybe")


TEXT = "__kindred_text"
#: Bytes of text that a worker works through at a time, and bytes of a batch that it is sent.
CHUNK, BATCH = 512 << 10, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Holds the bytes of a batch for Python to BATCH, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or now.rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH))


def map_texts(docs: DataFrame, text_col: str, carry: list[str], out: StructType, start, most: int = CHUNK) -> DataFrame:
    """``carry`` columns and the columns ``out``, made from whole texts a few megabytes at a time.

    ``start()`` runs once in each task and returns a function of (bytes,
    offsets) that gives an Arrow array for each field of ``out``.  A column of
    ``docs`` whose name is one of ``out`` (case ignored) gives way to it.
    """
    bounded(docs.sparkSession)
    names = {f.name.lower() for f in out}
    cols = [c for c in carry if c.lower() not in names]
    given = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text_col}`").alias(TEXT))

    def run(batches):
        work = start()
        for batch, data, at in chunks(batches, TEXT, most):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(cols))] + work(data, at), cols + out.names)

    return given.mapInArrow(run, StructType(given.schema.fields[:-1] + out.fields))


#: Vectors that are added up at a time.
FAN = 64


def added(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` numbers that ``run`` yields for each partition's batches: in a tree of groups, FAN rows of which come to the driver."""

    def vectors(batches):
        total = np.zeros(size)
        for x in run(batches):
            total += x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["g", "x"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in table["x"]:
            total += np.frombuffer(x.as_buffer())
        return pa.table({"g": table["g"][:1], "x": [total.tobytes()]})

    found = rows.mapInArrow(vectors, "g long, x binary")
    for groups in (FAN * FAN, FAN):
        found = found.withColumn("g", F.col("g") % groups).groupBy("g").applyInArrow(add, "g long, x binary")
    return sum((np.frombuffer(x.as_py()) for x in found.toArrow()["x"]), np.zeros(size))


def binaries(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are neighbouring slices of ``data`` that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
