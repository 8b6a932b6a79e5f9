"""Token ids in flat binary files with 64-bit document offsets.

A shard is two files: ``.bin`` has the ids of its documents one after another,
as little-endian unsigned integers of 16 or 32 bits (what the vocabulary
needs); ``.idx`` has, as little-endian 64-bit integers, the number of documents
n, n+1 offsets in ids, n document ids and n flags that are 1 for a null id.
Documents are in ascending order of their ids over all shards (null first, ties
by a hash of the text).  The base of each shard, the ids before it, is the
prefix sum of shard totals, in ``manifest.json``.

A task writes files under names of its own attempt and reports them; the
manifest, written last, names the files of the attempts that counted.

Defined cases: a null or empty text is its end id alone; repeated rows are
documents of their own; an empty table gives a manifest without shards.  While
encoding, stretches of text of equal 64-bit hash, length and first seven bytes
count as equal.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.kernels import SPACE, SliceCache, chunks
from kindred.llm.runtime import CHUNK, ROW_KEY, TEXT, bounded


def filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?()")] = True
_PLAIN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


_BYTES = frozenset(np.flatnonzero(_PLAIN).tolist())


def safe_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their tokens.

    These are their starts; plain spaces between two visible characters, since
    byte-level pre-tokenisers join one space to what follows it; both sides of
    a line end between two visible characters; and marks such as a comma after
    an ASCII letter or digit.  Next to characters whose UTF-8 form could be
    that of a Unicode space nothing is cut at a space or line end.
    """
    n = len(data)
    place = np.flatnonzero((data == 32) | (data == 10))
    place = place[(place > 0) & (place < n - 1)]
    odd = np.zeros(256, bool)
    odd[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    before, after = data[place - 1], data[place + 1]
    ok = ~SPACE[before] & ~SPACE[after] & ~odd[after] & ((before < 28) | (before > 31)) & ((after < 28) | (after > 31))
    wide = before >= 0x80
    ok &= ~(wide & (odd[data[np.maximum(place - 2, 0)]] | odd[data[np.maximum(place - 3, 0)]]))
    cut = np.zeros(n + 1, bool)
    place = place[ok]
    cut[place] = True
    cut[place[data[place] == 10] + 1] = True
    cut[1:n] |= _MARK[data[1:]] & _PLAIN[data[:-1]]
    cut[at] = True
    return np.flatnonzero(cut[:n])


class LibraryEncoder:
    """Whole texts through a ``tokenizers`` model: each distinct stretch between safe cuts is encoded once while it is cached."""

    def __init__(self, model: str, dtype: str, most: int = 1_400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self.cache = SliceCache(self.dtype, most)
        self.bytes = np.zeros(self.model.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token)  # byte-level vocabularies write a byte as a character

    def library(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has.

        Words with a space before them and an ASCII letter or digit at their
        end are encoded many in one text, which may be cut between them; the
        bytes of each token tell where.
        """
        simple = [len(p) > 1 and p[0] == 32 and p[1] in _BYTES and p[-1] in _BYTES for p in parts]
        words = [p for p, s in zip(parts, simple, strict=True) if s]
        ids, many = self.each([p for p, s in zip(parts, simple, strict=True) if not s])
        more, cuts = self.joined(words)
        n = np.zeros(len(parts), np.int64)
        mask = np.array(simple, bool)
        n[mask], n[~mask] = cuts, many
        out = np.empty(len(ids) + len(more), self.dtype)
        own = np.repeat(mask, n)
        out[own], out[~own] = more, ids
        return out, n

    def each(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.model.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(n.sum())), n

    def joined(self, words: list[bytes], together: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = [b"".join(words[i : i + together]).decode() for i in range(0, len(words), together)]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.bytes[ids])
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last = np.searchsorted(ends, stops)
        if len(ends) and last[-1] < len(ends) and (ends[last] == stops).all():
            return ids, np.diff(last, prepend=-1)
        return self.each(words)  # a vocabulary whose tokens aren't written byte by byte

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[bytes, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and how many ids there are up to the end of each text."""
        cuts = safe_cuts(data, at)
        store, first, length = self.cache.ids_of(data, cuts, self.library)
        before = np.concatenate([[0], np.cumsum(length)])
        ends = before[np.searchsorted(cuts, at[1:])] + np.arange(1, len(at))
        out = np.full(int(before[-1]) + len(at) - 1, end_id, self.dtype)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = store[np.arange(before[-1]) + np.repeat(first - before[:-1], length)]
        return out.tobytes(), ends


_kept: list = [None, None]
#: Documents after which a shard ends, as after its bytes: their offsets wait in memory until it does.
SHARD_DOCS = 2_000_000


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 30, chunk_bytes: int = CHUNK) -> dict:
    """Writes ``docs`` to ``folder`` (a URI) and returns the manifest."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    size = max(Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(model)
    bounded(docs.sparkSession)
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(ROW_KEY), F.col(text_col).alias(TEXT))
    dealt = given.repartitionByRange("id", ROW_KEY).sortWithinPartitions("id", ROW_KEY)

    def run(batches):
        if _kept[0] is not shared.value:
            _kept[:] = [shared.value, LibraryEncoder(shared.value, dtype)]
        encoder = _kept[1]
        out, _ = filesystem(folder)
        part = TaskContext.get().partitionId()
        state: dict = {}

        def close():
            state["bin"].close()
            ends, ids = np.concatenate(state["ends"]), state["ids"]
            null = np.concatenate([np.asarray(x.is_null()) for x in ids]).astype("<i8")
            ids = np.concatenate([x.fill_null(0).to_numpy() for x in ids]).astype("<i8")
            with out.open_output_stream(f"{root}/{state['name']}.idx") as f:
                f.write(np.concatenate([[len(ids)], [0], ends, ids, null]).astype("<i8").tobytes())
            row = [part, state["roll"], state["name"], len(ids), int(ends[-1])]
            roll = state["roll"] + 1
            state.clear()
            state["next"] = roll
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "roll", "name", "docs", "tokens"])

        for batch, data, at in chunks(batches, TEXT, chunk_bytes):
            if "bin" not in state:
                name = f"shard-{part:06d}-{state.get('next', 0):04d}-{uuid.uuid4().hex}"
                state |= {"name": name, "roll": state.get("next", 0), "bin": out.open_output_stream(f"{root}/{name}.bin"), "ends": [], "ids": [], "n": 0, "docs": 0}
            blob, ends = encoder.encode(data, at, end_id)
            state["bin"].write(blob)
            state["ends"].append(ends + state["n"])
            state["ids"].append(batch.column(0))
            state["n"] += int(ends[-1])
            state["docs"] += len(ends)
            if state["n"] * np.dtype(dtype).itemsize >= shard_bytes or state["docs"] >= SHARD_DOCS:
                yield close()
        if "bin" in state:
            yield close()

    rows = dealt.mapInArrow(run, "part long, roll long, name string, docs long, tokens long").collect()  # one row a shard
    base, first, shards = 0, 0, []
    for r in sorted(rows, key=lambda r: (r["part"], r["roll"])):
        shards.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "base": base, "first_doc": first})
        base, first = base + r["tokens"], first + r["docs"]
    manifest = {"dtype": dtype, "end_id": end_id, "docs": first, "tokens": base, "shards": shards}
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Stored:
    """``n`` numbers of a file from byte ``at``, read slice by slice: mapped where the file system is local, else by ranges."""

    def __init__(self, files, path: str, dtype: str, at: int = 0, n: int | None = None):
        self.dtype, self.at = np.dtype(dtype), at
        local = isinstance(files, pafs.LocalFileSystem)
        size = files.get_file_info(path).size
        self.n = (size - at) // self.dtype.itemsize if n is None else n
        self.map = np.memmap(path, self.dtype, "r", at, (self.n,)) if local and self.n else None
        self.file = None if local else files.open_input_file(path)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: slice) -> np.ndarray:
        low, high, _ = k.indices(self.n)
        if self.map is not None or self.file is None or high <= low:
            return np.zeros(0, self.dtype) if self.map is None else self.map[low:high]
        self.file.seek(self.at + low * self.dtype.itemsize)
        return np.frombuffer(self.file.read((high - low) * self.dtype.itemsize), self.dtype)


def open_shard(folder: str, name: str, dtype: str):
    """(ids, offsets, document ids, null flags) of a shard, each to be read by slices."""
    files, root = filesystem(folder)
    path = f"{root}/{name}.idx"
    n = int(Stored(files, path, "<i8", 0, 1)[0:1][0])
    return Stored(files, f"{root}/{name}.bin", dtype), *[Stored(files, path, "<i8", 8 * a, b) for a, b in ((1, n + 1), (n + 2, n), (2 * n + 2, n))]


#: Documents, and ids, that a reader takes at a time (more ids only where one document has more).
READ_DOCS, READ_IDS = 4096, 1 << 20


def stretches(at: Stored, n: int):
    """(first, end, offsets) of neighbouring documents of READ_IDS ids or READ_DOCS documents at most, one at least."""
    low = 0
    while low < n:
        ends = at[low : min(low + READ_DOCS, n) + 1]
        k = max(1, int(np.searchsorted(ends, ends[0] + READ_IDS, "right")) - 1)
        yield low, low + k, ends[: k + 1]
        low += k


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document in the files and, if asked for, its ``ids``."""
    files, root = filesystem(folder)
    with files.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    shared = spark.sparkContext.broadcast(manifest)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = shared.value["shards"][k]
                tokens, at, docs, null = open_shard(folder, shard["name"], shared.value["dtype"])
                for low, high, ends in stretches(at, len(docs)):
                    own = tokens[int(ends[0]) : int(ends[-1])]
                    cuts = (ends - ends[0]).tolist()
                    crc = [zlib.crc32(own[a:b].astype("<u4")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    columns = [pa.array(docs[low:high], mask=null[low:high] == 1), pa.array(ends[:-1] + shard["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())]
                    if ids:
                        columns.append(pa.array([own[a:b].astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    n = len(manifest["shards"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)
