import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from kindred.llm import kernels, token_files
from kindred.llm.kernels import SliceCache
from kindred.llm.runtime import fresh
from tests.llm.cases import awkward, none

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
MODEL.encode_special_tokens = True
ENCODER = token_files.LibraryEncoder(open(PATH, encoding="utf-8").read(), "<u2", 100)


def library(texts):
    return [e.ids + [0] for e in MODEL.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdmtrevl1a.,;　\xa0")), max_size=60), min_size=1, max_size=5))
def test_cuts_change_no_token(texts):
    data, at = kernels.buffer(pa.array(texts, pa.string()))
    blob, ends = ENCODER.encode(data, at, 0)
    assert [x.tolist() for x in np.split(np.frombuffer(blob, "<u2"), ends[:-1])] == library(texts)


def test_round_trip(spark):
    docs = awkward(spark)
    folder = fresh(spark, "test")
    manifest = token_files.write_tokens(docs, folder, PATH, shard_bytes=200, chunk_bytes=100)
    rows = sorted(token_files.read_tokens(spark, folder, ids=True).collect(), key=lambda r: r["start"])
    assert manifest["docs"] == len(rows) == docs.count() and len(manifest["shards"]) > 1
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, x) for r, x in zip(docs.collect(), library([r["text"] or "" for r in docs.collect()]), strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in rows) == want
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert start == manifest["tokens"]


def test_empty(spark):
    folder = fresh(spark, "test")
    assert token_files.write_tokens(none(spark), folder, PATH)["shards"] == []
    assert token_files.read_tokens(spark, folder).count() == 0


def test_query(spark, sf_dir):
    from kindred.llm import queries

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = sorted(queries.op2_token_files(spark, sf_dir).collect())
    ids = library([t for _, t in docs])
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [r["start"] for r in rows] == [sum(map(len, ids[:k])) for k in range(len(ids))]


def test_ranges_of_stored_files(spark, monkeypatch):
    """Through a file system that can't be mapped, slices are read one by one, and the rows are the same."""
    docs = awkward(spark)
    folder = fresh(spark, "test")
    token_files.write_tokens(docs, folder, PATH, shard_bytes=20_000, chunk_bytes=100)
    want = sorted(map(tuple, token_files.read_tokens(spark, folder, ids=True).drop("ids").collect()), key=str)
    files, root = token_files.filesystem(folder)
    read = []

    class File:
        def __init__(self, f):
            self.f = f
            self.seek = f.seek

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class Opener(pafs.SubTreeFileSystem):
        def open_input_file(self, path):
            return File(super().open_input_file(path))

    remote = Opener("/", files)
    monkeypatch.setattr(token_files, "filesystem", lambda uri: (remote, root.lstrip("/")))
    monkeypatch.setattr(token_files, "READ_DOCS", 2)
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    manifest = json.loads(files.open_input_file(f"{root}/manifest.json").read())
    got = []
    for shard in manifest["shards"]:
        tokens, at, ids, null = token_files.open_shard(folder, shard["name"], manifest["dtype"])
        assert tokens.map is None
        for low, high, ends in token_files.stretches(at, len(ids)):
            assert high - low == 1 or (high - low <= 2 and ends[-1] - ends[0] <= 50)
            own = tokens[int(ends[0]) : int(ends[-1])]
            for k in range(high - low):
                x = own[ends[k] - ends[0] : ends[k + 1] - ends[0]]
                got.append((None if null[low + k : low + k + 1][0] else int(ids[low + k : low + k + 1][0]), int(ends[k]) + shard["base"], len(x), zlib.crc32(x.astype("<u4"))))
    assert sorted(got, key=str) == want
    longest = max(2 * n for _, _, n, _ in want)
    assert max(read) <= max(longest, 8 * 3, 2 * 50)


def test_hashes_of_slices():
    """Equal slices have equal hashes wherever they stand; others differ, whatever follows them; no work for each byte."""
    rng = np.random.default_rng(3)
    whole = rng.integers(1, 255, 64).astype(np.uint8)
    slices = [whole[:n] for n in range(1, 65)]
    for n in (1, 7, 8, 9, 16, 33, 64):
        for k in range(n):
            other = whole[:n].copy()
            other[k] ^= 1
            slices.append(other)
    slices += [np.append(whole[:n], np.uint8(0)) for n in (3, 8, 15, 63)]
    cache = SliceCache(np.dtype("<u4"), 100)
    seen = []
    for order in (np.arange(len(slices)), rng.permutation(len(slices))):
        span = np.array([len(slices[i]) for i in order])
        key, head = cache.hashes(np.concatenate([slices[i] for i in order]), np.cumsum(span) - span, span)
        seen.append(dict(zip(order.tolist(), zip(key.tolist(), head.tolist(), strict=True), strict=True)))
        assert all(h >> 56 == len(slices[i]) and h & 255 == slices[i][0] for i, (_, h) in seen[-1].items())
    assert seen[0] == seen[1] and len({k for k, _ in seen[0].values()}) == len({s.tobytes() for s in slices})
