"""Each stage against a brute-force version on its own input."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kindred.llm import byte_bpe, toxicity
from kindred.llm.runtime import written
from tests.llm.test_jaccard_join import brute
from tests.llm.test_quality_rules import brute as counts


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    now = rows(docs)

    docs2 = written(stage["quality rules"](spark, docs, sf_dir), "test")
    assert docs2.columns == docs.columns
    assert set(rows(docs2)) == {i for i, t in now.items() if not counts(t)[-1]}  # no host is bad enough here

    docs3 = written(stage["toxicity"](spark, docs2, sf_dir), "test")
    now, left = rows(docs2), rows(docs3)
    seen = [i for i in now if i in labels and zlib.crc32(str(i).encode()) % 4 != toxicity.HELD_OUT]
    assert np.mean([(i not in left) == bool(labels[i]) for i in seen]) > 0.9
    assert all(left[i] == now[i] for i in left)

    docs4 = written(stage["n-gram Jaccard join"](spark, docs3, sf_dir), "test")
    assert set(rows(docs4)) == {c for _, c, _ in brute(sorted(rows(docs3).items()))}

    docs5 = written(stage["benchmark decontamination"](spark, docs4, sf_dir), "test")
    assert set(rows(docs5)) == {i for i, t in rows(docs4).items() if not any(b in t for b in items)}
    assert docs5.columns == docs.columns

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left, encoded = rows(docs5), stage["byte-level BPE"](spark, docs5, sf_dir).collect()
    assert {r["doc_id"] for r in encoded} == set(left)
    for r in encoded:
        ids = np.array(library.encode_ordinary(left[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    n = out.count()
    assert 0 < n < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert n == out.select("doc_id").distinct().count()


def test_guard_is_in_the_entry_alone():
    source = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert not re.search(r"except\s+(Import|ModuleNotFound)Error", source)
