import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import byte_bpe, kernels
from tests.llm.cases import awkward, none

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
CODEC = byte_bpe.Codec(RANKS, 50)  # so few pieces that the cache starts anew
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def both(texts):
    data, at = kernels.buffer(pa.array(texts, pa.string()))
    ids, ends = CODEC.encode(data, at)
    plain, cut = CODEC.decode(ids, ends)
    assert plain.tobytes() == data.tobytes() and (cut == at[1:]).all()
    starts = CODEC.starts(ids, ends)
    assert all((s == 0) for s, n, p in zip(starts[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]], ends, texts, strict=False))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdmtrevl1a.")), max_size=60), min_size=1, max_size=5))
def test_same_as_library(texts):
    assert both(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_contractions_spaces_and_long_pieces():
    texts = ["it's", "''s", " 's", "\n's", "  's", "'re're", "'r", "a \n b  ", "\n\nx", "", "x" * 3000, "ab" * 500 + " c", "é" * 500]
    assert both(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_blocks_of_the_scan():
    text = "word, word's  12\n" * 4000
    assert both([text, text[1:], text]) == [OTHER.encode_ordinary(t) for t in (text, text[1:], text)]


def test_operator_on_awkward_rows(spark):
    docs = awkward(spark)
    out = byte_bpe.encode(docs, PATH, decoded=True)
    assert [c for c in out.columns if c != "ids"][:4] == ["doc_id", "text", "lang", "source"]
    for r in out.collect():
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == OTHER.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["starts"]) // 4
    again = byte_bpe.decode(out.drop("decoded"), PATH)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again.collect())
    assert byte_bpe.encode(none(spark), PATH).count() == 0


def test_query(spark, sf_dir):
    from kindred.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = OTHER.encode_ordinary(docs[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_missing_rank_is_an_error():
    with pytest.raises(KeyError):
        byte_bpe.Merger({b"a": 0})([b"b"])
