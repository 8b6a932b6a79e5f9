import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm import kernels as K
from kindred.llm import runtime as R
from tests.llm.cases import awkward, none


def keyed(df):
    return df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias(R.ROW_KEY))


def test_without(spark):
    docs = awkward(spark)
    losers = R.written(keyed(docs.filter("doc_id is null or doc_id in (2, 6)")), "test")
    left = R.without(docs, losers)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 1, 1, 3, 4, 5, 7, 8, 9]
    assert R.without(docs, losers.filter("false")).count() == docs.count()
    assert R.without(none(spark), losers).count() == 0


def test_filter_passes_all_its_keys(spark):
    keys = keyed(spark.range(5000).selectExpr("id AS doc_id", "string(id) AS text"))
    bits = R.key_filter(keys)
    own = np.array([r[1] for r in keys.collect()])
    assert R.passes(bits, own).all()
    other = np.random.default_rng(0).integers(-(2**63), 2**63, 100_000)
    assert R.passes(bits, other).mean() < 0.01


WILD = st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tabc")), max_size=30), min_size=1, max_size=6)


@given(WILD)
def test_words(texts):
    data, at = K.buffer(pa.array(texts, pa.string()))
    words = K.Words(data, at)
    got = [(int(r), data[a:b].tobytes()) for r, a, b in zip(words.row, words.starts, words.ends, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in t.encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    hashes = words.hashes()
    assert len({h for h in hashes.tolist()}) == len({w for _, w in got})


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_lookup(keys, others):
    table = K.Lookup(np.array(keys, np.uint64))
    assert table.find(np.array(keys, np.uint64)).tolist() == list(range(len(keys)))
    place = {k: i for i, k in enumerate(keys)}
    assert table.find(np.array(others, np.uint64)).tolist() == [place.get(k, -1) for k in others]


def test_chunks_are_whole_rows():
    rows = ["a" * n for n in (5, 100, 0, 3, 7, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["t"])
    parts = list(K.chunks([batch, batch.slice(0, 0)], "t", 20))
    assert [p.num_rows for p, _, _ in parts] == [1, 1, 3, 1]
    assert b"".join(d.tobytes() for _, d, _ in parts).decode() == "".join(rows)
