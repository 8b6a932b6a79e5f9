import random
import zlib

import numpy as np
import pyarrow as pa

from kindred.llm import kernels
from kindred.llm import toxicity as T
from tests.llm.cases import awkward, none

MILD, FOUL = "river stone cloud garden window letter paper light winter summer".split(), ["vexgrub", "vexgrubs", "snarlok"]


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(MILD) for _ in range(8)).capitalize() + "." for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.3)
        where = None
        if toxic:
            where = rng.randrange(len(sentences))
            sentences[where] = f"You {rng.choice(FOUL)} of a {rng.choice(MILD)} are foul."
        rows.append((i, " ".join(sentences), toxic, where))
    return rows


def test_sentences():
    texts = ["One two. Three!\nFour five", "", None, "  ", "No end\nnext", "e.g. this? yes"]
    data, at = kernels.buffer(pa.array(texts))
    s = T.Sentences(data, at)
    got = [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(s.row, s.start, s.end, strict=True)]
    assert got == [(0, "One two."), (0, "Three!"), (0, "Four five"), (4, "No end"), (4, "next"), (5, "e.g."), (5, "this?"), (5, "yes")]


def test_held_out_accuracy_and_place(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = T.fit(*T.sample(docs, labels))
    out = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 100
    right = sum((out[i]["score"] >= 0.3) == bool(y) for i, _, y, _ in held)
    assert right / len(held) > 0.97
    placed = [(out[i]["worst"], text, where) for i, text, y, where in held if y]
    assert sum(text.split(". ")[where].rstrip(".") in text[w["start"] : w["end"]] for w, text, where in placed) / len(placed) > 0.95


def test_noisy_or(spark):
    rows = corpus(100)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    data, at = kernels.buffer(pa.array([r[1] for r in rows]))
    s = T.Sentences(data, at)
    model = T.Model(np.unique(s.feature)[:20], np.linspace(-1, 2, 20), -2.0)
    p = T.logistic(model.sentence_logits(s))
    want = [1 - np.prod(1 - p[s.row == i]) for i in range(len(rows))]
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], want)


def test_held_out_rows_are_not_learnt_from(spark):
    rows = corpus(80)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    _, _, bag, y = T.sample(docs, labels)
    free = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(bag) == len(free) and y.sum() == sum(r[2] for r in free)
    assert len(T.sample(docs, labels, most_docs=3)[2]) == 6
    assert len(T.sample(docs, labels, most_words=300)[0]) <= 300 * T.PER_WORD


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    model = T.fit(*T.sample(docs, labels))
    out = T.score(docs, model)
    assert out.count() == docs.count()
    assert all(r["score"] == 0 and r["worst"] is None and r["offending"] == [] for r in out.filter("text is null or trim(text) = ''").collect())
    assert T.keep(docs, labels).columns == docs.columns
    empty = labels.filter("false")
    assert T.keep(docs, empty).count() == docs.count()
    assert T.keep(none(spark), empty).count() == 0


def test_screening_on_executors_changes_no_model(spark):
    """The model is that of all features of the sample, counted here by brute force."""
    rows = corpus(300, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    few = T.sample(docs, labels)
    every = T.sample(docs, labels, least=0, screen=0.0)
    assert len(few[0]) < len(every[0]) and (few[2] == every[2]).all() and (few[3] == every[3]).all()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    text = {i: t for i, t, *_ in rows}
    data, at = kernels.buffer(pa.array([text[i] for i in text if not held[i]]))
    assert len(every[0]) == len(T.Sentences(data, at).feature)
    one, other = T.fit(*few), T.fit(*every)
    assert (one.keys == other.keys).all() and np.allclose(one.weights, other.weights) and np.isclose(one.bias, other.bias)


def test_a_long_text_does_not_end_the_sample(spark):
    rows = corpus(80)
    docs = [(i, t * 200 if i in (0, 1, 2, 3) else t) for i, t, *_ in rows]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    most = 2 * max(len(t.split()) for _, t in docs[4:]) * 80
    _, _, bag, y = T.sample(spark.createDataFrame(docs, "doc_id long, text string"), labels, most_words=most)
    free = [r for r in rows[4:] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(bag) >= len(free) and y.sum() >= sum(r[2] for r in free)
    assert T.choose([(1, 10), (1, 3), (0, 4), (1, 2), (0, 2)], 10) == [1, 2, 3]


def test_query(spark, sf_dir):
    """Every document has a score; those that were not learnt from are told apart by their labels."""
    from kindred.llm import queries

    out = {r["doc_id"]: r for r in queries.op3_toxicity(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(out) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in out.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if i in out and out[i]["held_out"] and labels[i] is not None]
    assert np.mean([out[i]["predicted"] == labels[i] for i in held]) > 0.8
