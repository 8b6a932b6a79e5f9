import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from kindred.llm import importance as I
from kindred.llm import kernels
from tests.llm.cases import awkward, none

WORDS = [f"word{i}" for i in range(200)]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS[:120] if good else WORDS[80:]) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words), int(good)))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, quality int")


def places(text):
    data, at = kernels.buffer(pa.array([text]))
    return Counter(I.grams(data, at)[0].tolist())


def test_models_and_weights(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    ratio, share = I.fit(docs, labels)
    raw, target = Counter(), Counter()
    for i, text, y in rows:
        raw += places(text)
        if i % 2 and y:
            target += places(text)
    assert math.isclose(share, np.mean([r[2] for r in rows if r[0] % 2]))
    model = lambda c, k: math.log((c[k] + 1) / (sum(c.values()) + I.BUCKETS))
    want = {k: model(target, k) - model(raw, k) for k in list(raw)[:300]}
    assert all(math.isclose(ratio[k], w, abs_tol=1e-9) for k, w in want.items())
    for r in I.weigh(docs, ratio).limit(20).collect():
        own = places(rows[r["doc_id"]][1])
        assert r["n_grams"] == sum(own.values())
        assert math.isclose(r["log_weight"], sum(ratio[k] * n for k, n in own.items()), abs_tol=1e-9)
        assert math.isclose(r["tempered_weight"] * math.sqrt(r["n_grams"]), r["log_weight"], abs_tol=1e-9)


def test_sample(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    out = I.resample(docs, labels, share=0.6).collect()
    kept = [r for r in out if r["kept"]]
    assert len(kept) == math.ceil(0.6 * len(rows))
    assert min(r["noisy_weight"] for r in kept) > max(r["noisy_weight"] for r in out if not r["kept"])
    good = {r[0]: r[2] for r in rows}
    assert np.mean([good[r["doc_id"]] for r in kept]) > 0.98
    assert [(r["doc_id"], r["kept"]) for r in sorted(I.resample(docs, labels, share=0.6).collect())] == [(r["doc_id"], r["kept"]) for r in sorted(out)]


def noise(doc_id, text, seed=0):
    """Gumbel noise of a row, from the hash chain that the column functions stand for."""
    key = xxhash.xxh64_intdigest((text or "").encode(), 42)
    h = xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
    for value in (key.to_bytes(8, "little"), seed.to_bytes(4, "little")):
        h = xxhash.xxh64_intdigest(value, h)
    return -math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52)))


def test_query_against_brute_force(spark, sf_dir):
    """Models, weights, noise and the k largest, all in plain Python."""
    from kindred.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    raw, target = Counter(), Counter()
    own = {i: places(t) for i, t in docs.items()}
    for i, c in own.items():
        raw.update(c)
        if labels.get(i) == 1:
            target.update(c)
    totals = sum(target.values()) + I.BUCKETS, sum(raw.values()) + I.BUCKETS
    weight = {i: sum(n * (math.log((target[k] + 1) / totals[0]) - math.log((raw[k] + 1) / totals[1])) for k, n in c.items()) for i, c in own.items()}
    noisy = {i: w + noise(i, docs[i]) for i, w in weight.items()}
    k = math.ceil(len(docs) * np.mean(list(labels.values())))
    kept = set(sorted(noisy, key=noisy.get)[-k:])
    out = {r["doc_id"]: r for r in queries.op5_importance(spark, sf_dir).collect()}
    assert set(out) == set(docs)
    assert all(math.isclose(out[i]["log_weight"], weight[i], abs_tol=1e-6) and math.isclose(out[i]["noisy_weight"], noisy[i], abs_tol=1e-6) for i in docs)
    assert {i for i, r in out.items() if r["kept"]} == kept


def test_noise_is_gumbel(spark):
    rows = spark.createDataFrame([(i, "") for i in range(20000)], "doc_id long, text string")
    x = np.array([r["noisy_weight"] for r in I.weigh(rows, np.zeros(I.BUCKETS)).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - math.pi**2 / 6) < 0.1


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(I, "BINS", 8)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500), rng.normal(size=50) * 1e6, np.full(100, 0.25)])
    rows = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 2, 60, 200, 300, 649, 650):
        assert I.kth_largest(rows, k, "v") == np.sort(x)[-k]


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, None), (None, 1)], "doc_id long, quality int")
    assert I.resample(docs, labels).count() == docs.count()
    assert I.keep(docs, labels).columns == docs.columns
    assert I.keep(docs, labels.filter("false")).count() == docs.count()
    assert I.keep(none(spark), labels).count() == 0
