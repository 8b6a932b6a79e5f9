import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from kindred.llm import lattice as L
from tests.llm.cases import awkward, none

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = [b"\xe2\x96\x81a", b"ab", b"b", b"abc", b"\xe2\x96\x81", b"ca"]
COUNTS = np.array([5.0, 3, 2, 1, 4, 2])


def test_all_segmentations():
    v = L.Vocabulary(PIECES, COUNTS, np.ones(256), 3.0)
    total = COUNTS.sum() + 256 + 3 + L.SMOOTH * (len(PIECES) + 257)
    p = {q: (c + L.SMOOTH) / total for q, c in zip(PIECES, COUNTS, strict=True)}

    def of(s):
        if not s:
            return 1.0
        out = (1 + L.SMOOTH) / total * of(s[1:])
        return out + sum(p[q] * of(s[len(q) :]) for q in PIECES if s.startswith(q))

    rng = random.Random(0)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 9))).encode() for _ in range(200)] + ["é".encode()]
    want = [math.log(of(L.SPACE_MARK + w)) for w in words]
    assert np.allclose(v.log_probabilities(words), want)
    assert np.isfinite(v.log_probabilities([b"abc" * 2000])).all()


def test_expected_counts():
    """Against all segmentations, written out."""
    v = L.Vocabulary(PIECES, COUNTS, np.ones(256), 3.0)
    more = [q for q in PIECES if len(q) > 1]
    logs = {bytes([b]): v.edge_logs[b] for b in range(256)}

    def ways(s):
        if not s:
            yield []
        for q in [s[:1], *[m for m in more if s.startswith(m)]] if s else []:
            yield from ([q, *rest] for rest in ways(s[len(q) :]))

    def log_of(q):
        return v.edge_logs[256 + more.index(q)] if q in more else logs[q]

    want = np.zeros(len(v.edge_logs))
    words, weights = [b"abca", b"x", b"aab"], np.array([2.0, 1.0, 0.5])
    for w, weight in zip(words, weights, strict=True):
        found = [(x, math.exp(sum(map(log_of, x)))) for x in ways(L.SPACE_MARK + w)]
        total = sum(p for _, p in found)
        for x, p in found:
            for q in x:
                want[256 + more.index(q) if q in more else q[0]] += weight * p / total
    assert np.allclose(v.expected_counts(words, weights), want)


def test_words_sum_to_one_at_most():
    v = L.Vocabulary(PIECES, COUNTS, np.zeros(256), 3.0)
    words = [b""]
    total = 0.0
    for _ in range(5):
        words = [w + c for w in words for c in (b"a", b"b", b"c")]
        total += np.exp(v.log_probabilities(words)).sum()
    assert total < 1


def test_log_gamma():
    x = np.array([1e-6, 0.3, 1, 2.5, 10, 1e3, 1e6])
    assert np.allclose(L.log_gamma(x), [math.lgamma(t) for t in x])


def score(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    return {r["doc_id"]: r for r in L.score(docs.withColumn("train", train), MODEL, "train").collect()}


def brute_base(rows):
    words = {i: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for i, t in rows}
    c = Counter(w for i in words if zlib.crc32(str(i).encode()) % 7 != 2 for w in words[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n * 1.0 + v + 1)) for x in w)) for i, w in words.items()}, c, n


def test_base_and_urn(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:80] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "UPPER upper Upper")]
    old, L.HEAD = L.HEAD, 50  # so that most words take the way of rare ones
    try:
        got = score(spark, rows)
    finally:
        L.HEAD = old
    want, c, n = brute_base(rows)
    for i, (tokens, known, total, base) in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (tokens, known, total)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert got[i]["score"] < 0 and got[i]["urn_score"] < 0
    whole = score(spark, rows)
    assert all(math.isclose(whole[i][c], got[i][c], rel_tol=1e-9) for i in got for c in ("score", "urn_score"))


def brute_score(rows, rounds=2):
    """Log10 marginal probability of each text: counts by the model's own segmentation, then expectation maximisation by forward and backward sums, word by word."""
    source = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    _, c, _ = brute_base(rows)
    ends = c[None]
    counts, single = {}, Counter()
    for i in range(source.get_piece_size()):
        piece = source.id_to_piece(i)
        if source.is_byte(i):
            single[bytes([int(piece[3:5], 16)])] += 0
        elif not (source.is_control(i) or source.is_unknown(i)) and "\u2581" not in piece[1:] and piece.encode().lower() == piece.encode():
            counts[piece.encode()] = 0.0
    for w, n in c.items():
        for i in source.encode(w) if w else []:
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                single[bytes([int(piece[3:5], 16)])] += n
            elif piece.encode() in counts:
                counts[piece.encode()] += n
    total = sum(counts.values()) + sum(single.values()) + ends + L.SMOOTH * (len(counts) + 257)
    p = {b: (n + L.SMOOTH) / total for b, n in single.items()}
    for q, n in counts.items():
        p[q] = p.get(q, 0) + (n + L.SMOOTH) / total
    longest = max(map(len, p))
    end = (ends + L.SMOOTH) / total

    def walk(w):
        s = L.SPACE_MARK + w.encode()
        f = [1.0] + [0.0] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + longest) + 1):
                f[j] += f[i] * p.get(s[i:j], 0)
        return s, f

    for _ in range(rounds):
        used = Counter()
        for w, n in c.items():
            if w:
                s, f = walk(w)
                g = [0.0] * len(s) + [1.0]
                for i in range(len(s) - 1, -1, -1):
                    g[i] = sum(p.get(s[i:j], 0) * g[j] for j in range(i + 1, min(len(s), i + longest) + 1))
                for i in range(len(s)):
                    for j in range(i + 1, min(len(s), i + longest) + 1):
                        if s[i:j] in p:
                            used[s[i:j]] += n * f[i] * p[s[i:j]] * g[j] / g[0]
        total = sum(used.values()) + ends + L.SMOOTH * (len(p) + 1)
        p, end = {q: (used[q] + L.SMOOTH) / total for q in p}, (ends + L.SMOOTH) / total
    words = {i: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")) for i, t in rows}
    return {i: math.log10(end) + sum(math.log10(walk(x)[1][-1]) for x in w) for i, w in words.items()}


def test_score_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], (r["text"] or "")[:200]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:25] + [(10**6, None), (10**6 + 1, "\u6f22 UPPER x\u00e9")]
    want, got = brute_score(rows), score(spark, rows)
    assert all(math.isclose(got[i]["score"], want[i], rel_tol=1e-7) for i in want)


def test_better_than_base_on_held_out(spark):
    """The urn model, which has whole words and a text's own repetition."""
    rng = random.Random(3)
    stems = ["form", "port", "struct", "press", "tract", "scrib", "duct", "vent", "mission", "cept"]
    heads, tails = ["re", "in", "con", "de", "per", "sub", "trans", "pro"], ["", "s", "ed", "ing", "or", "ion", "able"]
    vocabulary = [h + s + t for h in heads for s in stems for t in tails]
    rows = []
    for i in range(400):
        own = rng.sample(vocabulary, 25)
        rows.append((i, " ".join(rng.choice(own) for _ in range(80))))
    got = score(spark, rows)
    held = [r for r in got.values() if not r["train"]]
    assert len(held) > 30 and sum(r["urn_score"] for r in held) > sum(r["base_score"] for r in held)


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("train", F.col("doc_id") > 1)  # null for null ids
    assert L.score(docs, MODEL, "train").count() == docs.count()
    assert L.score(docs.withColumn("train", F.lit(False)), MODEL, "train").filter("n_known = 0 and train_tokens = 0 and score < 0").count() == docs.count()
    assert L.score(none(spark).withColumn("train", F.lit(True)), MODEL, "train").count() == 0
