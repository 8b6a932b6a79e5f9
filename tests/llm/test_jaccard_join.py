import random
from collections import Counter, defaultdict

import numpy as np

from kindred.llm import jaccard_join as J
from tests.llm.cases import awkward, none


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    return out


def brute(rows, threshold=0.8):
    """Links and class of each row."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a is None and b is None) or (a and b and len(a & b) >= threshold * len(a | b)):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return [(rows[i][0], min(groups[root(i)]), links[i]) for i in range(len(rows))]


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(near)
    texts += [passage + [rng.choice(words) for _ in range(rng.randint(5, 100))] for _ in range(40)]
    group = [rng.choice(words) for _ in range(200)]
    for _ in range(80):  # near copies of one another
        near = list(group)
        near[rng.randrange(200)] = rng.choice(words)
        texts.append(near)
    texts += [texts[0]] * 20 + [["a", "b"], ["a", "b"], ["a"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def check(spark, rows, **sizes):
    old = {k: getattr(J, k) for k in sizes}
    for k, v in sizes.items():
        setattr(J, k, v)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(docs).collect())
    finally:
        for k, v in old.items():
            setattr(J, k, v)
    assert got == sorted(brute(rows))


def test_against_brute_force(spark):
    check(spark, corpus())


def test_splits_and_blocks(spark):
    """Buckets so small that paths are split several times, alike ones are compared in blocks, and members verified in blocks."""
    check(spark, corpus(1), SMALL=6, BLOCK=16, EXACT_BLOCK=16)


def test_children_agree():
    """Equal values at a node's coordinates lead to equal children, 1 / threshold of them on average."""
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 32, (2000, J.SIZE), dtype=np.uint64).astype(np.uint32)
    path = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    row, child, _ = J.children(path, sig, 0.8)
    assert 1.2 < len(row) / 2000 < 1.3
    again = J.children(path, sig.copy(), 0.8)
    assert (again[1] == child).all()


def test_keep_one(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in J.keep_one(docs).collect()} == {c for _, c, _ in brute(rows)}


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = J.jaccard_join(docs)
    assert out.count() == docs.count()
    by = {(r["doc_id"], r[J.ROW_KEY]): r for r in out.collect()}
    assert sum(r["n_links"] == 2 and r["class_id"] == 1 for r in by.values()) == 2  # ids 1 and 2; 1 has two rows
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    assert len(left) == len(set(left)) == out.select("class_id", "class_key").distinct().count()
    assert J.jaccard_join(none(spark)).count() == 0 == J.keep_one(none(spark)).count()


def test_runs_follow_the_depth():
    """The probability of a miss, by simulation of the recursion on signatures of similarity 0.8."""
    assert [J.runs_for(d, 0.8, 0.999) for d in (1, 3, 6)] == sorted(J.runs_for(d, 0.8, 0.999) for d in (1, 3, 6))
    rng = np.random.default_rng(1)
    n, depth = 3000, 5
    one = rng.integers(0, 1 << 16, (n, J.SIZE)).astype(np.uint16)
    two = np.where(rng.random((n, J.SIZE)) < 0.8, one, rng.integers(0, 1 << 16, (n, J.SIZE)).astype(np.uint16))
    missed = np.ones(n, bool)
    for run in range(J.runs_for(depth, 0.8, 0.99)):
        rows, a, b = np.arange(n), *[np.full(n, J.mix(np.array([run + 1], np.uint64))[0])] * 2
        for _ in range(depth):
            (r1, c1, w1), (r2, c2, _) = J.children(a, one[rows], 0.8), J.children(b, two[rows], 0.8)
            same = c1 == c2  # both walk the same nodes: their children stand in the same order
            rows, a, b = rows[r1[same]], c1[same], c2[same]
        missed[rows] = False
    assert missed.mean() < 0.015


def test_recall_in_deep_buckets(spark):
    """Borderline pairs among many sets that share a long passage: paths are split until deep, and no link is lost."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(150):  # half of each text is the passage
        own = [rng.choice(words) for _ in range(60)]
        texts.append(passage + own)
        near = passage + own
        for k in rng.sample(range(120), 2):
            near[k] = rng.choice(words)
        texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    old = {k: getattr(J, k) for k in ("SMALL", "SHALLOW")}
    depths, inner = [], J._nominate

    def seen(*a):
        out = inner(*a)
        depths.append((a[1], out[2]))
        return out

    J.SMALL, J.SHALLOW, J._nominate = 4, 1, seen
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(docs).collect())
    finally:
        J.SMALL, J.SHALLOW, J._nominate = *old.values(), inner
    assert max(d for _, d in depths) >= 3 and len(depths) > 1
    want = sorted(brute(rows))
    links = sum(n for *_, n in want)
    assert links > 100 and sum(n for *_, n in got) >= 0.99 * links
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_buckets_of_one_task_need_no_levels(spark, monkeypatch):
    """A bucket that a task can hold is split there, to the same edges and depth as level by level."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(passage + [rng.choice(words) for _ in range(60)]) for _ in range(150)]
    texts += [" ".join(t.split()[:-1]) for t in texts[::3]]
    drawn = J.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5)
    sets = J.written(drawn.select("set_id", *J.PARTS), "test-sets")
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "SHALLOW", 1)
    found = {}
    for blocks in (0, 4):
        monkeypatch.setattr(J, "IN_TASK", blocks)
        edges, deep, depth = J._nominate(sets, range(3), 0.8)
        pairs = set()
        for e in edges:
            pairs |= {frozenset((r["a"], r["b"])) for r in e.filter("b is not null").collect()}
        a, b = (np.array([sorted(p)[k] for p in pairs]) for k in (0, 1))
        found[blocks] = (dict(zip(*map(np.ndarray.tolist, J.forest(a, b)), strict=True)), sorted(r[0] for r in deep.collect()), depth)
        assert blocks == 0 or len(edges) == 1
    assert found[0] == found[4] and found[4][2] >= 3 and len(found[4][0]) >= 45
