import numpy as np
import pytest

from pyspark.sql import functions as F

from kindred.operators import clusters, similarity
from kindred.operators.components import connected_components, forest
from kindred.operators.numbering import number_rows
from kindred.operators.similarity import average_linkage, chain_linkage, cluster_vectors, clustered, similar_pairs, vector_facts
from kindred.plans.engine import cluster_chunks
from kindred.shared import shared_dir


def components(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, shared_dir(spark), one_task).collect()}
    assert got == {k: v for k, v in components([p for p in pairs if p[0] != p[1]]).items()}
    assert connected_components(df.filter("false"), shared_dir(spark)).count() == 0


def test_forest():
    a, b = np.array([5, 4, 3, 9, 9]), np.array([4, 3, 5, 9, 8])
    assert dict(zip(*forest(a, b), strict=True)) == {4: 3, 5: 3, 9: 8}


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "key long, embedding array<float>")


def data(n=150, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 16))
    return centers[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.5


def test_pairs_in_blocks(spark):
    x = data().astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j): s[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] > 0.6}
    for block in (17, 4096):
        rows = similar_pairs(vectors(spark, x), 0.6, block=block).collect()
        assert len(rows) == len(want)
        assert all(abs(want[r["a"], r["b"]] - r["similarity"]) < 1e-9 for r in rows)
        tree = [(r["a"], r["b"]) for r in similar_pairs(vectors(spark, x), 0.6, block=block, spanning=True).collect()]
        assert components(tree) == components(want) and (block == 17 or len(tree) < len(components(want)))
    extra = spark.createDataFrame([(900, None), (901, [0.0] * 16)], "key long, embedding array<float>")
    assert similar_pairs(vectors(spark, x).unionByName(extra), 0.6).count() == len(want)


def slow_linkage(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = max(((np.mean([s[a, b] for a in g for b in h]), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j))
        if best[0] <= threshold:
            break
        i, j = -best[1], -best[2]
        groups[i] = groups[i] + groups.pop(j)
    return {frozenset(g) for g in groups}


def parts(labels):
    out: dict = {}
    for i, k in enumerate(labels):
        out.setdefault(int(k), set()).add(i)
    return {frozenset(g) for g in out.values()}


def test_average_linkage():
    for seed in range(4):
        x = data(40, seed)
        for t in (0.3, 0.6, 0.8):
            assert parts(average_linkage(x, t)) == slow_linkage(x, t)


def test_clusters_by_component(spark):
    x = data().astype(np.float32).astype(float)
    for t in (0.7, 0.85):
        rows = cluster_vectors(vectors(spark, x), shared_dir(spark), t).collect()
        got: dict = {}
        for r in rows:
            got.setdefault(r["cluster"], set()).add(r["key"])
        assert {frozenset(g) for g in got.values()} == {g for g in parts(average_linkage(x, t)) if len(g) > 1}
    with pytest.raises(Exception, match="max_component"):
        cluster_vectors(vectors(spark, x), shared_dir(spark), 0.1, max_component=5).collect()


def test_chain_linkage():
    for seed in range(4):
        x = np.concatenate([data(60, seed), data(60, seed)[:20]])
        weight = np.random.default_rng(seed).integers(1, 5, len(x))
        for t in (0.3, 0.6, 0.8):
            assert parts(chain_linkage(x, t)) == parts(average_linkage(x, t)) == slow_linkage(x, t)
            assert chain_linkage(x, t, weight).tolist() == average_linkage(x, t, weight).tolist()


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_linkage_from_short_lists(monkeypatch, dtype):
    """Lists that run out and bounds in place of the rest, equal vectors up to a factor among them."""
    monkeypatch.setattr(similarity, "LISTED", 3)
    monkeypatch.setattr(similarity, "SEARCH", 7)
    for seed in range(4):
        x = data(300, seed).astype(dtype)
        x[:20] = x[0] * np.arange(1, 21)[:, None]
        weight = np.random.default_rng(seed).integers(1, 4, len(x))
        for t in (0.3, 0.6, 0.8):
            assert parts(chain_linkage(x, t, weight)) == parts(average_linkage(x.astype(float), t, weight))


def test_spanning_pairs_without_copies_of_vectors(spark):
    """Rows don't grow with the number of blocks; blocks are read, not dealt once for each other block."""
    x = np.abs(data(300)) + 1
    df = vectors(spark, x)
    for block in (10, 7):
        pairs = similar_pairs(df, 0.5, block=block, spanning=True)
        assert "Generate" not in pairs._jdf.queryExecution().toString()
        rows = [(r["a"], r["b"]) for r in pairs.collect()]
        assert len(rows) < 2 * len(x)
        want = components([(r["a"], r["b"]) for r in similar_pairs(df, 0.5).collect()])
        assert components(rows) == want and len(want) > 250


def test_equal_vectors_and_large_components(spark):
    """20,001 copies of one vector are one point; large components need no matrix; the members are those of linkage over all rows."""
    x = data(60).astype(np.float32).astype(float)
    x = np.concatenate([x, x[:25], x[:5], [[0.0] * 15 + [1.0]] * 2])
    for matrix in (4096, 3):
        rows = cluster_vectors(vectors(spark, x), shared_dir(spark), 0.6, matrix=matrix).collect()
        got: dict = {}
        for r in rows:
            got.setdefault(r["cluster"], set()).add(r["key"])
        assert {frozenset(g) for g in got.values()} == {g for g in parts(average_linkage(x, 0.6)) if len(g) > 1}
        assert all(k == min(g) for k, g in got.items()) and len(rows) == len({r["key"] for r in rows})
    copies = spark.range(20_001).select(F.col("id").alias("key"), F.expr("array(1.0f, 2.0f)").alias("embedding"))
    got = cluster_vectors(copies, shared_dir(spark), 0.8).groupBy("cluster").count().collect()
    assert [(r["cluster"], r["count"]) for r in got] == [(0, 20_001)]


@pytest.mark.parametrize("one_task", [1, 25])
def test_linkage_in_rounds(spark, one_task):
    """Components beyond one task, over many blocks, give the clusters of linkage over all rows."""
    x = np.concatenate([data(90, 5), data(90, 5)[:20]]).astype(np.float32).astype(float)
    for t in (0.3, 0.7):
        rows = cluster_vectors(vectors(spark, x), shared_dir(spark), t, matrix=8, one_task=one_task, block=16).collect()
        got: dict = {}
        for r in rows:
            got.setdefault(r["cluster"], set()).add(r["key"])
        assert {frozenset(g) for g in got.values()} == {g for g in parts(average_linkage(x, t)) if len(g) > 1}
        assert all(k == min(g) for k, g in got.items())


def test_linkage_in_rounds_with_ties(spark):
    """A grid of equal similarities: every round merges something, and each vector is in one cluster."""
    x = np.array([[1.0 if j in (i, (i + 1) % 12) else 0.0 for j in range(12)] for i in range(12)])
    rows = cluster_vectors(vectors(spark, x), shared_dir(spark), 0.2, one_task=1, block=4).collect()
    assert len(rows) == len({r["key"] for r in rows}) and {len(g) for g in parts(average_linkage(x, 0.2))} <= {2, 3, 4}


def shuffled(spark):
    """Bytes that shuffles have written in this session."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_vectors_are_not_shuffled(spark):
    """Clusters and their facts, by one task and in rounds, with less than half of the vectors' bytes through shuffles."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(100, 1000)) + rng.normal(size=1000)
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1]).astype(np.float32).astype(float)
    df = vectors(spark, x).selectExpr("key", "'f' file_path", "1 start_line", "2 end_line", "embedding").cache()
    df.count()
    begun = shuffled(spark)
    assert cluster_chunks(df, 0.8)[0].count() == 100
    rows = cluster_vectors(df, shared_dir(spark), 0.3, one_task=120, block=32).collect()
    assert shuffled(spark) - begun < x.size * 4 / 2
    got: dict = {}
    for r in rows:
        got.setdefault(r["cluster"], set()).add(r["key"])
    assert {frozenset(g) for g in got.values()} == {g for g in parts(average_linkage(x, 0.3)) if len(g) > 1}
    df.unpersist()


@pytest.mark.parametrize("one_task", [65_536, 7])
def test_facts_of_distinct_vectors(spark, one_task):
    """Those of all members, copies counted."""
    x = data(120, 2).astype(np.float32).astype(float)
    df = vectors(spark, np.concatenate([x, x[:30], x[:5], x[:5]]))
    found, points, blocks = clustered(df, shared_dir(spark), 0.6, block=32)
    members = found.select("cluster", "key").join(df, "key").selectExpr("cluster", "key AS member_idx", "embedding")
    want = {r["cluster"]: r["similarity"] for r in clusters.mean_similarity(members, "cluster").collect()}
    near = {r["cluster"]: r["member_idx"] for r in clusters.medoids(members, "cluster").collect()}
    got = {r["cluster"]: r for r in vector_facts(points, blocks, one_task, 5).collect()}
    blocks.delete()
    assert got.keys() == want.keys() and max(found.groupBy("cluster").count().toPandas()["count"]) > 7
    assert all(abs(got[k]["similarity"] - want[k]) < 1e-9 and got[k]["medoid"] == near[k] for k in want)


def test_facts(spark):
    x = data(30)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i % 3, i, [float(t) for t in v]) for i, v in enumerate(unit)] + [(9, 99, [1.0] * 16)], "cluster_id long, member_idx long, embedding array<double>")
    got = {r["cluster_id"]: r["similarity"] for r in clusters.mean_similarity(df).collect()}
    best = {r["cluster_id"]: r["member_idx"] for r in clusters.medoids(df).collect()}
    for k in range(3):
        own = unit[k::3]
        s = own @ own.T
        assert abs(got[k] - s[np.triu_indices(len(own), 1)].mean()) < 1e-9
        assert best[k] == k + 3 * int(np.argmax(own @ own.mean(0)))
    assert got[9] == 1.0 and best[9] == 99


def test_rerank_rule(spark):
    rows = [(1, 0, 1.0), (1, 1, 0.2), (1, 2, 0.6), (1, 3, 0.9), (2, 0, 0.1), (2, 1, 0.3), (2, 2, 0.3), (3, 0, 0.7)]
    scored = spark.createDataFrame(rows, "cluster_id long, member_idx long, score double")
    kept = clusters.rerank_keep(scored, 0.5)
    got = sorted((r["cluster_id"], r["kept_idx"], r["member_idx"]) for r in kept.collect())
    assert got == [(1, 0, 0), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 1, 2), (3, 0, 0)]
    total = clusters.rerank_summary(clusters.rerank_stats(scored, kept)).first()
    assert (total["original"], total["filtered"], total["removed"]) == (8, 6, 2)
    assert abs(total["mean_filter_rate"] - (25 + 100 / 3 + 0) / 3) < 1e-9


def test_ranking(spark):
    facts = [(1, 0.9, 40, 2), (2, 0.8, 10, 5), (3, 1.0, 200, 1), (4, 0.95, 40, 2)]
    df = spark.createDataFrame(facts, "cluster_id long, similarity double, total_lines long, file_count long")
    notes = spark.createDataFrame([(1, "low", True), (2, "high", True), (3, "n/a", False)], "cluster_id long, complexity string, worth_refactoring boolean")
    order = lambda by, a=notes: [r["cluster_id"] for r in clusters.rank(df, a, by).orderBy("position").collect()]
    severity = {1: 80 + 0.1 * 20, 2: (50 + 0.2 * 50) * 0.3, 3: 0.01, 4: (80 + 0.05 * 20) * 0.6}
    assert order("severity") == sorted(severity, key=lambda k: -severity[k])
    quick = {1: 0.9 * 3 * 40, 2: 0.8 * 0.5 * 10, 3: 0.01, 4: 0.95 * 40}
    assert order("quick-wins") == sorted(quick, key=lambda k: -quick[k])
    assert order("lines") == [3, 1, 4, 2] and order("files") == [2, 1, 4, 3] and order("similarity") == [3, 4, 1, 2]
    assert order("nothing") == [1, 2, 3, 4] == order("unknown", None)


@pytest.mark.parametrize("one_task", [200_000, 10])
def test_numbering(spark, one_task):
    rows = spark.createDataFrame([(i * 37 % 501, i) for i in range(501)], "a int, b int").repartition(7)
    got = number_rows(rows, [F.desc("a"), F.asc("b")], "n", one_task).collect()
    assert [(r["n"], r["a"]) for r in sorted(got, key=lambda r: r["n"])] == [(k + 1, 500 - k) for k in range(501)]
    assert number_rows(rows.filter("false"), [F.asc("a")], "n", one_task).count() == 0
