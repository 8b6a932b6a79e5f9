"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kindred import catalogue
from kindred.functions import text
from kindred.operators import embed
from kindred.operators.similarity import average_linkage
from kindred.shared import table

SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    rel = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    key = lambda r: tuple((v is None, v) for v in r)
    want = [tuple(r) for r in rel.project(", ".join(columns)).fetchall()] if hasattr(rel, "fetchall") else []
    mine = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, plain(sorted(mine, key=key)))) == sorted(map(str, plain(sorted(want, key=key))))


def test_flagship(spark, sf_dir):
    """The clusters of average linkage over all vectors at once, with their facts from all pairs."""
    docs = sorted(table(spark, sf_dir, "documents").select("doc_id", "source", "text", text.embedding_text(F.col("lang"), F.lit("block"), F.lit(None).cast("string"), F.col("text")).alias("t")).collect())
    x = embed.HashingEmbedder().embed([d["t"] for d in docs]).astype(float)
    has = [i for i in range(len(docs)) if x[i].any()]
    unit = x[has] / np.linalg.norm(x[has], axis=1, keepdims=True)
    groups = {}
    for i, k in zip(has, average_linkage(unit, 0.8), strict=True):
        groups.setdefault(int(k), []).append(i)
    want = {}
    for g in groups.values():
        if len(g) > 1:
            s = x[g] @ x[g].T
            want[docs[g[0]]["doc_id"]] = (len(g), len({docs[i]["source"] for i in g}), round((s.sum() - np.trace(s)) / (len(g) * (len(g) - 1)), 4))
    rows = catalogue.flagship(spark, sf_dir).collect()
    got = {r["first_member"]: (r["size"], r["file_count"], r["similarity"]) for r in rows}
    assert got.keys() == want.keys() and len(want) > 1
    for k, (size, files, similarity) in want.items():
        assert got[k][:2] == (size, files) and abs(got[k][2] - similarity) <= 1e-4
    order = sorted(rows, key=lambda r: r["cluster_id"])
    assert [r["cluster_id"] for r in order] == list(range(1, len(rows) + 1)) and all(a["similarity"] >= b["similarity"] for a, b in zip(order, order[1:]))
