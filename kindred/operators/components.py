"""Connected components of an undirected graph given as pairs of 64-bit ids.

Each partition first replaces its pairs by a spanning forest, which bounds what
is shuffled by nodes rather than pairs.  Alternating large-star and small-star
rounds (Kiveris et al., 2014) then run on written tables until nothing changes;
once no more than ``one_task`` pairs are left, one executor task finishes them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A proven bound on what one task may be given: 16 bytes a pair.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every other node of the pairs."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    left, right = inverse[: len(a)], inverse[len(a) :]
    while True:
        x, y = parent[left], parent[right]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        left, right = left[open_], right[open_]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _contract(batches):
    a, b, n = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n > ONE_TASK:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, n = [x], [y], 0 if len(x) < ONE_TASK // 2 else -len(x)
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def connected_components(pairs: DataFrame, folder: str, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of ``pairs`` (its first two columns, 64-bit integers; null pairs are ignored).

    ``component`` is the smallest node of the component.  ``folder`` is a
    shared folder for the tables between rounds.
    """
    spark = pairs.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/components-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path)

    a, b = pairs.columns[:2]
    clean = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    edges = written(clean.mapInArrow(_contract, "a long, b long"))
    before = None
    while True:
        n = edges.count()
        if n <= one_task:
            edges = written(edges.coalesce(1).mapInArrow(_contract, "a long, b long"))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")))
        large = both.filter("b > a").join(least.withColumnRenamed("b", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a != b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(down.groupBy("a").agg(F.min("b").alias("b")))
        small = down.join(least.withColumnRenamed("b", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least).filter("a != b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
