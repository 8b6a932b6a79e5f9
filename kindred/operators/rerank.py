"""Scoring of pairs of texts, and reranking of clusters against their representatives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.operators.clusters import rerank_keep, rerank_stats

YES, NO = ("yes", "relevant", "true"), ("no", "irrelevant", "false", "not")


class Scorer(Protocol):
    def score(self, query: str, document: str) -> float: ...


class OverlapScorer:
    """Jaccard similarity of the sets of words; NaN (null in a column) where neither text has any."""

    def score(self, query: str, document: str) -> float:
        a, b = (set(re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (x or "").lower())) for x in (query, document))
        return len(a & b) / len(a | b) if a | b else float("nan")


def prompt(query: str, document: str) -> str:
    """What a generating scorer is asked."""
    return f"Query: {query}\nDocument: {document}\nDoes the document do the same as the query? Answer yes or no:"


def parse_score(text: str, probabilities: dict[str, float] | None = None) -> float:
    """Score of a generated answer: yes / (yes + no) of the likeliest such tokens, else 0.75 for yes, 0.25 for no, 0.5 for neither.

    Tokens are compared whole: "irrelevant" is a no.
    """
    word = lambda t: re.sub(r"\W+", "", t).lower()
    if probabilities:
        yes = max((p for t, p in probabilities.items() if word(t) in YES), default=0.0)
        no = max((p for t, p in probabilities.items() if word(t) in NO), default=0.0)
        if yes + no > 0:
            return yes / (yes + no)
    words = {word(w) for w in text.split()}
    return 0.25 if words & set(NO) else 0.75 if words & set(YES) else 0.5


def score_pairs(pairs: DataFrame, query: str, document: str, scorer: Scorer | None = None) -> DataFrame:
    """``pairs`` with ``score``, in Arrow batches; the scorer is loaded once in each worker."""
    scorer = scorer or OverlapScorer()

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([scorer.score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.withColumn("score", score(query, document))


def rerank(members: DataFrame, representatives: DataFrame, threshold: float = 0.5, min_cluster: int = 2, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(members that stay, statistics by cluster).

    ``members``: cluster_id, member_idx, content and others; ``representatives``:
    cluster_id, member_idx.  The representative scores 1 by being itself.  What
    stays is numbered anew; its first member becomes the representative, and
    cluster ids and similarities stay as they were.
    """
    rep = members.join(representatives.select("cluster_id", F.col("member_idx").alias("rep_idx")), "cluster_id").filter("member_idx = rep_idx").select("cluster_id", "rep_idx", F.col("content").alias("rep_content"))
    pairs = score_pairs(members.join(rep, "cluster_id"), "rep_content", "content", scorer)
    scored = pairs.withColumn("score", F.when(F.col("member_idx") == F.col("rep_idx"), 1.0).otherwise(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.5)))).drop("rep_content", "rep_idx")
    kept = rerank_keep(scored, threshold)
    stats = rerank_stats(scored, kept)
    enough = stats.filter(F.col("filtered_size") >= min_cluster).select("cluster_id")
    return kept.join(enough, "cluster_id").drop("member_idx").withColumnRenamed("kept_idx", "member_idx"), stats
