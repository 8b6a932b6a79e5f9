"""Facts about clusters, in DataFrame functions: similarity, medoid, sizes, order, ranking, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators.numbering import number_rows

SORTS = ("severity", "lines", "files", "similarity", "quick-wins")


def mean_similarity(members: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """(cluster, n, similarity): mean cosine over all pairs of a cluster, 1 for a single member.

    The sum over pairs is (|sum of unit vectors|^2 - n) / 2, which needs one
    pass over members and no pairs.
    """
    unit = members.select(F.col(cluster), F.posexplode(V.l2_normalize(F.col(vector))).alias("d", "x"))
    sums = unit.groupBy(cluster, "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy(cluster).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return out.select(cluster, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def medoids(members: DataFrame, cluster: str = "cluster_id", member: str = "member_idx", vector: str = "embedding") -> DataFrame:
    """(cluster, member, similarity): the member closest to the mean vector, the first of equals."""
    flat = members.select(cluster, F.posexplode(F.col(vector)).alias("d", "x"))
    means = flat.groupBy(cluster, "d").agg(F.avg("x").alias("m")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda t: t["m"]).alias("mean"))
    scored = members.join(means, cluster).select(cluster, F.col(member), V.cosine(F.col(vector).cast("array<double>"), F.col("mean")).alias("similarity"))
    best = scored.groupBy(cluster).agg(F.max(F.struct(F.round("similarity", 12).alias("s"), (-F.col(member)).alias("m"), "similarity")).alias("b"))
    return best.select(cluster, (-F.col("b.m")).alias(member), F.col("b.similarity").alias("similarity"))


def cluster_stats(members: DataFrame, cluster: str = "cluster_id", min_size: int = 2) -> DataFrame:
    """(cluster, size, file_count, total_lines) of clusters with ``min_size`` members or more."""
    lines = F.sum((F.col("end_line") - F.col("start_line") + 1).cast("long"))
    out = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.count_distinct("file_path").alias("file_count"), lines.alias("total_lines"))
    return out.filter(F.col("size") >= min_size)


def renumber(clusters: DataFrame, similarity: str = "similarity", first: str = "first_member") -> DataFrame:
    """``cluster_id`` 1..k by falling similarity, then by first member."""
    return number_rows(clusters, [F.desc(similarity), F.asc(first)], "cluster_id")


def severity(similarity: Column, lines: Column, files: Column, complexity: Column, worth: Column) -> Column:
    factor = F.when(complexity == "low", 1.0).when(complexity == "high", 0.3).otherwise(0.6)
    return F.when(~F.coalesce(worth, F.lit(True)), 0.01).otherwise((lines * files + (1 - similarity) * files * 10) * factor)


def quick_wins(similarity: Column, lines: Column, complexity: Column, worth: Column) -> Column:
    factor = F.when(complexity == "low", 3.0).when(complexity == "medium", 1.5).when(complexity == "high", 0.5).when(complexity == "n/a", 0.1).otherwise(1.0)
    return F.when(~F.coalesce(worth, F.lit(True)), 0.01).otherwise(similarity * factor * F.least(lines, F.lit(100)))


def rank(clusters: DataFrame, analyses: DataFrame | None = None, sort_by: str = "severity") -> DataFrame:
    """``clusters`` with ``rank_score`` and ``position`` (1 first; equal scores keep the order of cluster_id).

    An unknown ``sort_by`` keeps that order.
    """
    if analyses is not None:
        joined = clusters.join(analyses.select("cluster_id", "complexity", "worth_refactoring"), "cluster_id", "left")
    else:
        joined = clusters.withColumns({"complexity": F.lit(None).cast("string"), "worth_refactoring": F.lit(None).cast("boolean")})
    c = F.col
    score = {
        "severity": severity(c("similarity"), c("total_lines"), c("file_count"), c("complexity"), c("worth_refactoring")),
        "lines": c("total_lines").cast("double"),
        "files": c("file_count").cast("double"),
        "similarity": c("similarity"),
        "quick-wins": quick_wins(c("similarity"), c("total_lines"), c("complexity"), c("worth_refactoring")),
    }.get(sort_by, F.lit(0.0))
    joined = joined.withColumn("rank_score", score)
    return number_rows(joined, [F.desc("rank_score"), F.asc("cluster_id")], "position")


def rerank_keep(scored: DataFrame, threshold: float = 0.5, cluster: str = "cluster_id", member: str = "member_idx", score: str = "score") -> DataFrame:
    """Members that stay, with their place ``kept_idx``.

    Those of ``threshold`` or more stay, in member order; where fewer than two
    do, the two of highest score stay, in order of score.
    """
    by_score = Window.partitionBy(cluster).orderBy(F.desc(score), F.asc(member))
    by_member = Window.partitionBy(cluster).orderBy(F.asc(member))
    good = (F.col(score) >= threshold).cast("int")
    marked = scored.withColumns({"__ok": F.sum(good).over(Window.partitionBy(cluster)), "__rank": F.row_number().over(by_score), "__good": good, "__before": F.sum(good).over(by_member)})
    enough = F.col("__ok") >= 2
    kept = marked.filter((enough & (F.col("__good") == 1)) | (~enough & (F.col("__rank") <= 2)))
    return kept.withColumn("kept_idx", F.when(enough, F.col("__before") - 1).otherwise(F.col("__rank") - 1).cast("long")).drop("__ok", "__rank", "__good", "__before")


def rerank_stats(scored: DataFrame, kept: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, original_size, filtered_size, filter_rate, min_score, max_score)."""
    before = scored.groupBy(cluster).agg(F.count(F.lit(1)).alias("original_size"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    after = kept.groupBy(cluster).agg(F.count(F.lit(1)).alias("filtered_size"))
    out = before.join(after, cluster, "left").withColumn("filtered_size", F.coalesce("filtered_size", F.lit(0).cast("long")))
    return out.withColumn("filter_rate", V.filter_rate(F.col("original_size"), F.col("filtered_size")))


def rerank_summary(stats: DataFrame) -> DataFrame:
    """One row: clusters, sums before and after, removed, mean filter rate."""
    return stats.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("filtered_size"), F.lit(0)).alias("filtered"),
        F.coalesce(F.sum(F.col("original_size") - F.col("filtered_size")), F.lit(0)).alias("removed"),
        F.coalesce(F.avg("filter_rate"), F.lit(0.0)).alias("mean_filter_rate"),
    )


def top_regions(members: DataFrame, n: int = 3, cluster: str = "cluster_id", member: str = "member_idx") -> DataFrame:
    """The first ``n`` members of each cluster."""
    return members.withColumn("region", F.row_number().over(Window.partitionBy(cluster).orderBy(member)).cast("long")).filter(F.col("region") <= n)
