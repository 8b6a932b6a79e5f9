"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """``a`` over its length; as it is if that is 1e-9 or less."""
    # The length is bound first: inside the lambda it would be computed anew for each element.
    return let(norm(a), lambda n: F.when(n > 1e-9, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def yes_probability(yes_logprob: Column, no_logprob: Column) -> Column:
    """yes / (yes + no) from log probabilities; a missing one has none of the mass, half if both miss."""
    yes, no = F.coalesce(F.exp(yes_logprob), F.lit(0.0)), F.coalesce(F.exp(no_logprob), F.lit(0.0))
    return F.when(yes + no > 0, yes / (yes + no)).otherwise(0.5)


def filter_rate(original: Column, filtered: Column) -> Column:
    """Percent that a filter took away; 0 of nothing."""
    return F.when(original == 0, 0.0).otherwise((1 - filtered / original) * 100)
