"""Quality by importance resampling.

Two generative models of hashed n-grams, of target text (documents labelled
good) and of all raw text, give each document a log likelihood ratio.  Adding
Gumbel noise and taking the k largest samples k documents without replacement
in proportion to their importance.

Words are compared in lower case without the punctuation around them; n-grams
are those of one and two words and of one to three word shapes (case, digits,
marks).  The raw model counts every document; the
target model a bounded sample of labelled ones.  The noise of a row is a hash
of its id, its text and a seed, so that a task that runs again draws it again.

A document's weight is the ratio itself: ``log_weight`` is the sum of the log
ratios of its n-grams, and the noise is added to that.  ``tempered_weight``,
beside it, is that sum over the square root of their number, for callers who
want long texts to weigh less.

Defined cases: null and empty texts have no n-gram and weight 0; a null label
is no label; rows of equal id and text get equal noise and stay or go together,
so that k is exceeded where they tie for the last place; without a label all
weights are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kindred.llm.kernels import SOLID, Words, chunks, mix, windows
from kindred.llm.runtime import ROW_KEY, TEXT, added, bounded, map_texts, without, written

#: Places that n-grams are hashed to.
BUCKETS = 1 << 16
BINS = 4096


def shapes(words: Words) -> np.ndarray:
    """What a word looks like: case, digits, marks before it, the two last bytes if they are marks."""
    data, starts, ends = words.data, words.starts, words.ends
    count = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
    upper, lower_, digit, solid = (count(m) for m in ((data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57), SOLID[data]))
    first, last, before = data[starts], data[ends - 1], data[np.maximum(ends - 2, starts)]
    mark = lambda x: np.where(SOLID[x], 0, x).astype(np.uint64)
    case = np.where(upper == 0, 0, np.where(lower_ > 0, 1, np.where(upper > 1, 3, 2))).astype(np.uint64)
    flags = case | (digit > 0).astype(np.uint64) << np.uint64(2) | (solid == 0).astype(np.uint64) << np.uint64(3)
    return mix(flags | mark(first) << np.uint64(8) | mark(last) << np.uint64(16) | np.where(SOLID[last], np.uint64(0), mark(before)) << np.uint64(24) | np.uint64(1 << 40))


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every n-gram: one and two words, one to three shapes."""
    words = Words(data, at)
    core, _, _, solid = words.cores()
    core, row = core[solid], words.row[solid]
    shape = shapes(words)
    parts = [(mix(core + np.uint64(1)), row), (shape, words.row)]
    for values, own, width in ((core, row, 2), (shape, words.row, 2), (shape, words.row, 3)):
        keys, first = windows(values, own, width)
        parts.append((keys, own[first]))
    keys = np.concatenate([k for k, _ in parts])
    return (keys % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([r for _, r in parts])


def gram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each place occurs in all of ``docs``."""
    bounded(docs.sparkSession)

    def count(batches):
        for _, data, at in chunks(batches, TEXT):
            yield np.bincount(grams(data, at)[0], minlength=BUCKETS)

    return added(docs.select(F.col(text_col).alias(TEXT)), count, BUCKETS)


def labelled(labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, y) of documents with a label; of repeated labels the largest holds."""
    return labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_docs: int = 20_000) -> tuple[np.ndarray, float]:
    """(log ratio of each place, share of labelled documents that are good).

    The target model is fitted on ``most_docs`` good documents at most, the
    first by a hash of their ids; only their ids are broadcast.
    """
    known = labelled(labels, label, id_col)
    at = known.agg(F.avg("y").alias("share"), F.count(F.lit(1)).alias("n")).first()
    if not at["n"] or not at["share"]:
        return np.zeros(BUCKETS), 1.0
    good = written(known.filter("y = 1").orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most_docs).select(F.col(id_col).alias("id")), "target-ids")
    target = gram_counts(docs.join(F.broadcast(good), docs[id_col] == good["id"], "left_semi"), text_col)
    raw = gram_counts(docs, text_col)
    model = lambda c: np.log((c + 1.0) / (c.sum() + BUCKETS))
    return model(target) - model(raw), float(at["share"])


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, ROW_KEY, n_grams, log_weight, tempered_weight, noisy_weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    keyed = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(ROW_KEY), F.col(text_col))

    def start():
        def work(data, at):
            place, row = grams(data, at)
            n = np.bincount(row, minlength=len(at) - 1)
            total = np.bincount(row, weights=shared.value[place], minlength=len(at) - 1).astype(float)
            return [pa.array(n), pa.array(total), pa.array(total / np.sqrt(np.maximum(n, 1)))]

        return work

    out = StructType([StructField("n_grams", LongType()), StructField("log_weight", DoubleType()), StructField("tempered_weight", DoubleType())])
    rows = map_texts(keyed, text_col, [id_col, ROW_KEY], out, start)
    uniform = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), ROW_KEY, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.withColumn("noisy_weight", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(rows: DataFrame, k: int, value: str) -> float:
    """The k-th largest of a column of finite doubles, exactly, from histograms that narrow down on it."""
    at = rows.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).first()
    if k <= 0 or not at["n"]:
        return math.inf
    if k >= at["n"]:
        return at["low"]
    low, high, left, v = at["low"], at["high"], k, F.col(value)
    while True:
        inside = rows.filter((v >= low) & (v <= high))
        width = (high - low) / BINS
        if width <= 0 or low + width <= low:
            return high
        bins = inside.groupBy(F.least(F.floor((v - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy(F.desc("bin")).collect()  # BINS rows at most
        for b in bins:
            if b["n"] >= left:
                break
            left -= b["n"]
        if b["low"] == b["high"]:
            return b["low"]
        low, high = b["low"], b["high"]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", seed: int = 0, most_docs: int = 20_000) -> DataFrame:
    """(id, ROW_KEY, n_grams, log_weight, tempered_weight, noisy_weight, kept) of each row; ``share`` of all rows are kept, by default the share of good ones among those labelled."""
    ratio, good = fit(docs, labels, label, id_col, text_col, most_docs)
    rows = written(weigh(docs, ratio, id_col, text_col, seed), "weights")
    k = math.ceil(rows.count() * (good if share is None else share))
    return rows.withColumn("kept", F.col("noisy_weight") >= kth_largest(rows, k, "noisy_weight"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    out = resample(docs, labels, id_col=id_col, text_col=text_col, **options)
    return without(docs, written(out.filter("not kept").select(id_col, ROW_KEY).distinct(), "unsampled"), id_col, text_col)
