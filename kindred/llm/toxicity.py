"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of its words; a document's is the noisy-or of its sentences', so that
one offending sentence is enough.  Training sees document labels only, and the
sentence scores it arrives at locate the offending sentences.

Defined cases: a null or empty text has no sentence and scores 0; a label that
is null counts as no label, and of repeated labels the largest holds; an empty
table gives no rows; with no labels of both kinds every text scores 0; a
labelled text too long for the sample is left out of it and scored like others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from kindred.llm.kernels import Lookup, Words, buffer
from kindred.llm.runtime import ROW_KEY, binaries, drop, map_texts, without, written

HELD_OUT = 2


def held_out(doc_id: Column, parts: int, which: int = HELD_OUT) -> Column:
    """Whether crc32 of the id as text leaves ``which`` when divided by ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == which


#: A word's features are the word itself and its first so many bytes, which stand for its stem.
PREFIXES = (4, 5, 6)
PER_WORD = 1 + len(PREFIXES)
#: Documents of the sample that a feature must be in.
LEAST = 3


class Sentences:
    """Sentences of many texts: they end with a word whose last mark is . ! or ?, or at the end of a line.

    ``feature`` has PER_WORD features for each word; ``first`` is the first
    feature of each sentence.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words = Words(data, at)
        hashes, _, last, _ = words.cores(PREFIXES)
        n = len(words)
        self.rows = words.rows
        if not n:
            self.feature, self.first, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.start = self.end = self.row
            return
        marks = np.concatenate([[0], np.cumsum((data == 46) | (data == 33) | (data == 63))])
        stop = marks[words.ends] > marks[np.maximum(last + 1, words.starts)]  # after the word's last letter
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        stop[:-1] |= lines[words.starts[1:]] > lines[words.ends[:-1]]
        new = np.ones(n, bool)
        new[1:] = stop[:-1] | (words.row[1:] != words.row[:-1])
        first = np.flatnonzero(new)
        self.feature = hashes.ravel()
        self.first = first * PER_WORD
        self.row = words.row[first]
        self.start = words.starts[first]
        self.end = words.ends[np.append(first[1:], n) - 1]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        if not hasattr(self, "lookup"):
            self.lookup, self.padded = Lookup(self.keys), np.append(self.weights, 0.0)
        return np.add.reduceat(self.padded[self.lookup.find(s.feature)], s.first) + self.bias if len(s.first) else np.zeros(0)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def logistic(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def tests_of(screen: float | None, toxic: int) -> float:
    """Standard errors by which a feature's shares must differ."""
    return float(np.sqrt(2 * np.log1p(toxic))) if screen is None else screen


def fit(feature: np.ndarray, sentence: np.ndarray, bag: np.ndarray, toxic: np.ndarray, least: int = LEAST, screen: float | None = None, steps: int = 150, rate: float = 0.1, l2: float = 0.005) -> Model:
    """Noisy-or training.  ``sentence``: first feature of each sentence, which may have none; ``bag``: first sentence of each document.

    A feature gets a weight if it is in ``least`` documents or more and the
    share of toxic documents that have it differs from the share of others by
    ``screen`` standard errors or more; if None, sqrt(2 ln(1 + toxic documents)).
    What ``sample`` brings has been through the same test on the executors.
    """
    y = toxic.astype(bool)
    if not len(feature) or y.all() or not y.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    sizes = np.diff(np.append(sentence, len(feature)))
    docs = np.repeat(np.arange(len(bag), dtype=np.int32), np.diff(np.append(bag, len(sentence))))
    owner = np.repeat(np.arange(len(sentence), dtype=np.int32), sizes)
    keys, place = np.unique(feature, return_inverse=True)
    once = np.unique(place.astype(np.int64) * len(bag) + docs[owner])  # a feature and a document that has it
    counts = np.zeros((2, len(keys)))
    np.add.at(counts, (np.where(y[once % len(bag)], 0, 1), once // len(bag)), 1)
    total = np.array([[y.sum()], [(~y).sum()]])
    pooled = np.clip(counts.sum(0) / total.sum(), 1e-9, 1 - 1e-9)
    z = (counts[0] / total[0] - counts[1] / total[1]) / np.sqrt(pooled * (1 - pooled) * (1 / total).sum())
    good = (counts.sum(0) >= least) & (np.abs(z) >= tests_of(screen, int(y.sum())))
    used = np.flatnonzero(good[place])
    f, owner = (np.cumsum(good) - 1)[place[used]], owner[used]
    keys = keys[good]
    n = len(keys)
    del place, used, once, counts
    w, b = np.zeros(n), -4.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[f], minlength=len(sentence)) + b
        total = np.add.reduceat(softplus(z), bag)
        none = np.exp(-total)
        slope = np.where(y, none / np.maximum(1 - none, 1e-9), -1.0)[docs] * logistic(z)
        g = np.append(np.bincount(f, weights=slope[owner], minlength=n) - l2 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return Model(keys, w, float(b))


def choose(rows: list[tuple], most_words: int) -> list[int]:
    """Places of the (label, words) rows that fit: each label has half of ``most_words``, and a row that doesn't fit is passed over."""
    left, chosen = {}, []
    for k, (y, n) in enumerate(rows):
        room = left.setdefault(y, most_words // 2)
        if n <= room:
            left[y] = room - n
            chosen.append(k)
    return chosen


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of either label (``y``, ``words``) each feature is."""

    def run(batches):
        for batch in batches:
            found = []
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(np.frombuffer(words.as_buffer(), np.uint64))
                found.append((own, np.full(len(own), y == 1)))
            if found:
                keys, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                toxic = np.concatenate([x for _, x in found])
                n = [np.bincount(place, weights=x, minlength=len(keys)).astype(np.int64) for x in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, n)], ["feature", "toxic", "clean"])

    counted = rows.select("y", "words").mapInArrow(run, "feature long, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def screened(counts: DataFrame, toxic: int, clean: int, least: int, screen: float | None) -> DataFrame:
    """(feature) of those that ``fit`` would give a weight."""
    n = F.col("toxic") + F.col("clean")
    pooled = F.greatest(F.least(n / float(toxic + clean), F.lit(1 - 1e-9)), F.lit(1e-9))
    error = F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean))
    # a hair under the bound, since sums may be rounded in another order; fit has the last word
    return counts.filter((n >= least) & (F.abs(F.col("toxic") / toxic - F.col("clean") / clean) >= error * (tests_of(screen, toxic) - 1e-9))).select("feature")


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_docs: int = 4000, most_words: int = 2_500_000, parts: int = 4, least: int = LEAST, screen: float | None = None):
    """What ``fit`` needs of a bounded sample of labelled documents: at most ``most_docs`` of each label, and ``most_words`` words.

    Documents are taken in the order of a hash of their ids, whole; each label
    may fill half of the words, and a document that doesn't fit is left out
    alone.  Rows of the held-out part are never taken.  Only the ids, at most 2
    * most_docs of them, are broadcast.  Features are counted and screened on
    the executors; of the others only the screened ones of each sentence come
    to the driver.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), parts)).groupBy(id_col).agg(F.max(label).alias("y"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = [known.filter(F.col("y") == y).orderBy(order, id_col).limit(most_docs) for y in (1, 0)]
    ids = written(ids[0].unionByName(ids[1]).select(F.col(id_col).alias("id"), "y"), "sample-ids")
    taken = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    taken = taken.withColumn("rid", F.monotonically_increasing_id())
    out = StructType([StructField("words", BinaryType()), StructField("sizes", BinaryType()), StructField("n", LongType())])

    def start():
        def work(data, at):
            s = Sentences(data, at)
            ends = np.searchsorted(s.row, np.arange(s.rows), "right")
            sizes = np.diff(np.append(s.first, len(s.feature))).astype(np.int32)
            words = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[ends]
            return [binaries(s.feature, 8 * words), binaries(sizes, 4 * ends), pa.array(np.diff(words, prepend=0) // PER_WORD)]

        return work

    rows = written(map_texts(taken, "text", ["id", "y", "rid"], out, start), "sample-features")
    # one row for each id, as many as 2 * most_docs: of rows that repeat an id the first counts
    one = rows.filter("n > 0").groupBy("id", "y").agg(F.min(F.struct("rid", "n")).alias("r")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").select("y", "r.n", "r.rid").collect()
    chosen = [one[k] for k in choose([(r["y"], r["n"]) for r in one], most_words)]
    toxic = sum(r["y"] == 1 for r in chosen)
    if not chosen:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    places = spark.createDataFrame([(r["rid"], k) for k, r in enumerate(chosen)], "rid long, place long")
    features, rows = rows, rows.join(F.broadcast(places), "rid")
    keys = np.zeros(0, np.uint64)
    if 0 < toxic < len(chosen):
        found = screened(feature_counts(rows), toxic, len(chosen) - toxic, least, screen).toArrow()["feature"]
        keys = found.to_numpy().view(np.uint64) if len(found) else keys
    shared = spark.sparkContext.broadcast(keys)

    def only(batches):
        lookup = Lookup(shared.value)
        for batch in batches:
            made = []
            for words, sizes in zip(batch.column(2), batch.column(3), strict=True):
                feature, size = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(sizes.as_buffer(), np.int32)
                used = lookup.find(feature) >= 0
                owner = np.repeat(np.arange(len(size)), size)[used]
                made.append((feature[used].tobytes(), np.bincount(owner, minlength=len(size)).astype(np.int32).tobytes()))
            columns = [pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["place", "y", "words", "sizes"])

    kind = rows.schema["y"].dataType.simpleString()
    found = rows.select("place", "y", "words", "sizes").mapInArrow(only, f"place long, y {kind}, words binary, sizes binary").orderBy("place").toArrow()
    shared.destroy()
    drop(ids, features)
    words, _ = buffer(found["words"])
    sizes, cuts = buffer(found["sizes"])
    flat = np.frombuffer(sizes, np.int32).astype(np.int64)
    bag = cuts[:-1] // 4  # every document of the sample has a sentence
    return np.frombuffer(words, np.uint64), np.cumsum(flat) - flat, bag, found["y"].to_numpy()


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, least: float = 0.3) -> DataFrame:
    """``carry`` columns (all, if None) with the score and the sentences that make it.

    ``score``: noisy-or over sentences.  ``offending``: byte offsets and score
    of each sentence of score ``least`` or more.  ``worst``: the same of the
    highest sentence, null if there is none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    out = StructType([StructField("score", DoubleType()), StructField("n_sentences", LongType()), StructField("worst", span), StructField("offending", ArrayType(span))])

    def start():
        own = shared.value

        def structs(s, p, at, which):
            return pa.StructArray.from_arrays([pa.array((s.start - at[s.row])[which]), pa.array((s.end - at[s.row])[which]), pa.array(p[which])], ["start", "end", "score"])

        def work(data, at):
            s = Sentences(data, at)
            z = own.sentence_logits(s)
            p = logistic(z)
            total = np.bincount(s.row, weights=softplus(z), minlength=s.rows)
            count = np.bincount(s.row, minlength=s.rows)
            bad = np.flatnonzero(p >= least)
            ends = np.concatenate([[0], np.searchsorted(s.row[bad], np.arange(s.rows), "right")])
            top = np.lexsort((np.arange(len(p)), -p, s.row))
            worst = np.full(s.rows, -1)
            has = np.flatnonzero(count)
            worst[has] = top[(np.cumsum(count) - count)[has]]
            worst = structs(s, p, at, bad[:0]) if not len(p) else structs(s, p, at, worst)
            worst = pa.array([None] * s.rows, worst.type) if not len(worst) else pa.StructArray.from_arrays([worst.field(i) for i in range(3)], ["start", "end", "score"], mask=pa.array(count == 0))
            return [pa.array(-np.expm1(-total)), pa.array(count), worst, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), structs(s, p, at, bad))]

        return work

    return map_texts(docs, text_col, docs.columns if carry is None else carry, out, start)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with the columns of ``docs``."""
    model = fit(*sample(docs, labels, id_col=id_col, text_col=text_col))
    keyed = docs.select(id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(ROW_KEY))
    losers = score(keyed, model, text_col, [id_col, ROW_KEY]).filter(F.col("score") >= threshold).select(id_col, ROW_KEY).distinct()
    return without(docs, written(losers, "toxic"), id_col, text_col)
