"""Language-model scoring by subword lattices.

The pieces are those of an existing vocabulary.  A word's probability is the
sum over all its segmentations into pieces: forward recursion in log space over
the lattice of pieces, so that no single segmentation has to be right.  No
piece reaches over a word's end, so that the recursion runs once for each
distinct word; the sum over a text's words and its end is ``score``, the log of
the marginal probability of the text.

The vocabulary's own scores weight the pieces if they are log probabilities.
If they are merge ranks, as in a BPE model, they say nothing about likelihood:
the pieces' counts in the training words, segmented by the model's own rule,
stand in for them.  Expectation maximisation over all segmentations of the
training words, each as often as it occurs, then fits the weights.

``urn_score`` is another model of the same texts, for comparison.  A training
word has one more edge, over the whole word, with its discounted frequency;
what the discount takes away weights the pieces.  And a text's tokens are drawn
from an urn that starts as STRENGTH tokens of that distribution and gets each
token back twice, so that a text's own words become likelier as it goes on.
Both keep probabilities summing to one at most.

Beside them stands a base score, add-one smoothed word frequencies.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case.
Words that make up a share of 1 / HEAD or more of all tokens, HEAD of them at
most, are broadcast; the others are joined by hash.  Equal 64-bit hashes count
as equal words.

Defined cases: a null or empty text is its end alone; without training
documents all words are unknown and pieces are equally likely; repeated rows
are scored, and counted, each; an empty table gives no rows.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.kernels import LOWER, Lookup, Words, chunks, mix, powers
from kindred.llm.runtime import TEXT, added, bounded, drop, written

#: Most words that are broadcast (24 bytes each, and a table of four times as many places).
HEAD = 1 << 20
SPACE_MARK = "▁".encode()
#: Added to the count of every piece.
SMOOTH = 0.1
#: Taken from the count of every training word.
DISCOUNT = 0.75
#: Tokens that the urn holds before a text begins.
STRENGTH = 2000.0
LN10 = float(np.log(10))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hash that ``Words`` gives each of the words."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return Words(data, np.array([0, len(data)])).hashes()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers (Stirling's series after eight steps up)."""
    x = np.asarray(x, float)
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def urn(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log of the product of (STRENGTH * p + k) over k from 0 to n - 1."""
    a = STRENGTH * p
    out = np.log(a)
    more = np.flatnonzero(n > 1)
    out[more] = log_gamma(a[more] + n[more]) - log_gamma(a[more])
    return out


class Vocabulary:
    """Pieces by hash, with log probabilities; single bytes always have an edge."""

    def __init__(self, pieces: list[bytes], counts: np.ndarray, byte_counts: np.ndarray, ends: float):
        total = counts.sum() + byte_counts.sum() + ends + SMOOTH * (len(pieces) + 257)
        single = (byte_counts + SMOOTH) / total
        for p, c in zip(pieces, counts, strict=True):
            if len(p) == 1:
                single[p[0]] += (c + SMOOTH) / total
        self.end = float(np.log((ends + SMOOTH) / total))
        more = [(p, c) for p, c in zip(pieces, counts, strict=True) if len(p) > 1]
        logs = np.log((np.array([c for _, c in more]) + SMOOTH) / total)
        self.lengths = sorted({len(p) for p, _ in more})
        keys = np.array([self._key(np.frombuffer(p, np.uint8)) for p, _ in more], np.uint64)
        self.lookup = Lookup(keys)
        self.edge_logs = np.concatenate([np.log(single), logs])

    def weighted(self, counts: np.ndarray, ends: float) -> Vocabulary:
        """The same pieces with probabilities from counts of edges and of text ends."""
        out = copy.copy(self)
        total = counts.sum() + ends + SMOOTH * (len(counts) + 1)
        out.edge_logs = np.log((counts + SMOOTH) / total)
        out.end = float(np.log((ends + SMOOTH) / total))
        return out

    @staticmethod
    def _key(piece: np.ndarray) -> np.uint64:
        total = ((piece.astype(np.uint64) + np.uint64(1)) * powers(len(piece))).sum(dtype=np.uint64, keepdims=True)
        return mix(total + np.uint64(len(piece)))[0]

    def _edges(self, words: list[bytes]):
        """The lattice of all words: edges in order of their place in the word, and nodes (a word of n bytes has n + 1).

        Edge ids: below 256 a byte, else 256 + the piece.
        """
        data = np.frombuffer(b"".join(SPACE_MARK + w for w in words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + len(SPACE_MARK)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(data)) - first[word]
        left = size[word] - place
        starts, ids, spans = [np.arange(len(data))], [data.astype(np.int64)], [np.ones(len(data), np.int64)]
        value = data.astype(np.uint64) + np.uint64(1)
        at, done = np.arange(len(data)), 1
        for n in self.lengths:
            at = at[left[at] >= n]
            if not len(at):
                break
            for j in range(done, n):
                value[at] += (data[at + j].astype(np.uint64) + np.uint64(1)) * powers(j + 1)[j]
            done = n
            found = self.lookup.find(mix(value[at] + np.uint64(n)))
            hit = found >= 0
            starts.append(at[hit])
            ids.append(256 + found[hit])
            spans.append(np.full(int(hit.sum()), n))
        start, edge, span = np.concatenate(starts), np.concatenate(ids), np.concatenate(spans)
        order = np.argsort(place[start], kind="stable")
        start, edge, span = start[order], edge[order], span[order]
        bounds = np.searchsorted(place[start], np.arange(int(size.max()) + 1))
        node = start + word[start]
        root = first + np.arange(len(words))
        return edge, node, node + span, bounds, root, root + size, word[start]

    def _forward(self, log: np.ndarray, node: np.ndarray, to: np.ndarray, bounds: np.ndarray, root: np.ndarray, last: np.ndarray) -> np.ndarray:
        alpha = np.full(int(last[-1]) + 1, -np.inf)
        alpha[root] = 0.0
        for r in range(len(bounds) - 1):
            a, b = bounds[r], bounds[r + 1]
            alpha[to[a:b]] = np.logaddexp(alpha[to[a:b]], alpha[node[a:b]] + log[a:b])
        return alpha

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word after a space mark, over all segmentations."""
        if not words:
            return np.zeros(0)
        edge, node, to, bounds, root, last, _ = self._edges(words)
        return self._forward(self.edge_logs[edge], node, to, bounds, root, last)[last]

    def expected_counts(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """How often each edge (bytes, then pieces) is used, over all segmentations of words that occur ``weights`` times."""
        if not words:
            return np.zeros(len(self.edge_logs))
        edge, node, to, bounds, root, last, word = self._edges(words)
        log = self.edge_logs[edge]
        alpha = self._forward(log, node, to, bounds, root, last)
        beta = np.full(len(alpha), -np.inf)
        beta[last] = 0.0
        for r in range(len(bounds) - 2, -1, -1):
            a, b = bounds[r], bounds[r + 1]
            # Edges from one node lie apart in this range: one of each length at a time.
            step = to[a:b] - node[a:b]
            for n in np.unique(step):
                k = np.flatnonzero(step == n) + a
                beta[node[k]] = np.logaddexp(beta[node[k]], log[k] + beta[to[k]])
        share = np.exp(alpha[node] + log + beta[to] - alpha[last][word]) * weights[word]
        return np.bincount(edge, weights=share, minlength=len(self.edge_logs))


def count_words(docs: DataFrame, text_col: str, train_col: str, most: int = 300_000) -> DataFrame:
    """(word, c, a): occurrences of each word in training documents and in all."""
    low_bits = (1 << 40) - 1

    def run(batches):
        held: dict[bytes, int] = {}  # occurrences in training documents, shifted, plus those in all

        def flush():
            columns = [pa.array(held.keys(), pa.binary()).cast(pa.string())] + [pa.array([x >> 40 for x in held.values()], pa.int64()), pa.array([x & low_bits for x in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "c", "a"])

        for batch, data, at in chunks(batches, TEXT):
            low = LOWER[data]
            words = Words(low, at)
            train = np.asarray(batch.column(0))[words.row] if len(words) else np.zeros(0, bool)
            _, where, inverse, count = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
            known = np.bincount(inverse, weights=train, minlength=len(count)).astype(np.int64)
            raw = low.tobytes()
            for a, b, c, n in zip(words.starts[where].tolist(), words.ends[where].tolist(), known.tolist(), count.tolist(), strict=True):
                word = raw[a:b]
                held[word] = held.get(word, 0) + (c << 40) + n
            if len(held) > most:
                yield flush()
                held.clear()
        if held:
            yield flush()

    given = docs.select(F.col(train_col), F.col(text_col).alias(TEXT))
    return given.mapInArrow(run, "word string, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def piece_counts(words: DataFrame, model: bytes) -> np.ndarray:
    """How often each piece of the vocabulary occurs in the training words, segmented by the model's own rule."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()

    def run(batches):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            found = pieces.encode(batch.column(0).to_pylist(), num_threads=1)
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))
            yield np.bincount(ids, weights=np.repeat(batch.column(1).to_numpy(), n), minlength=size)

    out = added(words.filter("c > 0").select("word", "c"), run, size)
    shared.destroy()
    return out


def refine(words: DataFrame, start: Vocabulary, ends: float, rounds: int) -> Vocabulary:
    """Expectation maximisation over all segmentations of the training words (word, c)."""
    seen = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(start)

        def run(batches, shared=shared):
            for batch in batches:
                for low in range(0, batch.num_rows, 20_000):
                    part = batch.slice(low, 20_000)
                    yield shared.value.expected_counts([w.encode() for w in part.column(0).to_pylist()], part.column(1).to_numpy())

        counts = added(seen, run, len(start.edge_logs))
        shared.destroy()
        start = start.weighted(counts, ends)
    return start


def own_weights(source) -> np.ndarray | None:
    """Probabilities of a vocabulary's pieces by its own scores; None if those are ranks."""
    scores = np.array([source.get_score(i) for i in range(source.get_piece_size())])
    ranks = scores[scores < 0]
    return None if len(ranks) and (ranks == np.round(ranks)).all() else np.exp(scores)


def vocabulary(model: bytes, counts: np.ndarray, ends: float) -> Vocabulary:
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces, own, single = [], [], np.zeros(256)
    for i in range(source.get_piece_size()):
        if source.is_byte(i):
            single[int(source.id_to_piece(i)[3:5], 16)] = counts[i]
        elif not (source.is_control(i) or source.is_unknown(i) or source.is_unused(i)):
            text = source.id_to_piece(i).encode()
            if SPACE_MARK not in text[1:] and text.lower() == text:
                pieces.append(text)
                own.append(counts[i])
    return Vocabulary(pieces, np.array(own, float), single, float(ends))


def fit(words: DataFrame, model: bytes, ends: int, rounds: int) -> Vocabulary:
    """Pieces of ``model`` weighted by the training words (word, c) and the number of text ends."""
    import sentencepiece

    own = own_weights(sentencepiece.SentencePieceProcessor(model_proto=model))
    start = vocabulary(model, piece_counts(words, model), ends) if own is None else vocabulary(model, own * max(ends, 1), ends)
    return refine(words, start, ends, rounds)


def score(docs: DataFrame, model_path: str, train_col: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(id, train_col, n_tokens, n_known, train_tokens, base_score, score, urn_score) of each row; scores are log10 probabilities.

    ``train_col`` (boolean, null is false) marks the rows to learn from.
    """
    spark, docs = docs.sparkSession, docs.withColumn(train_col, F.coalesce(F.col(train_col), F.lit(False)))
    bounded(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    ends = docs.filter(F.col(train_col)).count()
    counted = written(count_words(docs, text_col, train_col), "word-counts")
    total = counted.agg(F.sum("c").alias("n"), F.sum("a").alias("a"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()  # counts of the corpus: one row
    n, v = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    base = lambda c: np.log10((np.asarray(c) + 1.0) / (float(n) + v + 1))
    weight = DISCOUNT * v / n if n else 1.0
    whole = lambda c: np.maximum(np.asarray(c, float) - DISCOUNT, 0) / max(n, 1)
    lattice = spark.sparkContext.broadcast(fit(counted, model, ends, rounds))

    def word_scores(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 20_000):
                part = batch.slice(low, 20_000)
                words = [w.encode() for w in part.column(0).to_pylist()]
                logs = lattice.value.log_probabilities(words) / LN10
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)), *part.columns[1:], pa.array(logs)], ["hash", "c", "a", "log"])

    words = written(counted.select("word", "c", "a").mapInArrow(word_scores, "hash long, c long, a long, log double"), "word-scores")
    drop(counted)
    least = -(-(total["a"] or 0) // HEAD)
    head = words.filter(F.col("a") >= max(least, 1)).select("hash", "c", "log").toArrow()  # HEAD rows at most
    shared = spark.sparkContext.broadcast((head["hash"].to_numpy().view(np.uint64), head["c"].to_numpy(), head["log"].to_numpy()) if head.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)))
    end_log, end_base = lattice.value.end / LN10, float(base(ends))
    end_urn = float(np.log(STRENGTH * (whole(ends) + weight * np.exp(lattice.value.end))))

    def texts(batches):
        keys, c, log = shared.value
        lookup, known, p, plain = Lookup(keys), c > 0, whole(c) + weight * np.power(10.0, log), base(c)
        part, seen = TaskContext.get().partitionId() << 33, 0
        for batch, data, at in chunks(batches, TEXT):
            w = Words(LOWER[data], at)
            hashes = w.hashes()
            order = np.lexsort((hashes, w.row))
            row, key = w.row[order], hashes[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            many, row, key = np.diff(np.append(first, len(row))), row[first], key[first]
            found = lookup.find(key)
            is_head = found >= 0
            at_head, n_head, r_head = found[is_head], many[is_head], row[is_head]
            sums = [np.bincount(r_head, weights=x, minlength=w.rows) for x in (n_head * known[at_head], n_head * plain[at_head], n_head * log[at_head], urn(p[at_head], n_head))]
            size = w.counts() + 1
            drawn = sums[3] + end_urn + log_gamma(np.full(w.rows, STRENGTH)) - log_gamma(STRENGTH + size)
            cuts = pa.array(np.concatenate([[0], np.searchsorted(row[~is_head], np.arange(w.rows), "right")]).astype(np.int32))
            tail = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(key[~is_head].view(np.int64)), pa.array(many[~is_head])], ["hash", "n"]))
            rid = pa.array(part + seen + np.arange(w.rows))
            seen += w.rows
            made = [rid, pa.array(size), pa.array(np.rint(sums[0]).astype(np.int64) + (ends > 0)), pa.array(sums[1] + end_base), pa.array(sums[2] + end_log), pa.array(drawn / LN10), tail]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["id", "train", "rid", "n_tokens", "known", "base", "log", "drawn", "tail"])

    given = docs.select(F.col(id_col).alias("id"), F.col(train_col).alias("train"), F.col(text_col).alias(TEXT))
    kind = given.schema["id"].dataType.simpleString()
    rows = written(given.mapInArrow(texts, f"id {kind}, train boolean, rid long, n_tokens long, known long, base double, log double, drawn double, tail array<struct<hash:long,n:long>>"), "text-scores")
    tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.hash", "t.n")
    p = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / max(n, 1) + weight * F.pow(F.lit(10.0), "log")
    plain = F.log10((F.col("c") + 1) / F.lit(float(n) + v + 1))
    rare = words.filter(F.col("a") < max(least, 1)).select("hash", "log", (F.col("c") > 0).cast("long").alias("known"), plain.alias("plain"), (STRENGTH * p).alias("share"))
    draws = F.when(F.col("n") == 1, F.log("share")).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(0.0), lambda a, k: a + F.log(F.col("share") + k)))
    more = tail.join(rare, "hash").groupBy("rid").agg(*[F.sum(F.col("n") * F.col(x)).alias(f"more_{x}") for x in ("log", "known", "plain")], (F.sum(draws) / LN10).alias("more_drawn"))
    joined = rows.drop("tail").join(more, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("train").alias(train_col),
        "n_tokens",
        plus("known", "more_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "more_plain").alias("base_score"),
        plus("log", "more_log").alias("score"),
        plus("drawn", "more_drawn").alias("urn_score"),
    )
