"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles; texts with the same words are one set
with a number of copies.  From a fixed signature of every set, a run splits the
sets recursively: a node picks the signature coordinates it splits on by its
own hash, 1/threshold of them on average, and sends each set to the child named
by its value there.  A bucket of few sets is compared whole.  A bucket whose
sets are alike on average wouldn't get smaller and is compared whole too, in
blocks.  A bucket that one task can hold is split to the end there.  A pair above the threshold has one surviving branch or more at every
level on average; ``survival`` is the probability that a run still has it at a
depth, and ``runs_for`` the number of runs after which it has been missed with
a probability of 1 - recall at most.  All sets get the runs that buckets of
depth SHALLOW need.  Sets that went deeper, which alone can form pairs that
need more, get further runs until there are enough for the depth reached.

Signatures nominate pairs; connected nominees are then verified by their exact
shingle sets, all pairs among them, in blocks.  Links are summed within blocks:
no list of pairs is made, and copies are counted, not expanded.

Defined cases: null texts count as empty; empty texts are copies of each other;
a text of 1 to 4 words is one shingle; words are split at white space and
compared in lower case; repeated rows are copies; an empty table gives no rows.
Equal 64-bit hashes count as equal words and texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kindred.llm.kernels import Words, chunks, lower, mix, powers, trim, windows
from kindred.llm.runtime import ROW_KEY, TEXT, binaries, bounded, drop, fresh, key_filter, map_texts, passes, without, written
from kindred.operators.components import connected_components, forest

WIDTH = 5
#: Coordinates of a signature.
SIZE = 64
#: Bits of a coordinate and how they are kept.
PARTS = {"lows": (0, np.uint8), "mids": (8, np.uint8), "tops": (16, np.uint16)}
_FACTORS = mix(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Sets up to which a bucket is compared whole, sets in a block of the signature and of the exact comparison.
SMALL, BLOCK, EXACT_BLOCK = 48, 1024, 512
#: Blocks of sets up to which one task splits a bucket to the end.
IN_TASK = 4
#: Share of equal pairs on the next coordinate from which a bucket counts as alike.
ALIKE = 0.5
DEPTH = 12
#: Depth that the first runs are enough for.
SHALLOW = 3


def shingles(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in row order, where each row's shingles start and end, and a hash of each row's words."""
    words = Words(lower(data), at)
    hashes, n, rows = words.hashes(), words.counts(), words.rows
    first = np.cumsum(n) - n
    whole = np.zeros(rows, np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        place = np.arange(len(hashes)) - np.repeat(first, n)
        whole[has] = np.add.reduceat(hashes * powers(int(n.max()))[place], first[has])
    whole = mix(whole + n.astype(np.uint64))
    grams, inside = windows(hashes, words.row, width)
    row = words.row[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        where = np.searchsorted(row, short)
        grams, row = np.insert(grams, where, whole[short]), np.insert(row, where, short)
    ends = np.searchsorted(row, np.arange(rows), "right")
    return grams, np.concatenate([[0], ends[:-1]]) if rows else ends, ends, whole


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, ROW_KEY, set_id, lows, mids, tops) for each row: bits 0-7, 8-15 and 16-31 of each coordinate, empty for an empty text.

    Roots split by 32 bits.  Below them the sets of a bucket have those in
    common, and 16 bits are enough; 8 bits tell whether two sets are alike.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(ROW_KEY), F.col(text_col).alias("text"))
    out = StructType([StructField("set_id", LongType()), *[StructField(c, BinaryType()) for c in PARTS]])

    def start():
        def work(data, at):
            grams, low, high, whole = shingles(data, at, width)
            has = np.flatnonzero(high > low)
            least = np.zeros((len(has), SIZE), np.uint32)
            if len(has):
                for k in range(SIZE):
                    least[:, k] = np.minimum.reduceat(((grams ^ _FACTORS[-1 - k]) * _FACTORS[k]) >> np.uint64(32), low[has])
            ends = np.cumsum(high > low) * SIZE
            parts = [binaries((least >> np.uint32(shift)).astype(kind), ends * np.dtype(kind).itemsize) for shift, kind in PARTS.values()]
            return [pa.array(whole.view(np.int64)), *parts]

        return work

    return map_texts(keyed, "text", ["id", ROW_KEY], out, start)


def choose(path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two coordinates for each node, and whether it splits on the second too (1/threshold coordinates on average)."""
    one = mix(path ^ np.uint64(0xA5A5A5A55A5A5A5A))
    first = (one % np.uint64(SIZE)).astype(np.int64)
    second = (first + 1 + ((one >> np.uint64(8)) % np.uint64(SIZE - 1)).astype(np.int64)) % SIZE
    return first, second, (one >> np.uint64(40)).astype(np.float64) / 2**24 < 1 / threshold - 1


def children(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, child node and coordinate (0 or 1) of every child that the rows go to."""
    first, second, also = choose(path, threshold)
    row = np.arange(len(path))
    child = lambda at, c: mix(path[at] + mix((c[at].astype(np.uint64) << np.uint64(32)) + sig[at, c[at]]))
    extra = np.flatnonzero(also)
    return np.concatenate([row, extra]), np.concatenate([child(row, first), child(extra, second)]), np.repeat([0, 1], [len(row), len(extra)])


def survival(depth: int, agree: np.ndarray, threshold: float) -> np.ndarray:
    """Probability that a run has two sets, whose signatures agree in a share ``agree``, in one bucket at ``depth``."""
    alive = np.ones_like(agree)
    for _ in range(depth):
        alive = 1 - (1 - agree * alive) * (1 - (1 / threshold - 1) * agree * alive)
    return alive


def runs_for(depth: int, threshold: float, recall: float) -> int:
    """Runs that find a pair of similarity ``threshold`` with probability ``recall`` in buckets of ``depth`` levels."""
    k = np.arange(SIZE + 1)
    ways = np.array([math.comb(SIZE, int(i)) for i in k], float)
    share = ways * threshold**k * (1 - threshold) ** (SIZE - k)  # of signatures that agree in k coordinates
    missed = 1 - survival(depth, k / SIZE, threshold)
    return next(r for r in range(1, 1000) if (share * missed**r).sum() <= 1 - recall or threshold == 0)


def _matrix(column, part: str = "lows") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), PARTS[part][1]).reshape(-1, SIZE)


def _values(columns) -> np.ndarray:
    """Coordinates of the signatures in columns lows, mids and, at the roots, tops."""
    return sum(_matrix(c, part).astype(np.uint32) << np.uint32(PARTS[part][0]) for c, part in zip(columns, PARTS, strict=False))


def _roots(runs: range, threshold: float, wanted=None):
    """Children of the roots of ``runs``, those that pass the filter ``wanted`` if there is one."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = _values(batch.columns[1:])
            for r in runs:
                root = np.full(len(ids), mix(np.array([r + 1], np.uint64))[0])
                row, child, _ = children(root, sig, threshold)
                path = child.view(np.int64)
                if wanted is not None:
                    kept = passes(wanted.value, path)
                    path, row = path[kept], row[kept]
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(ids[row])], ["path", "set_id"])

    return run


def _split(threshold: float):
    def run(batches):
        for batch in batches:
            sig, path = _values([batch.column(batch.schema.get_field_index(c)) for c in ("lows", "mids")]), batch.column(0).to_numpy().view(np.uint64)
            row, child, which = children(path, sig, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path[row].view(np.int64)), pa.array(child.view(np.int64)), pa.array(batch.column(1).to_numpy()[row]), pa.array(which)], ["path", "child", "set_id", "which"])

    return run


def _edges(a: list, b: list) -> pa.RecordBatch:
    x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _small_pairs(path: np.ndarray, ids: np.ndarray, sig: np.ndarray, least: float) -> tuple[list, list]:
    """Pairs of similar sets within each path; rows of a path follow each other."""
    a, b = [], []
    k = 1
    while k < len(path) and (at := np.flatnonzero(path[k:] == path[:-k])).size:
        for low in range(0, len(at), 20_000):
            i = at[low : low + 20_000]
            near = i[(sig[i] == sig[i + k]).mean(1) >= least]
            a.append(ids[near])
            b.append(ids[near + k])
        k += 1
    return a, b


def _by_path(work):
    """Calls ``work`` with batches that hold whole paths; rows of one path follow each other, and one that goes on in the next batch is kept for it."""

    def run(batches):
        kept = None
        for batch in batches:
            path = batch.column(0).to_numpy()
            if kept is not None:
                whole = pa.Table.from_batches([kept, batch]).combine_chunks()
                batch, path = whole.to_batches()[0], whole["path"].to_numpy()
            cut = int(np.searchsorted(path, path[-1]))
            kept = batch.slice(cut)
            if cut:
                yield work(batch.slice(0, cut))
        if kept is not None:
            yield work(kept)
        trim()

    return run


def _descend(start: int, threshold: float, least: float, small: int, shallow: int):
    """Splits buckets of depth ``start`` as ``_nominate`` does, down to those that are compared whole.

    Edges (a, b), and (set, null, depth) for sets that were in buckets split at
    depth ``shallow``.  Column mids may be null in buckets of ``small`` sets or fewer.
    """

    def work(batch):
        ids, low = batch.column(1).to_numpy(), _matrix(batch.column(2))
        sig = _values([batch.column(2), pc.fill_null(batch.column(3), bytes(SIZE))])
        path, row = batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows)
        a, b, deep = [], [], {}
        for level in range(start, DEPTH):
            order = np.argsort(path, kind="stable")
            path, row = path[order], row[order]
            _, group, n = np.unique(path, return_inverse=True, return_counts=True)
            few = (n > 1) & (n <= small)
            own = few[group]
            for all_, more in zip((a, b), _small_pairs(path[own], ids[row[own]], low[row[own]], least), strict=True):
                all_ += more
            large = (n > small)[group]
            path, row, group = path[large], row[large], group[large]
            if not len(path):
                break
            at, child, which = children(path, sig[row], threshold)
            first = which == 0
            _, one, c = np.unique(child[first], return_index=True, return_counts=True)
            alike = np.bincount(group[at[first][one]], c.astype(float) ** 2, len(n)) / np.maximum(n, 1).astype(float) ** 2
            whole = (alike >= ALIKE) | (level == DEPTH - 1)
            held = whole[group]
            for g in np.unique(group[held]):
                rows = row[group == g]
                for k in range(len(rows) - 1):
                    near = rows[k + 1 :][(low[rows[k + 1 :]] == low[rows[k]]).mean(1) >= least]
                    a.append(np.full(len(near), ids[rows[k]]))
                    b.append(ids[near])
            on = ~held[at]
            path, row = child[on], row[at[on]]
            if level + 1 >= shallow:
                deep |= dict.fromkeys(ids[row].tolist(), level + 1)
        x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        more, depth = np.array([*deep], np.int64), np.array([*deep.values()], np.int64)
        missing = np.repeat([False, True], [len(x), len(more)])
        columns = [np.concatenate([x, more]), pa.array(np.concatenate([y, more]), mask=missing), pa.array(np.concatenate([x, depth]), mask=~missing)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["a", "b", "depth"])

    return _by_path(work)


def _compare_blocks(least: float):
    """All pairs of the two blocks of a group, by signature."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, side, sig = t["set_id"].to_numpy(), t["side"].to_numpy(), _matrix(t["lows"])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        a, b = [], []
        for i in left:
            near = right[(sig[right] == sig[i]).mean(1) >= least]
            a.append(np.full(len(near), ids[i]))
            b.append(ids[near])
        return pa.Table.from_batches([_edges(a, b)])

    return run


def _blocked(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows of groups of known size dealt to pairs of blocks: columns ``i``, ``j`` (i <= j) and ``side``.

    Every two rows of a group meet in one pair of blocks.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("set_id", F.lit(7)), n).cast("int")
    dealt = rows.withColumn("n_blocks", n).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")}).drop("n_blocks", "mine", "other")


def nominate(sets: DataFrame, threshold: float, recall: float) -> list[DataFrame]:
    """Written edges (a, b) among ``sets`` (set_id and PARTS) that connect every pair which a run found; rows without b are none."""
    found, done, need, own = [], 0, runs_for(SHALLOW, threshold, recall), None
    while done < need:
        edges, deep, depth = _nominate(sets, range(done, need), threshold)
        found += edges
        done, need = need, runs_for(max(depth, SHALLOW), threshold, recall)
        if own is not None:
            drop(own)
        if deep is None:
            break
        if done < need:
            sets = own = written(sets.join(deep, "set_id", "left_semi"), "deep-sets")
        drop(deep)
    return found


def _nominate(sets: DataFrame, runs: range, threshold: float) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Edges that ``runs`` find, the sets that were in buckets split at depth SHALLOW (None: no such bucket), and the depth reached.

    Edges are written level by level, and what a level needed is dropped then.
    """
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / SIZE)
    nodes, before = sets.mapInArrow(_roots(runs, threshold), "path long, set_id long"), []
    found, deep, kept, most = [], [], None, IN_TASK * BLOCK
    for level in range(DEPTH):
        sizes = written(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "path-sizes")
        wanted = None
        if level == 0:  # most children of the roots are of one set: a filter keeps them from the join
            wanted = sets.sparkSession.sparkContext.broadcast(key_filter(sizes, "path"))
            nodes = sets.mapInArrow(_roots(runs, threshold, wanted), "path long, set_id long")
        paths = written(nodes.join(sizes, "path"), "paths")
        if level == 0:  # signatures of the other sets aren't needed any more, nor are the upper halves
            sets = kept = written(sets.select("set_id", "lows", "mids").join(paths.select("set_id").distinct(), "set_id", "left_semi"), "live-sets")
            wanted.destroy()
        # Buckets of the same few sets, as most runs give them, are compared once.
        hashed = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        few = paths.filter(F.col("n") <= SMALL)
        once = written(few.groupBy("path", "n").agg(*hashed).groupBy("n", "x1", "x2").agg(F.min("path").alias("path")).select("path"), "paths-once")
        # Buckets that a task can hold are split to the end there, others level by level.
        middle = paths.filter((F.col("n") > SMALL) & (F.col("n") <= most)).unionByName(few.join(once, "path", "left_semi"))
        middle = middle.join(sets, "set_id").select("path", "set_id", "lows", F.when(F.col("n") > SMALL, F.col("mids")).alias("mids"))
        edges = middle.repartition("path").sortWithinPartitions("path").mapInArrow(_descend(level, threshold, least, SMALL, SHALLOW), "a long, b long, depth long")
        if not sizes.filter(F.col("n") > most).limit(1).count():
            found.append(written(edges, "edges"))
            drop(*before, sizes, paths, once)
            break
        large = written(paths.filter(F.col("n") > most).join(sets, "set_id").select("path", "set_id", "n", "lows", "mids"), "large-paths")
        split = written(large.select("path", "set_id", "lows", "mids").mapInArrow(_split(threshold), "path long, child long, set_id long, which long"), "split-paths")
        shares = split.filter("which = 0").groupBy("path", "child").agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), 2)).alias("alike"))
        shares = written(shares.withColumn("whole", (F.col("alike") >= ALIKE) | F.lit(level == DEPTH - 1)).select("path", "whole"), "path-shares")
        whole = large.join(shares.filter("whole"), "path").select("path", "set_id", "n", "lows")
        blocks = _blocked(whole, "path", "n", BLOCK).groupBy("path", "i", "j").applyInArrow(_compare_blocks(least), "a long, b long")
        found.append(written(edges.unionByName(blocks.withColumn("depth", F.lit(None).cast("long"))), "edges"))
        more = shares.filter("not whole").limit(1).count()
        if more:
            nodes = written(split.join(shares.filter("not whole"), "path").select(F.col("child").alias("path"), "set_id"), "child-paths")
            if level == SHALLOW - 1:
                deep.append(written(nodes.select("set_id").distinct(), "deep-ids"))
        drop(*before, sizes, paths, once, large, split, shares)
        before = [nodes]
        if not more:
            break
    drop(kept)
    below = found[0]
    for table in found[1:]:
        below = below.unionByName(table)
    below = below.filter("depth is not null")
    depth = max(level, below.agg(F.max("depth")).first()[0] or 0) + 1
    if depth <= SHALLOW:
        return found, None, depth
    ids = below.select(F.col("a").alias("set_id"))
    for table in deep:
        ids = ids.unionByName(table)
    out = written(ids.distinct(), "deep-ids")
    drop(*deep)
    return found, out, depth


def _verify(threshold: float):
    """Exact Jaccard similarity of all pairs of the two blocks of a group: links of each set, and edges that connect them."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, side, copies = t["set_id"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy()
        parts = [np.unique(np.frombuffer(x, np.uint64)) for x in t["shingles"].to_pylist()]
        size = np.array([len(x) for x in parts])
        owner = np.repeat(np.arange(len(parts)), size)
        _, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count > 1
        rank = np.cumsum(shared) - 1
        used = shared[column]
        owner, column = owner[used], rank[column[used]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(parts), len(parts)), np.float32)
        step = 4096
        for low in range(0, int(shared.sum()), step):  # a stretch of columns at a time
            a, b = np.searchsorted(column, [low, low + step])
            m = np.zeros((len(parts), step), np.float32)
            m[owner[a:b], column[a:b] - low] = 1
            both += m @ m.T
        both = np.rint(both).astype(np.int64)
        either = size[:, None] + size[None, :] - both
        link = both >= threshold * either - 1e-9
        if (side == 1).any():
            link &= side[:, None] != side[None, :]
        else:
            np.fill_diagonal(link, False)
        n = link @ copies
        a, b = np.nonzero(np.triu(link))
        x, y = forest(ids[a], ids[b]) if len(a) else (np.zeros(0, np.int64),) * 2
        has = np.flatnonzero(n)
        return pa.table({"set_id": np.concatenate([ids[has], x]), "other": pa.array(np.concatenate([np.zeros(len(has), np.int64), y]), mask=np.repeat([True, False], [len(has), len(x)])), "links": np.concatenate([n[has], np.zeros(len(x), np.int64)])})

    return run


def member_shingles(docs: DataFrame, shared, id_col: str, text_col: str, width: int) -> DataFrame:
    """(text_id, text_key, shingles) of the rows of ``docs`` that pass the broadcast filter: all that members need."""
    texts = docs.select(F.col(id_col).alias("text_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias(TEXT))

    def run(batches):
        bits = shared.value
        for batch in batches:
            passed = passes(bits, batch.column(1).to_numpy())
            for part, data, at in chunks([batch.filter(pa.array(passed))], TEXT):
                grams, _, ends, _ = shingles(data, at, width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binaries(grams, 8 * ends)], ["text_id", "text_key", "shingles"])

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"text_id {kind}, text_key long, shingles binary")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.999, width: int = WIDTH) -> DataFrame:
    """(id, ROW_KEY, class_id, class_key, n_links) for each row of ``docs``.

    ``n_links``: other rows whose shingle sets have a Jaccard similarity of
    ``threshold`` or more.  ``class_id``: smallest id among rows that links
    connect, with ``class_key`` the hash of that row's text.
    """
    spark = docs.sparkSession
    bounded(spark)
    drawn = written(signatures(docs, id_col, text_col, width), "signatures")
    named = F.struct(F.col("id"), F.col(ROW_KEY).alias("key"))
    classes = written(drawn.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min(named).alias("first"), *[F.first(c).alias(c) for c in PARTS]), "classes")
    rows = written(drawn.select("id", ROW_KEY, "set_id"), "rows")
    drop(drawn)
    edges = nominate(classes.filter(F.length("lows") > 0).select("set_id", *PARTS), threshold, recall)
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    found = found.select("a", "b").dropna()
    near = connected_components(found, fresh(spark, "nominees"))
    near = written(near.select(F.col("node").alias("set_id"), "component"), "nominees")
    drop(*edges)
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = written(near.join(sizes, "component").join(classes.select("set_id", "copies", "first"), "set_id").select("component", "n", "set_id", "copies", F.col("first.id").alias("id"), F.col("first.key").alias(ROW_KEY)), "members")
    bits = spark.sparkContext.broadcast(key_filter(members))
    sketches = member_shingles(docs, bits, id_col, text_col, width)
    held = sketches.join(members, sketches["text_id"].eqNullSafe(members["id"]) & (sketches["text_key"] == members[ROW_KEY])).select("component", "n", "set_id", "copies", "shingles")
    held = written(held.dropDuplicates(["set_id"]), "member-shingles")
    bits.destroy()
    checked = _blocked(held, "component", "n", EXACT_BLOCK).groupBy("component", "i", "j").applyInArrow(_verify(threshold), "set_id long, other long, links long")
    checked = written(checked, "links")
    drop(near, members, held)
    roots = connected_components(checked.filter("other is not null").select("set_id", "other"), fresh(spark, "classes"))
    links = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = classes.select("set_id", "copies", "first").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").join(links, "set_id", "left")
    joined = written(joined.select("set_id", "copies", "first", F.coalesce("component", "set_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "linked")
    drop(classes, checked)
    heads = joined.groupBy("root").agg(F.min("first").alias("head"))
    final = written(joined.join(heads, "root").select("set_id", "head", (F.col("links") + F.col("copies") - 1).alias("n_links")), "class-heads")
    drop(joined)
    return rows.join(final, "set_id").select(F.col("id").alias(id_col), ROW_KEY, F.col("head.id").alias("class_id"), F.col("head.key").alias("class_key"), "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of ``docs``, that of the smallest id, with the columns of ``docs``.

    Of rows with the same id and text one stays.
    """
    found = written(jaccard_join(docs, id_col, text_col, **options), "near-copies")
    losers = found.filter(~(F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col(ROW_KEY) == F.col("class_key")))).select(id_col, ROW_KEY)
    kept = without(docs, written(losers.distinct(), "near-losers"), id_col, text_col)
    own = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col(ROW_KEY) == F.col("class_key"))
    repeated = written(found.filter(own).groupBy(id_col, ROW_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-rows")
    if not repeated.limit(1).count():
        return kept
    # only the rows that repeat are shuffled
    rest = without(kept, repeated, id_col, text_col)
    keys = repeated.select(F.col(id_col).alias("__id"), F.col(ROW_KEY).alias("__key"))
    marked = kept.withColumn(ROW_KEY, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = marked.join(keys, marked[id_col].eqNullSafe(keys["__id"]) & (marked[ROW_KEY] == keys["__key"]), "left_semi")
    return rest.unionByName(same.dropDuplicates([id_col, ROW_KEY]).drop(ROW_KEY))
