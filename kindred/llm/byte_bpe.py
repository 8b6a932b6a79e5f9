"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of codepoint classes.  Each class, with what a character
can see ahead of it, is a function from automaton states to automaton states;
functions compose associatively, so the states at block starts come from a
prefix scan over blocks, and the boundaries of pieces from the states.  No
regular expression runs.  Pieces are merged by rank once for each distinct
piece in a worker's cache and looked up, many at a time, from then on.

Defined cases: a null or empty text has no tokens and decodes to nothing;
repeated rows each get their own result; a piece of any length is merged in
O(n log n); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kindred.llm.kernels import SliceCache
from kindred.llm.runtime import binaries, map_texts

# Symbols: what a character is, given the characters after it.
LETTER, NUMBER, OTHER, SHORT, LONG, LEAD, RUN, LAST = range(8)
# States: what the text before a character leaves open.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_LEAD, IN_SPACE, TWO_LEFT, ONE_LEFT, CLOSED = range(8)
_RESET = 8  # added to the symbol of a text's first character

#: Code points with the property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at the character."""
    if symbol >= _RESET:
        return _step(CLOSED, symbol - _RESET)[0], True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return CLOSED, False
    if symbol == LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_LEAD)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_LEAD)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHERS, AFTER_LEAD):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}[symbol], True
    if symbol == LEAD:
        return AFTER_LEAD, True
    if symbol == RUN:
        return IN_SPACE, state != IN_SPACE
    return IN_SPACE, True  # LAST: the last of a run, not a plain space, before other text


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each codepoint; next state and start flag by symbol and state; transition of four symbols."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE] = RUN
    one = np.zeros((16, 8), np.uint8)
    starts = np.zeros((16, 8), bool)
    for symbol in range(16):
        for state in range(8):
            one[symbol, state], starts[symbol, state] = _step(state, symbol)
    two = one[np.arange(16)[None, :, None], one[:, None, :]].reshape(256, 8)
    four = two[np.arange(256)[None, :, None], two[:, None, :]].reshape(65536, 8)
    return kinds, one.ravel(), starts.ravel(), four.ravel()


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each codepoint; ``first`` marks the first of each text."""
    kinds = tables()[0]
    out = kinds[points]
    n = len(points)
    end = np.ones(n, bool)
    end[:-1] = first[1:]
    space = out == RUN
    last = space & ~end
    last[:-1] &= ~space[1:]
    out[last] = np.where(points[last] == 32, LEAD, LAST)
    at = np.flatnonzero((points == 39) & ~end)
    if len(at):
        a = points[at + 1]
        short = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        more = ~end[at + 1]
        b = np.where(more, points[np.minimum(at + 2, n - 1)], 0)
        long = (((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))
        out[at[short]] = SHORT
        out[at[long & more]] = LONG
    out[first] += _RESET
    return out


def piece_starts(symbol: np.ndarray, block: int = 64) -> np.ndarray:
    """Positions at which pieces start, by a scan over transition functions.

    Four symbols at a time are one table entry; ``block`` entries make a
    block, whose function is composed for all blocks at once; a doubling scan
    over block functions gives each block's entry state.
    """
    _, one, starts, four = tables()
    n = len(symbol)
    blocks = -(-n // (4 * block))
    s = np.zeros(blocks * block * 4, np.uint8)
    s[:n] = symbol
    s = s.reshape(-1, 4).astype(np.int32)
    quads = (((s[:, 0] << 12) | (s[:, 1] << 8) | (s[:, 2] << 4) | s[:, 3]) << 3).reshape(blocks, block)
    f = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for j in range(block):
        f = four[quads[:, j, None] + f]
    step = 1
    while step < blocks:  # inclusive doubling scan
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.int64), 1)
        step *= 2
    state = np.full(blocks, CLOSED, np.uint8)
    state[1:] = f[:-1, CLOSED]
    entered = np.empty((blocks, block), np.uint8)
    for j in range(block):
        entered[:, j] = state
        state = four[quads[:, j] + state]
    state = entered.ravel()
    flags = np.empty((len(state), 4), bool)
    for k in range(4):
        at = (s[:, k] << 3) + state
        flags[:, k] = starts[at]
        state = one[at]
    return np.flatnonzero(flags.ravel()[:n])


def split_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start in the texts ``data[at[i]:at[i+1]]``."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    return place[piece_starts(symbols(points, edge[place]))]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Pair merging by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        merged = [self.merge(p) for p in pieces]
        n = np.fromiter(map(len, merged), np.int64, len(merged))
        return np.fromiter(chain.from_iterable(merged), "<u4", int(n.sum())), n

    def merge(self, piece: bytes) -> list[int]:
        """Joins the neighbours of lowest rank, the leftmost first, until no join has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n < 40:
            parts = [piece[i : i + 1] for i in range(n)]
            none = len(ranks) + (1 << 40)
            order = [ranks.get(piece[i : i + 2], none) for i in range(n - 1)]
            while order and (best := min(order)) < none:
                i = order.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del order[i]
                if i < len(order):
                    order[i] = ranks.get(parts[i] + parts[i + 1], none)
                if i:
                    order[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            return [ranks[p] for p in parts]
        after = list(range(1, n + 1))  # start of the next part; a merged part has no entry of its own
        before = list(range(-1, n - 1))
        alive = [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue  # either part has changed since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(queue, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(queue, (r, p, end))
        return [ranks[piece[i : after[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes many texts at once."""

    def __init__(self, ranks: dict[bytes, int], most: int = 600_000):
        self.merger, self.cache = Merger(ranks), SliceCache(np.dtype("<u4"), most)
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
            self.length[i] = len(token)
        self.place = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many ids come before the end of each text."""
        starts = split_points(data, at)
        store, first, length = self.cache.ids_of(data, starts, self.merger)
        before = np.concatenate([[0], np.cumsum(length)])
        ids = store[np.arange(before[-1]) + np.repeat(first - before[:-1], length)]
        return ids, before[np.searchsorted(starts, at[1:])]

    def starts(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its own text."""
        total = np.concatenate([[0], np.cumsum(self.length[ids])])
        first = np.concatenate([[0], ends[:-1]])
        return (total[:-1] - np.repeat(total[first], ends - first)).astype("<u4")

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text ends."""
        length = self.length[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(total[-1]) + np.repeat(self.place[ids] - total[:-1], length)
        return self.flat[index], total[ends]


_kept: list = [None, None]


def codec(ranks: dict[bytes, int]) -> Codec:
    """A worker's codec for broadcast ranks, kept from task to task with its cache."""
    if _kept[0] is not ranks:
        _kept[:] = [ranks, Codec(ranks)]
    return _kept[1]


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", carry: list[str] | None = None, offsets: bool = True, decoded: bool = False) -> DataFrame:
    """``carry`` columns (all, if None), ``n_tokens``, ``ids`` and, if asked for, ``starts`` and ``decoded``.

    ``ids`` and ``starts`` (the byte offset of each token in the text) are
    little-endian unsigned 32-bit integers; ``decoded`` is what the ids decode
    to.  The ranks are read on the driver and broadcast: their size is that of
    the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    fields += [StructField("starts", BinaryType())] * offsets + [StructField("decoded", BinaryType())] * decoded

    def start():
        own = codec(shared.value)

        def work(data, at):
            ids, ends = own.encode(data, at)
            out = [pa.array(np.diff(ends, prepend=0)), binaries(ids, 4 * ends)]
            if offsets:
                out.append(binaries(own.starts(ids, ends), 4 * ends))
            if decoded:
                out.append(binaries(*own.decode(ids, ends)))
            return out

        return work

    return map_texts(docs, text_col, docs.columns if carry is None else carry, StructType(fields), start)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the bytes of ``ids_col``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        own = codec(shared.value)
        return lambda data, at: [binaries(*own.decode(np.frombuffer(data.tobytes(), "<u4"), at[1:] // 4))]

    return map_texts(encoded, ids_col, encoded.columns, StructType([StructField(out_col, BinaryType())]), start)
