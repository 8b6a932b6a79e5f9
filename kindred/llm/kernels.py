"""Vectorised kernels over UTF-8 text held in Arrow buffers.

Every function works on whole texts.  ``chunks`` bounds memory by bytes: a
batch of long texts is worked through a few texts at a time, and one text that
is longer than the bound is worked through alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kindred.shared import trim

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters and digits, and every byte of other characters.
SOLID = np.zeros(256, bool)
SOLID[48:58] = SOLID[65:91] = SOLID[97:123] = True
SOLID[128:] = True

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2^64."""
    global _powers
    if base != _ODD:
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 512 << 10) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``most`` bytes of text (one row at least), with bytes and offsets; at the end, ``trim``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = buffer(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high
    trim()


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capital letters U+00C0-U+00DE in lower case."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


class Words:
    """Maximal runs of bytes other than space and 0x09-0x0D: starts, ends, row of each and hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        self.data, self.at, self.rows = data, at, len(at) - 1
        gap = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.ones(n, bool)
        before[1:] = gap[:-1]
        self.starts = np.flatnonzero(~gap & (before | edge[:-1]))
        after = np.ones(n, bool)
        after[:-1] = gap[1:]
        self.ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.row = np.searchsorted(at, self.starts, "right") - 1
        self.gap = gap

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        first = self.starts[0]
        span = np.diff(np.append(self.starts, len(self.data)))
        offset = np.arange(first, len(self.data)) - np.repeat(self.starts, span)
        terms = (self.data[first:].astype(np.uint64) + np.uint64(1)) * powers(int(span.max()))[offset]
        terms[self.gap[first:]] = 0
        return mix(np.add.reduceat(terms, self.starts - first))


    def cores(self, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word without the punctuation around it, in lower case: hash, first and last byte, and whether any is left.

        With ``prefixes``, hashes are a matrix: the word, then its first so many bytes.
        """
        n = len(self.data)
        if not len(self.starts):
            empty = np.zeros(0, np.int64)
            hashes = empty.astype(np.uint64)
            return np.zeros((0, 1 + len(prefixes)), np.uint64) if prefixes else hashes, empty, empty, empty.astype(bool)
        low = self.starts[0]
        solid, at = SOLID[self.data[low:]], np.arange(low, n)
        first = np.minimum.reduceat(np.where(solid, at, n), self.starts - low)
        last = np.maximum.reduceat(np.where(solid, at, -1), self.starts - low)
        span = np.diff(np.append(self.starts, n))
        offset = at - np.repeat(first, span)
        terms = (lower(self.data)[low:].astype(np.uint64) + np.uint64(1)) * powers(int(span.max()))[np.maximum(offset, 0)]
        terms[(offset < 0) | (at > np.repeat(last, span))] = 0
        whole = mix(np.add.reduceat(terms, self.starts - low))
        if prefixes:
            columns = [whole]
            for k in sorted(prefixes, reverse=True):
                terms[offset >= k] = 0
                columns.insert(1, mix(np.add.reduceat(terms, self.starts - low) + np.uint64(k)))
            whole = np.stack(columns, 1)
        return whole, first, last, last >= 0


class Lookup:
    """Positions of 64-bit hashes among fixed distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.mask = np.uint64(size - 1)
        self.keys, self.place = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = ((keys[left] + np.uint64(self.probes)) & self.mask).astype(np.int64)
            _, one = np.unique(slot, return_index=True)
            one = one[self.place[slot[one]] < 0]
            self.keys[slot[one]], self.place[slot[one]] = keys[left[one]], left[one]
            left = np.delete(left, one)
            self.probes += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        slot = (keys & self.mask).astype(np.int64)
        out = self.place[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        for k in range(1, self.probes):
            if not len(left):
                break
            slot = ((keys[left] + np.uint64(k)) & self.mask).astype(np.int64)
            out[left] = self.place[slot]
            left = left[(self.place[slot] >= 0) & (self.keys[slot] != keys[left])]
        out[left] = -1
        return out


class SliceCache:
    """Token ids of byte slices, found for many slices at once.

    Slices are told apart by a 64-bit hash together with their length and first
    seven bytes.  The table holds ``most`` slices (of one batch, if that has
    more) and starts anew when full; slices over LONGEST bytes aren't kept.
    """

    LONGEST = 64

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self, least: int = 0) -> None:
        self.most = max(self.most, least)
        self.size = 1 << int(np.ceil(np.log2(2 * self.most + 2)))
        self.keys, self.heads = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.entry = np.full(self.size, -1, np.int32)
        self.n, self.used = 0, 0
        self.first, self.length = np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)
        self.ids = np.zeros(4096, self.dtype)

    def ids_of(self, data: np.ndarray, cuts: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the neighbouring slices of ``data`` that start at ``cuts``, as (ids, first, length).

        The ids of slice i are ``ids[first[i] : first[i] + length[i]]``.  What
        isn't known goes to ``encode``, which takes a list of slices and
        returns their ids one after another and the number of each.
        """
        first, length = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        if not len(cuts):
            return self.ids[:0], first, length
        span = np.diff(np.append(cuts, len(data)))
        key, head = self.hashes(data, cuts, span)
        raw = data.tobytes()
        slices = lambda which: [raw[a : a + b] for a, b in zip(cuts[which].tolist(), span[which].tolist(), strict=True)]
        short = span <= self.LONGEST
        entry = np.full(len(cuts), -1, np.int64)
        entry[short] = self.find(key[short], head[short])
        miss = np.flatnonzero(short & (entry < 0))
        _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
        if self.n + len(one) > self.most:
            self.clear(len(cuts))
            miss = np.flatnonzero(short)
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
        if len(miss):
            new = miss[one]
            entry[miss] = self.add(key[new], head[new], *encode(slices(new)))[back]
        first[short], length[short] = self.first[entry[short]], self.length[entry[short]]
        store, rest = self.ids[: self.used], np.flatnonzero(~short)
        if len(rest):
            ids, many = encode(slices(rest))
            first[rest], length[rest] = len(store) + np.cumsum(many) - many, many
            store = np.concatenate([store, ids])
        return store, first, length

    def hashes(self, data: np.ndarray, cuts: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each slice up to LONGEST bytes, eight bytes at a time; its length and first seven bytes."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        full = span >= 8
        word = eight[cuts] & np.where(full, _ALL, (np.uint64(1) << (8 * np.minimum(span, 7)).astype(np.uint64)) - np.uint64(1))
        head = word & (_ALL >> np.uint64(8)) | span.astype(np.uint64) << np.uint64(56)
        key = mix(word + span.astype(np.uint64) * _ODD)
        for at in range(8, self.LONGEST, 8):
            left = np.flatnonzero((span > at) & (span <= self.LONGEST)) if at == 8 else left[span[left] > at]
            if not len(left):
                break
            rest = span[left] - at
            word = eight[cuts[left] + at] & np.where(rest >= 8, _ALL, (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1))
            key[left] = mix(key[left] * _ODD + word)
        return key, head

    def find(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Entry of each slice, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        left, step = np.arange(len(key)), 0
        while len(left):
            slot = ((key[left] + np.uint64(step)) & np.uint64(self.size - 1)).astype(np.int64)
            got = self.entry[slot]
            same = (self.keys[slot] == key[left]) & (self.heads[slot] == head[left]) & (got >= 0)
            out[left[same]] = got[same]
            left, step = left[(got >= 0) & ~same], step + 1
        return out

    def add(self, key: np.ndarray, head: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entries of distinct new slices with their ids one after another."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        made = np.arange(self.n, self.n + len(key))
        self.first[made], self.length[made] = self.used + np.cumsum(length) - length, length
        left, step = np.arange(len(key)), 0
        while len(left):
            slot = ((key[left] + np.uint64(step)) & np.uint64(self.size - 1)).astype(np.int64)
            _, one = np.unique(slot, return_index=True)
            one = one[self.entry[slot[one]] < 0]
            self.keys[slot[one]], self.heads[slot[one]], self.entry[slot[one]] = key[left[one]], head[left[one]], made[left[one]]
            left, step = np.delete(left, one), step + 1
        self.n, self.used = self.n + len(key), self.used + len(ids)
        return made


def windows(values: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` neighbouring values within a row, and where each window starts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    weight = powers(width, _WINDOW)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += values[j : j + n] * weight[j]
    inside = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(total[inside]), inside
