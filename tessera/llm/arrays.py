"""Texts of an Arrow batch as flat byte arrays: words, spans and their hashes, without a loop per text.

A batch is worked on in slices of SLICE_BYTES. A longer text is a slice of its own and takes some 60
bytes of memory for each of its bytes, so a text of 10 MB takes 600 MB of its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at once within a batch.
SLICE_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces with about so many bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, upto = 0, np.cumsum(sizes, dtype=np.int64)
    while begin < len(sizes):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins (one more offset than texts). Null counts as empty."""
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables for one slice are kept, longer ones are not."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= SLICE_BYTES + 1:
        _powers = tuple(out)
    return tuple(out)


def span_sums(data: np.ndarray) -> np.ndarray:
    """Running sums over the bytes that spans_hash takes differences of."""
    up, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span; equal bytes, equal hash, wherever they lie. sums: span_sums(data), if at hand."""
    sums = span_sums(data) if sums is None else sums
    _, down = _power(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more than texts); gaps: the bytes between words."""
    inside = ~gaps[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    begin[borders] = inside[borders]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, borders: np.ndarray, dtype=np.int64) -> np.ndarray:
    """The sum of values between each two neighbouring borders."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, dtype=dtype, out=total[1:])
    return total[borders[1:]] - total[borders[:-1]]


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of n neighbouring items at each place where they lie in one text, and those places."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    ends = np.repeat(first[1:], np.diff(first))[: len(out)]
    at = np.flatnonzero(np.arange(len(out)) + n <= ends)
    return mix(out[at]), at


def repeated(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal (group, key) anywhere, and which have one earlier."""
    joint = mix(keys + group.astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    some, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    return some, later


class Lexicon:
    """What a function gives for words, so that a word met again is not worked out again.

    make gives a list of arrays, one entry a word, for a list of words. What is remembered stays
    under `most` bytes; results do not depend on it.
    """

    def __init__(self, make: Callable[[list[str]], list[pa.Array]], most: int = 24 << 20):
        self.make, self.most = make, most
        self.words, self.columns = pa.array([], pa.string()), make([])

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """The row of each of the distinct words in the columns that are returned with them."""
        at = pc.index_in(words, self.words)
        fresh = pc.is_null(at)
        new = words.filter(fresh)
        columns = [pa.concat_arrays([c, m]) for c, m in zip(self.columns, self.make(new.to_pylist()))]
        rows = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        rows[fresh.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        self.words, self.columns = pa.concat_arrays([self.words, new]), columns
        if self.size() > self.most:
            self.words, self.columns = words, [c.take(pa.array(rows)) for c in columns]
            if self.size() > self.most:
                self.words, self.columns = pa.array([], pa.string()), self.make([])
        return rows, columns

    def size(self) -> int:
        return self.words.nbytes + sum(c.nbytes for c in self.columns)
