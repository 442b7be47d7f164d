"""Vectorised text kernels shared by the operators that run in Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D; since those bytes are single-byte
characters in UTF-8, byte-wise splitting equals splitting by ``[^\\x20\\x09-\\x0D]+``. Words are
hashed from the Arrow buffer itself, without building Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C55 | 1
#: Bytes of text worked on at once: their arrays stay in the cache and are not mapped anew each time.
SLICE = 1 << 19
#: The low 0 to 8 bytes of a little-endian block.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def salts(at: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """A random-looking value for each place; an int stands for the places below it."""
    at = np.arange(at, dtype=U64) if isinstance(at, int) else at.astype(U64)
    return mix((at + U64(1)) * U64(BASE) + U64(seed * 0xD1B54A32D192ED03 % (1 << 64)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def spans(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a row's edge ends a word."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def _blocks(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (zeros beyond the end), one row a place."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((b, np.zeros(8, np.uint8))), 8)


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, in any order; another ``seed`` is another function.

    Every block of eight bytes is mixed with its place before blocks are added up, so there is no
    polynomial whose terms structured texts could cancel; spans of up to eight bytes of one length
    never collide. Others collide by chance, n different spans about n**2 / 2**65 times.
    """
    if not len(starts):
        return np.zeros(0, U64)
    blocks, n = _blocks(b), ends - starts
    load = lambda at, left: blocks[at].view("<u8").ravel() & _LOW[np.minimum(left, 8)]
    out = load(starts, n)
    out ^= salts(1, seed)
    out = mix(out)
    more = np.flatnonzero(n > 8)
    if len(more):
        extra = (n[more] - 1) >> 3
        group, k = ragged(extra)
        k += 1
        x = load(starts[more][group] + 8 * k, n[more][group] - 8 * k)
        x ^= salts(int(extra.max()) + 1, seed)[k]
        out[more] += np.add.reduceat(mix(x), np.cumsum(extra) - extra)
    out += n.astype(U64) * U64(BASE)
    return mix(out)


def same_spans(b: np.ndarray, s: np.ndarray, e: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``s`` to ``e`` are those from ``t`` to ``f``."""
    blocks, n = _blocks(b), e - s
    load = lambda at, left: blocks[at].view("<u8").ravel() & _LOW[np.minimum(left, 8)]
    out = (n == f - t) & (load(s, n) == load(t, f - t))
    more = np.flatnonzero(out & (n > 8))
    if len(more):
        group, k = ragged((n[more] - 1) >> 3)
        at, left = 8 * (k + 1), n[more][group] - 8 * (k + 1)
        out[more[group[load(s[more][group] + at, left) != load(t[more][group] + at, left)]]] = False
    return out


def word_numbers(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 0 for each span; equal numbers exactly for equal bytes, whatever their hashes."""
    h = hash_spans(b, starts, ends)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    rep = first[number]
    odd = np.flatnonzero(~same_spans(b, starts, ends, starts[rep], ends[rep]))
    if len(odd):
        raw, own = b.tobytes(), {}
        number[odd] = [len(first) + own.setdefault(raw[p:q], len(own)) for p, q in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
    return number


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and each row's offsets into them (n + 1)."""
    b, offs = text_buffers(column)
    starts, ends = spans(b, offs)
    return hash_spans(b, starts, ends), np.searchsorted(starts, offs)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (len - k + 1), across rows; callers mask row ends."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - k + 1, U64)
    for j, p in enumerate(salts(k, 1) | U64(1)):
        out += h[j : len(h) - k + 1 + j] * p
    return mix(out)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of one document's k-word shingles; a shorter document is one shingle; none is none."""
    return h[:0] if not len(h) else grams(h, min(k, len(h)))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each part holds about ``limit`` bytes of text, at least one row."""
    _, offs = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: each element's group and place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return group, np.arange(len(group)) - np.repeat(begin, counts)


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and their offsets."""
    return np.concatenate([np.zeros(0, U64), *sets]), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


class Seen:
    """The values that a task has met, at most ``LIMIT``; then it forgets them and starts anew.

    A value is new once a task, or a few times in a long one, so that a frequent value yields few rows."""

    LIMIT = 1 << 18

    def __init__(self) -> None:
        self.values = np.zeros(0, U64)

    def new(self, values: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
        """Places, ascending, where a value (of those to ``use``) occurs for the first time."""
        at = np.arange(len(values)) if use is None else np.flatnonzero(use)
        own, first = np.unique(values[at], return_index=True)
        if len(self.values):
            known = self.values[np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)] == own
            own, first = own[~known], first[~known]
        held = len(self.values) + len(own) <= self.LIMIT
        self.values = np.sort(np.concatenate((self.values, own)), kind="stable") if held else own
        return np.sort(at[first])
