"""Vectorised text kernels over Arrow string buffers.

Texts stay in the Arrow buffer: words are pairs of byte positions, and no Python object is
made for a word. Hashes only find candidates or place rows; what decides a result is compared
on the bytes (``same_spans``) or by a cryptographic digest of them (``digests``). Words are
hashed by eight bytes at a time through a bijection; runs of tokens, for anchors alone, by
prefix sums.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed in one piece; the tables of powers have this length.
BLOCK = 1 << 20
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)
U64 = np.uint64

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes that are not part of a normalised word: all of ASCII but digits and lower-case letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """q**i and q**-i modulo 2**64 for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, BLOCK + 1)
        for name, q in (("p", _Q), ("i", _QINV)):
            a = np.full(m, q, U64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


BYTE_VALUES = _splitmix(256, 0x5851F42D)


class PrefixHash:
    """Hashes of any run of ``values`` (64-bit) in constant time."""

    def __init__(self, values: np.ndarray):
        p, self.inv = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * p[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U64))


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if raw else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes, at least one row each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each row the index of its first word (one more than rows).

    Words never cross rows.
    """
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(separators[data], out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    stops = inside[:-1] & ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offs)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros beyond the end) as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Masks that keep the first n of eight bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Spans longer than this are hashed one by one.
LONG_SPAN = 512


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes a step, each step a bijection of the state and of the bytes."""
    size = ends - starts
    h = mix(size.astype(U64) + U64(0x2545F4914F6CDD1D))
    if not len(size):
        return h
    at, live, first = eights(data), np.flatnonzero(size <= LONG_SPAN), starts
    step = 0
    while len(live):
        rest = size[live] - step
        block = at[first[live] + step] & _KEEP[np.minimum(rest, 8)]
        h[live] = mix((h[live] ^ block) * U64(0xD6E8FEB86659FD93))
        live, step = live[rest > 8], step + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def same_spans(data: np.ndarray, s1: np.ndarray, s2: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes of equally long spans of ``data`` and of ``other`` (or ``data``) are the same."""
    x = eights(data)
    y = x if other is None else eights(other)
    same, live, step = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(live):
        rest = size[live] - step
        ok = ((x[s1[live] + step] ^ y[s2[live] + step]) & _KEEP[np.minimum(rest, 8)]) == 0
        same[live[~ok]] = False
        live, step = live[ok & (rest > 8)], step + 8
    return same


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit BLAKE2 digest of each byte span as two signed numbers: equal ones are equal bytes."""
    out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(out, "<i8").reshape(-1, 2)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each begins and ends."""
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + inner] = data[np.repeat(starts, size) + inner]
    return out.tobytes(), begin, begin + size


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on, built by doubling; the last k-1 positions are left out."""
    if len(h) < k:
        return np.zeros(0, U64)
    cur, p = h, 1
    while 2 * p <= k:
        cur = mix(cur[:-p] * U64(0xD6E8FEB86659FD93) + cur[p:] + U64(p))
        p *= 2
    if p < k:
        n = len(h) - k + 1
        cur = mix(cur[:n] * U64(0xA0761D6478BD642F) + cur[k - p : k - p + n] + U64(k))
    return cur


def inside_rows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first ``n`` positions begin a window of k items that stays in its row."""
    ok = np.ones(n, bool)
    for edge in first[1:]:
        ok[max(0, edge - k + 1) : edge] = False
    return ok


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Positions below n that lie in a window [s, s+k)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:-1]) > 0


def row_sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` in each row."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end]; starts ascend and runs are short against BLOCK."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    longest = int((ends - starts).max()) if n else 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK - longest, "right")))
        s0 = starts[i]
        out[i:j] = PrefixHash(values[s0 : ends[i:j].max()]).of(starts[i:j] - s0, ends[i:j] - s0)
        i = j
    return out


def fixed_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on, for at most BLOCK values."""
    p = PrefixHash(values)
    n = max(0, len(values) - k + 1)
    return mix((p.sums[k : k + n] - p.sums[:n]) * p.inv[:n] + U64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on."""
    n, p = len(x) - w + 1, 1
    while 2 * p <= w:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[:n], x[w - p : w - p + n])


def anchors(values: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, position, first start, last start) of the anchors of all windows inside rows.

    The anchor of a window is its k-gram with the smallest hash (the leftmost of equal ones),
    so equal windows have equal anchors at the same place. A run of starts with one anchor
    is one result; every start of a window belongs to exactly one. Positions are ascending.
    """
    out: list[tuple[np.ndarray, ...]] = []
    low, n = U64(BLOCK - 1), len(values)
    valid = inside_rows(first, window, max(0, n - window + 1))
    for t in range(0, n - window + 1, BLOCK - window + 1):
        v = values[t : t + BLOCK]
        h = fixed_hashes(v, k)
        key = (h & ~low) | np.arange(len(h), dtype=U64)
        at = (sliding_min(key, window - k + 1) & low).astype(np.int64)
        ok = valid[t : t + len(at)]
        edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]))))
        last = np.concatenate((edge[1:], [len(at)])) - 1
        use = ok[edge]
        edge, last = edge[use], last[use]
        out.append((h[at[edge]], at[edge] + t, edge + t, last + t))
    if not out:
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on for tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
