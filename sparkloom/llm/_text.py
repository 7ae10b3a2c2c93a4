"""Vectorised views of Arrow text: rows in segments, words, word hashes and shingle hashes.

Everything works on UTF-8 bytes. White space and ASCII classes never match bytes inside a longer UTF-8
sequence, so byte classes equal the code-point classes that the operators define.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one vectorised step handles; bounds the memory of the temporary arrays (about 40 times as much).
STEP_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM_BASE = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def segments(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        table = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            table.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = (table[0], table[1])
    return _powers[size]


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_table(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes with one kind; kind 0 separates, as row ends do."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = kinds[data]
    new = np.empty(len(data) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
    new[offsets] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _pieces(data: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts one long row where no run is cut; a single run of over STEP_BYTES stays whole."""
    first, n = 0, len(data)
    while first < n:
        last = min(n, first + STEP_BYTES)
        while last < n:
            k = kinds[data[last - STEP_BYTES if last - STEP_BYTES > first else first : last + 1]]
            cut = np.flatnonzero(k[1:] != k[:-1])
            if len(cut):
                last = last + 1 - len(k) + int(cut[-1]) + 1
                break
            last = min(n, last + STEP_BYTES)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run, in order. kinds: 256 small integers, 0 for separators."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in segments(offsets):
        part = data[offsets[a] : offsets[b]]
        if b == a + 1 and len(part) > 2 * STEP_BYTES:
            for x, y in _pieces(part, kinds):
                s, e, _ = runs(part[x:y], np.array([0, y - x]), kinds)
                hashes.append(_span_hashes(part[x:y], s, e))
                rows.append(np.full(len(s), a))
            continue
        s, e, r = runs(part, offsets[a : b + 1] - offsets[a], kinds)
        if len(s):
            hashes.append(_span_hashes(part, s, e))
            rows.append(r + a)
    return np.concatenate(hashes), np.concatenate(rows)


WORDS = (~SPACE).astype(np.uint8)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all k-word shingles; a row of fewer words gives its whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    out, at = [], []
    if n >= k:
        full = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        h = np.zeros(len(full), np.uint64)
        for j in range(k):
            h = h * _GRAM_BASE + words[full + j]
        out.append(mix(h))
        at.append(rows[full])
    for c in range(1, k):
        short = first[count == c]
        if len(short):
            h = np.full(len(short), c, np.uint64)
            for j in range(c):
                h = h * _GRAM_BASE + words[short + j]
            out.append(mix(h))
            at.append(rows[short])
    out, at = np.concatenate(out), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return out[order], at[order]
