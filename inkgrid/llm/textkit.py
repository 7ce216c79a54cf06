"""Vectorised text kernels over Arrow buffers: no Python object per word, gram or character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[name] = np.multiply.accumulate(grown)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (in place on a copy)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j]-P[i] = sum of code*B^position over [i, j)."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_CODE[buf])


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of [lo, hi) for each pair, equal for equal content whatever its place."""
    down = powers(len(prefix))[1]
    return mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive codes."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((prefix[k:] - prefix[:n]) * powers(n)[1])


def utf8_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling: log2(w) passes."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def rightmost_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes, the place of its least hash, ties to the right."""
    place = np.arange(len(hashes), dtype=np.uint64)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    return (np.uint64(0xFFFFFFFF) - (sliding_min(keyed, w) & np.uint64(0xFFFFFFFF))).astype(np.int64)


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _WORD_BYTE[ord(_a) : ord(_b) + 1] = True


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words before each text). A word is a run of ASCII letters and
    digits and of non-ASCII bytes; texts never share a word. Lower-case the text beforehand."""
    n = len(buf)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD_BYTE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(byte_prefix(buf), starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words, shingles before each text). A text of 1 to size-1 words
    has one shingle, all its words; an empty one has none."""
    n_texts = len(counts) - 1
    per = np.diff(counts)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    prefix = prefix_hash(words | np.uint64(1))
    have = np.where(per >= size, per - size + 1, np.minimum(per, 1))
    before = np.concatenate(([0], np.cumsum(have)))
    at = np.repeat(counts[:-1] - before[:-1], have) + np.arange(before[-1])
    upto = np.minimum(at + size, np.repeat(counts[1:], have))
    return span_hash(prefix, at, upto), before
