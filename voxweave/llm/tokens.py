"""Words of many texts at once, on the UTF-8 buffer of an Arrow column.

Used inside tasks only. Texts are taken a few megabytes at a time, so memory does
not depend on the batch; a single longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The six bytes that end a word; all are single bytes in UTF-8.
BLANK_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
PIECE = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(BLANK_BYTES)] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    return _powers(size, base)[:n] if size <= 1 << 22 else _powers.__wrapped__(n, base)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.large_binary()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else large)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `limit` bytes."""
    data, offsets = buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, counts): byte spans of all words, and words per text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = _IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = edges[edges > 0] - 1
    last[inner] = word[inner]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums that give any substring's hash; one entry more than bytes."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data), _BASE), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    return mix64((sums[ends] - sums[starts]) * powers(len(sums), _INVERSE)[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text); fold lower-cases A-Z."""
    starts, ends, counts = word_spans(data, offsets)
    sums = prefix(_FOLD[data] if fold else data)
    return span_hashes(sums, starts, ends), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, shingles per text), repeats included.

    A text with fewer words than `width` has its whole sequence as one shingle.
    """
    total = len(words)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = np.repeat(np.minimum(counts, width), n)
    out = mix64(size.astype(U64))
    for k in range(width):
        here = at + k
        inside = size > k
        if inside.all():
            out = mix64(out * U64(_BASE) + words[here])
        else:
            step = mix64(out * U64(_BASE) + words[np.minimum(here, total - 1)])
            out = np.where(inside, step, out)
    return out, n
