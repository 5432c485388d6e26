"""Suffix arrays by induced sorting, and permuted common prefixes.

`suffix_array` is linear in the text: suffixes are classified as smaller or larger
than the next, the substrings between leftmost smaller ones are sorted by inducing from
any order of them, named, and, where names repeat, sorted by recursion on the
string of names; the whole array is induced from their order. Over small alphabets a bucket is
induced in NumPy blocks; over the long alphabets of the recursion, one by one.
"""

from __future__ import annotations

import numpy as np

#: From so many symbols a letter on, buckets are worth a NumPy block each.
PER_LETTER = 256


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Start positions of text's suffixes in order; symbols are 0 .. letters-1."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_blocks if n >= PER_LETTER * letters else _induce_each
    counts = np.bincount(text, minlength=letters)
    ends = np.cumsum(counts)
    if len(lms) > 1:
        rough = induce(text, smaller, lms, ends - counts, ends)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        in_order = rough[is_lms[rough]]
        new = ~_same_substrings(text, lms, in_order)
        if not new.all():
            names = np.empty(n, dtype=np.int64)
            names[in_order] = np.cumsum(new) - 1
            in_order = lms[suffix_array(names[lms], int(new.sum()))]
        lms = in_order
    return induce(text, smaller, lms, ends - counts, ends)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one never is."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    differs = np.append(text[1:] != text[:-1], True)
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    inner = at < n - 1
    out[inner] = text[at[inner]] < text[at[inner] + 1]
    return out


def _same_substrings(text: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring, in sorted order, equals the one before."""
    n = len(text)
    stop = np.empty(n, dtype=np.int64)
    stop[lms] = np.append(lms[1:] + 1, 2 * n + 1)  # the last one ends with the text, like no other
    size = stop[in_order] - in_order
    same = np.zeros(len(in_order), dtype=bool)
    same[1:] = size[1:] == size[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[in_order[live] + k] == text[in_order[live - 1] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[size[live] > k]
    return same


def _push(text: np.ndarray, array: np.ndarray, found: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Append positions, in order, to the open edge of their letters' buckets."""
    letter = text[found]
    order = np.argsort(letter, kind="stable")
    found, letter = found[order], letter[order]
    first = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
    many = np.diff(np.append(first, len(letter)))
    kinds = letter[first]
    rank = np.arange(len(letter)) - np.repeat(first, many)
    if step > 0:
        array[np.repeat(edge[kinds], many) + rank] = found
    else:
        array[np.repeat(edge[kinds], many) - 1 - rank] = found
    edge[kinds] += step * many


def _induce_blocks(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, letters = len(text), np.flatnonzero(ends > starts)
    array = np.full(n, -1, dtype=np.int64)
    seeds = ends.copy()
    if len(lms):
        _push(text, array, lms[::-1], seeds, -1)
    head = starts.copy()
    _push(text, array, np.array([n - 1]), head, 1)
    for c in letters:  # larger suffixes, from the left
        done = starts[c]
        while done < head[c]:
            block = array[done : head[c]] - 1
            done = head[c]
            block = block[block >= 0]
            block = block[~smaller[block]]
            if len(block):
                _push(text, array, block, head, 1)
        block = array[seeds[c] : ends[c]] - 1
        if len(block):  # a leftmost smaller suffix follows a larger one
            _push(text, array, block, head, 1)
    tail = ends.copy()
    for c in letters[::-1]:  # smaller suffixes, from the right
        done = ends[c]
        while done > tail[c]:
            block = array[tail[c] : done][::-1] - 1
            done = tail[c]
            block = block[block >= 0]
            block = block[smaller[block]]
            if len(block):
                _push(text, array, block, tail, -1)
        block = array[starts[c] : head[c]][::-1] - 1
        block = block[block >= 0]
        block = block[smaller[block]]
        if len(block):
            _push(text, array, block, tail, -1)
    return array


def _induce_each(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(text)
    letter, small = text.tolist(), smaller.tolist()
    array = [-1] * n
    edge = ends.tolist()
    for p in lms[::-1].tolist():
        c = letter[p]
        edge[c] -= 1
        array[edge[c]] = p
    edge = starts.tolist()
    c = letter[n - 1]
    array[edge[c]] = n - 1
    edge[c] += 1
    for p in array:
        if p > 0 and not small[p - 1]:
            c = letter[p - 1]
            array[edge[c]] = p - 1
            edge[c] += 1
    edge = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = array[i]
        if p > 0 and small[p - 1]:
            c = letter[p - 1]
            edge[c] -= 1
            array[edge[c]] = p - 1
    return np.array(array, dtype=np.int64)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, cap: int) -> np.ndarray:
    """In text order: bytes that a suffix shares with the one before it in the array, up to cap.

    text is uint8; eight bytes are compared at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), dtype="<u8", buffer=padded.data, strides=(1,))
    out = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, cap, 8):
        ends = n - np.maximum(live, before[live]) - k  # bytes that both still have
        live = live[ends > 0]
        ends = ends[ends > 0]
        differ = words[live + k] ^ words[before[live] + k]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8)
        same = np.minimum(same, ends)
        out[live] += same
        live = live[same == 8]
    return np.minimum(out, cap)
