"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow's own text buffers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; documents longer than that are cut between words and put together again.
SLICE = 1 << 20
_rng = np.random.default_rng(20240229)
_odd = lambda n: _rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = _odd(256)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE, _PLACE, _MIX = _odd(1)[0], _odd(16), _odd(2)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _hash_words(data: np.ndarray, first: np.ndarray):
    """Word hashes of ``data`` and where each begins; ``first`` marks the bytes at which documents begin."""
    word = ~_BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), at
    starts = np.flatnonzero(begins[at])
    sizes = np.diff(np.append(starts, len(at)))
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(_VALUE[data[at]] * powers[place], starts)
    return mix(sums + sizes.astype(np.uint64)), at[starts]


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long document, cut after blanks."""
    parts, a = [], 0
    while a < len(data):
        b = min(a + SLICE, len(data))
        while b < len(data):
            blanks = np.flatnonzero(_BLANK[data[a:b]])
            if len(blanks):
                b = a + int(blanks[-1]) + 1
                break
            b = min(b + SLICE, len(data))
        parts.append(_hash_words(data[a:b], np.zeros(b - a, bool))[0])
        a = b
    return np.concatenate(parts)


def groups(texts: pa.Array):
    """(first row, word hashes, words of each row) for runs of rows of about SLICE bytes; a null text has no words."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    valid = np.ones(n, bool) if not texts.null_count else texts.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(offsets), 0)
    row = 0
    while row < n:
        end, total = row, 0
        while end < n and (end == row or total + sizes[end] <= SLICE):
            total += sizes[end]
            end += 1
        lo, hi = offsets[row], offsets[end]
        if end == row + 1 and sizes[row] > SLICE:
            words = _long(data[lo:hi])
            counts = np.array([len(words)])
        else:
            first = np.zeros(hi - lo, bool)
            begin = offsets[row:end] - lo
            first[begin[begin < hi - lo]] = True
            words, at = _hash_words(data[lo:hi], first)
            own = np.searchsorted(offsets[row : end + 1], at + lo, "right") - 1
            keep = valid[row:end][own]
            words, counts = words[keep], np.bincount(own[keep], minlength=end - row)
        yield row, words, counts
        row = end


def distinct(words: np.ndarray, counts: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each document one after the other, and how many each has.

    A document with fewer than ``width`` words, but at least one, has its whole sequence as one shingle.
    """
    ends = np.cumsum(counts)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_ends = np.cumsum(sizes)
    if not len(words):
        return words, sizes
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = np.full(len(words), width, np.uint64)
    for k in range(width):
        h = mix(h + padded[k : k + len(words)] * _PLACE[k])
    own = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    h = h[place < sizes[own]]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        x = np.array([counts[d]], np.uint64)
        for k, at in enumerate(range(ends[d] - counts[d], ends[d])):
            x = mix(x + words[at : at + 1] * _PLACE[8 + k])
        h[out_ends[d] - 1] = x[0]
    for a, b in zip(out_ends - sizes, out_ends, strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(out_ends - sizes)[sizes > 0]] = True
    own = np.repeat(np.arange(len(counts)), sizes)
    return h[new], np.bincount(own[new], minlength=len(counts))


def sequence_key(text: str | None) -> bytes:
    """Digest of the lower-cased word sequence: documents with the same one have the same shingles."""
    words = (text or "").encode("utf-8").lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else b""
