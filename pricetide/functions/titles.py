"""Comparing many titles with many: no pair that can be similar enough is left out, and few others are compared in full.

The ratio of two titles is twice the characters of their matching blocks over the characters of both. Matching blocks are a
common subsequence, so the ratio is at most that of the longest common subsequence, which is at most that of the characters
that the titles share in any order. Both bounds are worked out for whole blocks of titles with numpy.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Pairs whose bounds are worked out at once, about.
PAIRS = 1 << 20
_slack = 1e-9


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in titles], np.int64)
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), sizes


class Titles:
    """A block of titles: sizes, and how often each of the characters of two blocks stands in each."""

    def __init__(self, titles: list[str], alphabet: np.ndarray):
        self.titles = titles
        codes, self.sizes = _codes(titles)
        self.place = np.searchsorted(alphabet, codes)
        self.own = np.repeat(np.arange(len(titles)), self.sizes)
        self.at = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        counts = np.bincount(self.own * len(alphabet) + self.place, minlength=len(titles) * len(alphabet)).reshape(len(titles), -1)
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))

    def matrix(self, blank: int) -> np.ndarray:
        """The characters of each title in a row, filled up with ``blank``."""
        out = np.full((len(self.titles), int(self.sizes.max(initial=0))), blank, np.int32)
        out[self.own, self.at] = self.place
        return out

    def masks(self, width: int) -> np.ndarray:
        """For each title of at most 64 characters and each character, the bits of the places where it stands."""
        out = np.zeros((len(self.titles), width), np.uint64)
        fits = self.sizes[self.own] <= 64
        np.bitwise_or.at(out, (self.own[fits], self.place[fits]), np.uint64(1) << self.at[fits].astype(np.uint64))
        return out


def shared_characters(left: Titles, right: Titles, rows: slice) -> np.ndarray:
    """How many characters each pair of titles has in common, in any order."""
    a, b = left.counts[rows], right.counts
    total = np.zeros((len(a), len(b)), np.int32)
    for c in np.flatnonzero(a.any(0) & b.any(0)):
        total += np.minimum(a[:, c, None], b[None, :, c])
    return total


def common_subsequences(masks: np.ndarray, sizes: np.ndarray, i: np.ndarray, matrix: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair (i, j), bit by bit: 64 characters of i at most."""
    state = np.full(len(i), ~np.uint64(0))
    for column in range(matrix.shape[1]):
        hit = state & masks[i, matrix[j, column]]
        state = (state + hit) | (state - hit)
    low = np.where(sizes[i] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(sizes[i], 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & low).astype(np.int64)


def candidates(left: list[str], right: list[str], least: float):
    """(i, j, bound) of all pairs of titles whose bound on the ratio is ``least`` or more."""
    alphabet = np.unique(np.concatenate([_codes(left)[0], _codes(right)[0]]))
    a, b = Titles(left, alphabet), Titles(right, alphabet)
    masks, matrix = np.pad(a.masks(len(alphabet)), ((0, 0), (0, 1))), b.matrix(len(alphabet))
    step, found = max(1, PAIRS // max(1, len(right))), []
    for start in range(0, len(left), step):
        rows = slice(start, start + step)
        both = a.sizes[rows, None] + b.sizes[None, :]
        i, j = np.nonzero(2.0 * shared_characters(a, b, rows) >= (least - _slack) * both)
        bound = np.full(len(i), 2.0)
        i = i + start
        short = np.flatnonzero(a.sizes[i] <= 64)
        for part in np.array_split(short, -(-len(short) // 65_536) or 1):
            bound[part] = 2.0 * common_subsequences(masks, a.sizes, i[part], matrix, j[part]) / (a.sizes[i[part]] + b.sizes[j[part]])
        keep = bound >= least - _slack
        found.append((i[keep], j[keep], bound[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best_partners(left: list[str], right: list[str], ids: list, least: float) -> list[tuple[int, float, object]]:
    """(i, ratio, id) of the most similar title of ``right`` for each of ``left`` that has one of ``least``; ties to the smaller id."""
    i, j, bound = candidates(left, right, least)
    best: dict[int, tuple[float, object]] = {}
    for k in np.lexsort((-bound, i)).tolist():
        row, other = int(i[k]), int(j[k])
        old = best.get(row)
        if old is not None and bound[k] < old[0] - _slack:
            continue
        a, b = left[row], right[other]
        ratio = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
        if ratio >= least and (old is None or (-ratio, ids[other]) < (-old[0], old[1])):
            best[row] = (ratio, ids[other])
    return [(row, *x) for row, x in best.items()]
