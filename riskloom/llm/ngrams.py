"""Hashed character n-grams and words of many texts at once, in numpy.

Texts go through in blocks of bounded size.  A text longer than a block is cut
into parts that overlap by less than a gram, so that every gram of the whole
text is seen once and memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters in one block of work.
BLOCK = 1 << 19
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)
_BASE = 0x9E3779B97F4A7C15


def blocks(texts: list[str], overlap: int, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, start of each part, number of each part's text); parts are not empty."""
    points, starts, owners, held = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), size):
            part = np.frombuffer(text[at: at + size + overlap].encode("utf-32-le", "replace"), np.uint32)
            if not len(part):
                continue
            points.append(part)
            starts.append(held)
            owners.append(k)
            held += len(part)
            if held >= size:
                yield np.concatenate(points), np.array(starts), np.array(owners)
                points, starts, owners, held = [], [], [], 0
    if points:
        yield np.concatenate(points), np.array(starts), np.array(owners)


def char_grams(points: np.ndarray, starts: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram at every position; 2**bits where it would leave its part."""
    hashed = np.full(len(points), np.uint32(n * 40503), np.uint32)
    for k in range(n):
        hashed[: len(points) - k] += points[k:] * _MIX[k]
        if k + 1 < n:
            hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x85EBCA6B)
    out = (hashed >> np.uint32(32 - bits)).astype(np.int32)
    for k in range(1, n):
        ends = np.append(starts[1:], len(points)) - k
        out[ends[ends >= starts]] = 1 << bits
    return out


def subwords(text: str, orders: tuple[int, ...], bits: int, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Buckets of the words of a text and of the n-grams of each word with a
    mark at either end, in bounded blocks; words part at ASCII white space.
    Every word that repeats the one before adds the bucket 2**bits."""
    for part in _parts(text, size):
        points = np.frombuffer((" " + part + " ").encode("utf-32-le", "replace"), np.uint32)
        space = (points - np.uint32(9) < 5) | (points == 32)
        points = np.where(space, np.uint32(32), points)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = edge[0::2], edge[1::2]
        if not len(first):
            continue
        power = _powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points.astype(np.uint64) * power, out=sums[1:])
        whole = (sums[last] - sums[first]) * _inverse(len(points))[first]
        yield np.full(np.count_nonzero(whole[1:] == whole[:-1]), 1 << bits, np.int64)
        whole ^= whole >> np.uint64(29)
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        yield (whole >> np.uint64(64 - bits)).astype(np.int64)
        for n in orders:
            if len(points) < n:
                continue
            inner = np.zeros(len(points) - n + 1, bool)
            for k in range(1, n - 1):
                inner |= space[k: len(points) - n + 1 + k]
            inner |= space[: len(inner)] & space[n - 1:]
            buckets = char_grams(points, np.array([0]), n, bits)[: len(inner)]
            yield buckets[~inner].astype(np.int64)


def _parts(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters that end at white space if there is any near."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


_CACHE: dict[str, np.ndarray] = {}


def _series(name: str, base: int, n: int) -> np.ndarray:
    found = _CACHE.get(name)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        steps[0] = 1
        found = _CACHE[name] = np.multiply.accumulate(steps)
    return found[:n]


def _powers(n: int) -> np.ndarray:
    return _series("power", _BASE, n)


def _inverse(n: int) -> np.ndarray:
    return _series("inverse", pow(_BASE, -1, 1 << 64), n)
