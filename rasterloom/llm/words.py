"""Words, lines and their hashes for many texts at once, on flat byte arrays.

Words are runs of bytes other than space and 0x09-0x0D. Hashes are 64 bits of a
position-keyed sum, so two different words agree with a chance of about 2^-60.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_keys = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def position_keys(n: int) -> np.ndarray:
    """At least ``n`` fixed odd 64-bit multipliers."""
    global _keys
    if len(_keys) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        _keys = mix(np.arange(1, size + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    return _keys


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans must not be empty or overlap and come in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    inside = np.arange(int(lengths.sum()), dtype=np.int64)
    inside -= np.repeat(first, lengths)
    where = inside + np.repeat(starts, lengths)
    terms = position_keys(int(lengths.max()))[inside]
    terms *= data[where].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _GOLD)


@dataclass
class Words:
    """Words of several texts in order: where each starts, how long it is, and its text's number."""

    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray  # number of words of each text
    hash: np.ndarray


def spans(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true marks, cut at text borders."""
    if not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = marks.copy(), marks.copy()
    begin[1:] &= ~marks[:-1]
    end[:-1] &= ~marks[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    some = last >= first
    begin[first[some]] = marks[first[some]]
    end[last[some]] = marks[last[some]]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1 - starts


def words_of(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    starts, lengths = spans(~BLANK[data], offsets)
    doc = np.searchsorted(offsets[1:], starts, side="right")
    return Words(
        starts,
        lengths,
        doc,
        np.bincount(doc, minlength=len(offsets) - 1),
        span_hashes(data, starts, lengths) if hashed else np.zeros(0, np.uint64),
    )


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and text numbers of the non-empty lines (split at \\n)."""
    starts, lengths = spans(data != 10, offsets)
    return starts, lengths, np.searchsorted(offsets[1:], starts, side="right")


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where one of each is, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(head) - 1
    return ordered[head], order[head], back
