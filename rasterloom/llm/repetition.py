"""Quality rules by suffix-array repetition.

Each text gets a suffix array over its words (prefix doubling, all texts of a
slice at once) with longest common prefixes. The deepest LCP interval that holds
a suffix gives the longest repeated string starting there; the union of those
spans is what the text repeats. A text is rejected when repeats of at least
``min_words`` words cover too large a share, or the longest one is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import PART_BYTES, flat, slices
from rasterloom.llm.words import BLANK, lines_of, span_hashes, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Production limits of the suffix-array rule."""

    min_words: int = 5
    max_covered: float = 0.5
    max_longest: int = 100


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; the last level orders them fully.

    Suffixes end with their text and texts are ranked one after another, so two
    texts never share a rank. Only suffixes still tied are sorted again.
    """
    n = len(symbols)
    _, codes = np.unique(symbols, return_inverse=True)
    key = doc.astype(np.int64) * (int(codes.max()) + 1 if n else 1) + codes
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = at
    levels, step = [rank], 1
    tied = _tied(order, head)
    while len(tied):
        ahead = tied + step
        inside = ahead < n
        ahead[~inside] = 0
        inside &= doc[ahead] == doc[tied]
        second = np.where(inside, rank[ahead] + 1, 0)
        first = rank[tied]
        key = first * (n + 2) + second
        order = np.argsort(key, kind="stable")
        tied, key, first = tied[order], key[order], first[order]
        place = np.arange(len(tied))
        group = np.ones(len(tied), bool)
        group[1:] = first[1:] != first[:-1]
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]
        base = np.maximum.accumulate(np.where(group, place, 0))
        at = np.maximum.accumulate(np.where(head, place, 0))
        rank = rank.copy()
        rank[tied] = first + at - base
        levels.append(rank)
        step *= 2
        tied = _tied(tied, head)
    return levels


def _tied(members: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Members of groups of two or more; ``head`` marks the first of each group."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return members[~alone]


def longest_repeats(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that starts there and elsewhere in its text."""
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    levels = suffix_ranks(symbols, doc)
    suffix = np.empty(n, np.int64)
    suffix[levels[-1]] = np.arange(n)
    left, right = suffix[:-1], suffix[1:]
    open_ = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[open_], right[open_]
    # the greatest level on which both agree, then the rest from the levels below it
    lcp = np.zeros(len(a), np.int64)
    end = np.searchsorted(doc, doc[a], side="right") if len(a) else a
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        fits = (i < end) & (j < end)
        same = np.zeros(len(a), bool)
        same[fits] = levels[level][i[fits]] == levels[level][j[fits]]
        lcp[same] += 1 << level
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Marks the positions in the union of repeated spans of at least ``least`` symbols."""
    change = np.zeros(len(best) + 1, np.int64)
    starts = np.flatnonzero(best >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + best[starts], -1)
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and verdicts for each text of a slice."""
    n = len(offsets) - 1
    found = words_of(data, offsets)

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[offsets[1:]] - total[offsets[:-1]]

    ink = ~BLANK[data]
    best = longest_repeats(found.hash, found.doc)
    start, length, line_doc = lines_of(data, offsets)
    inked = np.concatenate(([0], np.cumsum(ink)))
    some = inked[start + length] > inked[start]
    start, length, line_doc = start[some], length[some], line_doc[some]
    lines = np.stack([line_doc.astype(np.uint64), span_hashes(data, start, length)], axis=1)
    order = np.lexsort((lines[:, 1], lines[:, 0]))
    lines = lines[order]
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[1:] == lines[:-1]).all(axis=1)
    repeat = np.bincount(found.doc, weights=covered(best, WINDOW), minlength=n).astype(np.int64)
    share = np.bincount(found.doc, weights=covered(best, rules.min_words), minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, found.doc, best)
    words = found.per_doc.astype(np.int64)
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * words)
    fraction = share / np.maximum(words, 1)
    fine = (fraction <= rules.max_covered) & (longest <= rules.max_longest)
    return {
        "n_words": words,
        "word_chars": per_text(ink & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(lines[:, 0].astype(np.int64)[again], minlength=n).astype(np.int64),
        "n_repeat_words": repeat,
        "covered_fraction": fraction,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & fine,
    }


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_fraction double, longest_repeat long, base_failed boolean, kept boolean"
)


def repetition_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts, repeated share, longest repeat (both in words) and verdict.

    Null and empty texts have no words and fail the base rule. Repeated rows are
    judged one by one. Other columns are ignored. Every text is judged whole and
    alone, without a shuffle.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PART_BYTES):
            values = measure(*flat(batch.column("text")), rules)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v) for v in values.values()]], ["doc_id", *values]
            )

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(judge, f"doc_id {id_type}, {SCHEMA}")
