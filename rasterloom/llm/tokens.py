"""Token ids of whole texts, from a library tokenizer that sees each distinct word once per worker.

Both vocabularies split a text before they apply merges, and a single space
between two other characters is always such a border. A text is therefore cut at
its spaces, each part is looked up in a bounded table, and only parts not met
before go to the library. Where a cut would not be safe (doubled or outer white
space, special strings) the whole text goes to the library.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from rasterloom.llm.words import BLANK, LOWER, distinct_keys, span_hashes, spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TABLE_ENTRIES = 500_000
# Ids in that table for each of its entries, on average; long parts have more, and fewer entries then.
ENTRY_IDS = 8


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


_LETTERS = _byte_letters()
# The patterns of the two vocabulary files, for texts below U+0250. White space is spelled out:
# that of the library lacks U+001C to U+001F, which a pattern's \s would include.
_WHITE = "\t-\r \x85\xa0"
_BYTE_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[0-9²³¹¼½¾]+| ?(?:[^{_WHITE}\w]|_)+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^{_WHITE}\w]|_)+")
_PLAIN = "ɐ"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|()")] = True
_NO_LEAD = np.uint64(0x5851F42D4C957F2D)


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII begins (fixed values of the character standard)."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    found |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[found]


def _gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pool's runs [start, start + count), one after another."""
    first = np.zeros(len(count), np.int64)
    np.cumsum(count[:-1], out=first[1:])
    return pool[np.arange(int(count.sum())) + np.repeat(start - first, count)]


class Encoder:
    """Ids of whole texts, equal to the library's, for many texts at once."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # a vocabulary with a normalizer lower-cases and drops white space, so all of it is a border
        self.words = self.library.normalizer is not None
        self.split = _WORD_SPLIT if self.words else _BYTE_SPLIT
        self.entries = entries
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _part(self, part: str, lead: str) -> list[int]:
        """Ids of a text without inner spaces that follows ``lead``."""
        if part.isascii() and part.isalpha():
            return [t.id for t in self.model.tokenize(part.lower() if self.words else _LETTERS[32] + part if lead else part)]
        if max(part) >= _PLAIN:
            return self.slow(part if self.words else lead + part)
        ids = []
        for piece in self.split.findall(part.lower() if self.words else lead + part):
            ids += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]
        return ids

    def _cut(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts parts further where the pattern always does: letter before a mark, line end before a letter."""
        cut = np.zeros(len(data) + 1, bool)
        letter = _LETTER[data]
        cut[1:-1] = letter[:-1] & _MARK[data[1:]]
        cut[2:-1] |= (letter | _MARK[data])[:-2] & (data[1:-1] == 10) & letter[2:]
        inner = np.flatnonzero(cut)
        owner = np.searchsorted(start, inner, side="right") - 1
        inner = inner[(owner >= 0) & (inner > start[owner]) & (inner < start[owner] + length[owner])]
        begins = np.sort(np.concatenate([start, inner]))
        ends = np.sort(np.concatenate([start + length, inner]))
        return begins, ends - begins

    def _unsafe(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts in which a space may not be a border."""
        n, at = len(offsets) - 1, []
        raw = data.tobytes()
        for special in self.special:
            where = raw.find(special)
            while where >= 0:
                at.append(where)
                where = raw.find(special, where + 1)
        at = [np.array(at, np.int64)]
        if not self.words:
            space = data == 32
            near = BLANK[data]
            first, last = offsets[:-1][offsets[1:] > offsets[:-1]], offsets[1:][offsets[1:] > offsets[:-1]] - 1
            wide = np.zeros(len(data) + 3, bool)
            begins = _wide_blanks(data)
            for step in range(3):
                wide[begins + step] = True
            near = near | wide[: len(data)]
            at += [np.flatnonzero(space[1:] & near[:-1]) + 1, np.flatnonzero(space[:-1] & near[1:])]
            at += [first[space[first]], last[space[last]]]
        else:
            at.append(_wide_blanks(data))
        out = np.zeros(n, bool)
        out[np.searchsorted(offsets[1:], np.concatenate(at), side="right")] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(self.hashes) > self.entries or len(self.pool) > ENTRY_IDS * self.entries:
            self._forget()
        unsafe = self._unsafe(data, offsets)
        seen = LOWER[data] if self.words else data
        start, length = self._cut(data, *spans(~BLANK[data] if self.words else data != 32, offsets))
        doc = np.searchsorted(offsets[1:], start, side="right")
        fine = ~unsafe[doc]
        start, length, doc = start[fine], length[fine], doc[fine]
        keys = span_hashes(seen, start, length)
        head = np.zeros(len(keys), bool)
        if not self.words and len(keys):
            head = (start == offsets[doc]) | (data[start - 1] != 32)
            keys[head] ^= _NO_LEAD
        distinct, sample, back = distinct_keys(keys)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            at = sample[fresh]
            fields = zip(start[at].tolist(), length[at].tolist(), head[at].tolist())
            ids = [self._part(raw[s : s + k].decode(), "" if h else " ") for s, k, h in fields]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            new = np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))
            begin = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, new])
            where = place[fresh]
            self.hashes = np.insert(self.hashes, where, distinct[fresh])
            self.start = np.insert(self.start, where, begin)
            self.count = np.insert(self.count, where, count)
            place = np.searchsorted(self.hashes, distinct)
        at, count = self.start[place][back], self.count[place][back]
        pool = self.pool
        if unsafe.any():
            raw, whole = data.tobytes(), np.flatnonzero(unsafe)
            ids = [self.slow(raw[offsets[d] : offsets[d + 1]].decode()) for d in whole]
            more = np.array([len(i) for i in ids], np.int64)
            at = np.concatenate([at, len(pool) + np.cumsum(more) - more])
            pool = np.concatenate([pool, np.array([x for i in ids for x in i], np.uint32)])
            count, doc = np.concatenate([count, more]), np.concatenate([doc, whole])
            order = np.argsort(doc, kind="stable")
            at, count, doc = at[order], count[order], doc[order]
        per_text = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        return _gather(pool, at, count), per_text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
