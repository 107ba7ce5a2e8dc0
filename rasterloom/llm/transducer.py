"""Token counts from a tokenizer compiled to finite-state transducers.

Two transducers follow one another. The first reads characters and emits the
borders at which the vocabulary's pattern splits a text; it has 13 states. A
slice of text is cut into chunks, each chunk's map from entry to exit state is
found for all chunks at once, the maps are composed by a parallel prefix scan,
and each chunk is then replayed from its true entry state.

The second reads the bytes of one split part. Its transitions carry the change
in the number of emitted tokens. A state stands for what later merges can still
depend on: for every start from which a vocabulary entry may yet grow, the entry
before that start and the tokens emitted since. States are compiled when first
met and forgotten together when there are too many.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import flat, slices
from rasterloom.llm.words import distinct_keys, span_hashes

CHUNK = 512
STATES = 200_000
PARTS = 2_000_000

# Character classes of the split pattern.
OTHER_LETTER, SHORT, R, V, L_, E, NUMBER, QUOTE, MARK, SPACE, BLANK = range(11)
# States: at a border, in letters, in numbers, in marks, after one or more blanks that end
# in a space, the same ending in another blank, after a quote that may begin a contraction,
# after its r, v or l. CLOSED is also the state at the beginning of a text.
CLOSED, LETTERS, NUMBERS, MARKS, SPACE1, SPACES, BLANK1, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # a border before this character; before the one that precedes it


def _opening(kind: int) -> int:
    """State after a character that begins a part."""
    if kind <= E:
        return LETTERS
    return {NUMBER: NUMBERS, QUOTE: QUOTED, MARK: MARKS, SPACE: SPACE1, BLANK: BLANK1}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and borders for one character."""
    letter, blank = kind <= E, kind in (SPACE, BLANK)
    if state == LETTERS and letter or state == NUMBERS and kind == NUMBER or state == MARKS and kind in (QUOTE, MARK):
        return state, 0
    if state in (SPACE1, SPACES, BLANK1, BLANKS):
        if blank:
            return (SPACES if kind == SPACE else BLANKS), 0
        if state in (SPACE1, SPACES):
            # a space before something else belongs to it, and no quote after it is a contraction
            after = MARKS if kind in (QUOTE, MARK) else _opening(kind)
            return after, BEFORE if state == SPACES else 0
        return _opening(kind), HERE | (BEFORE if state == BLANKS else 0)
    if state == QUOTED:
        if kind in (SHORT, R, V, L_):
            return {SHORT: CLOSED, R: QUOTED_R, V: QUOTED_V, L_: QUOTED_L}[kind], 0
        return (MARKS, 0) if kind in (QUOTE, MARK) else (_opening(kind), HERE)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L_ if state == QUOTED_L else E):
            return CLOSED, 0
        return (LETTERS, BEFORE) if letter else (_opening(kind), BEFORE | HERE)
    return _opening(kind), HERE


def border_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and borders for (class, state); classes from 11 on are the same at the start of a text."""
    nexts = np.zeros((22, N_STATES), np.uint8)
    emits = np.zeros((22, N_STATES), np.uint8)
    for kind in range(11):
        for state in range(N_STATES):
            nexts[kind, state], emits[kind, state] = _step(state, kind)
            nexts[kind + 11, state], emits[kind + 11, state] = _opening(kind), HERE
    return nexts, emits


def character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, MARK, np.uint8)
    for point in range(0x110000):
        group = unicodedata.category(chr(point))[0]
        if group == "L":
            out[point] = OTHER_LETTER
        elif group == "N":
            out[point] = NUMBER
    # white space of the character standard (fixed values)
    out[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[0x20] = SPACE
    out[0x27] = QUOTE
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", L_), ("e", E)):
        out[[ord(c) for c in letters]] = kind
    return out


class Borders:
    """The first transducer, run over many chunks at once."""

    def __init__(self, chunk: int = CHUNK):
        self.nexts, self.emits = border_tables()
        self.classes = character_classes()
        self.chunk = chunk

    def entries(self, grid: np.ndarray) -> np.ndarray:
        """The state in which each chunk (row) is entered."""
        rows, width = grid.shape
        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
        open_ = np.arange(rows)
        t = 0
        # chunks whose map still depends on the entry state; most settle within a few characters
        while len(open_) and t < width:
            maps[open_] = self.nexts[grid[open_, t][:, None], maps[open_]]
            t += 1
            if t % 4 == 0 or t == width:
                settled = (maps[open_] == maps[open_][:, :1]).all(axis=1)
                done = open_[settled]
                if len(done):
                    state = maps[done, 0]
                    for u in range(t, width):
                        state = self.nexts[grid[done, u], state]
                    maps[done] = state[:, None]
                    open_ = open_[~settled]
        # inclusive prefix scan of function composition
        reach = 1
        while reach < rows:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
            reach *= 2
        out = np.empty(rows, np.uint8)
        out[0] = CLOSED
        out[1:] = maps[:-1, CLOSED]
        return out

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks the characters that begin a part. ``first``: indexes at which texts begin."""
        n = len(points)
        kinds = self.classes[points]
        kinds[first] += 11
        rows = -(-n // self.chunk)
        grid = np.full(rows * self.chunk, MARK + 11, np.uint8)
        grid[:n] = kinds
        grid = grid.reshape(rows, self.chunk)
        columns = np.ascontiguousarray(grid.T)
        state = self.entries(grid)
        emitted = np.empty((self.chunk, rows), np.uint8)
        states = np.empty((self.chunk, rows), np.uint8)
        for t in range(self.chunk):
            emitted[t] = self.emits[columns[t], state]
            state = self.nexts[columns[t], state]
            states[t] = state
        emitted = emitted.T.reshape(-1)[:n]
        out = (emitted & HERE) > 0
        out[:-1] |= (emitted[1:] & BEFORE) > 0
        # a text that ends inside a contraction has no contraction
        last = np.append(first[1:], n) - 1
        ends = states.T.reshape(-1)[:n][last]
        out[last[(ends >= QUOTED_R) & (ends <= QUOTED_L)]] = True
        return out


class TokenCounter:
    """The second transducer, compiled from a byte-level merge vocabulary."""

    def __init__(self, library):
        self.model = library.model
        special = {t.content for t in library.get_added_tokens_decoder().values()}
        vocabulary = {k: v for k, v in library.get_vocab().items() if k not in special}
        letters = byte_letters()
        back = {ord(c): b for b, c in letters.items()}
        self.letters = letters
        self.spelled = {v: k for k, v in vocabulary.items()}
        self.children: list[dict[int, int]] = [{}]
        self.entry: list[int] = [-1]
        for spelled, number in vocabulary.items():
            node = 0
            for c in spelled:
                b = back[ord(c)]
                node_next = self.children[node].get(b)
                if node_next is None:
                    node_next = len(self.children)
                    self.children[node][b] = node_next
                    self.children.append({})
                    self.entry.append(-1)
                node = node_next
            self.entry[node] = number
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.keys: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        state = self.keys.get(key)
        if state is None:
            state = self.keys[key] = len(self.live)
            self.live.append(key)
            self.moves.append({})
        return state

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave the two entries as they are, side by side."""
        found = self.follows.get((left, right))
        if found is None:
            text = (self.spelled[left] if left >= 0 else "") + self.spelled[right]
            ids = [t.id for t in self.model.tokenize(text)]
            found = ids == ([left, right] if left >= 0 else [right])
            if len(self.follows) > 4 * STATES:
                self.follows.clear()
            self.follows[left, right] = found
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, token, change = [], -1, 0
        for node, left, since in self.live[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            grown.append((child, left, since))
            entry = self.entry[child]
            if entry >= 0 and token < 0 and self._may_follow(left, entry):
                token, change = entry, 1 - since
        if token < 0:
            raise ValueError("the vocabulary has no entry for a byte")
        live = [(node, left, since + change) for node, left, since in grown if self.children[node]]
        move = self._state((*live, (0, token, 0))), change
        self.moves[state][byte] = move
        return move

    def count(self, part: bytes) -> int:
        """Tokens of one split part."""
        state = total = 0
        for byte in part:
            move = self.moves[state].get(byte)
            if move is None:
                move = self._compile(state, byte)
            state = move[0]
            total += move[1]
        if len(self.live) > STATES:
            self.reset()
        return total


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: itself where printable, else the next code point from 256."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class Counter:
    """Token counts of many whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
        self.borders = Borders()
        self.tokens = TokenCounter(library)
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def _segments(self, data: np.ndarray, offsets: np.ndarray):
        """Texts without their special strings: bytes, offsets, owner of each segment, special strings per text."""
        raw, found, at = data.tobytes(), [], 0
        where = {s: raw.find(s) for s in self.special}
        while True:
            here = min(((w, s) for s, w in where.items() if w >= 0), default=None)
            if here is None:
                break
            begin, text = here
            end = begin + len(text)
            doc = int(np.searchsorted(offsets, begin, side="right")) - 1
            if end <= offsets[doc + 1]:
                found.append((begin, end, doc))
                at = end
            else:  # runs over into the next text
                at = begin + 1
            for s in self.special:
                if 0 <= where[s] < at:
                    where[s] = raw.find(s, at)
        n = len(offsets) - 1
        if not found:
            return data, offsets, np.arange(n), np.zeros(n, np.int64)
        spans = np.array(found)
        keep = np.ones(len(data), bool)
        for begin, end, _ in found:
            keep[begin:end] = False
        left = np.concatenate([[0], np.cumsum(keep)])
        cuts = np.sort(np.concatenate([left[offsets], left[spans[:, 0]]]), kind="stable")
        places = np.sort(np.concatenate([offsets, spans[:, 1]]), kind="stable")
        owner = np.searchsorted(offsets, places[:-1], side="right") - 1
        return data[keep], cuts, owner, np.bincount(spans[:, 2], minlength=n)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        data, cuts, owner, total = self._segments(data, offsets)
        total = total.astype(np.int64)
        if not len(data):
            return total
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        some = cuts[1:] > cuts[:-1]
        first = np.searchsorted(begins, cuts[:-1][some])
        start = begins[self.borders.starts(points, first)]
        length = np.diff(np.append(start, len(data)))
        keys, sample, back = distinct_keys(span_hashes(data, start, length))
        if len(self.hashes) > PARTS:
            self.hashes, self.counts = self.hashes[:0], self.counts[:0]
        place = np.searchsorted(self.hashes, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == keys[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw, at = data.tobytes(), sample[fresh]
            count = self.tokens.count
            new = [count(raw[s : s + k]) for s, k in zip(start[at].tolist(), length[at].tolist())]
            self.counts = np.insert(self.counts, place[fresh], new)
            self.hashes = np.insert(self.hashes, place[fresh], keys[fresh])
            place = np.searchsorted(self.hashes, keys)
        per_part = self.counts[place][back]
        text = owner[np.searchsorted(cuts, start, side="right") - 1]
        return total + np.bincount(text, weights=per_part, minlength=n).astype(np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's compiled transducers for a vocabulary, kept between tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``, without a shuffle.

    Null and empty texts have no bytes and no tokens. Special strings inside a
    text count as one token each. Other columns are ignored.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(vocabulary)
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            tokens = made.count(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return picked.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
