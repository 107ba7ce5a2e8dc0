"""Removal of long repeated substrings by deep-shallow sorting of anchored suffixes.

Any string of ``length`` bytes that occurs twice holds the same anchor both
times: the ``gram``-byte string in it with the least hash, the first of equals.
So only one suffix per anchor is looked at, about one in ninety bytes. The
strings that share an anchor form a stretch of text; stretches with equal bytes
are counted by hash, which settles all but those at the borders of a repeat.

What is left is grouped by anchor and sorted deep-shallow: the text after the
anchor, and the text before it read backwards, are ordered by multikey quicksort
(eight bytes a step, only ties go on) to a shallow depth; groups that still
agree go into blind tries, which compare one string with one other. Neighbours'
common prefixes then tell how far any two stretches agree on either side. An
anchor with very many different stretches is first split by the hashes of its
single strings, so no group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import flat, join_groups, slices, stored
from rasterloom.llm.words import mix

LENGTH = 200
GRAM = 24
SHALLOW = 32
# Different stretches of one anchor that are sorted together; more are split by string hash.
TOGETHER = 50_000
# Up to so many of them are compared through all pairs of common prefixes, more through classes by depth.
PAIRWISE = 64
# Bytes of a single text looked at together, and stretches sorted together.
CHUNK = 4 << 20
BLOCK = 20_000

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 24) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values, by doubling."""
    out, have, block, size = None, 0, values, 1
    while True:
        if width & size:
            if out is None:
                out, have = block, size
            else:
                n = len(values) - have - size + 1
                out, have = out[:n] * _power(size) + block[have : have + n], have + size
        if have == width:
            return out
        n = len(block) - size
        block = block[:n] * _power(size) + block[size : size + n]
        size *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - size :])


class Prefixes:
    """Hashes of any substring of a flat byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, _BASE, np.uint64)
        back = np.full(n + 1, _INVERSE, np.uint64)
        power[0] = back[0] = 1
        power = np.multiply.accumulate(power)
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The stretches of strings with one anchor, for all texts of a slice.

    row: text; key: hash of the anchor; print: hash of all bytes and the anchor's
    place; at: start in the text << 16 | number of strings << 8 | anchor's place.
    """
    empty = {"row": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "print": np.zeros(0, np.int64), "at": np.zeros(0, np.int64)}
    if len(data) < length:
        return empty
    change = np.zeros(len(data) + 1, np.int8)
    long_ = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(change, offsets[:-1][long_], 1)
    np.add.at(change, offsets[1:][long_] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[: len(data) - length + 1]))
    if not len(starts):
        return empty
    grams = mix(_rolling(_BYTE[data], gram))
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(packed, length - gram + 1)[starts] & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets[1:], starts, side="right")
    head = np.ones(len(starts), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(starts)))
    begin, anchor, row = starts[first], anchor[first], row[first]
    place = anchor - begin
    prints = Prefixes(data).of(begin, begin + count - 1 + length)
    return {
        "row": row,
        "key": grams[anchor].view(np.int64),
        "print": mix(prints + place.astype(np.uint64)).view(np.int64),
        "at": ((begin - offsets[row]) << 16) | (count << 8) | place,
    }


# What tells a row's text from others: its doc_id (0 for null) and a hash of its text. Rows equal in
# both are copies of each other.
_ROW = ("doc_id", "mark")


def _listed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, mark, key, print, at) of every stretch of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
            at = pa.array(found["row"])
            return pa.RecordBatch.from_arrays(
                [*[rows.column(c).take(at) for c in _ROW], *[pa.array(found[c]) for c in ("key", "print", "at")]],
                [*_ROW, "key", "print", "at"],
            )

        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            if batch.num_rows > 1 or len(data) <= CHUNK:
                yield out(batch, stretches(data, offsets, length, gram))
                continue
            for start in range(0, len(data), CHUNK):  # a very long text, in parts that share length - 1 bytes
                part = data[start : start + CHUNK + length - 1]
                found = stretches(part, np.array([0, len(part)]), length, gram)
                found["at"] += start << 16
                yield out(batch, found)

    return docs.mapInArrow(find, "doc_id long, mark long, key long, print long, at long")


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def blind_trie(strings: list[bytes], known: int) -> tuple[list[int], list[int]]:
    """Order of strings that agree on ``known`` bytes, and each one's common prefix with the one before it.

    Inner nodes hold only a depth and the next bytes. A string goes down by those
    bytes alone, is compared with the leaf it reaches, and is put in at the depth
    at which the two part. A string that ends goes before those that go on.
    """
    # node: [depth, {byte or -1: node}]; leaf: [-1, [string numbers]]
    root: list = [-1, [0]]
    for number in range(1, len(strings)):
        text, node = strings[number], root
        while node[0] >= 0:
            branch = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(branch) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        shared = _common(text, other, known)
        if shared == len(text) == len(other):
            node[1].append(number)
            continue
        above, node = None, root
        while 0 <= node[0] < shared:
            above, node = node, node[1][text[node[0]]]
        mine = text[shared] if shared < len(text) else -1
        if node[0] == shared:
            node[1][mine] = [-1, [number]]
            continue
        theirs = other[shared] if shared < len(other) else -1
        split = [shared, {theirs: node, mine: [-1, [number]]}]
        if above is None:
            root = split
        else:
            above[1][text[above[0]]] = split
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list, int]] = [(root, known)]
    while stack:
        node, shared = stack.pop()
        if node[0] < 0:
            for place, number in enumerate(node[1]):
                order.append(number)
                lcp.append(len(strings[number]) if place else shared)
            continue
        for place, branch in enumerate(sorted(node[1], reverse=True)):
            last = place == len(node[1]) - 1
            stack.append((node[1][branch], shared if last else node[0]))
    return order, lcp


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings inside their (sorted) groups, and each one's common prefix with the one before it."""
    n = len(strings)
    length = np.fromiter(map(len, strings), np.int64, n)
    raw = b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings)
    grid = np.frombuffer(raw, np.uint8).reshape(n, shallow)
    words = grid.view(">u8").astype(np.uint64)
    order = np.arange(n)
    tie = np.zeros(n, bool)  # whether a place is in the same class as the one before it
    tie[1:] = group[1:] == group[:-1]
    for column in [*words.T, length.astype(np.uint64)]:
        inside = tie.copy()
        inside[:-1] |= tie[1:]
        places = np.flatnonzero(inside)
        if not len(places):
            break
        classes = np.cumsum(~tie)[places]
        value = column[order[places]]
        sort = np.lexsort((value, classes))
        order[places] = order[places][sort]
        value = value[sort]
        fresh = np.zeros(len(places), bool)
        fresh[1:] = (value[1:] != value[:-1]) & (places[1:] == places[:-1] + 1)
        if column is not length:
            tie[places[fresh]] = False
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return order, lcp
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    differ = grid[a] != grid[b]
    equal = ~differ.any(axis=1)
    depth = np.where(equal, shallow, differ.argmax(axis=1))
    lcp[1:] = np.where(same, np.minimum(depth, np.minimum(length[a], length[b])), 0)
    # deep groups: equal on all shallow bytes, with bytes left to compare
    deep = np.zeros(n, bool)
    deep[1:] = same & equal & (length[a] > shallow) & (length[b] > shallow)
    begins = np.flatnonzero(deep & ~np.append(False, deep[:-1])) - 1
    ends = np.flatnonzero(deep & ~np.append(deep[1:], False)) + 1
    for begin, end in zip(begins.tolist(), ends.tolist()):
        members = order[begin:end]
        inner, common = blind_trie([strings[m] for m in members], shallow)
        order[begin:end] = members[inner]
        lcp[begin + 1 : end] = common[1:]
    return order, lcp


def _agreement(order: np.ndarray, lcp: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """[group, i, j]: common prefix of members i and j, for groups of ``size`` beginning at ``starts``."""
    rows = starts[:, None] + np.arange(size)
    local = order[rows] - starts[:, None]
    steps = lcp[rows]
    sorted_ = np.zeros((len(starts), size, size), np.int64)
    for i in range(size - 1):
        least = np.minimum.accumulate(steps[:, i + 1 :], axis=1)
        sorted_[:, i, i + 1 :] = least
        sorted_[:, i + 1 :, i] = least
    rank = np.argsort(local, axis=1)
    return sorted_[np.arange(len(starts))[:, None, None], rank[:, :, None], rank[:, None, :]]


def _mark_by_depth(
    marks: np.ndarray, sides: list, place: np.ndarray, count: np.ndarray, rows: slice, length: int
) -> None:
    """Marks the shared strings of one large group: for every number of bytes before the anchor, members that
    fall into one class on both sides. A class is a run of sorted members whose common prefixes are long enough."""
    size = rows.stop - rows.start
    places = [(order[rows] - rows.start, lcp[rows]) for order, lcp in sides]
    low, high = (place - count + 1)[rows], place[rows]
    for before in range(length + 1):
        valid = np.flatnonzero((low <= before) & (before <= high))
        if len(valid) < 2:
            continue
        classes = []
        for (order, lcp), depth in zip(places, (before, length - before)):
            fresh = lcp < depth
            fresh[0] = True
            of = np.empty(size, np.int64)
            of[order] = np.cumsum(fresh)
            classes.append(of[valid])
        _, back, n = np.unique(classes[0] * (size + 1) + classes[1], return_inverse=True, return_counts=True)
        shared = valid[n[back] > 1] + rows.start
        marks[shared, before] += 1
        marks[shared, before + 1] -= 1


def repeated(
    keys: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (stretch number, start, end in its text) of the strings that two stretches of one anchor share.

    ``keys`` come sorted; left texts are reversed.
    """
    n = len(keys)
    begin, count, place = at >> 16, (at >> 8) & 0xFF, at & 0xFF
    fresh = np.ones(n, bool)
    fresh[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(fresh)
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    sides = [deep_shallow(s, group) for s in (left, right)]
    marks = np.zeros((n, length + 2), np.int32)
    for start, size in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        _mark_by_depth(marks, sides, place, count, slice(start, start + size), length)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRWISE)]).tolist():
        chosen = starts[sizes == size]
        for chunk in range(0, len(chosen), max(1, 2_000_000 // (size * size))):
            some = chosen[chunk : chunk + max(1, 2_000_000 // (size * size))]
            before, after = (_agreement(*side, some, size) for side in sides)
            member = np.broadcast_to((some[:, None] + np.arange(size))[:, :, None], before.shape)
            # how many bytes a shared string takes before the anchor
            low = np.maximum(length - after, (place - count + 1)[member])
            high = np.minimum(before, place[member])
            fine = (low <= high) & ~np.eye(size, dtype=bool)
            np.add.at(marks, (member[fine], low[fine]), 1)
            np.add.at(marks, (member[fine], high[fine] + 1), -1)
    on = np.cumsum(marks, axis=1) > 0
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), on.astype(np.int8)], axis=1), axis=1)
    who, first = np.nonzero(edge == 1)
    _, after_last = np.nonzero(edge == -1)
    anchor = (begin + place)[who]
    return who, anchor - after_last + 1, anchor - first + length


def repeated_substrings(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept_text (binary).

    A byte is removed when a string of ``length`` bytes around it also starts
    anywhere else; matches stay inside documents. Null and empty texts have
    nothing to remove. A doc_id may be null or occur several times, with any
    texts: rows are told apart by doc_id and text, and equal rows are copies of
    each other, so all that they share goes. Other columns are ignored.
    """
    if not gram < length <= 255:
        raise ValueError("strings are longer than the anchor and at most 255 bytes")
    name = F.col(doc_id).cast("long")
    docs = docs.select(
        name.alias("_name"),
        F.coalesce(name, F.lit(0)).alias("doc_id"),
        F.xxhash64(name.isNull(), F.col(text)).alias("mark"),
        F.col(text).alias("text"),
    )
    # listed anew for each use: storing all stretches would take half as much disk as the input
    found = _listed(docs, length, gram)
    keys = stored(found.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "repeat-keys")
    total = keys.agg(F.sum("c")).first()[0] or 0
    shared = stored(join_groups(found, keys, ["key"], "c", total).drop("c"), "repeat-shared")
    variants = stored(
        shared.groupBy("key", "print").agg(F.count("*").alias("m"), F.min(F.struct(*_ROW, "at")).alias("one")),
        "repeat-variants",
    )
    copies = join_groups(shared, variants.filter("m > 1").select("key", "print", "m"), ["key", "print"], "m", total)
    begin, count = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255)
    spans = copies.select(*_ROW, begin.alias("begin"), (begin + count - 1 + length).alias("end"))
    # anchors with different stretches, one of which occurs once
    open_ = variants.groupBy("key").agg(F.count("*").alias("d"), F.min("m").alias("least")).filter("d > 1 AND least = 1")
    wanted = stored(
        join_groups(variants, open_, ["key"], "d", total).select("key", "m", "d", "one.*"),
        "repeat-open",
    )

    def contexts(some: DataFrame) -> DataFrame:
        """(key, m, doc_id, mark, at, left, right): the bytes of stretches on both sides of their anchors."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows: list[tuple] = []
                for name, mark, raw, needs in zip(
                    *[batch.column(c).to_pylist() for c in _ROW], batch.column("text").cast(pa.binary()).to_pylist(), batch.column("needs").to_pylist()
                ):
                    for need in needs:
                        start, anchor = need["at"] >> 16, (need["at"] >> 16) + (need["at"] & 0xFF)
                        stop = start + ((need["at"] >> 8) & 0xFF) - 1 + length
                        rows.append((need["key"], need["m"], name, mark, need["at"], raw[start:anchor][::-1], raw[anchor:stop]))
                kinds = [*[pa.int64()] * 5, pa.binary(), pa.binary()]
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "m", *_ROW, "at", "left", "right"]
                )

        needs = some.groupBy(*_ROW).agg(F.collect_list(F.struct("key", "m", "at")).alias("needs"))
        return (
            docs.drop("_name")
            .join(needs, list(_ROW))
            .dropDuplicates(list(_ROW))
            .mapInArrow(cut, "key long, m long, doc_id long, mark long, at long, left binary, right binary")
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(block: pa.Table) -> pa.RecordBatch:
            key, at = block.column("key").to_numpy(), block.column("at").to_numpy()
            who, start, stop = repeated(key, at, block.column("left").to_pylist(), block.column("right").to_pylist(), length)
            single = block.column("m").to_numpy()[who] == 1
            rows = [block.column(c).combine_chunks().take(pa.array(who[single])) for c in _ROW]
            return pa.RecordBatch.from_arrays([*rows, pa.array(start[single]), pa.array(stop[single])], [*_ROW, "begin", "end"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK:
                continue
            whole = pa.Table.from_batches(held)
            key = whole.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
            if cut:
                yield close(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield close(pa.Table.from_batches(held))

    few = contexts(wanted.filter(F.col("d") <= together))
    sorted_spans = (
        few.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "doc_id long, mark long, begin long, end long")
    )

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            at = batch.column("at").to_numpy()
            whole = [a[::-1] + b for a, b in zip(left, right)]
            sizes = np.array([len(w) for w in whole])
            offset = np.cumsum(sizes) - sizes
            count = (at >> 8) & 0xFF
            row = np.repeat(np.arange(len(at)), count)
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            begin = offset[row] + inside
            prints = Prefixes(np.frombuffer(b"".join(whole), np.uint8)).of(begin, begin + length)
            names = ["key", "before", "string", *_ROW, "begin"]
            columns = [batch.column("key").to_numpy()[row], (at & 0xFF)[row] - inside, prints.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), *[batch.column(c).take(pa.array(row)) for c in _ROW], pa.array((at >> 16)[row] + inside)],
                names,
            )

    many = contexts(wanted.filter(F.col("d") > together)).mapInArrow(
        strings, "key long, before long, string long, doc_id long, mark long, begin long"
    )
    many = stored(many, "repeat-strings")
    on = ["key", "before", "string"]
    twice = many.groupBy(*on).agg(F.count("*").alias("c")).filter("c > 1")
    hot = join_groups(many, twice, on, "c", many.count()).select(*_ROW, "begin", (F.col("begin") + length).alias("end"))
    every = spans.unionByName(sorted_spans).unionByName(hot)
    by_doc = every.groupBy(*_ROW).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            change = np.zeros(len(data) + 1, np.int32)
            for start, listed in zip(offsets[:-1].tolist(), batch.column("spans").to_pylist()):
                for span in listed or ():
                    change[start + span["begin"]] += 1
                    change[start + span["end"]] -= 1
            gone = np.cumsum(change[:-1]) > 0
            rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_text": []}
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                part = gone[start:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                rows["n_bytes"].append(end - start)
                rows["n_removed"].append(int(part.sum()))
                rows["n_spans"].append(len(edges) // 2)
                rows["spans"].append(edges.tolist())
                rows["kept_text"].append(data[start:end][~part].tobytes())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(rows.values(), kinds)]], ["doc_id", *rows]
            )

    marked = docs.join(by_doc, list(_ROW), "left").select(F.col("_name").alias("doc_id"), "text", "spans")
    return marked.mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_text binary"
    )


def digest(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of the operator's rows."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))
