"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets form one class. Each class gets minhashes; in
each of several independent trees it walks a path whose next minhash position is
chosen by the hash of the path so far, so two sets stay together at a step with
the chance of their similarity. A node that is small enough is compared
exhaustively on 128-bit sketches; a larger one is branched further, and its
members are linked to its least member on the way. A first round of few trees
finds most components; the second round, of all trees, ends a node as soon as its
members are one component, so large groups are never expanded into pairs. Nodes
still large at the last depth compare members of different components. Every
candidate pair is confirmed on the full sets.

A pair of similarity s that is alone in its node at depth d is missed by all
trees with chance (1 - s^d)^trees: about 2e-9 for s = 0.8, d = 2 and 20 trees,
6e-7 for d = 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import PART_BYTES, by_mark, flat, join_spread, settled, settled_all, slices, stored
from rasterloom.llm.components import components
from rasterloom.llm.words import LOWER, mix, words_of

HASHES = 128
# Sets that one task of crossing() compares, from either side.
BLOCK_BYTES = 2 << 20


@dataclass(frozen=True)
class Search:
    """Production parameters; similarity is a percentage."""

    similarity: int = 80
    trees: int = 20
    # trees of the first round, which connects most documents of each group
    first_trees: int = 2
    node: int = 16
    first_depth: int = 2
    last_depth: int = 6
    # sketch bits that a linked pair may differ in: five deviations above what similarity 0.8 gives
    distance: int = 30


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _C2)
_A = (_seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another; and how many each has.

    A text with fewer words is one shingle, its whole sequence; without words it has none.
    """
    n = len(offsets) - 1
    found = words_of(LOWER[data], offsets)
    hashes, doc, per_doc = found.hash, found.doc, found.per_doc
    first = np.cumsum(per_doc) - per_doc
    parts, owners = [], []
    for size in range(1, words + 1):
        # texts of exactly ``size`` words below the width, every position at it
        if size < words:
            start = first[per_doc == size]
        else:
            start = np.arange(max(len(hashes) - words + 1, 0))
            start = start[doc[start] == doc[start + words - 1]]
        value = np.full(len(start), size, np.uint64)
        for j in range(size):
            value = mix(value * _C1 + hashes[start + j])
        parts.append(value)
        owners.append(doc[start])
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    order = np.argsort(owner.astype(np.uint16) if n < 65536 else owner, kind="stable")
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=n).astype(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, f1, f2, mins, s1, s2): set size, set fingerprint, minhashes and sketch of each whole text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PART_BYTES):
            sets, sizes = shingle_sets(*flat(batch.column("text")), words)
            n = len(sizes)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            mins = np.zeros((n, HASHES), np.uint32)
            prints = np.zeros((2, n), np.uint64)
            if len(some):
                short = (sets >> np.uint64(32)).astype(np.uint32)
                for j in range(HASHES):
                    mins[some, j] = np.minimum.reduceat(short * _A[j] + _B[j], starts)
                prints[0, some] = np.add.reduceat(sets, starts)
                prints[1, some] = np.add.reduceat(mix(sets ^ _C2), starts)
            bits = np.packbits((mix(mins.astype(np.uint64) * _C1) & np.uint64(1)).astype(np.uint8), axis=1)
            sketch = np.ascontiguousarray(bits).view("<i8").reshape(n, 2)
            column = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * HASHES), pa.array(mins.view(np.int32).reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)),
                    column,
                    pa.array(sketch[:, 0].copy()),
                    pa.array(sketch[:, 1].copy()),
                ],
                ["doc_id", "n", "f1", "f2", "mins", "s1", "s2"],
            )

    return docs.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, mins array<int>, s1 long, s2 long")


def _next(key, mins):
    """Key of the child node: the path so far chooses the minhash that the branch goes by."""
    place = (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(HASHES)) + 1).cast("int")
    return F.xxhash64(key, F.element_at(mins, place))


def _distance(a: str, b: str):
    return F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(
        F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2"))
    )


def candidates(classes: DataFrame, mins: DataFrame, search: Search, trees: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, d) with a < b in different parts, and the members of nodes still large at the end.

    ``classes`` has rep, part, mins, s1, s2 and is read once; ``mins`` (rep, mins) is read for members of large
    nodes. A node whose members are all of one part has nothing to find and ends there, so pairs inside what is
    already known to be connected are never made.
    """
    spark = classes.sparkSession
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")))
    rows = classes.select("rep", "part", "s1", "s2", "mins", step.alias("key"))
    for _ in range(search.first_depth):
        rows = rows.withColumn("key", _next(F.col("key"), F.col("mins")))
    pairs, kept = [], ["key", "rep", "part", "s1", "s2"]
    depth = search.first_depth

    def several() -> DataFrame:
        """Members of nodes with more than one part, with the node's size."""
        laid = stored(rows.select(*kept), "path-rows")
        nodes = laid.groupBy("key").agg(F.count("*").alias("m"), F.min("part").alias("p0"), F.max("part").alias("p1"))
        return join_spread(laid, nodes.filter("p0 < p1").select("key", "m"), ["key"])

    while True:
        met = settled(spark, several, "path-nodes")
        small, large = met.filter(F.col("m") <= search.node), met.filter(F.col("m") > search.node)
        a, b = small.select(*kept).alias("a"), small.select(*kept).hint("shuffle_hash").alias("b")
        near = (
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.rep") < F.col("b.rep"))
            & (F.col("a.part") != F.col("b.part"))
            & (_distance("a", "b") <= search.distance)
        )
        pairs.append(a.join(b, near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), _distance("a", "b").alias("d")))
        pivots = large.groupBy("key").agg(F.min(F.struct("rep", "part", "s1", "s2")).alias("pivot"))
        star = join_spread(large, pivots, ["key"])
        d = F.bit_count(F.col("s1").bitwiseXOR(F.col("pivot.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("pivot.s2")))
        star = star.filter((F.col("rep") != F.col("pivot.rep")) & (F.col("part") != F.col("pivot.part")))
        star = star.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b"), d.alias("d"))
        pairs.append(star.filter(F.col("d") <= search.distance))
        if depth == search.last_depth or large.isEmpty():
            break
        if depth == search.first_depth:
            # members of later nodes are among these, so the minhashes of all are shuffled once
            wanted = large.select("rep").distinct()
            few = mins.join(wanted.hint("shuffle_hash"), "rep", "left_semi")
            mins = settled(spark, lambda: few, "path-mins")  # noqa: B023
        depth += 1
        # a document is in at most ``trees`` rows, so no key is hot
        rows = large.select(*kept).join(mins.hint("shuffle_hash"), "rep").withColumn(
            "key", _next(F.col("key"), F.col("mins"))
        )
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    return every.groupBy("a", "b").agg(F.min("d").alias("d")), large.select("key", "rep", "part")


def block_links(left: list, right: list, similarity: int) -> list[tuple[int, int]]:
    """Links between two lists of (rep, part, sorted set), as few as join the parts that all links would join.

    A link of parts that earlier ones have joined is left out, so there are fewer links than parts. All intersections of a set with the other side are counted at once through
    that side's postings, so nothing is estimated.
    """
    sizes = np.array([len(s) for _, _, s in left], np.int64)
    values = np.concatenate([s for _, _, s in left])
    owners = np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    names, place = np.unique(np.array([p for _, p, _ in (*left, *right)], np.int64), return_inverse=True)
    # what each part, and each set on the left, is joined with so far
    top = np.arange(len(names))
    tops = top[place[: len(left)]]
    links = []
    for (rep, _, members), at in zip(right, place[len(left) :]):
        low, high = np.searchsorted(values, members, "left"), np.searchsorted(values, members, "right")
        counts = high - low
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - counts), counts)
        both = np.bincount(owners[places], minlength=len(left))
        met = np.flatnonzero((100 * both >= similarity * (sizes + len(members) - both)) & (tops != top[at]))
        if len(met):
            joined, first = np.unique(tops[met], return_index=True)
            links += [(int(left[i][0]), int(rep)) for i in met[first]]
            top[np.isin(top, joined)] = top[at]
            tops = top[place[: len(left)]]
    return links


def crossing(leaves: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (u, v) between members in different parts of one node, on the full sets.

    Each member outside the node's largest part meets all members, block by block: either side is cut into
    blocks of about BLOCK_BYTES of sets, whatever the node's size, and a task compares one block of each. What is
    shuffled grows with members and blocks, and only links leave the task, not pairs.
    """
    members = leaves.join(sets.select("rep", F.octet_length("set").alias("bytes")).hint("shuffle_hash"), "rep")
    members = stored(members, "path-leaves")
    parts = members.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
    nodes = parts.groupBy("key").agg(F.max(F.struct("c", "part", "bytes")).alias("main"), F.sum("bytes").alias("bytes"))
    blocks = [F.ceil(b / F.lit(BLOCK_BYTES)).cast("int") for b in (F.col("bytes"), F.col("bytes") - F.col("main.bytes"))]
    nodes = nodes.select("key", F.col("main.part").alias("main"), blocks[0].alias("across"), blocks[1].alias("down"))
    laid = join_spread(members.select("key", "rep", "part"), nodes.filter("down > 0"), ["key"])
    turn = F.xxhash64("rep", F.lit(3))
    every = laid.select(
        "key", "rep", "part", F.lit(False).alias("few"), F.pmod(turn, F.col("across")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"),
    )
    few = laid.filter("part != main").select(
        "key", "rep", "part", F.lit(True).alias("few"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"),
        F.pmod(turn, F.col("down")).cast("int").alias("y"),
    )
    met = every.unionByName(few).join(sets.hint("shuffle_hash"), "rep")

    def meet(block: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        columns = (block.column(c).to_pylist() for c in ("rep", "part", "few", "set"))
        for rep, part, side, raw in zip(*columns):
            sides[side].append((rep, part, np.frombuffer(raw, "<u8")))
        links = block_links(*sides, similarity) if sides[0] and sides[1] else []
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return met.groupBy("key", "x", "y").applyInArrow(meet, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(u, v): pairs whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                left, right = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(left) + len(right) - len(np.union1d(left, right))
                keep.append(100 * both >= similarity * (len(left) + len(right) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["u", "v"]
            )

    # shuffled at every size: what is broadcast must not depend on how many pairs there are
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")).hint("merge")
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("y")).hint("merge")
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    return met.select("a", "b", "x", "y").mapInArrow(check, "u long, v long")


def near_duplicates(
    docs: DataFrame, words: int = 5, search: Search = Search(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; a set is the distinct shingles of ``words`` words. Texts
    are linked when their sets reach the similarity, and component_id is the
    smallest doc_id reachable. Texts without words are linked with nothing. A
    doc_id names one text; rows that repeat it get the same answer. A null
    doc_id takes part as a document of its own that nothing is linked with.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    on, own = ["n", "f1", "f2"], F.expr("n > 0 AND doc_id IS NOT NULL")

    def signed_classes() -> list[DataFrame]:
        """What identifies each document's set, and each class with its minhashes and sketch."""
        full = stored(signatures(docs, words), "path-full")
        firsts = [F.first(c).alias(c) for c in ("mins", "s1", "s2")]
        return [full.select("doc_id", *on), full.filter(own).groupBy(*on).agg(F.min("doc_id").alias("rep"), *firsts)]

    signed, classes = settled_all(spark, signed_classes, "path-signatures", "path-classes")
    named, mins = signed.filter(own), classes.select("rep", "mins")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PART_BYTES):
            sets, sizes = shingle_sets(*flat(batch.column("text")), words)
            ends = np.cumsum(sizes)
            raw = [sets[e - n : e].astype("<u8").tobytes() for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(raw, pa.binary())], ["rep", "set"])

    def sets_of(reps: DataFrame) -> DataFrame:
        """Full sets of the documents named; of the other texts, only a few are shuffled."""
        wanted = stored(reps.distinct(), "path-wanted")
        some, _ = by_mark(docs, "doc_id", wanted)
        texts = some.join(wanted.hint("shuffle_hash"), some["doc_id"] == wanted["rep"], "left_semi")
        texts = texts.select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"])
        return settled(spark, lambda: texts.mapInArrow(listed, "rep long, set binary"), "path-sets")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))

    def first_links() -> DataFrame:
        """A few trees connect the bulk of each group: every document by its closest candidates, before and after it."""
        apart = classes.withColumn("part", F.col("rep"))
        pairs = stored(candidates(apart, mins, search, search.first_trees)[0], "path-pairs")
        before = pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        after = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        best = stored(before.unionByName(after).distinct(), "path-best")
        return confirmed(best, sets_of(ends_of(best)), search.similarity)

    def more_links() -> DataFrame:
        """All trees then look for links between what is still apart."""
        known = components(links, "path-stars").select(F.col("node").alias("rep"), F.col("component").alias("part"))
        apart = classes.join(known.hint("shuffle_hash"), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        pairs, leaves = candidates(apart, mins, search, search.trees)
        rest = stored(pairs.select("a", "b"), "path-rest")
        sets = sets_of(ends_of(rest).unionByName(leaves.select("rep")))
        # one after the other, so that their shuffles of sets are not on disk together
        near = settled(spark, lambda: confirmed(rest, sets, search.similarity), "path-near")
        return near.unionByName(crossing(leaves, sets, search.similarity))

    links = settled(spark, first_links, "path-links")
    more = settled(spark, more_links, "path-more")
    final = settled(spark, lambda: components(links.unionByName(more), "path-final"), "path-components")
    placed = classes.select(*on, "rep").join(final.withColumnRenamed("node", "rep").hint("shuffle_hash"), "rep", "left")
    placed = placed.select(*on, F.coalesce("component", "rep").alias("component_id"))
    out = join_spread(named.select("doc_id", *on), placed, on).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    alone = signed.filter("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
