"""Best-fit-decreasing packing, matched on the driver over the histogram of lengths.

Pieces and gaps are held as runs: all pieces of one length, and all sequences
with one gap, are a count and a range of ranks, so either side has at most
``capacity`` sizes at any input size. Matching is a sequential loop over these
runs on the driver: lengths in falling order, and for each a binary search for
the smallest gap that holds it; pieces of lower rank are placed first. There are
no distributed rounds, sweeps or conflicts: the histogram is bounded, and a round
of Spark jobs for each size would only add to it. Counting the lengths, ranking
the pieces inside a length, and giving each piece its place, are distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import PART_BYTES, flat, running, slices, stored
from rasterloom.llm.tokens import encoder
from rasterloom.operators.joins import salted_join

CAPACITY = 4096
# Placements that may be broadcast (five integers each); more are joined by a shuffle.
BROADCAST_MOVES = 200_000


def place_runs(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, last rank + 1, first sequence, offset) that place all pieces.

    ``lengths`` maps a length to its number of pieces.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    moves, opened = [], 0

    def add(gap: int, first: int, count: int) -> None:
        if gap not in runs:
            insort(gaps, gap)
            runs[gap] = []
        held = runs[gap]
        if held and held[-1][0] + held[-1][1] == first:
            held[-1] = (held[-1][0], held[-1][1] + count)
        else:
            held.append((first, count))

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fresh = -(-left // (capacity // length))
                add(capacity, opened, fresh)
                opened += fresh
                continue
            gap = gaps[at]
            for number, (first, count) in enumerate(runs[gap]):
                take = min(count, left)
                moves.append((length, rank, rank + take, first, capacity - gap))
                if gap > length:
                    add(gap - length, first, take)
                rank, left = rank + take, left - take
                if not left:
                    runs[gap] = [(first + take, count - take)] * (count > take) + runs[gap][number + 1 :]
                    break
            else:
                runs[gap] = []
            if not runs[gap]:
                del runs[gap]
                gaps.remove(gap)
    return moves


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths are 1 to ``capacity``; ``pieces`` must be stored.

    Pieces of one length are ranked along ``order``; rows equal in it may swap
    places. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    moves = place_runs(counts, capacity)
    plan = spark.createDataFrame(moves, f"`{length}` long, _from long, _to long, _first long, _offset long")
    ranked = running(pieces, [length], order, F.lit(1), "_rank", "pack-ranks").withColumn(length, F.col(length).cast("long"))
    if len(moves) <= BROADCAST_MOVES:
        met = ranked.join(F.broadcast(plan), length)
    else:
        met = salted_join(ranked, plan, [length])
    return met.filter("_rank >= _from AND _rank < _to").select(
        *pieces.columns,
        (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): whole texts as ids with the end id, cut at ``capacity``.

    Null and empty texts are the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in slices(batches, limit=PART_BYTES):
            ids, counts = coder.encode(*flat(batch.column("text")))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            at = (np.cumsum(counts) - counts)[row] + start
            raw = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist())]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start.astype(np.int64)),
                "length": pa.array(length.astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    more = ", ids binary" if with_ids else ""
    return picked.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces that carry ids; a group is one sequence, so it is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part["ids"])).alias("ids"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there. Other columns are ignored."""
    pieces = stored(token_pieces(docs, vocabulary, end_id, capacity), "pack-pieces")
    return pack(pieces, ["doc_id", "piece"], capacity=capacity)
