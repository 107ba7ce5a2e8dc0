"""Compact codes for vectors: product codebooks trained in exact integers by limb-split matrix products.

Components become integers ``floor(1024 x)``. Integers are broken into limbs of
so few bits that every float64 product of two limb matrices stays below 2^53
and is exact; the products are recombined in int64 and the first nearest entry
wins. So codes and codebooks do not depend on the order of rows, on the number
of partitions, or on the BLAS at hand.

Each round is one pass over the vectors in tasks (a batch against the codebooks,
partial sums per entry) and one small aggregation. Only the codebooks travel:
at most 256 entries, each as wide as a vector.

Cases: vectors that are null or hold null or non-finite components are left out.
Shorter vectors count as padded with zeros to the longest, and that to a multiple
of four; an empty vector is all zeros. Fewer than 256 vectors give as many entries.
Initial entries come by vec_id (nulls last), repeated ids by their components.
Numbers too large for int64 arithmetic are worked out in Python's integers; an
error beyond a long is given as the largest long. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.llm.common import stored
from rasterloom.operators.joins import lookup_join

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
MOST = (1 << 63) - 1
# Components handled at once in a task.
CELLS = 1 << 20
# Sums travel in digits of this many bits, so that sums of any integers are sums of longs.
DIGIT = 31


# -- exact arithmetic


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(1024 x)`` as int64, or as Python integers where a component exceeds 2^52."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < 2.0**52:
        return scaled.astype(np.int64)
    # a factor of 2^10 is exact in doubles until it overflows, and there doubles are whole numbers
    values = x.astype(np.float64).ravel().tolist()
    whole = [int(v) * int(SCALE) if abs(v) > 2.0**1000 else math.floor(v * SCALE) for v in values]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def limb_bits(width: int) -> int:
    """Bits a limb may have so that a sum of ``width`` products stays below 2^53."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 limbs, lowest first: all but the highest lie in [0, 2^bits), that one is signed."""
    out = []
    while True:
        if not x.size or int(np.abs(x).max()) < 1 << bits:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact ``x @ y.T`` of int64 matrices whose products fit int64, by limb-wise float64 products."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for k, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (bits * (i + k))
    return total


def _largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row and its squared distance."""
    reach = _largest(x) + _largest(entries)
    if x.dtype == object or entries.dtype == object or 4 * x.shape[1] * reach * reach >= MOST:
        x, entries = x.astype(object), entries.astype(object)
        cross = x.dot(entries.T) if x.shape[1] else np.zeros((len(x), len(entries)), object)
    else:
        cross = dot(x, entries)
    square = (entries * entries).sum(axis=1) - 2 * cross
    at = square.argmin(axis=1)
    return at, square[np.arange(len(x)), at] + (x * x).sum(axis=1)


# -- codebooks


@dataclass(frozen=True)
class Codebooks:
    """Per part an integer matrix: entries by positions."""

    parts: tuple[np.ndarray, ...]
    width: int  # of a padded vector

    @classmethod
    def first(cls, vectors: np.ndarray) -> Codebooks:
        return cls(tuple(np.split(vectors, PARTS, axis=1)), vectors.shape[1])

    def digest(self) -> str:
        numbers = (str(int(v)) for part in self.parts for v in part.ravel())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Entries by part, and the squared distances summed over parts."""
        found = [nearest(x, c) for x, c in zip(np.split(vectors, PARTS, axis=1), self.parts)]
        error = found[0][1]
        if error.dtype == object or sum(float(e.max(initial=0)) for _, e in found) > 2.0**62:
            error = error.astype(object)
        for _, more in found[1:]:
            error = error + more
        return [at for at, _ in found], error

    def moved(self, means: dict[tuple[int, int], list[int]]) -> Codebooks:
        """With new values for the entries in ``means``; the others stay."""
        parts = []
        for p, old in enumerate(self.parts):
            new = old.astype(object)
            for (part, entry), values in means.items():
                if part == p:
                    new[entry] = values
            parts.append(new.astype(np.int64) if _largest(new) < 1 << 52 else new)
        return Codebooks(tuple(parts), self.width)


def finite(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, padded with zeros to ``width``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width), np.float64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return integers(out)


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(width, ENTRIES * PARTS))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _digits(values: list[int]) -> list[list[int]]:
    """Two's-complement digits of DIGIT bits, lowest first; the highest is signed."""
    out = []
    for v in values:
        digits = []
        while abs(v) >> DIGIT:
            digits.append(v & ((1 << DIGIT) - 1))
            v >>= DIGIT
        out.append([*digits, v])
    return out


def _partial_sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece in _chunks(batch, books.width):
                vectors = _matrix(piece.column("embedding"), books.width)
                at, _ = books.assign(vectors)
                for p, (x, entry) in enumerate(zip(np.split(vectors, PARTS, axis=1), at)):
                    order = np.argsort(entry, kind="stable")
                    heads = np.flatnonzero(np.diff(entry[order], prepend=-1))
                    ends = [*heads[1:].tolist(), len(order)]
                    for head, end in zip(heads.tolist(), ends):
                        key = (p, int(entry[order[head]]))
                        add = x[order[head:end]].sum(axis=0).astype(object)
                        sums[key] = sums[key] + add if key in sums else add
                        counts[key] = counts.get(key, 0) + end - head
        out: dict[str, list] = {c: [] for c in ("part", "entry", "place", "digit", "value")}
        for (p, e), total in sums.items():
            # place -1 holds the count
            for place, digits in enumerate(_digits([counts[p, e], *total.tolist()]), start=-1):
                for k, value in enumerate(digits):
                    for c, v in zip(out, (p, e, place, k, value)):
                        out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=_SUMS)

    return run


_SUMS = pa.schema([*[(c, pa.int32()) for c in ("part", "entry", "place", "digit")], ("value", pa.int64())])


def _means(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], list[int]]:
    """floor(sum / count) by part and entry; 256 entries as wide as a vector come to the driver."""
    rows = vectors.mapInArrow(_partial_sums(books), "part int, entry int, place int, digit int, value long")
    rows = rows.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect()
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for part, entry, place, digit, value in rows:
        at = totals.setdefault((part, entry), {})
        at[place] = at.get(place, 0) + (value << (DIGIT * digit))
    return {k: [at.get(i, 0) // at[-1] for i in range(len(at) - 1)] for k, at in totals.items()}


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the finite vectors (vec_id, embedding); None where there are none."""
    vectors = finite(vectors).select("vec_id", "embedding")
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // PARTS) * PARTS
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    padded = np.array([[*r["embedding"], *[0.0] * (width - len(r["embedding"]))] for r in start], np.float64)
    books = Codebooks.first(integers(padded.reshape(len(start), width)))
    for _ in range(rounds):
        books = books.moved(_means(vectors, books))
    return books


def encode(vectors: DataFrame, books: Codebooks | None, label: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (a long) of the finite vectors."""
    schema = T.StructType(
        [vectors.schema["vec_id"], vectors.schema[label], *T.StructType.fromDDL("code string, error long")]
    )
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _chunks(batch, books.width):
                at, error = books.assign(_matrix(piece.column("embedding"), books.width))
                codes = np.stack(at, axis=1).astype(np.uint8).tobytes().hex()
                step = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("vec_id"),
                        piece.column(label),
                        pa.array([codes[i : i + step] for i in range(0, len(codes), step)], pa.string()),
                        pa.array([min(int(e), MOST) for e in error], pa.int64()),
                    ],
                    schema=arrow,
                )

    return finite(vectors).select("vec_id", label, "embedding").mapInArrow(run, schema)


def _key(label: str) -> Column:
    return F.coalesce(F.col(label).cast("string"), F.lit("\0"))


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: the error summed over equal labels, nulls together.

    Sums are made map-side; they are broadcast only while they are few, and meet the rows by salted keys otherwise.
    """
    codes = stored(codes.withColumn("_label", _key(label)), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    return lookup_join(codes, codes.groupBy("_label").agg(total.alias("label_error")), ["_label"]).drop("_label")


def compress(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every finite vector."""
    books = fit(vectors)
    out = with_label_error(encode(vectors, books, label), label)
    return out.withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
