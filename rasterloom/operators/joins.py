"""Join helpers that look at the size of the small side before broadcasting it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.session import spread

# What a lookup side may measure and still be broadcast; every executor can hold this.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Estimated size of a row: fixed-width columns plus the real lengths of the others."""
    total = F.lit(16 + 8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ArrayType, T.MapType)):
            plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
            total = total + F.greatest(F.size(value), F.lit(0)) * F.lit(8 if plain else 64)
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.length(value), F.lit(0))
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has few enough rows and bytes; reads no more than ``max_rows`` + 1 rows."""
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 32, many: bool = False
) -> DataFrame:
    """Shuffle join in which a hot key of ``big`` is spread over ``salts`` tasks.

    With ``many`` a row meets so many that tasks must not be merged by the size of what they read.

    ``small`` is repeated once per salt. Valid for joins that keep or drop rows
    of ``big`` (inner, left, left_semi, left_anti). The salt comes from the row's
    own values, so a retried task sends each row to the same place.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how!r}")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if many:
        left, right = (spread(side, *on, "_salt") for side in (left, right))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` to a lookup table: broadcast when it is small, salted shuffle when not."""
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how)
