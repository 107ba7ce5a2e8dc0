"""What several operators share: stored intermediates, distributed running sums, byte views of texts."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators.joins import salted_join
from rasterloom.session import work_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A key with more than 1/HEAVY of all rows is heavy, so there are fewer than HEAVY heavy keys.
HEAVY = 1000
# Text handled at once inside a task; a single longer text is handled alone.
SLICE_BYTES = 2 << 20
# The same where arrays of many times the text's size are made of a slice, and each row's result is its own.
PART_BYTES = 512 << 10
# Rows that Spark hands to Python at once inside narrow_batches().
BATCH_BYTES = 4 << 20
# Text after which a worker gives free memory back.
RELEASE_BYTES = 1 << 20
# Places of the bitmap that tells which rows are worth a shuffle: 4 MB, whatever the number of ids.
MARK_BITS = 1 << 25


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers once per application, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="rasterloom-")) / "rasterloom-package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted((root / "rasterloom").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Folders of tables stored while a settled() is under way, innermost last.
_passing: list[list[str]] = []


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read back: lineage ends, later uses read files."""
    folder = work_folder(df.sparkSession, purpose)
    if _passing:
        _passing[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled_all(spark: SparkSession, make: Callable[[], Sequence[DataFrame]], *purposes: str) -> list[DataFrame]:
    """The tables that ``make`` returns, each stored; tables that ``make`` stored on its way are deleted.

    The results must be all that is used of them later. Shuffle files go when the
    JVM finds that nothing refers to them, so it is asked to look.
    """
    _passing.append([])
    try:
        folders = [work_folder(spark, purpose) for purpose in purposes]
        made = make()
        for df, folder in zip(made, folders, strict=True):
            df.write.parquet(folder)
        schemas = [df.schema for df in made]
        del made, df
    finally:
        for old in _passing.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()
    if _passing:
        _passing[-1] += folders
    return [spark.read.schema(schema).parquet(folder) for schema, folder in zip(schemas, folders)]


def settled(spark: SparkSession, make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """The one table that ``make`` returns, as in settled_all()."""
    return settled_all(spark, lambda: [make()], purpose)[0]


@contextmanager
def narrow_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Inside it, Spark jobs hand rows to Python ``limit`` bytes at a time, not 10,000 rows whatever their length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_mark(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose long ``key`` may be in the one column of ``ids``, and those where it surely is not; no row is shuffled.

    The hashes of ``ids`` mark places of a bitmap of MARK_BITS, so what is broadcast has a fixed bound. Keys that
    share a place with one of ``ids`` are among the first rows too: an exact join of those has to follow.
    """

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(MARK_BITS)) + 1

    at = place(ids[ids.columns[0]])
    # dealt first, so that no task holds a part of every bitmap
    marks = ids.select(F.bitmap_bucket_number(at).alias("_mark_bucket"), F.bitmap_bit_position(at).alias("_mark_bit"))
    marks = marks.repartition("_mark_bucket").groupBy("_mark_bucket")
    marks = marks.agg(F.bitmap_construct_agg("_mark_bit").alias("_mark_bits"))
    own = place(rows[key])
    met = rows.join(F.broadcast(marks), F.bitmap_bucket_number(own) == marks["_mark_bucket"], "left")
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substr(marks["_mark_bits"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    found = F.coalesce(F.getbit(byte.cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    some, sure = (met.filter(f).drop(marks["_mark_bucket"], marks["_mark_bits"]) for f in (found, ~found))
    return some, sure


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def join_groups(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of rows to one-row-per-key ``groups`` where a few keys may hold most rows.

    ``size`` in ``groups`` is the number of rows of a key. Keys with more than
    total / HEAVY rows are fewer than HEAVY, so their broadcast has a fixed
    bound; all other keys are joined by a shuffle in which none is large.
    ``groups`` is stored, so that looking for heavy keys does not make it twice.
    """
    groups = stored(groups, "groups")
    heavy = F.col(size) * HEAVY > total
    first = groups.filter(heavy)
    if first.isEmpty():
        return rows.join(groups, list(on), "inner")
    many = rows.join(F.broadcast(first), list(on), "inner")
    rest = rows.join(F.broadcast(first.select(*on)), list(on), "left_anti")
    return many.unionByName(rest.join(groups.filter(~heavy), list(on), "inner"))


def join_spread(rows: DataFrame, groups: DataFrame, on: Sequence[str], salts: int = 8) -> DataFrame:
    """Inner join of rows to one-row-per-key ``groups`` by a shuffle at every size; a key's rows go to ``salts`` tasks."""
    return salted_join(rows, groups.hint("shuffle_hash"), on, salts=salts)


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, purpose: str
) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group, along ``order``.

    Rows are range-partitioned by group and order and stored, so a group of any
    size is split over partitions. Sums per (partition, group) are accumulated
    over the partitions a group spans and added to the sums inside a partition.
    Null group keys form a group of their own. ``df`` should be cheap to read
    twice (range boundaries are sampled).
    """
    laid = df.withColumn("_running_value", value.cast("long"))
    # the hash breaks up rows that are equal in all order columns
    laid = laid.repartitionByRange(*[F.col(c) for c in (*group, *order)], F.xxhash64(*laid.columns))
    laid = stored(laid.withColumn("_running_part", F.spark_partition_id()), purpose)
    keys = {f"_running_key{i}": F.coalesce(F.col(c).cast("string"), F.lit("\0")) for i, c in enumerate(group)}
    laid = laid.withColumns(keys) if keys else laid
    by = ["_running_part", *keys]
    across = Window.partitionBy(*keys, F.lit(0)).orderBy("_running_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(*by).agg(F.sum("_running_value").alias("_running_sum"))
    starts = starts.select(*by, F.coalesce(F.sum("_running_sum").over(across), F.lit(0)).alias("_running_start"))
    inside = Window.partitionBy(*by).orderBy(*order, "_running_tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("_running_tie", F.xxhash64(*[c for c in laid.columns if c not in by]))
    return (
        laid.withColumn("_running_before", F.coalesce(F.sum("_running_value").over(inside), F.lit(0)))
        .join(starts, by)
        .withColumn(name, F.col("_running_start") + F.col("_running_before"))
        .drop("_running_value", "_running_part", "_running_tie", "_running_before", "_running_start", *keys)
    )


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_handled = 0


def release(size: int) -> None:
    """Gives memory that is free back to the system when RELEASE_BYTES of text were handled since the last time.

    Workers serve one task after another, and what an allocator holds would else add up to the most of each kind.
    """
    global _handled
    _handled += size
    if _handled >= RELEASE_BYTES:
        _handled = 0
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64) + 64)
        start = 0
        while start < len(total):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            release(int(total[end - 1] - base))
            start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, one after another, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]
