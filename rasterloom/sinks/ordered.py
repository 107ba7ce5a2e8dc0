"""Tables whose order is stored: sorted ranges in numbered files, and readers that keep it.

Rows are range-partitioned and sorted in parallel, so no task sees the whole table.
Spark numbers a write's files by partition, so the order of file names, and of rows
in a file, is the order of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.ranking import numbered

FORMATS = ("json", "parquet")


def write_ordered(
    df: DataFrame, folder: str, by: Sequence[str], kind: str = "json", mode: str = "overwrite", files: int | None = None
) -> None:
    """Stores rows in the order of ``by``; rows equal in it come in the order of their other plain columns.

    ``files`` fixes the number of ranges; without it adaptive execution merges small ones.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; use one of {FORMATS}")
    ties = [c for c, t in df.dtypes if c not in by and not t.startswith(("map", "variant"))]
    order = [F.col(c) for c in (*by, *ties)]
    ranges = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranges.sortWithinPartitions(*order).write.format(kind).mode(mode).save(folder)


def read_ordered(
    spark: SparkSession, folder: str, schema: str, kind: str = "json", position: str = "position"
) -> DataFrame:
    """Rows of such a folder with their 0-based place in it, whatever tasks read them.

    A Parquet file numbers its rows. Lines of JSON are numbered inside the blocks that tasks
    read them in, and blocks follow one another by file name and offset.
    """
    rows = spark.read.format(kind).schema(schema).load(folder)
    if kind == "parquet":
        inside, within = F.col("_metadata.row_index"), F.lit(0)
    else:
        inside, within = F.monotonically_increasing_id(), F.col("_metadata.file_block_start")
    keyed = rows.select(
        "*", F.col("_metadata.file_name").alias("_file"), within.alias("_block"), inside.alias("_row")
    )
    return numbered(keyed, ["_file", "_block", "_row"], position).drop("_file", "_block", "_row")
