"""Running numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import cut_lineage


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position, a long, of each row in the given order.

    Rows are range-partitioned and sorted in parallel; a partition's first number
    is the size of all partitions before it. The sorted table is checkpointed, so
    that both steps see the same partitions. Only the partition sizes, one row
    per partition, are brought together.
    """
    laid_out = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )
    sizes = laid_out.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # one row per shuffle partition of the sort
    return (
        laid_out.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + inside - 1).cast("long"))
        .drop("_part", "_start")
    )
