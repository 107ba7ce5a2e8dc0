"""Exact deduplication by progressive refinement, in DataFrame operations only.

Documents are grouped by length, then by a hash of a short prefix, then by a hash
of the whole text. A document alone in its group leaves at once, so whole texts
are hashed only for documents that share both length and prefix with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import join_groups, lower_ascii, stored

PREFIX = 64


def _shared(rows: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows whose key occurs at least twice."""
    groups = rows.groupBy(*on).agg(F.count("*").alias("_size")).filter("_size > 1")
    return join_groups(rows, groups, on, "_size", total).drop("_size")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX, digest: bool = False
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept.

    With ``digest`` each row also has the text_sha256 of its own lower-cased text;
    then the texts of all documents are hashed, not only those of survivors.

    Texts are equal when they agree after lower-casing A-Z; null counts as
    empty. Of equal texts the largest doc_id stays; a null doc_id is smaller than
    any other. Rows that repeat a doc_id with the same text are kept or dropped
    together and each counts in group_size. Other columns are ignored.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.col(text)).alias("_text"))
    signs = stored(
        source.select(
            "doc_id",
            F.octet_length("_text").alias("_bytes"),
            F.xxhash64(F.substring("_text", 1, prefix)).alias("_prefix"),
        ),
        "exact-signs",
    )
    total = signs.count()
    near = stored(_shared(signs, ["_bytes"], total), "exact-lengths")
    near = stored(_shared(near, ["_bytes", "_prefix"], total), "exact-prefixes")
    # whole texts are hashed for survivors only; the join is a shuffle at every size
    chosen = near.select("doc_id").distinct()
    if digest:
        marked = chosen.select(F.col("doc_id").alias("_near_id"), F.lit(True).alias("_near")).hint("shuffle_hash")
        hashed = stored(
            source.join(marked, source["doc_id"].eqNullSafe(marked["_near_id"]), "left").select(
                "doc_id", F.octet_length("_text").alias("_bytes"), F.sha2("_text", 256).alias("_hash"), "_near"
            ),
            "exact-hashes",
        )
        full, rest = hashed.filter("_near").drop("_near"), hashed.filter("_near IS NULL")
        groups = full.groupBy("_bytes", "_hash").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        last = join_groups(full, groups, ["_bytes", "_hash"], "group_size", total)
        alone = rest.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_hash")
        return last.select("doc_id", "keep_id", "group_size", "_hash").unionByName(alone).select(
            "doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), F.col("_hash").alias("text_sha256")
        )
    chosen = chosen.hint("shuffle_hash")
    full = stored(
        source.join(chosen, source["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi").select(
            "doc_id", F.octet_length("_text").alias("_bytes"), F.sha2("_text", 256).alias("_hash")
        ),
        "exact-hashes",
    )
    groups = full.groupBy("_bytes", "_hash").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    last = join_groups(full, groups, ["_bytes", "_hash"], "group_size", total)
    alone = signs.join(chosen, signs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return last.select("doc_id", "keep_id", "group_size").unionByName(alone).withColumn(
        "kept", F.col("keep_id").eqNullSafe(F.col("doc_id"))
    )
