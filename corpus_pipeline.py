"""Cleans, deduplicates, mixes and packs ``documents``: five stages, each on all rows its predecessor kept.

SQL cannot express suffix-array rules, tokenization or packing, so there is no
SQL check; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import chosen_path, exact, mixture, packing, repetition
from rasterloom.llm.common import by_mark, narrow_batches, settled, stored, table

ORACLE_SQL = None


def _only(docs: DataFrame, decide: Callable[[], DataFrame]) -> DataFrame:
    """Rows of ``docs`` whose doc_id is kept by what ``decide`` returns; no column of ``docs`` is touched.

    Only the ids stay stored; what the operator stored on its way is deleted. Rows whose id is surely not dropped
    stay where they are; the others, a few more than are dropped, meet the dropped ids in a join.
    """

    def verdicts() -> DataFrame:
        kept = F.max(F.coalesce("kept", F.lit(False)))
        return decide().groupBy(F.col("doc_id").alias("_kept_id")).agg(kept.alias("_kept"))

    with narrow_batches(docs.sparkSession):
        ids = settled(docs.sparkSession, verdicts, "pipeline-kept")
    dropped = ids.filter("NOT _kept").select("_kept_id")
    some, sure = by_mark(docs, "doc_id", dropped)
    return sure.unionByName(some.join(dropped, some["doc_id"].eqNullSafe(dropped["_kept_id"]), "left_anti"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the suffix-array repetition rules reject."""
    return _only(docs, lambda: repetition.repetition_rules(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each set of equal texts."""
    return _only(docs, lambda: exact.exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component (five words, similarity 0.8)."""
    return _only(docs, lambda: chosen_path.near_duplicates(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come to their target weights.

    A document is returned once for each time the mix takes it, to the nearest whole time.
    """

    def times_taken() -> DataFrame:
        taken = mixture.mix(docs).filter("size > 0").select(
            F.col("doc_id").alias("_mix_id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_mix_times")
        )
        return taken.groupBy("_mix_id").agg(F.max("_mix_times").alias("_mix_times")).filter("_mix_times > 0")

    with narrow_batches(spark):
        taken = settled(spark, times_taken, "pipeline-taken")
    met = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_mix_id"]))
    times = F.explode(F.array_repeat(F.lit(0), F.col("_mix_times")))
    return met.withColumn("_mix_turn", times).select(*[docs[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    with narrow_batches(spark):
        return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{n}")
    return docs
