"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a list of slots of ``block`` words. Slot k takes the k-th
golden-ratio point and looks it up in the cumulative target weights; that gives
its source. Slots are ranked inside their source, the source's documents are
laid out in hashed order and cut into blocks of equal size, and the slot of rank
r takes block r, going round again when the source is used up. A source's last
slot ends where its target is reached.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import PART_BYTES, flat, join_groups, running, slices, stored
from rasterloom.llm.words import words_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
BLOCK = 1024
CELLS = 4096
# 2^32 / golden ratio, odd: multiples visit all 32-bit points in golden-ratio steps
_STEP = 2654435769


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each whole text; null has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PART_BYTES):
            size = words_of(*flat(batch.column("text")), hashed=False).per_doc.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(size)], ["doc_id", "source", "size"]
            )

    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    return picked.mapInArrow(count, f"doc_id {kind}, source string, size long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(_src, _no_src, source_no, source_docs, source_size, target) of each source, stored.

    Sources are numbered by code point, null last, and take the weights in turn.
    Targets share the total by weight; what exceeds ``most`` times a source's
    size is shared again among the others until none is above. Each round is one
    sum over the sources.
    """
    groups = sizes.groupBy("_src", "_no_src").agg(
        F.count("*").alias("source_docs"), F.sum("size").alias("source_size")
    )
    numbered = running(stored(groups, "mix-sources"), [], ["_no_src", "_src"], F.lit(1), "source_no", "mix-numbers")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = stored(
        numbered.withColumn("_weight", weight).withColumn("_most", (F.col("source_size") * most).cast("double")),
        "mix-weights",
    )
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("_weight") * level > F.col("_most") if level else F.lit(False)
        held, free = numbered.agg(
            F.sum(F.when(capped, F.col("_most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_weight")))
        ).first()
        fresh = (total - held) / free if free else level
        if not fresh > level:
            break
        level = fresh
    return numbered.withColumn("target", F.least(F.col("_weight") * level, F.col("_most"))).drop("_weight", "_most")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, rank, pass, block, source_size, words_from, words_to) of the whole mix.

    Points are looked up through ``CELLS`` or more equal cells, each with an equal share of the slots.
    A source whose points fall short of its target by a slot or two gets the
    missing ones at the end of the mix; points beyond its target go unused.
    """
    spark = targets.sparkSession
    need = F.floor(F.round("target")).cast("long")
    plan = targets.select("source_no", "source_size", need.alias("_need")).filter("_need > 0")
    plan = plan.withColumn("_blocks", F.ceil(F.col("source_size") / block)).withColumn(
        "_passes", F.floor(F.col("_need") / F.col("source_size"))
    )
    plan = plan.withColumn(
        "_slots",
        F.col("_passes") * F.col("_blocks") + F.ceil((F.col("_need") - F.col("_passes") * F.col("source_size")) / block),
    )
    plan = stored(running(stored(plan, "mix-plan"), [], ["source_no"], F.col("_slots"), "_before", "mix-before"), "mix-slots")
    total, sources = plan.agg(F.sum("_slots"), F.count("*")).first()
    total, cells = total or 0, max(CELLS, sources)
    # 32-bit product taken in two halves, so that it never leaves 64 bits
    low, high = F.col("slot") % 65536, F.floor(F.col("slot") / 65536) % 65536
    point = (((high * _STEP) % 65536) * 65536 + low * _STEP) % (1 << 32) / float(1 << 32)
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("_point", point)
    slots = slots.withColumn("_cell", F.floor(F.col("_point") * cells).cast("long"))
    wide = plan.withColumn("_low", F.col("_before") / float(max(total, 1))).withColumn(
        "_high", (F.col("_before") + F.col("_slots")) / float(max(total, 1))
    )
    ranges = wide.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_low") * cells), F.least(F.floor(F.col("_high") * cells), F.lit(cells - 1)))),
    ).select("_cell", "source_no", "_low", "_high", "_slots")
    drawn = slots.join(ranges, "_cell").filter("_point >= _low AND _point < _high").select("slot", "source_no", "_slots")
    ranked = running(stored(drawn, "mix-drawn"), ["source_no"], ["slot"], F.lit(1), "rank", "mix-ranks")
    got = ranked.groupBy("source_no").agg(F.count("*").alias("_got"))
    missing = (
        plan.join(got, "source_no", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .filter("_got < _slots")
        .select(
            F.lit(total).cast("long").alias("slot"),
            "source_no",
            F.explode(F.sequence("_got", F.col("_slots") - 1)).alias("rank"),
        )
    )
    used = ranked.filter("rank < _slots").select("slot", "source_no", "rank").unionByName(missing)
    shape = plan.select("source_no", "source_size", "_blocks", "_need", "_slots")
    total_slots = max(total, 1)
    out = join_groups(used, shape, ["source_no"], "_slots", total_slots)
    out = out.withColumn("pass", F.floor(F.col("rank") / F.col("_blocks"))).withColumn(
        "block", F.col("rank") % F.col("_blocks")
    )
    begin = F.col("block") * block
    end = F.least(begin + block, F.col("source_size"), F.col("_need") - F.col("pass") * F.col("source_size"))
    return out.select(
        "slot", "source_no", "rank", "pass", "block", "source_size", begin.alias("words_from"), end.alias("words_to")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_PASSES,
    block: int = BLOCK,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken), one row per document.

    ``taken`` counts the words that the mix takes from the document, repeats
    included; it never exceeds ``most`` times its size and the sums of a source
    come to its target rounded to a word. Null and empty texts have size 0 and
    take 0; a null source is a source of its own. Repeated rows are documents of
    their own. The layout depends on ``seed`` and the rows alone, so reruns agree.
    """
    sizes = stored(word_counts(docs, doc_id, text, source), "mix-sizes").withColumns(
        {"_src": F.coalesce("source", F.lit("")), "_no_src": F.col("source").isNull()}
    )
    targets = stored(source_targets(sizes, weights, most), "mix-targets")
    total = sizes.count()
    slots = schedule(targets, block)
    known = join_groups(sizes, targets, ["_src", "_no_src"], "source_docs", total).drop("_src", "_no_src", "source_docs")
    placed = running(
        known.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size")),
        ["source_no"],
        ["_key", "doc_id", "size"],
        F.col("size"),
        "_at",
        "mix-layout",
    ).drop("_key")
    placed = stored(placed, "mix-placed")
    # a block's slots of full passes, and where its last, shorter one ends
    full = F.col("words_to") >= F.least((F.col("block") + 1) * block, F.col("source_size"))
    uses = slots.groupBy("source_no", "block").agg(
        F.sum(F.when(full, 1).otherwise(0)).alias("_full"), F.max(F.when(~full, F.col("words_to"))).alias("_part")
    )
    some = placed.filter("size > 0")
    parts = some.select(
        "doc_id",
        "source_no",
        "_at",
        "size",
        F.explode(
            F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))
        ).alias("block"),
    )
    low = F.greatest(F.col("_at"), F.col("block") * block)
    high = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block)
    words = F.col("_full") * (high - low) + F.greatest(
        F.least(high, F.coalesce(F.col("_part"), F.lit(0))) - low, F.lit(0)
    )
    taken = (
        parts.join(uses, ["source_no", "block"])
        .groupBy("source_no", "_at")
        .agg(F.sum(words).cast("long").alias("taken"))
    )
    columns = ["doc_id", "size", "source", "source_size", "target"]
    found = some.join(taken, ["source_no", "_at"], "left").select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"))
    none = placed.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return found.unionByName(none)
