"""Large groups of near copies: links as few as parts, texts that stay where they are, tables that are deleted."""

from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_crossing import brute, joined, made

from rasterloom.llm import chosen_path, common
from rasterloom.llm.common import by_mark, ship


def test_block_links_are_fewer_than_parts():
    one = np.arange(50, dtype="<u8")
    members = [(rep, rep, one) for rep in range(200)]
    links = chosen_path.block_links(members, members, 80)
    assert len(links) == 199 and joined(links, members) == {frozenset(range(200))}
    members = made(5, 80)
    links = chosen_path.block_links(members[:50], members[30:], 80)
    want = [e for e in brute(members) if min(e) < 50 and max(e) >= 30]
    want = [(u, v) for u, v in want if (u < 50 and v >= 30) or (v < 50 and u >= 30)]
    assert joined(links, members) == joined(want, members)
    assert len(links) < len({p for _, p, _ in members})


@pytest.mark.parametrize("bits", [1 << 25, 8])
def test_by_mark(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MARK_BITS", bits)
    ids = [*range(-50, 400), None, 1 << 60, 7, 7]
    rows = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, _mark_bits string").repartition(3)
    some, sure = by_mark(rows, "doc_id", spark.createDataFrame([(i,) for i in (7, -50, None, 399, 399)], "id long"))
    assert some.columns == sure.columns == rows.columns
    first, second = ([r[1] for r in half.collect()] for half in (some, sure))
    assert sorted(first + second) == sorted(f"t{n}" for n in range(len(ids)))
    assert {f"t{n}" for n, i in enumerate(ids) if i in (7, -50, None, 399)} <= set(first)
    assert bits < 99 or len(first) < 10
    some, sure = by_mark(rows, "doc_id", spark.createDataFrame([], "id long"))
    assert some.collect() == [] and sure.count() == len(ids)


def test_only_keeps_ids_and_shuffles_no_sure_row(spark):
    ship(spark)
    docs = spark.createDataFrame([(n % 90 if n % 11 else None, f"t{n}") for n in range(200)], "doc_id long, text string")
    # an id is kept if one of its rows is; null ids are all dropped
    kept = F.when(F.col("doc_id") % 3 == 0, F.col("text") < "t4").when(F.col("doc_id").isNull(), None).otherwise(True)
    got = corpus_pipeline._only(docs, lambda: docs.withColumn("kept", kept))
    want = docs.join(docs.filter(kept).select("doc_id").distinct(), "doc_id", "left_semi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not any(r.doc_id is None for r in got.collect())
    kept = F.col("doc_id").isNull()
    got = corpus_pipeline._only(docs, lambda: docs.withColumn("kept", kept))
    assert {r.doc_id for r in got.collect()} == {None} and got.count() == 19
    some, sure = by_mark(docs, "doc_id", spark.createDataFrame([(1,)], "id long"))
    plan = sure._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "text" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_tables_of_rounds_are_deleted(spark, docs):
    at = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(at.iterdir())
    chosen_path.near_duplicates(docs, 5, chosen_path.Search(node=2, last_depth=4)).collect()
    left = {p.name.rsplit("-", 1)[0] if len(p.name) > 36 else p.name for p in set(at.iterdir()) - before}
    left = {name for name in left if name.startswith("path-")}
    assert left == {"path-signatures", "path-classes", "path-links", "path-more", "path-components"}
