"""What a worker holds: batches of bounded bytes, free memory given back, a bounded table of known parts."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import chosen_path, packing, repetition
from rasterloom.llm.common import flat, stored

LIMIT = 8 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Runs a function of record batches as a task does; prints the MB it holds at the end beyond those at the start.
TASK = """
import pickle, random, re, sys
import numpy, pyarrow as pa
import rasterloom.llm.packing, rasterloom.llm.repetition, rasterloom.llm.chosen_path

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(30_000)]
    for n in range(4):
        texts = [" ".join(rng.choices(words, k=rng.randint(1, 1200))) for _ in range(900)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "text": texts})

task = pickle.load(open(sys.argv[1], "rb"))
made = iter(batches())
before = held()
for out in task(made):
    del out
print(held() - before)
"""


def _seen(docs):
    """(doc_id, kept): whether a document came to Python in a batch of bounded bytes."""

    def look(batches):
        for batch in batches:
            fine = batch.nbytes <= 8 << 20
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fine] * batch.num_rows)], ["doc_id", "kept"])

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, kept boolean")


def test_stages_hand_over_narrow_batches(spark, monkeypatch):
    docs = spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', 60000)").alias("text"))
    before = spark.conf.get(SETTING)
    monkeypatch.setattr(repetition, "repetition_rules", _seen)
    monkeypatch.setattr(chosen_path, "near_duplicates", _seen)
    monkeypatch.setattr(packing, "pack_documents", lambda docs, *_, **__: stored(_seen(docs), "test-seen").filter("kept"))
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.pack):
        assert stage(spark, docs, "").count() == 100
        assert spark.conf.get(SETTING) == before


def test_setting_returns_after_a_failure(spark, docs, monkeypatch):
    before = spark.conf.get(SETTING)

    def fails(docs):
        raise ValueError("no")

    monkeypatch.setattr(repetition, "repetition_rules", fails)
    with pytest.raises(ValueError, match="no"):
        corpus_pipeline.quality(spark, docs, "")
    assert spark.conf.get(SETTING) == before


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
@pytest.mark.parametrize(
    "operator, most",
    [
        (repetition.repetition_rules, 60),
        (lambda docs: packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1), 100),
        (lambda docs: chosen_path.signatures(docs, 5), 50),
    ],
    ids=["repetition", "pieces", "signatures"],
)
def test_worker_gives_memory_back(docs, monkeypatch, tmp_path, operator, most):
    tasks = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, task, schema, **_: tasks.append(task) or self)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema, **_: tasks.append(task) or self)
    operator(docs)
    (tmp_path / "task").write_bytes(cloudpickle.dumps(tasks[0]))
    root = Path(repetition.__file__).resolve().parents[2]
    run = subprocess.run(
        [sys.executable, "-c", TASK, str(tmp_path / "task")], cwd=root, capture_output=True, text=True, timeout=120
    )
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < most


def test_table_of_parts_is_bounded_by_ids():
    from rasterloom.llm.tokens import ENTRY_IDS, Encoder

    rng, entries = random.Random(3), 2000
    coder = Encoder(public_tokenizers.path("word_bpe_49k.json"), entries)
    for _ in range(12):
        texts = [" ".join("".join(rng.choices("qxzjkvw", k=400)) for _ in range(20)) for _ in range(5)]
        ids, counts = coder.encode(*flat(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in coder.slow(t)]
        assert len(coder.pool) <= ENTRY_IDS * entries + len(ids)
