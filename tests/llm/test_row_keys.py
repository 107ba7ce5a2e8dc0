"""Null ids, ids that several texts share, repeated rows, and a text over the pieces that long ones are cut into."""

import collections
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import packing, repetition, substrings, transducer
from rasterloom.llm.common import ship
from tests.llm.conftest import SCHEMA
from tests.llm.test_documents import brute_repeats, brute_repetition, text_of


@pytest.fixture(scope="module")
def mixed(rows):
    """The awkward corpus with some ids taken away, some shared by other texts, and some rows twice."""
    out = []
    for i, (doc_id, *rest) in enumerate(rows):
        if len(rest[0] or "") > 20_000:
            continue
        out.append((None if i % 5 == 0 else 7 if i % 5 == 1 else doc_id, *rest))
    passage = " ".join(f"w{i}" for i in range(80))
    out += [(None, f"{x} {passage} {x}", "en", "s0", 0) for x in ("left", "other", None)]
    out += [(7, f"{passage} at the front {x}", "en", "s1", 0) for x in "ab"]
    return out + out[3:9]


@pytest.fixture(scope="module")
def frame(spark, mixed):
    ship(spark)
    return spark.createDataFrame(mixed, SCHEMA).repartition(4)


def counted(values):
    return collections.Counter(values)


@pytest.mark.parametrize("together", [256, 1])
def test_repeats(frame, mixed, together):
    got = substrings.repeated_substrings(frame, length=60, gram=12, together=together).collect()
    want = brute_repeats([text_of(r).encode() for r in mixed], 60)
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_text)) for r in got) == counted(
        (row[0], *expected) for row, expected in zip(mixed, want)
    )


def test_repeats_in_a_very_long_text(spark, monkeypatch):
    """A text of many pieces, with the same passages inside, at the borders of pieces and in others."""
    ship(spark)
    monkeypatch.setattr(substrings, "CHUNK", 5000)
    words = " ".join(str(i * 7919) for i in range(6000))
    passage = "p" + " ".join(str(i) for i in range(60))
    long = words[:4900] + passage + words[4900:14_950] + passage + words[14_950:]
    rows = [(1, long), (None, "x " + passage), (None, words[20_000:20_300]), (1, "short")]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA).repartition(3)
    got = substrings.repeated_substrings(df).collect()
    want = brute_repeats([t.encode() for _, t in rows], substrings.LENGTH)
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_text)) for r in got) == counted(
        (row[0], *expected) for row, expected in zip(rows, want)
    )


def test_rules(frame, mixed):
    rules = repetition.Rules()
    got = counted((r.doc_id, r.n_words, r.n_repeat_words) for r in repetition.repetition_rules(frame).collect())
    want = [brute_repetition(text_of(r), rules.min_words) for r in mixed]
    assert got == counted((row[0], w[0], w[4]) for row, w in zip(mixed, want))


def test_counts_and_packing(frame, mixed):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = counted((r.doc_id, r.n_tokens) for r in transducer.token_counts(frame, path).collect())
    assert got == counted((r[0], len(library.encode(text_of(r), add_special_tokens=False).ids)) for r in mixed)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    packed = packing.pack_documents(frame, path, end_id=1)
    want = []
    for row in mixed:
        ids = [*library.encode(text_of(row), add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            want.append((row[0], start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert counted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed.collect()) == counted(want)
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert all(r.n == r.end <= 4096 for r in full.collect())
