"""Passages, gradients and held-out accuracy of the quality classifier."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.llm import attention
from rasterloom.llm.common import flat, ship
from rasterloom.llm.words import words_of


def bags(texts):
    return attention.passages(*flat(pa.array(texts, pa.string())))


def test_passages_cover_whole_texts():
    rng = random.Random(1)
    texts = [None, "", " \n ", "one", "w " * 48, "w " * 49, "ab! " * 5000, "x" * 5000, "É中 | # $"]
    texts += [" ".join(rng.choice(["aa", "B", "c.", "12"]) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    features, counts = bags(texts)
    assert counts.tolist() == [
        max(1, -(-n // max(48, -(-n // 32)))) for n in (len((t or "").split(None)) for t in texts)
    ]
    assert np.isfinite(features).all() and counts.max() <= attention.MOST_PASSAGES
    start = 0
    for text, n in zip(texts, counts):
        alone, one = bags([text])
        assert one[0] == n and (alone == features[start : start + n]).all()  # neighbours change nothing
        start += n
    # words of all passages are words of the text
    _, long = bags(["ab! " * 5000])
    per = np.expm1(bags(["ab! " * 5000])[0][:, attention.PAIRS])
    assert round(float(per.sum())) == len(words_of(*flat(pa.array(["ab! " * 5000]))).start) == 5000 and long[0] == 32


def test_gradients():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 3, 2, 5])
    x, y = rng.normal(size=(11, attention.WIDTH)) * 0.3, np.array([0.0, 1.0, 1.0, 0.0])
    model = attention.train([x[:4], x[4:]], np.array([0.0, 1.0]))

    def loss():
        s = model.forward(x, sizes)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, gradient in model.gradients(x, sizes, y).items():
        weights = model.weights[name].reshape(-1)
        for i in rng.integers(0, len(weights), 6):
            old, step = weights[i], 1e-5
            weights[i] = old + step
            up = loss()
            weights[i] = old - step
            down = loss()
            weights[i] = old
            assert abs((up - down) / (2 * step) - gradient.reshape(-1)[i]) < 1e-6 + 1e-4 * abs(gradient.reshape(-1)[i])


def test_attention_finds_the_passage():
    """Bags whose label hangs on one passage among several: attention goes there."""
    rng = np.random.default_rng(3)
    x = [rng.normal(0, 0.2, (6, attention.WIDTH)) for _ in range(300)]
    y = np.array([float(i % 3 == 0) for i in range(300)])
    where = rng.integers(0, 6, 300)
    for i in range(300):
        if y[i]:
            x[i][where[i], :20] += 2.0
    model = attention.train(x, y)
    score, share = model.score(np.concatenate(x), np.full(300, 6))
    assert ((score >= 0.5) == y).mean() > 0.98
    share = share.reshape(300, 6)
    assert (share[y == 1].argmax(axis=1) == where[y == 1]).mean() > 0.95


def test_held_out_accuracy(spark):
    ship(spark)
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = attention.quality_scores(docs, labels)
    rows = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert out.count() == docs.count()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(bad) >= 5 and sum(r.predicted for r in good) >= 0.95 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.8 * len(bad)
    again = attention.quality_scores(docs.repartition(7), labels.repartition(3))
    first, second = ({r.doc_id: r.score for r in x.collect()} for x in (out, again))
    assert first == second


def test_awkward_rows(spark, docs, wide, none):
    ship(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (None, 1, 0), (4, 0, 1), (4, 1, 1), (99_999, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    out = {r.doc_id: r for r in attention.quality_scores(docs, labels).collect()}
    assert len(out) == docs.count()
    for i, r in out.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    clashing = wide.withColumns({"quality": F.lit(1), "label": F.lit(0), "order": F.lit(1), "bag": F.lit(0), "score": F.lit(9)})
    assert {r.doc_id: r.score for r in attention.quality_scores(clashing, labels).collect()} == {i: r.score for i, r in out.items()}
    assert attention.quality_scores(none, labels).collect() == []
    assert {r.score for r in attention.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in attention.quality_scores(docs, labels.withColumn("quality", F.lit(1))).collect()} == {1.0}
    nobody = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.held_out, r.score) for r in attention.quality_scores(nobody, labels).collect()} == {(False, 0.5)}
