"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded
(frequencies of neighbouring character classes, lengths, repetition), a gated
attention learned from document labels alone weighs the passages, and the
weighted representation is scored. Nothing but the text goes into a score.

Passages have ``PASSAGE_WORDS`` words; a text with more than ``MOST_PASSAGES``
of them gets as many, longer passages, so a bag is bounded and every word is
read. Training uses a bounded sample, ``train_rows`` labelled documents (those
whose doc_id and text hash lowest), because a model of some ten thousand weights
learns nothing more from further rows; all documents are scored, in tasks, by a
model of fixed size.

Cases: null and empty texts are one passage without words. Null labels are no
labels; a doc_id with several labels takes their mean, rounded up. Rows that
repeat a doc_id are learned and scored one by one; a null doc_id is never
learned from and, having no remainder, not held out. Without labelled rows, or
with one class only, every score is the share of good labels (0.5 without any).
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.llm.common import flat, slices
from rasterloom.llm.words import distinct_keys, mix, words_of

PASSAGE_WORDS = 48
MOST_PASSAGES = 32
TRAIN_ROWS = 6000
THRESHOLD = 0.3
HIDDEN, GATES = 32, 16
EPOCHS, BAGS, RATE, DECAY = 30, 32, 4e-3, 1e-4

# Classes of bytes; neighbouring pairs of them describe how a text looks in any language.
_GROUPS = (b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"!?", b"'\"-()", b"|", b"#*$%&", b"<>/=_@\\{}[]~^+`")
CLASSES = len(_GROUPS) + 2  # and other ASCII, and bytes from 0x80 on
_CLASS = np.full(256, len(_GROUPS), np.int64)
_CLASS[128:] = len(_GROUPS) + 1
for _n, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _n
PAIRS = CLASSES * CLASSES
EXTRAS = 7
WIDTH = PAIRS + EXTRAS


def _share(mask: np.ndarray, at: np.ndarray, per: np.ndarray) -> np.ndarray:
    return np.bincount(at, mask, minlength=len(per)) / np.maximum(per, 1)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Marks keys that an earlier place holds too."""
    again = np.ones(len(keys), bool)
    _, place, back = distinct_keys(keys)
    first = np.full(len(place), len(keys))
    np.minimum.at(first, back, np.arange(len(keys)))
    again[first] = False
    return again


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of several texts, and each text's number of passages (at least one)."""
    words = words_of(data, offsets)
    size = np.maximum(PASSAGE_WORDS, -(-words.per_doc // MOST_PASSAGES))
    bags = np.maximum(1, -(-words.per_doc // size))
    first_word = np.cumsum(words.per_doc) - words.per_doc
    first_bag = np.cumsum(bags) - bags
    rank = np.arange(len(words.start)) - first_word[words.doc]
    of_word = first_bag[words.doc] + rank // size[words.doc]
    total = int(bags.sum())

    # a passage runs from its first word, the first one from the text's first byte
    begin = np.repeat(offsets[:-1], bags)
    opens = np.flatnonzero((rank % size[words.doc] == 0) & (rank > 0))
    begin[of_word[opens]] = words.start[opens]
    ends = np.append(begin[1:], len(data))
    of_byte = np.repeat(np.arange(total), ends - begin)

    out = np.zeros((total, WIDTH), np.float32)
    if len(data) > 1:
        kind = _CLASS[data]
        inside = np.ones(len(data) - 1, bool)
        cuts = offsets[1:-1] - 1
        inside[cuts[(cuts >= 0) & (cuts < len(data) - 1)]] = False
        cell = (of_byte[:-1] * PAIRS + kind[:-1] * CLASSES + kind[1:])[inside]
        pairs = np.bincount(cell, minlength=total * PAIRS).reshape(total, PAIRS)
        out[:, :PAIRS] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    per = np.bincount(of_word, minlength=total)
    length = words.length.astype(np.float64)
    mean = _share(length, of_word, per)
    salt = mix(words.doc.astype(np.uint64) + np.uint64(1))
    again = _repeats(words.hash ^ salt)
    again_two = np.zeros(len(words.hash), bool)
    second = np.flatnonzero(rank > 0)  # a pair's second word; no pair spans two texts
    with np.errstate(over="ignore"):
        both = mix(words.hash[second - 1] * np.uint64(3) + words.hash[second]) ^ salt[second]
    again_two[second] = _repeats(both)
    out[:, PAIRS:] = np.stack(
        [
            np.log1p(per),
            mean,
            np.sqrt(np.maximum(_share(length**2, of_word, per) - mean**2, 0)),
            _share(again, of_word, per),
            _share(again_two, of_word, per),
            np.log1p(np.repeat(words.per_doc, bags)),
            _share(length > 20, of_word, per),
        ],
        axis=1,
    )
    return out, bags


# -- the model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Encoder, gated attention and scorer; ``weights`` is None where there was nothing to tell apart."""

    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags of passages; ``x`` is standardized."""
        w = self.weights
        starts = np.cumsum(bags) - bags
        h = np.tanh(x @ w["encode"] + w["encode0"])
        view, gate = np.tanh(h @ w["view"]), _sigmoid(h @ w["gate"])
        pull = (view * gate) @ w["pull"]
        pull = np.exp(pull - np.repeat(np.maximum.reduceat(pull, starts), bags))
        share = pull / np.repeat(np.add.reduceat(pull, starts), bags)
        z = np.add.reduceat(share[:, None] * h, starts)
        return {"h": h, "view": view, "gate": gate, "share": share, "z": z, "score": _sigmoid(z @ w["out"] + w["out0"])}

    def gradients(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; attention is learned from document labels alone."""
        w, f = self.weights, self.forward(x, bags)
        starts = np.cumsum(bags) - bags
        miss = (f["score"] - label) / len(bags)
        to_z = np.repeat(miss[:, None] * w["out"][None, :], bags, axis=0)
        to_share = (to_z * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["share"] * to_share, starts), bags)
        to_pull = f["share"] * (to_share - mean)
        to_view = to_pull[:, None] * w["pull"] * f["gate"] * (1 - f["view"] ** 2)
        to_gate = to_pull[:, None] * w["pull"] * f["view"] * f["gate"] * (1 - f["gate"])
        to_h = f["share"][:, None] * to_z + to_view @ w["view"].T + to_gate @ w["gate"].T
        to_in = to_h * (1 - f["h"] ** 2)
        return {
            "encode": x.T @ to_in,
            "encode0": to_in.sum(axis=0),
            "view": f["h"].T @ to_view,
            "gate": f["h"].T @ to_gate,
            "pull": (f["view"] * f["gate"]).T @ to_pull,
            "out": f["z"].T @ miss,
            "out0": miss.sum(keepdims=True),
        }

    def score(self, features: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents and the attention of their passages."""
        if self.weights is None:
            return np.full(len(bags), self.prior), np.repeat(1.0 / bags, bags)
        f = self.forward((features - self.shift) / self.scale, bags)
        return f["score"], f["share"]


def train(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fits a model to whole bags by mini-batches; the same bags in the same order give the same model."""
    if not len(labels):
        return Model(0.5)
    if len(np.unique(labels)) < 2:
        return Model(float(labels.mean()))
    rng = np.random.default_rng(20)
    every = np.concatenate(bags).astype(np.float64)
    model = Model(float(labels.mean()), every.mean(axis=0), every.std(axis=0) + 1e-2)
    bags = [(b - model.shift) / model.scale for b in bags]

    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    model.weights = {
        "encode": normal(WIDTH, HIDDEN),
        "encode0": np.zeros(HIDDEN),
        "view": normal(HIDDEN, GATES),
        "gate": normal(HIDDEN, GATES),
        "pull": normal(GATES),
        "out": normal(HIDDEN),
        "out0": np.zeros(1),
    }
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    sizes, step = np.array([len(b) for b in bags]), 0
    steps = EPOCHS * -(-len(bags) // BAGS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), BAGS):
            pick = order[start : start + BAGS]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in model.gradients(np.concatenate([bags[i] for i in pick]), sizes[pick], labels[pick]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                change = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                model.weights[k] -= rate * (change + DECAY * model.weights[k])
    return model


# -- rows


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices([batch]):
            features, bags = passages(*flat(piece.column("text")))
            ends = np.cumsum(bags)
            rows = [features[e - n : e].tobytes() for e, n in zip(ends.tolist(), bags.tolist())]
            yield pa.RecordBatch.from_arrays(
                [piece.column("label"), piece.column("order"), pa.array(rows, pa.binary())], ["label", "order", "bag"]
            )


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels`` (doc_id, quality) from at most ``train_rows`` documents that aren't held out.

    Tasks find and encode the sample; bags of bounded size come to the driver, where the model is trained.
    """
    known = labels.filter(F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "label", F.xxhash64("doc_id", "text").alias("order"))
    found = rows.mapInArrow(_bags, "label int, order long, bag binary").orderBy("order", "bag").limit(train_rows)
    picked = found.collect()
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in picked]
    return train(bags, np.array([r["label"] for r in picked], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every document, with the weight of its heaviest passage."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("score double, n_passages int, heaviest double")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices([batch]):
                features, bags = passages(*flat(piece.column("text")))
                scores, share = model.score(features, bags)
                most = np.maximum.reduceat(share, np.cumsum(bags) - bags)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(scores), pa.array(bags.astype(np.int32)), pa.array(most)], schema=arrow
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the attention's digest of every document."""
    scored = score(docs, fit(docs, labels))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_passages",
        "heaviest",
    )
