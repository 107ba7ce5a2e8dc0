"""Language-model scores by prediction by partial matching over bytes.

Training texts give counts of each byte after its contexts of up to ``order``
bytes; together the contexts are a trie, held as a table. A byte unseen after a
context escapes to the next shorter one. Escape mass follows method D (each
distinct follower gives up half a count), and symbols that a longer context has
seen are excluded from the shorter ones. The model is fixed once
trained, so the probability of a context and byte is worked out once per
distinct pair, in joins, and not once per position.

No table is sent whole to any task. Each input partition lists its distinct
words and byte strings, the joined values come back by partition, and the texts
are scored beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import flat, slices, stored
from rasterloom.llm.words import LOWER, distinct_keys, words_of

ORDER = 4
END = 256  # the symbol after the last byte
SYMBOLS = 257
FOLDS, HELD_OUT = 5, 1
_ORDER_BITS, _SYMBOL_BITS = 59, 9  # so that six context bytes fit between them
# Entries gathered in a task before equal ones are added up.
_GATHER = 3_000_000


def held_out(doc_ids: list) -> np.ndarray:
    """Documents that the model does not learn from; a null id is learned from."""
    return np.array([d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids], bool)


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every byte with its context and of the end of each text.

    A key holds the context's length, its bytes, and the symbol.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets) + 1
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(n), lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    stream = np.full(len(place), END, np.int64)
    inner = np.ones(len(place), bool)
    inner[starts + lengths - 1] = False
    stream[inner] = LOWER[data]
    context = np.zeros(len(place), np.int64)
    for back in range(1, order + 1):
        earlier = np.zeros(len(place), np.int64)
        earlier[back:] = stream[:-back]
        earlier[place < back] = 0
        context |= earlier << (8 * (back - 1))
    used = np.minimum(place, order)
    return (used << _ORDER_BITS) | (context << _SYMBOL_BITS) | stream, text


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text) of every word, and the words of each text. Word keys are negative."""
    found = words_of(LOWER[data], offsets)
    keys = ((found.hash >> np.uint64(1)) | np.uint64(1 << 63)).view(np.int64)
    return keys, found.doc, found.per_doc


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    distinct, _, back = distinct_keys(keys)
    return distinct, np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def _listed(docs: DataFrame, order: int) -> DataFrame:
    """(part, key, n): distinct keys of each input partition and how often training texts have them."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts, held = TaskContext.get().partitionId(), [], 0
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            train = ~held_out(batch.column("doc_id").to_pylist())
            for key, text in (gram_keys(data, offsets, order), word_keys(data, offsets)[:2]):
                distinct, _, back = distinct_keys(key)
                parts.append((distinct, np.bincount(back, weights=train[text], minlength=len(distinct))))
                held += len(distinct)
            if held > _GATHER:
                parts = [_added(parts)]
                held = len(parts[0][0])
        if parts:
            key, n = _added(parts)
            for at in range(0, len(key), 100_000):
                k = key[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(n[at : at + 100_000])],
                    ["part", "key", "n"],
                )

    return docs.mapInArrow(keys, "part int, key long, n long")


def trie(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """The context trie from training counts of keys, as two stored tables.

    followers (k, ctx, s, c): symbol s came c times after the context of k bytes.
    nodes (k, ctx, t, u, ex_t, ex_u): all and distinct followers of a context;
    and of its shorter context, once this one's followers are excluded.
    """
    seen = counts.filter("key >= 0 AND n > 0")
    k = F.expr(f"posexplode(sequence(0, cast(shiftright(key, {_ORDER_BITS}) as int)))").alias("k", "_k")
    followers = stored(
        seen.select("key", "n", k)
        .select("k", F.expr(_sql_context("k")).alias("ctx"), (F.col("key") % (1 << _SYMBOL_BITS)).cast("int").alias("s"), "n")
        .groupBy("k", "ctx", "s")
        .agg(F.sum("n").alias("c")),
        "ppm-followers",
    )
    totals = stored(
        followers.groupBy("k", "ctx").agg(F.sum("c").alias("t"), F.count("*").alias("u")), "ppm-totals"
    )
    shorter = F.expr("ctx & (shiftleft(1L, 8 * (k - 1)) - 1)")
    above = followers.filter("k > 0").select("k", "ctx", "s", (F.col("k") - 1).alias("_k"), shorter.alias("_ctx"))
    below = followers.select(F.col("k").alias("_k"), F.col("ctx").alias("_ctx"), "s", "c")
    both = above.join(below, ["_k", "_ctx", "s"]).groupBy("k", "ctx").agg(F.sum("c").alias("_d"))
    up = totals.filter("k > 0").select("k", "ctx", "t", "u", (F.col("k") - 1).alias("_k"), shorter.alias("_ctx"))
    parents = totals.select(F.col("k").alias("_k"), F.col("ctx").alias("_ctx"), F.col("t").alias("_t"), F.col("u").alias("_u"))
    low = F.col("_k") <= 1
    # contexts of at most one byte number 257, so that part of the parents has a fixed bound
    met = up.filter(~low).join(parents.filter(~low), ["_k", "_ctx"]).unionByName(
        up.filter(low).join(F.broadcast(parents.filter(low)), ["_k", "_ctx"])
    )
    nodes = met.join(both, ["k", "ctx"]).select(
        "k", "ctx", "t", "u", (F.col("_t") - F.col("_d")).alias("ex_t"), (F.col("_u") - F.col("u")).alias("ex_u")
    )
    root = totals.filter("k = 0").select("k", "ctx", "t", "u", F.lit(0).cast("long").alias("ex_t"), F.lit(0).cast("long").alias("ex_u"))
    return followers, stored(nodes.unionByName(root), "ppm-nodes")


def _sql_context(k: str) -> str:
    return f"shiftright(key, {_SYMBOL_BITS}) & (shiftleft(1L, 8 * {k}) - 1)"


def gram_scores(keys: DataFrame, followers: DataFrame, nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 probability of each distinct key's symbol after its context."""
    k = F.expr(f"posexplode(sequence(0, cast(shiftright(key, {_ORDER_BITS}) as int)))").alias("k", "_k")
    asked = keys.select("key", k).select(
        "key", "k", F.expr(_sql_context("k")).alias("ctx"), (F.col("key") % (1 << _SYMBOL_BITS)).cast("int").alias("s")
    )
    low = F.col("k") <= 1
    high_rows, low_rows = asked.filter(~low), asked.filter(low)
    # up to one byte of context: at most 257 contexts and 257 followers each
    found = (
        high_rows.join(followers.filter(~low), ["k", "ctx", "s"], "left")
        .join(nodes.filter(~low), ["k", "ctx"], "left")
        .unionByName(
            low_rows.join(F.broadcast(followers.filter(low)), ["k", "ctx", "s"], "left").join(
                F.broadcast(nodes.filter(low)), ["k", "ctx"], "left"
            )
        )
    )
    step = F.struct("c", "t", "u", "ex_t", "ex_u")
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("k") == j, step)).alias(f"o{j}") for j in range(order + 1)])
    value, done = F.lit(0.0), F.lit(False)
    longer = None
    for j in range(order, -1, -1):
        at = F.col(f"o{j}")
        here = at["t"].isNotNull()
        if longer is None:
            t, u = at["t"], at["u"]
        else:
            t, u = F.coalesce(longer["ex_t"], at["t"]), F.coalesce(longer["ex_u"], at["u"])
        hit = here & at["c"].isNotNull()
        part = F.when(hit, F.log10((at["c"] - 0.5) / t)).when(here & (u > 0), F.log10(u / (2 * t))).otherwise(0.0)
        value = value + F.when(done, 0.0).otherwise(part)
        done = done | hit
        longer = at
    rest = -F.log10(F.lit(SYMBOLS) - F.coalesce(F.col("o0")["u"], F.lit(0)))
    return wide.select("key", (value + F.when(done, 0.0).otherwise(rest)).alias("value"))


def scores(
    docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", scanned: bool = False
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the whole text, A-Z lower-cased, and
    its end under the byte model; ``base_score`` is that of its words under
    unigram counts. Null and empty texts score their end alone. Repeated rows
    are learned from and scored each. Other columns are ignored. ``scanned``
    says that ``docs`` is a plain file scan, whose partitions come out the same
    when it is read again; other inputs are stored first.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not scanned:
        docs = stored(docs, "ppm-docs")
    listed = stored(_listed(docs, order), "ppm-keys")
    counts = stored(listed.groupBy("key").agg(F.sum("n").alias("n")), "ppm-counts")
    # the end of a text is learned once per training text: all its end symbols
    ends = F.when((F.col("key") >= 0) & (F.col("key") % (1 << _SYMBOL_BITS) == END), F.col("n"))
    words = F.when(F.col("key") < 0, F.col("n"))
    first = counts.agg(F.sum(words), F.sum(F.when(words > 0, 1)), F.sum(ends)).first()
    n_words, distinct, texts = (v or 0 for v in first)
    total, size = n_words + texts, distinct + (texts > 0)
    followers, nodes = trie(counts, order)
    values = gram_scores(counts.filter("key >= 0").select("key"), followers, nodes, order).unionByName(
        counts.filter("key < 0").select("key", F.col("n").cast("double").alias("value"))
    )
    back = listed.select("part", "key").join(values, "key")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        key = right.column("key").to_numpy()
        order_ = np.argsort(key)
        key, value = key[order_], right.column("value").to_numpy()[order_]
        share = 0.5 * (size + 1)

        def look(keys: np.ndarray) -> np.ndarray:
            distinct_, _, places = distinct_keys(keys)
            at = np.searchsorted(key, distinct_)
            if len(distinct_) and (at[-1] >= len(key) or (key[at] != distinct_).any()):
                raise RuntimeError("the input's partitions changed between two reads; pass scanned=False")
            return value[at][places]

        out = []
        for batch in slices(iter(left.to_batches())):
            data, offsets = flat(batch.column("text"))
            n = batch.num_rows
            grams, owner = gram_keys(data, offsets, order)
            model = np.bincount(owner, weights=look(grams), minlength=n)
            keys, owner, per_doc = word_keys(data, offsets)
            count = look(keys)
            base = np.bincount(owner, weights=np.log10((count + 0.5) / (total + share)), minlength=n)
            base = base + np.log10((texts + 0.5) / (total + share))
            known = np.bincount(owner, weights=count > 0, minlength=n).astype(np.int64) + (texts > 0)
            ids = batch.column("doc_id")
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(held_out(ids.to_pylist())),
                        pa.array(per_doc.astype(np.int64) + 1),
                        pa.array(known),
                        pa.array(np.full(n, total, np.int64)),
                        pa.array(base),
                        pa.array(model),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not out:
            kinds = [left.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        return pa.Table.from_batches(out)

    placed = docs.withColumn("part", F.spark_partition_id())
    return (
        placed.groupBy("part")
        .cogroup(back.groupBy("part"))
        .applyInArrow(
            score,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
