"""Static range asymmetric numeral coding of token ids in independent interleaved blocks.

One frequency table, made from all ids, serves every block. Inside a block, id i
belongs to lane i mod ``lanes``; all lanes advance together as one numpy vector.
A block carries a checkpoint (stream position and lane states) every ``every``
steps, each with the CRC of the ids that follow it, and a CRC of its stream, so
blocks and the segments inside a block can be decoded in parallel and checked.

Block layout, little-endian: ``RLA1``; eight u64 (ids, documents, lanes, steps
between checkpoints, checkpoints, stream words, stream CRC, bytes of the
document list); the document list (deflated i64 ids, u8 present flags, i64
lengths); u64 positions and u32 CRCs of the checkpoints; u64 states; u32 words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import flat, running, slices, stored
from rasterloom.llm.tokens import encoder

SCALE = 20
LANES = 1024
EVERY = 256
BLOCK_IDS = 1 << 19
MAGIC = b"RLA1"
_HEAD = 4 + 8 * 8


@dataclass(frozen=True)
class Model:
    """Quantised frequencies (sum 2^SCALE, none zero) and their running sums."""

    freq: np.ndarray
    cum: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray) -> "Model":
        """Rounds counts down to the scale; every id keeps at least one slot, the most frequent takes the rest."""
        room = (1 << SCALE) - len(counts)
        if room < 0:
            raise ValueError(f"{len(counts)} ids do not fit 2^{SCALE} slots")
        total = max(int(counts.sum()), 1)
        freq = np.array([1 + int(c) * room // total for c in counts], np.uint64)
        freq[int(np.argmax(counts))] += np.uint64((1 << SCALE) - int(freq.sum()))
        return Model(freq, np.cumsum(freq) - freq)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(
    ids: np.ndarray, doc_ids: list, lengths: np.ndarray, model: Model, lanes: int = LANES, every: int = EVERY
) -> bytes:
    """One self-contained block; ``lengths`` are the documents' shares of ``ids``."""
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, 1 << 31, np.uint64)
    words: list[np.ndarray] = []
    states, sizes = [], np.zeros(steps + 1, np.int64)
    shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        part = ids[t * lanes : (t + 1) * lanes]
        f, c = model.freq[part], model.cum[part]
        x = state[: len(part)]
        full = x >= (f << np.uint64(63 - SCALE))
        out = x[full]
        words.append((out & low).astype("<u4"))
        sizes[t + 1] = len(out)
        x[full] = out >> shift
        whole = x // f
        x[:] = (whole << np.uint64(SCALE)) + (x - whole * f) + c
        if t % every == 0:
            states.append(state.copy())
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks = range(0, steps, every)
    before = np.cumsum(sizes)
    crcs = [zlib.crc32(ids[t * lanes : (t + every) * lanes].astype("<u4").tobytes()) for t in marks]
    present = np.array([d is not None for d in doc_ids], np.uint8)
    listed = zlib.compress(
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
        + present.tobytes()
        + np.asarray(lengths, "<i8").tobytes(),
        1,
    )
    payload = stream.tobytes()
    head = np.array(
        [n, len(doc_ids), lanes, every, len(marks), len(stream), zlib.crc32(payload), len(listed)], "<u8"
    )
    return b"".join(
        [
            MAGIC,
            head.tobytes(),
            listed,
            before[list(marks)].astype("<u8").tobytes(),
            np.array(crcs, "<u4").tobytes(),
            *[s.astype("<u8").tobytes() for s in states[::-1]],
            payload,
        ]
    )


class Block:
    """Reads a block; ``segment(k)`` decodes from checkpoint k alone."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token block")
        head = np.frombuffer(raw, "<u8", 8, 4)
        self.n, self.docs, self.lanes, self.every, marks, words, crc, listed = (int(v) for v in head)
        names = zlib.decompress(raw[_HEAD : _HEAD + listed])
        present = np.frombuffer(names, np.uint8, self.docs, 8 * self.docs)
        self.doc_ids = [int(v) if p else None for v, p in zip(np.frombuffer(names, "<i8", self.docs), present)]
        self.lengths = np.frombuffer(names, "<i8", self.docs, 9 * self.docs)
        at = _HEAD + listed
        self.at = np.frombuffer(raw, "<u8", marks, at)
        self.crcs = np.frombuffer(raw, "<u4", marks, at + 8 * marks)
        at += 12 * marks
        self.states = np.frombuffer(raw, "<u8", marks * self.lanes, at).reshape(marks, self.lanes)
        at += 8 * marks * self.lanes
        if zlib.crc32(raw[at : at + 4 * words]) != crc:
            raise ValueError("a token block's stream is damaged")
        self.stream = np.frombuffer(raw, "<u4", words, at)

    def segment(self, k: int, model: Model, slots: np.ndarray) -> np.ndarray:
        begin = k * self.every * self.lanes
        end = min(self.n, (k + 1) * self.every * self.lanes)
        out = np.empty(end - begin, np.uint32)
        state, at = self.states[k].astype(np.uint64), int(self.at[k])
        mask, low = np.uint64((1 << SCALE) - 1), np.uint64(1 << 31)
        for start in range(0, len(out), self.lanes):
            width = min(self.lanes, len(out) - start)
            x = state[:width]
            slot = x & mask
            ids = slots[slot]
            out[start : start + width] = ids
            x[:] = model.freq[ids] * (x >> np.uint64(SCALE)) + slot - model.cum[ids]
            short = x < low
            need = int(short.sum())
            x[short] = (x[short] << np.uint64(32)) | self.stream[at : at + need]
            at += need
        if zlib.crc32(out.astype("<u4").tobytes()) != int(self.crcs[k]):
            raise ValueError(f"segment {k} of a token block is damaged")
        return out

    def decode(self, model: Model, slots: np.ndarray) -> np.ndarray:
        parts = [self.segment(k, model, slots) for k in range(len(self.at))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def token_table(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, packed): each whole text's ids and the end id, compressed; null is empty.

    Ids wait in this form between tokenizing and coding, which halves what is stored and shuffled.
    """

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze = encoder(vocabulary), pa.Codec("zstd", 3)
        for batch in slices(batches):
            ids, counts = coder.encode(*flat(batch.column("text")))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            ids = ids.astype("<u4" if wide else "<u2")
            ends = np.cumsum(counts)
            packed = [squeeze.compress(ids[e - n : e], asbytes=True) for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.where(wide, -counts, counts)), pa.array(packed, pa.binary())],
                ["doc_id", "n", "packed"],
            )

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(ids_of, "doc_id long, n long, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each row; a negative count marks four-byte ids."""
    squeeze = pa.Codec("zstd")
    for n, packed in zip(batch.column("n").to_pylist(), batch.column("packed")):
        kind, n = ("<u4", -n) if n < 0 else ("<u2", n)
        raw = squeeze.decompress(packed.as_buffer(), decompressed_size=n * int(kind[2]))
        yield np.frombuffer(raw, kind)


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each of the ``size`` ids of the vocabulary occurs; one count per id reaches the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "packed"):
            total += np.bincount(np.concatenate(list(_unpacked(batch))), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = tokens.select("n", "packed").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in rows.collect():
        out[row.id] = row.n
    return out


def write_blocks(tokens: DataFrame, model: Model, folder: str, block_ids: int = BLOCK_IDS) -> None:
    """Writes blocks of whole documents in ascending doc_id order (null first), range-partitioned.

    Files hold one block a row with its place (part, block) and first doc_id.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        made = total = 0

        def close() -> pa.RecordBatch:
            raw = encode_block(np.concatenate(parts), names, np.array(sizes), model)
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([raw], pa.binary())],
                ["block", "first_id", "data"],
            )

        for batch in slices(batches, "packed"):
            for name, ids in zip(batch.column("doc_id").to_pylist(), _unpacked(batch)):
                names.append(name)
                parts.append(ids)
                sizes.append(len(ids))
                total += sizes[-1]
                if total >= block_ids:
                    yield close()
                    names, parts, sizes, made, total = [], [], [], made + 1, 0
        if names:
            yield close()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, "block int, first_id long, data binary").withColumn(
        "part", F.spark_partition_id()
    ).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str, model: Model, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document in the files; with ``digest`` (doc_id, n_tokens, ids_crc32)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            for raw in batch.column("data"):
                block = Block(raw.as_buffer().to_pybytes())
                ids = block.decode(model, slots).astype("<u4")
                ends = np.cumsum(block.lengths)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends, block.lengths)]
                last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(block.lengths.astype(np.int64)), last],
                    ["doc_id", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids binary"
    return spark.read.parquet(folder).select("data").mapInArrow(rows, f"doc_id long, n_tokens long, {last}")


def encode_documents(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Tokenizes whole texts, fits the shared table on all of them, and writes the blocks to ``folder``.

    Texts are tokenized once; the ids are stored in between. Null and empty
    texts are the end id alone; repeated rows are written again; an empty table
    gives no blocks. Other columns are ignored.
    """
    tokens = stored(token_table(docs, vocabulary, end_id, doc_id, text), "token-ids")
    size = max(encoder(vocabulary).library.get_vocab_size(), end_id + 1)
    model = Model.fit(count_ids(tokens, size))
    write_blocks(tokens, model, folder)
    return model


def with_starts(read: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents with a smaller doc_id."""
    return running(stored(read, "token-digest"), [], ["doc_id"], F.col("n_tokens"), "start", "token-starts")
