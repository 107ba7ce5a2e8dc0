"""Per-pixel feature vectors scored against text prompts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import vectors
from rasterloom.operators.joins import lookup_join
from rasterloom.session import cut_lineage

PIXEL = ("image", "y", "x")


def map_vectors(df: DataFrame, fn, source: str, target: str) -> DataFrame:
    """Add ``target`` = fn(matrix of ``source`` vectors), one Arrow batch at a time.

    For dense linear algebra on wide vectors, where a matrix product per batch is
    far cheaper than array expressions per row. ``fn`` maps (n, d) to (n, k).
    """
    kept = [f for f in df.schema.fields if f.name != target]
    schema = T.StructType([*kept, T.StructField(target, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # list columns of equal lengths are one flat buffer: no row is touched singly
            flat = batch.column(source).flatten().to_numpy(zero_copy_only=False)
            result = np.asarray(fn(flat.reshape(batch.num_rows, -1)), dtype=np.float64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * result.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(result.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], [*names, target])

    return df.mapInArrow(run, schema)


def decode_vectors(
    df: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray]], source: str = "feature", target: str = "feature"
) -> DataFrame:
    """Dense layers (weight (out, in), bias) with ReLU between them; results have length one."""

    def run(x: np.ndarray) -> np.ndarray:
        for i, (weight, bias) in enumerate(layers):
            x = x if i == 0 else np.maximum(x, 0.0)
            x = x @ weight.T + bias
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    if source != target:
        return map_vectors(df, run, source, target)
    return map_vectors(df.withColumnRenamed(source, "_in"), run, "_in", target).drop("_in")


def similarities(df: DataFrame, prompts: Sequence[Sequence[float]], target: str, dense: bool = False) -> DataFrame:
    """Array of inner products of ``feature`` with each prompt vector.

    The prompts ride along in the expression (or, for ``dense``, in the batch
    function), so a pixel is never multiplied into prompt rows.
    """
    if dense:
        table = np.asarray(prompts, dtype=np.float64)
        return map_vectors(df, lambda x: x.astype(np.float64) @ table.T, "feature", target)
    table = vectors.matrix(prompts)
    return df.withColumn(target, F.transform(table, lambda p: vectors.dot(F.col("feature"), p)))


def relevancy_groups(
    df: DataFrame,
    groups: Mapping[str, Sequence[Sequence[float]]],
    negatives: Sequence[Sequence[float]],
    dense: bool = False,
) -> DataFrame:
    """Add one array of relevancies per group of positive prompts.

    All groups and the negatives share a single pass of inner products.
    """
    every = [v for group in groups.values() for v in group]
    scored = similarities(df, [*every, *negatives], "_s", dense)
    worst = F.slice("_s", len(every) + 1, len(negatives))
    start, columns = 1, {}
    for name, group in groups.items():
        own = F.slice("_s", start, len(group))
        columns[name] = vectors.relevancy(own, worst)
        start += len(group)
    return scored.withColumns(columns).drop("_s")


def relevancy_scores(
    df: DataFrame,
    positives: Sequence[Sequence[float]],
    negatives: Sequence[Sequence[float]],
    dense: bool = False,
) -> DataFrame:
    """Add ``relevancy``: one score per positive prompt, against all negatives."""
    return relevancy_groups(df, {"relevancy": positives}, negatives, dense)


def score_ranges(scored: DataFrame, sizes: Mapping[str, int], by: Sequence[str] = ("image",)) -> DataFrame:
    """Smallest and largest score of every prompt per image, as arrays ``<column>_low`` and ``_high``.

    ``sizes`` gives each score column and its number of prompts. All columns are
    ranged in one pass with one aggregate per prompt, so no pixel is multiplied
    into prompt rows.
    """
    bounds = [
        f(F.get(name, F.lit(i))).alias(f"_{kind}_{name}_{i}")
        for name, n in sizes.items()
        for i in range(n)
        for kind, f in (("low", F.min), ("high", F.max))
    ]
    gathered = [
        F.array(*[F.col(f"_{kind}_{name}_{i}") for i in range(n)]).alias(f"{name}_{kind}")
        for name, n in sizes.items()
        for kind in ("low", "high")
    ]
    return scored.groupBy(*by).agg(*bounds).select(*by, *gathered)


def query_confidence(
    scored: DataFrame, sizes: Mapping[str, int], use_softmax: bool = False, by: Sequence[str] = ("image",)
) -> DataFrame:
    """Best prompt per pixel and its confidence: ``<column>_query`` and ``<column>_confidence``.

    The first prompt wins a tie. Confidence is the score scaled by the smallest
    and largest score that prompt has in the whole image, or with ``use_softmax``
    the softmax over prompts. Ranges are one small row per image, looked up by
    image; no window gathers an image in one task.
    """
    best = {f"{name}_query": vectors.argmax(F.col(name)) for name in sizes}
    if use_softmax:
        return scored.withColumns(
            {**best, **{f"{name}_confidence": F.array_max(vectors.softmax(F.col(name))) for name in sizes}}
        )
    by = list(by)
    ranges = cut_lineage(score_ranges(scored, sizes, by))
    out = lookup_join(scored.withColumns(best), ranges, by)

    def at(name: str, source: str) -> Column:
        return vectors.pick(F.col(source), F.col(f"{name}_query"))

    confidence = {
        f"{name}_confidence": vectors.min_max(at(name, name), at(name, f"{name}_low"), at(name, f"{name}_high"))
        for name in sizes
    }
    return out.withColumns(confidence).drop(*[f"{name}_{k}" for name in sizes for k in ("low", "high")])


def semantic_argmax(
    df: DataFrame,
    class_ids: Sequence[int],
    positives: Sequence[Sequence[float]],
    negatives: Sequence[Sequence[float]],
    dense: bool = False,
) -> DataFrame:
    """Class of the most similar prompt; NULL when a negative prompt is most similar.

    Softmax keeps the order of its inputs, so the similarities decide.
    """
    scored = similarities(df, [*positives, *negatives], "_s", dense)
    ids = F.array(*[F.lit(int(c)) for c in class_ids], *[F.lit(None).cast("int") for _ in negatives])
    return scored.withColumn("label", vectors.pick(ids, vectors.argmax(F.col("_s")))).drop("_s")


def label_above(
    confident: DataFrame, class_ids: Sequence[int], threshold: float, scores: str = "relevancy"
) -> DataFrame:
    """Class of the best prompt where the confidence reaches ``threshold``."""
    ids = F.array(*[F.lit(int(c)) for c in class_ids])
    return confident.filter(F.col(f"{scores}_confidence") >= F.lit(float(threshold))).select(
        *PIXEL, vectors.pick(ids, F.col(f"{scores}_query")).alias("label")
    )


def segment_features(segments: DataFrame, features: DataFrame, level: int) -> DataFrame:
    """Feature of each pixel through its segment id at one level; -1 is no segment."""
    chosen = segments.filter((F.col("level") == int(level)) & (F.col("seg") != -1))
    return lookup_join(chosen, features, ["image", "seg"])


def dual_segment_features(
    segments_a: DataFrame, features_a: DataFrame, segments_b: DataFrame, features_b: DataFrame, level: int
) -> DataFrame:
    """Features from two sources per pixel, and whether the second covers it."""
    a = segment_features(segments_a, features_a, level).select(*PIXEL, F.col("feature").alias("feature_a"))
    b = segment_features(segments_b, features_b, level).select(*PIXEL, F.col("feature").alias("feature_b"))
    return a.join(b, list(PIXEL), "left").withColumn("covered_b", F.col("feature_b").isNotNull())


def expand_prompts(classes: DataFrame, first_only: bool = False) -> DataFrame:
    """(class_id, prompt_idx, prompt) rows: all prompts, or each class's first."""
    out = classes.select("class_id", F.posexplode("prompts").alias("prompt_idx", "prompt"))
    return out.filter(F.col("prompt_idx") == 0) if first_only else out


def threshold_label(label: Column, score: Column, threshold: float) -> Column:
    """NULL where the score is below the threshold."""
    return F.when(score >= F.lit(float(threshold)), label)
