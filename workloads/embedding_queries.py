"""Embedding vectors: prototypes, similarity labels, relevancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import vectors
from rasterloom.operators import features, instances
from workloads import views
from workloads.registry import query, r6, rounded, table

NEGATIVE_LABELS = (8, 9)

UNIT_SQL = """
u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(v, lambda e: e / (n + 1e-8)) AS v FROM u),
flat AS (SELECT label, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM unit),
means AS (SELECT label, pos, avg(e) AS e FROM flat GROUP BY 1, 2),
proto AS (SELECT label, list(e ORDER BY pos) AS v FROM means GROUP BY label),
flat0 AS (SELECT label, unnest(v) / n AS e, generate_subscripts(v, 1) AS pos FROM u),
means0 AS (SELECT label, pos, avg(e) AS e FROM flat0 GROUP BY 1, 2),
proto0 AS (SELECT label, list(e ORDER BY pos) AS v FROM means0 GROUP BY label),
cls AS (SELECT label, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM proto0)"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("feature")
    )


def _class_table(spark, folder):
    prompts = _vectors(spark, folder).select(F.col("label").alias("class_id"), "feature")
    return instances.class_prototypes(prompts)


@query(
    "l2_normalize",
    f"""WITH {UNIT_SQL} SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, round(unnest(v), 6) AS value,
    round(sqrt(list_dot_product(v, v)), 6) AS length FROM unit""",
)
def l2_normalize(spark, folder):
    unit = _vectors(spark, folder).withColumn("v", vectors.l2_normalize(F.col("feature")))
    return unit.select(
        "vec_id", F.posexplode("v").alias("pos", "value"), r6(vectors.norm(F.col("v"))).alias("length")
    ).withColumn("value", r6("value"))


@query(
    "prototypes",
    f"WITH {UNIT_SQL} SELECT label AS instance_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, round(unnest(v), 6) AS value FROM proto WHERE label <> 0",
)
def prototypes(spark, folder):
    rows = _vectors(spark, folder).select(F.col("label").alias("instance_id"), "feature")
    proto = instances.instance_prototypes(rows)
    return rounded(proto.select("instance_id", F.posexplode("feature").alias("pos", "value")), "value")


@query(
    "class_prototypes",
    f"WITH {UNIT_SQL} SELECT label AS class_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, round(unnest(v), 6) AS value FROM cls",
)
def class_prototypes(spark, folder):
    proto = _class_table(spark, folder)
    return rounded(proto.select("class_id", F.posexplode("feature").alias("pos", "value")), "value")


SCORES_SQL = UNIT_SQL + """,
sims AS (SELECT u.vec_id, c.label AS class_id, list_dot_product(u.v, c.v) AS s FROM unit u CROSS JOIN cls c),
best AS (SELECT vec_id, max(s) AS score, arg_min(class_id, ROW(-s, class_id)) AS class_id FROM sims GROUP BY vec_id)"""


@query(
    "cosine_classify",
    f"WITH {SCORES_SQL} SELECT CAST(vec_id AS INT) AS instance_id, CASE WHEN score >= 0.2 THEN class_id END AS label, round(score, 6) AS score FROM best",
)
def cosine_classify(spark, folder):
    rows = _vectors(spark, folder).select(F.col("vec_id").cast("int").alias("instance_id"), "feature")
    classes = _class_table(spark, folder)
    return rounded(instances.classify_instances(rows, classes, 0.2), "score")


@query(
    "label_override",
    f"""WITH {SCORES_SQL}, h AS (SELECT CAST(vec_id AS INT) AS instance_id, 100 + label AS label FROM embeddings WHERE vec_id % 3 = 0),
    c AS (SELECT CAST(vec_id AS INT) AS instance_id, CASE WHEN score >= 0.2 THEN class_id END AS label FROM best)
    SELECT c.instance_id, coalesce(h.label, c.label) AS label FROM c LEFT JOIN h USING (instance_id)""",
)
def label_override(spark, folder):
    """Only instances the hierarchy does not know are classified; its labels win."""
    known = (
        _vectors(spark, folder)
        .filter(F.col("vec_id") % 3 == 0)
        .select(F.col("vec_id").cast("int").alias("instance_id"), (F.col("label") + 100).alias("label"))
    )
    rows = _vectors(spark, folder).select(F.col("vec_id").cast("int").alias("instance_id"), "feature")
    classes = _class_table(spark, folder)
    left = instances.classify_instances(instances.without_label(rows, known), classes, 0.2)
    return instances.override_labels(left.select("instance_id", "label"), known)


@query(
    "unlabeled_instances",
    "SELECT CAST(vec_id AS INT) AS instance_id FROM embeddings WHERE vec_id % 3 <> 0",
)
def unlabeled_instances(spark, folder):
    rows = _vectors(spark, folder).select(F.col("vec_id").cast("int").alias("instance_id"), "label")
    known = rows.filter(F.col("instance_id") % 3 == 0)
    return instances.without_label(rows.select("instance_id"), known)


@query(
    "usable_features",
    f"""WITH {UNIT_SQL}, z AS (SELECT CAST(vec_id AS INT) AS instance_id, CASE WHEN vec_id % 5 = 1 THEN 0 ELSE n END AS n, v FROM u)
    SELECT instance_id, round(v[1] / n, 6) AS first FROM z WHERE instance_id <> 0 AND n > 1e-8""",
)
def usable_features(spark, folder):
    """A dense feature table: row number is the id, zero rows are unused ids."""
    zero = F.transform("feature", lambda v: v * 0)
    rows = _vectors(spark, folder).select(
        F.col("vec_id").cast("int").alias("instance_id"),
        F.when(F.col("vec_id") % 5 == 1, zero).otherwise(F.col("feature")).alias("feature"),
    )
    return instances.usable_features(rows).select("instance_id", r6(F.col("feature")[0]).alias("first"))


# Pixels with a feature: the vectors laid out on images of 50 columns.
PIXELS_SQL = SCORES_SQL + """,
rel0 AS (SELECT u.vec_id, c.label AS q, list_dot_product(u.v, c.v) AS s FROM (SELECT vec_id, v FROM u) u CROSS JOIN cls c),
neg AS (SELECT vec_id, max(s) AS m FROM rel0 WHERE q IN (8, 9) GROUP BY vec_id),
rel AS (SELECT CAST(vec_id % 4 AS INT) AS image, CAST(vec_id // 50 AS INT) AS y, CAST(vec_id % 50 AS INT) AS x, vec_id, CAST(q AS INT) AS q,
  1 / (1 + exp(-10 * (s - m))) AS r FROM rel0 JOIN neg USING (vec_id) WHERE q < 8),
rng AS (SELECT image, q, min(r) AS low, max(r) AS high FROM rel GROUP BY 1, 2),
top AS (SELECT image, y, x, vec_id, arg_min(q, ROW(-r, q)) AS q, max(r) AS r FROM rel GROUP BY 1, 2, 3, 4),
conf AS (SELECT image, y, x, q AS query, (r - low) / (high - low + 1e-9) AS confidence FROM top JOIN rng USING (image, q))"""


def _pixels(spark, folder):
    key = F.col("vec_id")
    return _vectors(spark, folder).select(
        (key % 4).cast("int").alias("image"),
        F.floor(key / F.lit(50)).cast("int").alias("y"),
        (key % 50).cast("int").alias("x"),
        "feature",
    )


def _relevant(spark, folder, dense: bool = False):
    table_rows = instances.prompt_rows(_class_table(spark, folder))
    positives = [v for c, v in table_rows if c not in NEGATIVE_LABELS]
    negatives = [v for c, v in table_rows if c in NEGATIVE_LABELS]
    return features.relevancy_scores(_pixels(spark, folder), positives, negatives, dense)


def _confidence_rows(confident):
    return confident.select(
        "image",
        "y",
        "x",
        F.col("relevancy_query").alias("query"),
        r6("relevancy_confidence").alias("confidence"),
    )


RELEVANCY_SQL = f"""WITH {PIXELS_SQL} SELECT image, y, x, q AS query, round(r, 6) AS relevancy FROM rel"""


@query("relevancy", RELEVANCY_SQL)
def relevancy(spark, folder):
    scored = _relevant(spark, folder)
    return scored.select("image", "y", "x", F.posexplode("relevancy").alias("query", "r")).select(
        "image", "y", "x", "query", r6("r").alias("relevancy")
    )


@query("relevancy_dense", RELEVANCY_SQL)
def relevancy_dense(spark, folder):
    """The same scores through one matrix product per Arrow batch."""
    scored = _relevant(spark, folder, dense=True)
    return scored.select("image", "y", "x", F.posexplode("relevancy").alias("query", "r")).select(
        "image", "y", "x", "query", r6("r").alias("relevancy")
    )


@query(
    "confidence_norm",
    f"WITH {PIXELS_SQL} SELECT image, y, x, query, round(confidence, 6) AS confidence FROM conf",
)
def confidence_norm(spark, folder):
    return _confidence_rows(features.query_confidence(_relevant(spark, folder), {"relevancy": 8}))


@query(
    "confidence_softmax",
    f"""WITH {PIXELS_SQL} SELECT t.image, t.y, t.x, t.q AS query, round(exp(t.r) / sum(exp(rel.r)), 6) AS confidence
    FROM top t JOIN rel USING (vec_id) GROUP BY t.image, t.y, t.x, t.q, t.r""",
)
def confidence_softmax(spark, folder):
    return _confidence_rows(
        features.query_confidence(_relevant(spark, folder), {"relevancy": 8}, use_softmax=True)
    )


@query(
    "feature_labels",
    f"WITH {PIXELS_SQL} SELECT image, y, x, CAST(500 + query AS INT) AS label FROM conf WHERE confidence >= 0.4",
)
def feature_labels(spark, folder):
    confident = features.query_confidence(_relevant(spark, folder), {"relevancy": 8})
    return features.label_above(confident, [500 + i for i in range(8)], 0.4)


@query(
    "semantic_argmax",
    f"""WITH {UNIT_SQL}, s AS (SELECT u.vec_id, arg_min(c.label, ROW(-list_dot_product(u.v, c.v), c.label)) AS label FROM u CROSS JOIN cls c GROUP BY u.vec_id)
    SELECT CAST(vec_id % 4 AS INT) AS image, CAST(vec_id // 50 AS INT) AS y, CAST(vec_id % 50 AS INT) AS x, CASE WHEN label < 8 THEN CAST(label AS INT) END AS label FROM s""",
)
def semantic_argmax(spark, folder):
    rows = instances.prompt_rows(_class_table(spark, folder))
    labelled = features.semantic_argmax(
        _pixels(spark, folder),
        [c for c, _ in rows if c not in NEGATIVE_LABELS],
        [v for c, v in rows if c not in NEGATIVE_LABELS],
        [v for c, v in rows if c in NEGATIVE_LABELS],
    )
    return labelled.select("image", "y", "x", "label")


@query(
    "segment_features",
    f"""WITH {views.RASTER_SQL} SELECT v.image, v.y, v.x, v.pred_label AS seg, e.vec_id, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first
    FROM v_raster v JOIN embeddings e ON e.vec_id = v.pred_label + v.image * 200 WHERE v.pred_label <> -1""",
)
def segment_features(spark, folder):
    """Predicted classes serve as segment ids; each image has its own feature rows."""
    rasters = views.raster(spark, folder)
    segments = rasters.select("image", F.lit(1).alias("level"), "y", "x", F.col("pred_label").alias("seg"))
    table_rows = _vectors(spark, folder).select(
        F.floor(F.col("vec_id") / F.lit(200)).cast("int").alias("image"),
        (F.col("vec_id") % 200).cast("int").alias("seg"),
        "vec_id",
        "feature",
    )
    found = features.segment_features(segments, table_rows, 1)
    return found.select("image", "y", "x", "seg", "vec_id", r6(F.col("feature")[0].cast("double")).alias("first"))


@query(
    "dual_features",
    f"""WITH {views.RASTER_SQL} SELECT v.image, count(*) AS pixels, count(b.vec_id) AS covered
    FROM v_raster v JOIN embeddings a ON a.vec_id = v.pred_label + v.image * 200 LEFT JOIN embeddings b ON b.vec_id = v.secondary_label + v.image * 200
      AND v.secondary_label <> -1 WHERE v.pred_label <> -1 GROUP BY 1""",
)
def dual_features(spark, folder):
    rasters = views.raster(spark, folder)
    table_rows = _vectors(spark, folder).select(
        F.floor(F.col("vec_id") / F.lit(200)).cast("int").alias("image"),
        (F.col("vec_id") % 200).cast("int").alias("seg"),
        "feature",
    )

    def segments(name: str):
        return rasters.select("image", F.lit(0).alias("level"), "y", "x", F.col(f"{name}_label").alias("seg"))

    both = features.dual_segment_features(
        segments("pred"), table_rows, segments("secondary"), table_rows, 0
    )
    return both.groupBy("image").agg(F.count("*").alias("pixels"), F.count_if("covered_b").alias("covered"))


# two dense layers, 64 -> 6 -> 4, with weights from a rule
_FIRST = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(64)] for i in range(6)]
_SECOND = [[((5 * i + 2 * j) % 7 - 3) / 4 for j in range(6)] for i in range(4)]
_BIAS = ([0.1 * i - 0.2 for i in range(6)], [0.3, 0.0, 0.1, -0.4])


def _layer_sql(vector: str, weights, bias, relu: bool) -> str:
    cells = [f"list_dot_product({vector}, {[float(w) for w in row]!r}::DOUBLE[]) + ({b!r})::DOUBLE" for row, b in zip(weights, bias)]
    return "[" + ", ".join(f"greatest({c}, 0)" if relu else c for c in cells) + "]"


@query(
    "decode_vectors",
    f"""WITH h AS (SELECT vec_id, {_layer_sql("CAST(embedding AS DOUBLE[])", _FIRST, _BIAS[0], True)} AS v FROM embeddings),
    o AS (SELECT vec_id, {_layer_sql("v", _SECOND, _BIAS[1], False)} AS v FROM h)
    SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS value FROM o""",
)
def decode_vectors(spark, folder):
    """Whole vectors through two dense layers; the result has length one."""
    import numpy as np

    layers = [(np.array(w), np.array(b)) for w, b in zip((_FIRST, _SECOND), _BIAS)]
    out = features.decode_vectors(_vectors(spark, folder).select("vec_id", F.col("feature").cast("array<double>").alias("feature")), layers)
    return rounded(out.select("vec_id", F.posexplode("feature").alias("pos", "value")), "value")
