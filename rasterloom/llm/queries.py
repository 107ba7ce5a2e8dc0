"""The thirteen operators as registered queries, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import (
    attention,
    chosen_path,
    codebooks,
    exact,
    mixture,
    packing,
    pages,
    ppm,
    rans,
    repetition,
    substrings,
    transducer,
    turns,
)
from rasterloom.llm.common import ship, table
from rasterloom.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op2_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "token-blocks")
    docs = table(spark, sf_dir, "documents")
    model = rans.encode_documents(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return rans.with_starts(rans.read_blocks(spark, folder, model, digest=True)).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def op3_progressive_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), digest=True)


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op5_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.repeated_substrings(table(spark, sf_dir, "documents")))


def op6_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_golden_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"), scanned=True)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    damaged = turns.damage(rows)
    return turns.digests(damaged, turns.audits(damaged, rows))


def op12_limb_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def _op12_sql(rounds: int = codebooks.ROUNDS) -> str:
    """Integers as doubles: all numbers of the test tables stay far below 2^53."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT rn, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT rn, p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
    FROM parts JOIN c{n} USING (p)) GROUP BY rn, p)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (
  SELECT p, e, list(v ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS DOUBLE) AS v FROM (
      SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e),
c{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v,
         row_number() OVER (ORDER BY vec_id) AS rn
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT rn, p, list_slice(v, p * (len(v) // {codebooks.PARTS}) + 1, (p + 1) * (len(v) // {codebooks.PARTS})) AS x
  FROM kept, range({codebooks.PARTS}) t(p)),
c0 AS (SELECT p, rn - 1 AS e, x AS c FROM parts WHERE rn <= {codebooks.ENTRIES}),
{",".join(steps)},
books AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c{rounds})),
codes AS (
  SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rn), books
"""


def op13_attention_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipping(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _shipping(f)
    for f in (
        op1_suffix_repetition,
        op2_rans_blocks,
        op3_progressive_exact,
        op4_chosen_path,
        op5_deep_shallow,
        op6_token_transducer,
        op7_golden_mixture,
        op8_consensus_paths,
        op9_ppm_scores,
        op10_best_fit,
        op11_target_alignment,
        op12_limb_gemm,
        op13_attention_bags,
    )
}
QUERIES["pipeline"] = _shipping(corpus_pipeline.run)
ORACLES: dict[str, str] = {"op3_progressive_exact": OP3_SQL, "op12_limb_gemm": _op12_sql()}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
