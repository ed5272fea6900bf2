"""Registered queries of this subpackage and their SQL.

Each applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from habitatrix.llm import (
    decontaminate,
    embedding_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    packing,
    quality,
    records,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
    whitening,
)
from habitatrix.llm.tables import read
from habitatrix.session import scratch_path

#: Longest document, in tokens, that op1 does not mark.
TOKEN_LIMIT = 4096


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.WHOLE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, read(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", "held_out", "score", predicted, "offending")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.size("removed").cast("bigint").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", spans, "kept_sha256", "removed")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    coded = vector_codes.encode(vectors, vector_codes.fit(vectors))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    model = public_tokenizers.path("byte_bpe_50k.json")
    records.write(read(spark, sf_dir, "documents").select("doc_id", "text"), model, folder, width=2)
    found = records.read(spark, folder)
    return found.select("doc_id", "start", F.col("tokens").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_records": op12_token_records,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}


def _vector_codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Codebooks by measuring every entry; tied distances take the lower one."""

    def assigned(book: str) -> str:
        far = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return (
            f"SELECT x.vec_id, x.label, x.p, min({far} * {entries} + b.e) AS m "
            f"FROM x JOIN {book} b ON b.p = x.p GROUP BY x.vec_id, x.label, x.p, x.v"
        )

    whole = "list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS e, "
        f"{whole} AS v FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, e, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v "
        f"FROM kept, range({parts}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, v FROM x WHERE e < {entries})",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS MATERIALIZED (SELECT x.p, q.m % {entries} AS e, x.v FROM x JOIN ({assigned(f'b{k}')}) q USING (vec_id, p))",
            f"s{k} AS (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, (SELECT max(len(v)) FROM x) + 1) AS r(i) "
            "GROUP BY p, e, i)",
            f"m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY p, e)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)",
        ]
    last = f"b{rounds}"
    steps += [
        f"f AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, "
        f"CAST(sum(m // {entries}) AS BIGINT) AS error FROM ({assigned(last)}) GROUP BY vec_id, label)",
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last})",
    ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error, "
        "CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h"
    )


#: The other operators have no SQL: tokenizers, fitted models and searches are tested against plain versions.
ORACLES: dict[str, str] = {"op11_vector_codes": _vector_codes_sql()}
