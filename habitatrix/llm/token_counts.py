"""Token counts through a cache that is keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.chunked import PieceCounter, opened
from habitatrix.llm.tables import materialize, rows_by_bytes, ship, texts_of, whole_text
from habitatrix.session import scratch_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(model: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(model, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = opened(PieceCounter, model)
        for part in rows_by_bytes(batches, "_text"):
            n = counter.counts(part.column(1).to_pylist(), *texts_of(part, "_text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"]
            )

    return run


def _stored(spark, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; a repeated append counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    else:
        table = spark.createDataFrame([], CACHE_SCHEMA)
    mine = table.where(F.col("tokenizer") == version)
    return mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    model: str,
    cache: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the text, plus ``n_bytes``, ``n_tokens`` and ``digest``, row for row.

    ``cache`` is a Parquet folder of (tokenizer, digest, n_tokens); None takes a new one.  Digests
    that it lacks are encoded once, from the row with the smallest id, and appended.  Content is
    normalised by reading NULL as the empty text, nothing more, as counts belong to whole texts.
    NULL and repeated ids, repeated rows and an empty table are fine; other columns stay (an input
    column with the name of a result is replaced).
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    ship(docs.sparkSession)
    version = tokenizer_digest(model)
    text = whole_text(text_column)
    results = {"digest", "n_bytes", "n_tokens", text_column.lower()}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results]
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    keys = materialize(
        docs.select(*kept, digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes")),
        "token-keys",
    )
    stored = _stored(spark, cache, version)
    named = keys.select(F.col(f"`{id_column}`").alias("_id"), "digest")
    first = (
        named.groupBy("digest")
        .agg(F.min("_id").alias("_first"))
        .join(stored.select("digest", F.lit(True).alias("_hit")), "digest", "left")
    )
    # Ids of which no text need be encoded: known content, and later copies of new content.
    known = F.col("_hit").isNotNull() | F.coalesce(F.col("_id") != F.col("_first"), F.lit(False))
    spared = (
        named.join(first, "digest")
        .groupBy("_id")
        .agg(F.bool_and(known).alias("_known"))
        .where("_known")
        .select("_id")
    )
    spared = materialize(spared, "token-spared")
    todo = docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text")).join(
        spared, "_id", "left_anti"
    )
    todo = todo.select(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), "_text")
    new = todo.mapInArrow(_counter(model), "digest binary, n_tokens bigint")
    # ids may repeat or be NULL, so a known digest can come again
    new = new.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).join(stored, "digest", "left_anti")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return keys.join(_stored(spark, cache, version), "digest", "left")
