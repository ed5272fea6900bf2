"""Small helpers that the operators share: reading tables, scratch tables, batches."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix.session import discard, materialize

__all__ = ["discard", "held_out", "materialize", "read", "release", "rows_by_bytes", "ship", "texts_of", "unused", "whole_text"]

#: Text that a numpy kernel takes at a time; its arrays are about 50 times as large.
SLICE_BYTES = 1 << 21


#: Bytes of one batch between Spark and Python; by rows alone it would grow with the texts, and be held several times.
BATCH_BYTES = 1 << 22
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    The session's batches get ``BATCH_BYTES``, unless the application's settings name a size.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="habitatrix-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(column: str = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """One row in five, by the checksum of its id as text."""
    return F.coalesce(F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rows_by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has at most ``limit`` bytes in each, or one row."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        offsets = np.frombuffer(text.buffers()[1], dtype="int64" if wide else "int32")
        offsets = offsets[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, int(offsets[at]) + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str):
    """Bytes of all texts in one array, and where each begins and ends."""
    import numpy as np

    text = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    offsets = np.frombuffer(text.buffers()[1], dtype="int64" if wide else "int32")
    offsets = offsets[text.offset : text.offset + len(text) + 1].astype("int64")
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype="uint8") if data is not None else np.empty(0, dtype="uint8")
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
