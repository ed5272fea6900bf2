"""Session helpers: shared scratch tables and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest lookup that is broadcast.  Rows are narrow (a key and a few values),
#: so this stays well below the memory of one executor.
BROADCAST_ROWS = 500_000

#: Below this estimate no counting job is needed.
BROADCAST_BYTES = 10 * 1024 * 1024

_local_scratch: str | None = None

#: Local application ids repeat, so the process has a name of its own.
_PROCESS = uuid.uuid4().hex[:12]


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without
    that setting gets a temporary folder of its own.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="habitatrix-")
    return _local_scratch


def session_scratch(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{scratch_root(spark)}/habitatrix/{spark.sparkContext.applicationId}-{_PROCESS}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{session_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later branches read the columnar table instead of recomputing the input, and
    a lost executor never loses it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote in this session, when nothing is to read them again."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        scratch = jvm.org.apache.hadoop.fs.Path(session_scratch(spark))
        fs = scratch.getFileSystem(conf)
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if fs.makeQualified(path.getParent()).equals(fs.makeQualified(scratch)):
                fs.delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this session wrote; those of other sessions stay."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_scratch(spark))
    conf = spark._jsc.hadoopConfiguration()
    path.getFileSystem(conf).delete(path, True)


def _estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Small by the planner's size estimate, or else by a bounded count."""
    if _estimated_bytes(df) <= BROADCAST_BYTES:
        return True
    return df.limit(max_rows + 1).count() <= max_rows


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its size allows it.

    A larger table stays unhinted: the join then shuffles on its key and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed NULLs and keep exactly ``columns``."""
    out: list[Column] = []
    for name, kind in columns.items():
        present = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        out.append(present.cast(kind).alias(name))
    return df.select(*out)
