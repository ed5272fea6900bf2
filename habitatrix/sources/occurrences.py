"""Occurrence parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix import config as C


def read_occurrences(
    spark: SparkSession, path: str, *, parts_only: bool = False
) -> DataFrame:
    """Scan a folder of occurrence parquet.

    ``parts_only`` keeps the top-level ``part-*.parquet`` files; the default also
    descends into sub-folders.  The scan stays lazy, so only the columns and row
    groups that later steps need are read.
    """
    reader = spark.read
    if parts_only:
        reader = reader.option("pathGlobFilter", "part-*.parquet")
    else:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        occ = reader.parquet(path)
    except AnalysisException as err:
        raise FileNotFoundError(f"no readable parquet below {path}") from err
    require_columns(occ, C.REQUIRED_OCCURRENCE_COLUMNS)
    return occ


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def file_position() -> Column:
    """Sorts the rows of a text or CSV source by file, then by place in the file.

    A split is read in order by one task, so its first byte and the running number of the task order
    its rows, however splits are dealt to tasks.  Only the order has a meaning.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
