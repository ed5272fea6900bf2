"""Log of finished folder rows, one part for each folder.

A row is in the log once however often its job is repeated: the log is split by folder, and writing
a folder again replaces it.  Rows of finished folders survive any later failure, and a run that starts
anew asks the log which folders are left.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix import config as C
from habitatrix.sinks import replace_folders, rounded_text

_COLUMNS = [name for name, _ in C.PROGRESS_COLUMNS]


def progress_rows(rows: DataFrame) -> DataFrame:
    """The fixed columns as text, doubles with two decimals; absent ones are empty."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    out = []
    for name, ours in C.PROGRESS_COLUMNS:
        source = ours or name
        if name == "timestamp":
            out.append(stamp.alias(name))
        elif source in rows.columns:
            out.append(F.col(f"`{source}`").alias(name))
        else:
            out.append(F.lit(None).cast("string").alias(name))
    return rounded_text(rows.select(*out))


def append_progress(rows: DataFrame, path: str) -> None:
    text = progress_rows(rows).repartition("folder")
    csv = text.write.option("sep", "\t").option("header", True).option("emptyValue", "")
    replace_folders(csv).csv(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; none if nothing has been logged."""
    inside = ", ".join(f"`{c}` string" for c in _COLUMNS if c != "folder")
    reader = spark.read.option("sep", "\t").option("header", True).schema(f"{inside}, folder string")
    try:
        return reader.csv(path).select(*[f"`{c}`" for c in _COLUMNS])
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in _COLUMNS))
