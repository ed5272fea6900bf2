"""Semicolon / sniffed-delimiter lookup files.

Everything is read as text and cast leniently.  ``_row`` keeps the order of files and of rows in
them, which the "first row wins" rules of the habitat map need.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix import config as C
from habitatrix.functions import text
from habitatrix.session import with_missing
from habitatrix.sources.occurrences import file_position

_SNIFF_BYTES = 4096


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latin1_files(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """Files below ``path`` with a line that is not valid UTF-8, and whether there are others.

    A lookup is a few files; only their names are collected.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    found = lines.groupBy("file").agg(F.bool_and(F.coalesce(F.is_valid_utf8("value"), F.lit(True))).alias("fine")).collect()
    # the reader takes paths, not the escaped names that it reports
    bad = sorted(unquote(r.file) for r in found if not r.fine)
    return bad, any(r.fine for r in found)


def read_delimited(spark: SparkSession, path: str, sep: str = ";", position: bool = False) -> DataFrame:
    """All-text CSV with header; each file is UTF-8, or Latin-1 if it has a line that is not.

    Short rows are padded with NULL; rows with more fields than the header are
    skipped (they show up in the surplus column).  ``position`` adds the place of a row as ``_row``.
    """
    bad, others = latin1_files(spark, path)
    reader = spark.read.option("sep", sep).option("header", True)
    names = reader.option("encoding", "UTF-8" if others or not bad else "ISO-8859-1").csv(path).columns
    fields = ", ".join(f"`{n}` string" for n in [*names, "_surplus"])
    place = [file_position().alias("_row")] if position else []

    def rows(encoding: str, where: str | list[str]) -> DataFrame:
        return reader.option("encoding", encoding).schema(fields).csv(where).select("*", *place)

    if not bad:
        out = rows("UTF-8", path)
    elif not others:
        out = rows("ISO-8859-1", path)
    else:
        files = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        good = sorted({unquote(r.f) for r in files} - set(bad))
        out = rows("UTF-8", good).unionByName(rows("ISO-8859-1", bad))
    return out.where(F.col("_surplus").isNull()).drop("_surplus")


def _padded(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    if not _exists(spark, path):
        schema = ", ".join(f"`{n}` {t}" for n, t in columns.items())
        return spark.createDataFrame([], schema)
    return with_missing(read_delimited(spark, path), columns)


def read_ias_bank(spark: SparkSession, path: str) -> DataFrame:
    raw = _padded(
        spark, path, {"taxonID": "string", "scientificName": "string", "weight": "string"}
    )
    return bank_rows(raw)


def read_n2k_bank(spark: SparkSession, path: str) -> DataFrame:
    names = ("taxonID", "scientificName", "habitatCode", "weight")
    return bank_rows(_padded(spark, path, dict.fromkeys(names, "string")))


def bank_rows(raw: DataFrame) -> DataFrame:
    """Typed bank: taxon number and weight, a missing weight meaning 1."""
    keep = [c for c in ("scientificName", "habitatCode") if c in raw.columns]
    return raw.select(
        text.taxon_number(F.col("taxonID")).alias("taxon_id"),
        *keep,
        F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"),
    )


def read_habitat_assignments(spark: SparkSession, path: str) -> DataFrame | None:
    """Raw assignment rows in file order, or ``None`` when there is no file."""
    if not _exists(spark, path):
        return None
    names = ("taxonID", "scientificName", "habitat")
    read = read_delimited(spark, path, position=True)
    place = read.schema["_row"].dataType.simpleString()
    return with_missing(read, dict.fromkeys(names, "string") | {"_row": place})


def assignment_labels(raw: DataFrame) -> DataFrame:
    """(taxon_id, habitat) rows for the locality stage: any trailing number."""
    return raw.select(
        text.taxon_number(F.col("taxonID")).alias("taxon_id"), "habitat"
    ).where(F.col("taxon_id").isNotNull())


def read_red_list(spark: SparkSession, path: str) -> DataFrame:
    return red_list_ids(read_delimited(spark, path))


def red_list_ids(raw: DataFrame) -> DataFrame:
    """Distinct red-listed taxa as id text."""
    name = C.RED_LIST_ID_HEADER
    if name not in raw.columns:
        raise ValueError(f"red list lacks the column {name!r}")
    number = F.col(f"`{name}`").try_cast("bigint")
    return (
        raw.select(number.cast("string").alias("taxon_id"))
        .where(F.col("taxon_id").isNotNull())
        .distinct()
    )


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of the first few KB, comma when undecided."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(50).collect())
    try:
        return csv.Sniffer().sniff(head[:_SNIFF_BYTES], delimiters=",;\t").delimiter
    except csv.Error:
        return ","


def read_focal_list(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], "taxon_id string, name string")
    return focal_rows(read_delimited(spark, path, sniff_delimiter(spark, path)))


def focal_rows(raw: DataFrame) -> DataFrame:
    """(taxon_id, name) selectors under any of the accepted headers.

    An id that is no whole number is dropped; the name of that row still counts.
    """

    def first_of(names):
        found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    number = F.trim(first_of(C.FOCAL_ID_HEADERS)).try_cast("bigint")
    return raw.select(
        number.cast("string").alias("taxon_id"),
        F.trim(first_of(C.FOCAL_NAME_HEADERS)).alias("name"),
    )


def focal_selectors(
    spark: SparkSession,
    ids: list[int] | None = None,
    names: list[str] | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Merge configured ids and names with the rows of a focal list."""
    given = [(str(i), None) for i in ids or []] + [(None, n) for n in names or []]
    out = spark.createDataFrame(given, "taxon_id string, name string")
    if rows is not None:
        out = out.unionByName(rows.select("taxon_id", "name"))
    return out.distinct()
