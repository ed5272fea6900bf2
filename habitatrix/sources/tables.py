"""Text tables that the stages exchange, as files or as DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix.session import with_missing
from habitatrix.operators.ordering import ordinal
from habitatrix.sources.occurrences import file_position, require_columns

# Fixed value of the file format: words that stand for a missing id.
_MISSING_IDS = ("<NA>", "NA", "nan")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_folder_lines(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Lines of ``<root>/<folder>/<file_name>`` for every folder at once.

    ``pos`` orders lines inside a file.  A folder that lacks the file simply has
    no rows, so "all files present" is an inner join of the tables.
    """
    lines = spark.read.text(f"{root}/*/{file_name}")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return lines.select(
        F.url_decode(F.element_at(parts, -2)).alias("folder"),
        file_position().alias("pos"),
        F.col("value").alias("line"),
    )


# -- locality master ----------------------------------------------------------


def locality_master_rows(raw: DataFrame) -> DataFrame:
    """Typed locality table; rows without key, weight or stratum are dropped."""
    require_columns(raw, ("LocalityID", "w_inv", "effort_stratum"))
    doubles = ("w_inv", "effort_stratum", "n2000_score", "n_records", "n_species", "n_species_N2K")
    typed = with_missing(
        raw,
        {"LocalityID": "string", "dominant_habitat": "string"}
        | dict.fromkeys(doubles, "string"),
    ).withColumns({c: F.col(c).try_cast("double") for c in doubles})
    if "dominant_habitat" not in raw.columns:
        typed = typed.withColumn("dominant_habitat", F.lit("Unknown"))
    return typed.dropna(subset=["LocalityID", "w_inv", "effort_stratum"])


def read_locality_master(spark: SparkSession, path: str) -> DataFrame:
    return locality_master_rows(read_tsv(spark, path))


# -- per-folder text files ----------------------------------------------------


def words(c) -> F.Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")


def parse_red_local(lines: DataFrame) -> DataFrame:
    """``<locality> <count>`` lines.

    The last word is the count and the rest is the key, so a key with blanks
    survives instead of corrupting the file.
    """
    pair = r"^\s*(.*\S)\s+(\S+)\s*$"
    return (
        lines.select(
            "folder",
            F.nullif(F.regexp_extract("line", pair, 1), F.lit("")).alias("LocalityID"),
            F.regexp_extract("line", pair, 2).try_cast("double").alias("value"),
        )
        .dropna(subset=["LocalityID", "value"])
    )


def parse_totals(lines: DataFrame) -> DataFrame:
    """``<name> <observations> <species> <red>`` lines."""
    pattern = r"^\s*(.*?)\s*\b([0-9]+)\s+([0-9]+)\s+([0-9]+)\s*$"
    got = [F.regexp_extract("line", pattern, k) for k in range(1, 5)]
    name = F.array_join(words(got[0]), " ")
    return lines.where(F.col("line").rlike(pattern)).select(
        "folder",
        name.alias("focal_id"),
        F.element_at(words(got[0]), 1).alias("genus"),
        F.array_join(F.filter(words(got[0]), lambda _, i: i >= 1), " ").alias("species_n"),
        got[1].try_cast("double").alias("No_obs"),
        got[2].try_cast("double").alias("No_asc_spp"),
        got[3].try_cast("double").alias("No_redlisted"),
    )


def parse_observed_ids(lines: DataFrame) -> DataFrame:
    """Every run of digits in a line is an id, also inside the name."""
    runs = F.regexp_extract_all("line", F.lit(r"([0-9]+)"), F.lit(1))
    return lines.select("folder", F.explode(runs).alias("t")).select(
        "folder", F.col("t").try_cast("bigint").alias("taxon_id")
    )


def parse_locality_species(lines: DataFrame) -> DataFrame:
    """``<locality> <N> <E> <ids...>`` lines; up to three words mean no species."""
    toks = words(F.col("line"))
    joined = F.lower(F.array_join(F.col("toks"), " "))
    header = (joined.contains("locality") & joined.contains("sweref")) | joined.startswith(
        "localityid"
    )
    ids = F.filter("toks", lambda t, i: (i >= 3) & ~t.isin(*_MISSING_IDS))
    return (
        lines.withColumn("toks", toks)
        .where((F.size("toks") > 0) & ~header)
        .select("folder", "pos", F.element_at("toks", 1).alias("LocalityID"), ids.alias("ids"))
    )


def numbered(localities: DataFrame) -> DataFrame:
    """``pos`` as a number from 0 in each folder, the same however the files are split."""
    counted = ordinal(localities, ["folder"], ["pos"], "_number")
    return counted.withColumn("pos", F.col("_number") - 1).drop("_number")


# -- repeated runs ------------------------------------------------------------


def run_rows(raw: DataFrame, value_column: str, class_column: str, keys: list[str]) -> DataFrame:
    """Typed rows of a result table: keys, value and optional class."""
    require_columns(raw, [value_column])
    return with_missing(
        raw, dict.fromkeys([*keys, value_column, class_column], "string")
    ).select(
        *keys,
        F.col(f"`{value_column}`").try_cast("double").alias("value"),
        F.col(f"`{class_column}`").try_cast("double").alias("value_class"),
    ).where(F.col("value").isNotNull())
