"""Stage 1 from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from habitatrix import sinks
from habitatrix.operators import locality
from habitatrix.session import materialize
from habitatrix.sources import lookups, occurrences


def build(
    spark: SparkSession, occurrence_path: str, ias_path: str, n2k_path: str, habitat_path: str
) -> tuple[DataFrame, DataFrame]:
    """(events, master)."""
    records = locality.observations(occurrences.read_occurrences(spark, occurrence_path))
    obs = locality.observation_counts(records)
    raw = lookups.read_habitat_assignments(spark, habitat_path)
    labels = None if raw is None else lookups.assignment_labels(raw)
    master = locality.locality_master(
        obs,
        lookups.read_ias_bank(spark, ias_path),
        lookups.read_n2k_bank(spark, n2k_path),
        labels,
    )
    return locality.locality_events(obs), master


def run(spark: SparkSession, out: str, **paths: str) -> DataFrame:
    """Write both tables; returns the strata histogram."""
    events, master = build(spark, **paths)
    sinks.write_tsv(events, f"{out}/LocalityEvents")
    master = materialize(master, "master")
    sinks.write_tsv(master, f"{out}/LocalityMaster")
    return locality.strata_histogram(master).orderBy("effort_stratum")
