"""Stage 4 from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from habitatrix import sinks
from habitatrix.operators import stability
from habitatrix.session import materialize
from habitatrix.sources import tables


def build(
    raw: DataFrame,
    keys: list[str] | None = None,
    value_column: str = "composite_index",
    class_column: str = "composite_class",
    obs_column: str = "No_obs",
) -> DataFrame:
    keys = keys or ["focal_id"]
    kept = stability.drop_undersampled(raw, obs_column)
    return stability.stability_report(
        tables.run_rows(kept, value_column, class_column, keys), keys
    )


def run(spark: SparkSession, path: str, out: str, **options) -> DataFrame:
    """Write the report and return its most unstable rows."""
    report = materialize(build(tables.read_tsv(spark, path), **options), "report")
    sinks.write_tsv(stability.most_unstable_first(report), out)
    return stability.top_unstable(report)
