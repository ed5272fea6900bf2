"""Stage 4: how stable a focal species' index is over repeated runs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix import config as C
from habitatrix.functions import stats
from habitatrix.operators.classes import with_class
from habitatrix.session import materialize


def observation_column(columns: list[str], preferred: str = "No_obs") -> str | None:
    """Name of the observation-count column, if any known one is present."""
    return next((c for c in (preferred, *C.OBS_COLUMN_CANDIDATES) if c in columns), None)


def drop_undersampled(
    runs: DataFrame, preferred: str = "No_obs", at_least: int = C.SAMPLE_SITES
) -> DataFrame:
    """Keep rows with enough observations; without such a column keep all."""
    name = observation_column(runs.columns, preferred)
    if name is None:
        warnings.warn("no observation-count column; under-sampling filter skipped", stacklevel=2)
        return runs
    return runs.where(F.col(f"`{name}`").try_cast("double") >= F.lit(float(at_least)))


def removed_groups(all_runs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that lost every row."""
    return all_runs.select(*keys).distinct().exceptAll(kept.select(*keys).distinct())


def stability_scores(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Run statistics per group (NULL keys form a group) in one aggregation.

    The sign share needs the mean first; counting all three signs avoids a
    second pass.
    """
    x, cls = F.col("value"), F.col("value_class")
    mean, n = F.avg(x), F.count(F.lit(1))
    sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    signs = [F.count_if(x > 0), F.count_if(x == 0), F.count_if(x < 0)]
    share = [F.avg(c.cast("double")) for c in (x > 0, x >= C.STRONG_VALUE, cls >= C.HIGH_CLASS)]
    return runs.groupBy(*keys).agg(
        n.alias("n_runs"),
        mean.alias("mean"),
        sd.alias("sd"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"),
        (sd / F.greatest(F.abs(mean), F.lit(C.EPS))).alias("relative_sd"),
        share[0].alias("stability_pos"),
        share[1].alias("stability_ge1"),
        stats.sign_share(*signs, n, mean).alias("stability_same_sign"),
        share[2].alias("stability_class3plus"),
    )


def stability_report(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Scores plus class of the mean and the combined stability values."""
    # one short row per focal species; written once, then read for limits and rows
    scores = materialize(stability_scores(runs, keys), "scores")
    scored = with_class(scores, "mean", "mean_class")
    score = (
        F.lit(0.50) * F.col("stability_pos")
        + F.lit(0.30) * F.col("stability_same_sign")
        + F.lit(0.20) * F.col("stability_ge1")
    )
    high = (F.col("mean_class") >= C.HIGH_CLASS).cast("double")
    return scored.withColumns(
        {"mean_class3plus": high, "stability_score": score}
    ).withColumn(
        "instability_score", F.col("relative_sd") * (F.lit(1.0) - F.col("stability_score"))
    )


def most_unstable_first(report: DataFrame) -> DataFrame:
    return report.orderBy(
        F.desc_nulls_last("instability_score"), F.desc_nulls_last("sd"), *_key_order(report)
    )


def _key_order(report: DataFrame) -> list[str]:
    return report.columns[: report.columns.index("n_runs")]


def top_unstable(report: DataFrame, n: int = 20) -> DataFrame:
    return most_unstable_first(report).limit(n)
