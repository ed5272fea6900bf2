"""Column expressions for effort, diversity and enrichment statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitatrix import config as C


def ratio(num: Column, den: Column, otherwise: float | None = 0.0) -> Column:
    """``num / den`` where ``den > 0``."""
    out = F.when(den > 0, num.cast("double") / den.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def effort_index(n_events: Column, n_species: Column) -> Column:
    return F.lit(0.5) * n_events + F.lit(0.5) * ratio(n_species, n_events)


def inverse_effort_weight(effort: Column, median: Column) -> Column:
    raw = F.when(effort > 0, median / effort).otherwise(F.lit(1.0))
    return F.least(F.greatest(raw, F.lit(C.WEIGHT_FLOOR)), F.lit(C.WEIGHT_CEILING))


def rank_stratum(rank: Column, total: Column, n_strata: int = C.N_STRATA) -> Column:
    """Stratum of a 1-based rank.  Not NTILE: group sizes differ elsewhere."""
    raw = F.floor((F.lit(n_strata) * rank - F.lit(1)) / total)
    return F.least(raw, F.lit(n_strata - 1)).cast("bigint")


def margalef(species: Column, records: Column) -> Column:
    return F.when(records > 1, (species - 1) / F.log(records.cast("double")))


def smoothed(successes: Column, weight: Column, a: float, b: float) -> Column:
    return (successes + F.lit(a)) / (weight + F.lit(a + b))


def log_lift(p: Column, q: Column) -> Column:
    return F.when(q > 0, F.log2(p / q))


def sign_share(pos: Column, zero: Column, neg: Column, n: Column, mean: Column) -> Column:
    """Share of runs whose sign is the sign of the mean."""
    same = F.when(mean > 0, pos).when(mean < 0, neg).otherwise(zero)
    return same.cast("double") / n
