"""Running sums, ranks and medians that never sort one group in one task.

A window over a hot group (or over the whole table) puts all of its rows into a
single task.  Here rows are range-partitioned on (group, order); a group may
span many slices.  Each slice computes its own running sum, and a small table
with one row per (slice, group) supplies what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitatrix.session import materialize


def _slices(df: DataFrame, keys: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys).withColumn("_slice", F.spark_partition_id())
    # both branches below must see the same slice numbers, so write them down
    return materialize(cut, "slices")


def running_sum(
    df: DataFrame, group: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per group; ``order`` must be total.

    Sort directions are ascending with NULLs last inside a group.
    """
    return running_sums(df, group, order, {out: value})


def running_sums(
    df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]
) -> DataFrame:
    """Several running sums (new column: summed column) over one order, in one pass."""
    flags = [f"_null_{c}" for c in order]
    keyed = df.select("*", *[F.col(c).isNull().alias(f) for c, f in zip(order, flags)])
    keys = group + [k for pair in zip(flags, order) for k in pair]
    cut = _slices(keyed, keys)

    inside = (
        Window.partitionBy("_slice", *group)
        .orderBy(*keys[len(group):])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    part = cut.groupBy("_slice", *group).agg(*[F.sum(v).alias(f"_part_{k}") for k, v in sums.items()])
    before = Window.orderBy("_slice") if not group else Window.partitionBy(*group).orderBy("_slice")
    # a group has at most one row per slice here
    offsets = part.select(
        F.col("_slice").alias("_o_slice"),
        *[F.col(g).alias(f"_o_{g}") for g in group],
        *[
            F.sum(f"_part_{k}").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{k}")
            for k in sums
        ],
    )
    cond = F.col("_slice") == F.col("_o_slice")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    summed = cut.withColumns({f"_inside_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    totals = []
    for k in sums:
        zero = F.lit(0).cast(part.schema[f"_part_{k}"].dataType)
        totals.append((F.col(f"_inside_{k}") + F.coalesce(f"_before_{k}", zero)).alias(k))
    return summed.join(offsets, cond, "inner").select(*df.columns, *totals)


def ordinal(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """1-based BIGINT row number per group; ``order`` must be total."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ones, group, order, "_one", out).drop("_one")


def grouped_median(
    df: DataFrame, group: list[str], value: str, weight: str, out: str
) -> DataFrame:
    """Exact median of ``value`` per group, each row counted ``weight`` times."""
    tall = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.sum(weight).cast("bigint").alias("_w")
    )
    ranked = running_sum(tall, group, [value], "_w", "_upto")
    # a second sum over the same slices would need another pass; totals are cheap
    total = tall.groupBy(*[F.col(g).alias(f"_t_{g}") for g in group]).agg(
        F.sum("_w").alias("_n")
    )
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
    low = F.floor((F.col("_n") + 1) / 2)
    high = F.floor(F.col("_n") / 2) + 1
    reached = F.col("_upto")
    return (
        ranked.join(total, cond, "inner")
        .where(reached >= low)
        .groupBy(*group)
        .agg(
            F.min(value).alias("_low"),
            F.min(F.when(reached >= high, F.col(value))).alias("_high"),
        )
        .select(*group, ((F.col("_low") + F.col("_high")) / 2).alias(out))
    )
