"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.tables import materialize


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest member.

    Each round points every node at its smallest neighbour and follows pointers twice; links then
    join the nodes pointed at, once each, until none is left.  Chains at least halve in a round, so
    the number of rounds grows with the logarithm of the longest chain.
    Aggregates combine before they shuffle and pointers are unique by node, so a node with very many
    links is no hot task.  Each round is written to the shared folder.  Rows with a NULL end, loops
    and repeated links are ignored.
    """
    left = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    left = materialize(left.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    node = left.schema["u"].dataType.simpleString()
    steps: list[DataFrame] = []
    while not left.isEmpty():
        parent = left.groupBy("u").agg(F.min("v").alias("p"))
        # p of p: a node without a smaller neighbour keeps itself
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = materialize(
            parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "pointers"
        )
        steps.append(jumped)
        x = jumped.select(F.col("u"), F.col("p").alias("pu"))
        y = jumped.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        ends = left.join(x, "u").join(y, "v", "left").select(F.col("pu"), F.coalesce("pv", "v").alias("pv"))
        ends = ends.where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v"))
        left = materialize(ends.distinct(), "links")
    if not steps:
        return links.sparkSession.createDataFrame([], f"node {node}, component {node}")
    # A node is pointed away in one round; what it points at may be pointed away in a later one.
    found = steps[-1]
    for earlier in reversed(steps[:-1]):
        later = found.select(F.col("u").alias("p"), F.col("p").alias("root"))
        followed = earlier.join(later, "p", "left").select("u", F.coalesce("root", "p").alias("p"))
        found = materialize(followed.unionByName(found).distinct(), "followed")
    roots = found.select(F.col("p").alias("u")).distinct().join(found.select("u"), "u", "left_anti")
    whole = found.unionByName(roots.select("u", F.col("u").alias("p")))
    return whole.select(F.col("u").alias("node"), F.col("p").alias("component"))
