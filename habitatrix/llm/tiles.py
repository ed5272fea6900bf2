"""Deal the members of groups of any size into tiles of bounded size in which every pair meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def into_tiles(rows: DataFrame, keys: list[str], member: str, block: int = 1024) -> DataFrame:
    """``rows`` with ``_i``, ``_j`` and ``_own``: a tile is the rows of one (keys, _i, _j).

    A group of up to ``block`` rows is one tile.  A larger one is split into blocks by a hash of
    ``member``; tile (i, j) holds blocks i and j, and ``_own`` is the row's block.  Each pair of rows
    meets in the tile of its two blocks.  Groups of one row are left out.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit("block")), blocks).cast("int")
    dealt = rows.join(sizes, keys).withColumn("_blocks", blocks).withColumn("_own", own)
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (
        dealt.withColumn("_i", F.least("_own", "_o")).withColumn("_j", F.greatest("_own", "_o"))
    ).drop("_n", "_blocks", "_o")
