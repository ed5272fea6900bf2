"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction, and holds the vectors whose cosine with it reaches a bound.  The directions
form random product codes: after a random rotation a vector is cut into sub-vectors, each part of a
direction comes from a small code of unit vectors, and every combination is a direction.  A vector's
filters are list-decoded: parts are tried from the best inner product down, and a branch ends where
even the best remaining parts cannot reach the bound.  A vector that few directions suit gets a lower
bound of its own, so that each is in ``least`` filters.  Vectors that share a filter are compared.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.components import connected
from habitatrix.llm.tables import materialize, ship
from habitatrix.llm.tiles import into_tiles


@dataclasses.dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    per_vector: int = 24  # filters that a random vector is in, on average
    least: int = 24  # filters that every vector is in
    per_filter: int = 64  # vectors that a filter would hold, were they spread evenly
    parts: int = 3
    seed: int = 7


def codes(dim: int, filters: int, s: Settings):
    """Rotation, code of each part, and the bound that lets ``per_vector`` of all filters pass."""
    from statistics import NormalDist

    import numpy as np

    rng = np.random.default_rng([s.seed, dim])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    parts = min(s.parts, dim)
    words = max(2, round(filters ** (1 / parts)))
    cut = np.array_split(np.arange(dim), parts)
    code = []
    for c in cut:
        x = rng.standard_normal((words, len(c)))
        code.append(x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(len(c) / dim))
    share = min(0.5, s.per_vector / words**parts)
    return turn, cut, code, NormalDist().inv_cdf(1 - share) / np.sqrt(dim)


def nth_best(products, n: int):
    """The ``n``-th largest sum of one product from each part, for each vector.

    A sum of the r-th, s-th, ... largest products of the parts is below r * s * ... - 1 others, so only
    ranks whose product is at most ``n`` matter.
    """
    import numpy as np

    ranked = [-np.sort(-p, axis=1) for p in products]
    sums, product = ranked[0][:, :n], np.arange(1, ranked[0][:, :n].shape[1] + 1)
    for p in ranked[1:]:
        i, r = np.nonzero(product[:, None] * np.arange(1, p.shape[1] + 1) <= n)
        sums, product = sums[:, i] + p[:, r], product[i] * (r + 1)
    n = min(n, sums.shape[1])
    return -np.partition(-sums, n - 1, axis=1)[:, n - 1]


def decode(vectors, turn, cut, code, bound, least: int):
    """(vector, filter) of every filter that reaches the bound, or a vector's ``least`` best ones."""
    import numpy as np

    x = vectors @ turn
    products = [x[:, c] @ w.T for c, w in zip(cut, code, strict=True)]
    best = [p.max(axis=1) for p in products]
    bound = np.minimum(bound, nth_best(products, least) - 1e-12)
    row, key, total = np.arange(len(x)), np.zeros(len(x), dtype="int64"), np.zeros(len(x))
    for k, p in enumerate(products):
        rest = sum((b for b in best[k + 1 :]), np.zeros(len(x)))
        need = bound[row] - total - rest[row]
        i, word = np.nonzero(p[row] >= need[:, None])
        total = total[i] + p[row[i], word]
        key = key[i] * p.shape[1] + word
        row = row[i]
    return row, key


def _unit(batch: pa.RecordBatch, column: int):
    """Rows with a usable vector, by dimension, as unit vectors."""
    import numpy as np

    by_dim: dict[int, list] = {}
    for i, v in enumerate(batch.column(column).to_pylist()):
        if v and None not in v:
            by_dim.setdefault(len(v), []).append((i, v))
    for dim, rows in sorted(by_dim.items()):
        x = np.array([v for _, v in rows], dtype="float64")
        largest = np.abs(x).max(axis=1)
        good = np.flatnonzero(np.isfinite(largest) & (largest > 0))
        x = x[good] / largest[good, None]  # tiny and huge components keep their squares in range
        yield dim, [rows[i][0] for i in good], x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(count: int, s: Settings):
    filters = max(8, count * s.per_vector // s.per_filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        made: dict = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, rows, x in _unit(batch, 1):
                if dim not in made:
                    made[dim] = codes(dim, filters, s)
                for at in range(0, len(x), 2048):
                    some = x[at : at + 2048]
                    row, key = decode(some, *made[dim], s.least)
                    raw = [v.tobytes() for v in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), dim, dtype="int32")),
                            pa.array(key),
                            pa.array(ids[np.array(rows[at : at + 2048])[row]]),
                            pa.array([raw[i] for i in row], pa.binary()),
                        ],
                        names=["dim", "filter", "vec", "unit"],
                    )

    return run


def _compare(cosine: float):
    def run(pdf):
        import numpy as np
        import pandas as pd

        x = np.stack([np.frombuffer(u, dtype="float64") for u in pdf["unit"]])
        ids, own = pdf["vec"].to_numpy(), pdf["_own"].to_numpy()
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.nonzero(x[left] @ x[right].T >= cosine - 1e-9)
        a, b = left[a], right[b]
        kept = ids[a] < ids[b] if i == j else np.ones(len(a), dtype=bool)
        a, b = a[kept], b[kept]
        good = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = ids[a[good]], ids[b[good]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _usable(v: str):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.exists(v, lambda x: x != 0) & ~bad, F.lit(False))


def link(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``): ``n_links``, ``component_id``, ``kept``.

    Equal vectors are compared once and counted with their copies.  A filter that holds many vectors
    is split into blocks, and every pair of blocks is compared; nothing is capped.  Vectors that are
    NULL, empty or zero, or have NULL or non-finite components, link with nothing, and only vectors
    of the same length are compared.  A repeated id counts as another vector; rows with a NULL id are
    left out.  Pairs below the cosine are never linked; of those above it, filters miss few (see the
    README for the recall).  Further columns are not read.
    """
    ship(vectors.sparkSession)
    named = vectors.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    digest = F.xxhash64("embedding"), F.xxhash64(F.lit(1), F.size("embedding"), "embedding")
    usable = _usable("embedding")
    rows = materialize(
        named.select("vec_id", F.when(usable, digest[0]).alias("d1"), F.when(usable, digest[1]).alias("d2")), "vectors"
    )
    classes = materialize(
        rows.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("n")),
        "vector-classes",
    )
    firsts = named.join(classes.select(F.col("vec").alias("vec_id")), "vec_id", "left_semi")
    firsts = firsts.groupBy("vec_id").agg(F.first("embedding").alias("embedding"))
    held = firsts.mapInArrow(
        _filters(classes.count(), settings), "dim int, filter bigint, vec bigint, unit binary"
    )
    held = materialize(held, "filters")
    tiles = into_tiles(held, ["dim", "filter"], "vec").groupBy("dim", "filter", "_i", "_j")
    links = materialize(tiles.applyInPandas(_compare(settings.cosine), "a bigint, b bigint").distinct(), "vector-links")
    roots = connected(links)
    size = classes.select(F.col("vec").alias("b"), F.col("n").alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size, "b").groupBy(F.col("a").alias("vec")).agg(F.sum("size").alias("near"))
    known = (
        classes.join(near, "vec", "left")
        .join(roots.select(F.col("node").alias("vec"), "component"), "vec", "left")
        .select(
            "d1",
            "d2",
            (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
            F.coalesce("component", "vec").alias("component_id"),
        )
    )
    out = rows.join(known, ["d1", "d2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
