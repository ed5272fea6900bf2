"""Whitened principal components of embeddings by a bidiagonal qd solver.

Every task reduces its centred rows, block after block, to one small triangle by QR, and triangles are
stacked and reduced again in groups until one is left: ``R'R`` is the scatter of all rows, but squares
of the data are never formed.  ``bidiagonal`` finds the singular values and right singular vectors of
``R``, which are the whitening directions.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.bidiagonal import EPS, right_singular
from habitatrix.llm.tables import materialize, ship
from habitatrix.llm.vectors import below, common_size, finite, matrix

#: Triangles, or blocks of moments, that one task combines: as many as these bytes hold, at least two.
GROUP_BYTES = 1 << 24

#: Components of this magnitude or more are left out like infinite ones: sums of a batch stay in a long.
TOO_LARGE = 2.0**40


@dataclasses.dataclass(frozen=True)
class Settings:
    scale: int = 64  # an entry c becomes floor(scale * c) + shift
    shift: int = 1_000_000
    components: int = 32


@dataclasses.dataclass(frozen=True)
class Model:
    """Fit over ``n`` rows: sums per dimension, eigenvalues (falling) and unit directions as columns."""

    settings: Settings
    dim: int
    n: int
    sums: tuple[int, ...]
    values: object
    directions: object
    total: float

    @property
    def rank(self) -> int:
        """Components that are above the rounding of the largest one, at most as many as asked for."""
        kept = self.values > (self.dim * EPS) ** 2 * max(self.values.max(initial=0.0), 0.0)
        return min(int(kept.sum()), self.settings.components)


def _integers(batch: pa.RecordBatch, dim: int, s: Settings):
    import numpy as np

    return np.floor(matrix(batch, "_vector", dim) * s.scale).astype("int64") + s.shift


class _Centre:
    """``x - S / n`` with one rounding of the fraction, and ``n * x - S`` in integers."""

    def __init__(self, n: int, sums):
        import numpy as np

        self.n = n
        self.whole = np.array([t // n for t in sums], dtype="int64")
        self.rest = np.array([t % n for t in sums], dtype="int64")
        self.fraction = self.rest / n

    def __call__(self, x):
        return (x - self.whole) - self.fraction

    def deviation(self, x):
        """Sum of the squares of ``n * x - S``, and where it fits a long.

        Longs wrap round, so the sum is exact wherever the true one fits.
        """
        import numpy as np

        d = x - self.whole
        exact = self.n * d - self.rest
        about = ((self.n * (d - self.fraction)) ** 2).sum(axis=1)
        return (exact * exact).sum(axis=1), about < 2.0**63 * (1 - 1e-9)


def _task_sums(dim: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch, dim, s)
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))],
                    names=["n", "total"],
                )

    return run


def _packed(key: int, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int64()), pa.array([value.tobytes()], pa.binary())], names=["key", "value"]
    )


def _task_triangle(dim: int, centre: _Centre, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        r = None
        for batch in batches:
            block = centre(_integers(batch, dim, s))
            r = block if r is None else np.concatenate([r, block])
            r = np.linalg.qr(r, mode="r")
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    return run


def _join_triangles(dim: int):
    import numpy as np

    def combine(values: list[bytes]):
        return np.linalg.qr(np.concatenate([np.frombuffer(v).reshape(-1, dim) for v in values]), mode="r")

    return combine


def _join_moments(k: int):
    """Count, mean and centred products of several blocks of rows."""
    import numpy as np

    def combine(values: list[bytes]):
        n, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
        for v in values:
            m = np.frombuffer(v)
            apart = m[1 : k + 1] - mean
            both = n + m[0]
            products = products + m[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * m[0] / both)
            mean, n = mean + apart * (m[0] / both), both
        return np.concatenate([[n], mean, products.ravel()])

    return combine


def reduced(pieces: DataFrame, combine: Callable, size: int, label: str):
    """Combine rows (``key``, ``value`` of ``size`` numbers) in groups until one group is left, then that here.

    Keys say in which order values meet, so a repeated task gives the same bits.
    """
    import numpy as np

    fan_in = max(2, GROUP_BYTES // (8 * size))

    def some(pdf):
        import pandas as pd

        values = pdf.sort_values("key")["value"].tolist()
        return pd.DataFrame({"key": [int(pdf["key"].min()) // fan_in], "value": [combine(values).tobytes()]})

    pieces = materialize(pieces, label)
    while pieces.count() > fan_in:
        group = F.floor(F.col("key") / fan_in)
        pieces = materialize(pieces.groupBy(group).applyInPandas(some, "key bigint, value binary"), label)
    values = [r["value"] for r in pieces.orderBy("key").collect()]
    return np.asarray(combine(values)) if values else None


def _prepared(vectors: DataFrame) -> DataFrame:
    named = vectors.select(F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("_vector"))
    return named.where(finite("_vector")).where(below("_vector", TOO_LARGE))


def fit(vectors: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Whitening directions of all usable rows of ``vectors``; None if there is none.

    Rows count that are not NULL, hold no NULL, non-finite or too large entry, and have the commonest
    length.  Two passes: exact integer sums, then the triangles of centred rows.  One triangle of
    dim x dim numbers reaches the driver from each of the last groups, ``GROUP_BYTES`` in all.
    """
    import numpy as np

    ship(vectors.sparkSession)
    named = _prepared(vectors)
    dim = common_size(named, "_vector")
    if dim is None:
        return None
    rows = named.where(F.size("_vector") == dim).select("_vector")
    totals = [F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dim)]
    sums = rows.mapInArrow(_task_sums(dim, settings), "n bigint, total array<bigint>")
    n, total = sums.agg(F.sum("n"), F.array(*totals)).first()
    total = tuple(int(t) for t in total)
    centre = _Centre(n, total)
    parts = rows.mapInArrow(_task_triangle(dim, centre, settings), "key bigint, value binary")
    r = reduced(parts, _join_triangles(dim), dim * dim, "triangles")
    square = np.zeros((dim, dim))
    square[: len(r)] = r
    values, directions = right_singular(square)
    values = values / n
    return Model(settings, dim, n, total, values, directions, float(values.sum()))


def _project(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        k = model.rank
        centre = _Centre(model.n, model.sums)
        turn = model.directions[:, :k] / np.sqrt(model.values[:k])
        for batch in batches:
            x = _integers(batch, model.dim, model.settings)
            deviation, fits = centre.deviation(x)
            white = centre(x) @ turn
            ends = np.arange(len(x) + 1, dtype="int32") * k
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, mask=~fits), lists], names=["_id", "deviation", "whitened"]
            )

    return run


def _task_moments(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        combine, held = _join_moments(k), None
        for batch in batches:
            w = matrix(batch, "whitened", k)
            if len(w):
                mean = w.mean(axis=0)
                block = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                held = block if held is None else combine([held.tobytes(), block.tobytes()])
        if held is not None:
            yield _packed(TaskContext.get().partitionId(), held)

    return run


def whiten(vectors: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """``vec_id``, ``whitened`` (an array of components) and ``deviation`` of every usable row.

    ``deviation`` is the exact sum of ``(n * x - S)`` squared over the dimensions, NULL if a long cannot
    hold it.  Directions that carry nothing but rounding are left out, so a table with fewer different
    rows than components gives shorter arrays.  Repeated rows and NULL ids stay; an empty table, or one
    without a usable row, gives an empty one; further columns are not read.
    """
    model = model or fit(vectors, settings)
    named = _prepared(vectors)
    empty = named.where(F.lit(False)).select(
        "_id", F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")
    )
    made = empty
    if model is not None:
        made = named.where(F.size("_vector") == model.dim).mapInArrow(_project(model), empty.schema)
    return made.select(F.col("_id").alias("vec_id"), "deviation", "whitened")


def identity_error(whitened: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity.

    Every block of rows is centred before its products are formed, and blocks meet with the distance of
    their means.  None if there are no rows or no components.
    """
    import numpy as np

    k = whitened.select(F.max(F.size("whitened"))).first()[0]
    if not k:
        return None
    parts = whitened.select("whitened").mapInArrow(_task_moments(k), "key bigint, value binary")
    m = reduced(parts, _join_moments(k), 1 + k + k * k, "moments")
    return float(np.abs(m[k + 1 :].reshape(k, k) / m[0] - np.eye(k)).max())


def components(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling eigenvalue.

    ``explained`` is the component's share of the whole variance; ``identity_error`` is one value for
    the table, measured over the rows that are returned.  A vector of a table without any variance has
    no component and no row.
    """
    model = fit(vectors, settings)
    white = materialize(whiten(vectors, model, settings), "whitened")
    if model is None:
        share, error, n = [], None, None
    else:
        share, error, n = [float(v / model.total) for v in model.values[: model.rank]], identity_error(white), model.n
    tall = white.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    shares = F.array(*[F.lit(v) for v in share]) if share else F.array().cast("array<double>")
    return tall.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
