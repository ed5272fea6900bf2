"""Product-quantised vector codes; nearest entries by slices of sorted coordinates.

Vectors become integers and are cut into equal parts, and each part position has a codebook of at
most 64 entries.  The entries' coordinates are sorted in each dimension, and a prefix mask holds the
entries of every prefix of that order as bits of one unsigned 64-bit integer.  The entries within a
radius in one dimension are then the difference of two prefix masks, and the AND over all dimensions
is exactly the set of entries in the cube around a part.  Only those are measured.  When the nearest
of them lies within the radius, it is the nearest of all; otherwise the cube grows, to the distance
that was found or, if it was empty, to twice the radius.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from habitatrix.llm.tables import materialize, ship
from habitatrix.llm.vectors import below, common_size, finite, matrix
from habitatrix.session import lookup

#: One mask has a bit for each entry.
MAX_ENTRIES = 64


@dataclasses.dataclass(frozen=True)
class Settings:
    scale: int = 256  # a component x becomes floor(scale * x)
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    radius: int | None = None  # of the first cube; None takes one from the entries

    def __post_init__(self):
        if not 0 < self.entries <= MAX_ENTRIES:
            raise ValueError(f"a codebook has 1 to {MAX_ENTRIES} entries")


@dataclasses.dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position; ``dim`` is None if no vector could be used."""

    settings: Settings
    dim: int | None
    books: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def sha256(self) -> str:
        numbers = (str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


class Slices:
    """Sorted coordinates of one codebook with their prefix masks."""

    def __init__(self, entries, radius: int | None = None):
        import numpy as np

        self.entries = np.array(entries, dtype="int64")
        bits = np.uint64(1) << np.arange(len(self.entries), dtype="uint64")
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.entries, order, axis=0).T)
        none = np.zeros((1, order.shape[1]), dtype="uint64")
        prefixes = np.concatenate([none, np.bitwise_or.accumulate(bits[order], axis=0)])
        self.prefixes = np.ascontiguousarray(prefixes.T)
        self.radius = self._usual_gap() if radius is None else max(1, radius)

    def _usual_gap(self) -> int:
        """Median distance between an entry and the nearest different one."""
        import numpy as np

        far = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2).astype("float64")
        far[far == 0] = np.inf
        nearest = far.min(axis=1)
        nearest = nearest[np.isfinite(nearest)]
        return max(1, int(np.sqrt(np.median(nearest)))) if len(nearest) else 1

    def candidates(self, points, radius):
        """Mask of the entries that lie within ``radius`` of each point in every dimension."""
        import numpy as np

        mask = np.full(len(points), ~np.uint64(0))
        for d, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefixes, strict=True)):
            low = np.searchsorted(coordinates, points[:, d] - radius, side="left")
            high = np.searchsorted(coordinates, points[:, d] + radius, side="right")
            mask &= prefix[high] & ~prefix[low]
        return mask

    def nearest(self, points):
        """Nearest entry of each point (ties: the lower one) and the squared distance."""
        import numpy as np

        best = np.full(len(points), -1)
        distance = np.full(len(points), np.iinfo("int64").max)
        radius = np.full(len(points), self.radius)
        todo = np.arange(len(points))
        while len(todo):
            mask = self.candidates(points[todo], radius[todo])
            live = np.flatnonzero(mask)
            while len(live):
                m, row = mask[live], todo[live]
                entry = np.bitwise_count((m & (~m + np.uint64(1))) - np.uint64(1)).astype("int64")
                far = ((points[row] - self.entries[entry]) ** 2).sum(axis=1)
                # a grown cube shows the same entries again, in rising order, so ties stay low
                closer = (far < distance[row]) | ((far == distance[row]) & (entry < best[row]))
                best[row[closer]], distance[row[closer]] = entry[closer], far[closer]
                mask[live] = m & (m - np.uint64(1))
                live = live[mask[live] != 0]
            open_ = todo[(best[todo] < 0) | (distance[todo] > radius[todo] ** 2)]
            empty = best[open_] < 0
            root = np.ceil(np.sqrt(distance[open_].astype("float64"))).astype("int64")
            root += root * root < distance[open_]
            radius[open_] = np.where(empty, 2 * radius[open_], root)
            todo = open_
        return best, distance


def _limit(s: Settings, dim: int) -> float:
    """Components below it keep every squared distance of a whole vector in a long."""
    return 2.0**30 / dim**0.5 / s.scale


def _assigned(batch: pa.RecordBatch, books: Codebooks, slices: list[Slices]):
    import numpy as np

    s = books.settings
    x = np.floor(matrix(batch, "_vector", books.dim) * s.scale).astype("int64")
    parts = np.split(x, s.parts, axis=1)
    found = [c.nearest(p) for c, p in zip(slices, parts, strict=True)]
    return parts, [f[0] for f in found], [f[1] for f in found]


def _slices(books: Codebooks) -> list[Slices]:
    return [Slices(b, books.settings.radius) for b in books.books]


def _sums(books: Codebooks):
    """Sums and counts of the parts of each entry, one row per entry and task."""
    width = books.dim // books.settings.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        slices = _slices(books)
        shape = (len(slices), len(slices[0].entries))
        n, total = np.zeros(shape, dtype="int64"), np.zeros((*shape, width), dtype="int64")
        for batch in batches:
            parts, entries, _ = _assigned(batch, books, slices)
            for p, (x, e) in enumerate(zip(parts, entries, strict=True)):
                n[p] += np.bincount(e, minlength=shape[1])
                np.add.at(total[p], e, x)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype("int32")),
                pa.array(entry.astype("int32")),
                pa.array(n[part, entry]),
                pa.array(list(total[part, entry]), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "total"],
        )

    return run


def _usable(vectors: DataFrame, dim: int, s: Settings) -> DataFrame:
    kept = (F.size("_vector") == dim) & below("_vector", _limit(s, dim))
    return vectors.where(kept)


def _vectors(vectors: DataFrame, *columns: str) -> DataFrame:
    vector = F.col("embedding").cast("array<double>").alias("_vector")
    return vectors.select(*[F.col(f"`{c}`") for c in columns], vector).where(finite("_vector"))


def fit(vectors: DataFrame, settings: Settings = Settings()) -> Codebooks:
    """Codebooks of all ``vectors`` (``vec_id``, ``embedding``), each round over every one of them.

    A codebook starts as that part of the vectors with the smallest ids (repeated ids: by the vector;
    NULL ids last) and is replaced by the floored means of its parts; unused entries stay.  Tasks send
    one row of sums for each entry they met, so what reaches the driver has parts x entries rows.
    Vectors that are NULL, hold NULL or non-finite components, have another length than the commonest
    one that the parts divide, or are too large for longs do not count.
    """
    ship(vectors.sparkSession)
    s = settings
    named = _vectors(vectors, "vec_id")
    dim = common_size(named, "_vector", s.parts)
    if dim is None:
        return Codebooks(s, None, ())
    usable = _usable(named, dim, s)
    first = usable.orderBy(F.asc_nulls_last("vec_id"), "_vector").limit(s.entries)
    width = dim // s.parts
    ints = F.transform("_vector", lambda x: F.floor(x * s.scale))
    start = [r[0] for r in first.select(ints).collect()]
    if not start:
        return Codebooks(s, None, ())
    books = Codebooks(s, dim, tuple(tuple(tuple(v[p * width : (p + 1) * width]) for v in start) for p in range(s.parts)))
    schema = "part int, entry int, n bigint, total array<bigint>"
    totals = [F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)]
    for _ in range(s.rounds):
        sums = (
            usable.select("_vector")
            .mapInArrow(_sums(books), schema)
            .groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), F.array(*totals).alias("total"))
        )
        new = [list(b) for b in books.books]
        for r in sums.collect():
            new[r.part][r.entry] = tuple(int(t) // r.n for t in r.total)
        books = dataclasses.replace(books, books=tuple(map(tuple, new)))
    return books


def _codes(books: Codebooks, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        slices = _slices(books)
        digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), dtype="S2")
        for batch in batches:
            known = np.flatnonzero(batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False))
            code = np.full(batch.num_rows, None, dtype=object)
            error = np.zeros(batch.num_rows, dtype="int64")
            if len(known):
                _, entries, far = _assigned(batch, books, slices)
                text = np.ascontiguousarray(digits[np.stack(entries, axis=1)]).view(f"S{2 * len(entries)}")
                code[known], error[known] = text.ravel().astype(str), sum(far)
            made = [pa.array(code, pa.string()), pa.array(error, mask=np.equal(code, None))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema)

    return run


def encode(vectors: DataFrame, books: Codebooks, group: str = "label") -> DataFrame:
    """``vec_id``, ``group``, ``code``, ``error`` and ``label_error`` of every finite vector.

    A code has two hexadecimal digits for each part, and an error is the exact squared distance from
    the entries.  ``label_error`` sums it over the rows with an equal ``group``, NULLs together.
    Vectors that are NULL or hold NULL or non-finite components are dropped; those that have another
    length than the codebooks or are too large for longs stay with a NULL code and error, and a sum
    beyond a long is NULL.  Repeated rows are coded as often as they occur; an empty table gives an
    empty one; other columns are not read, whatever their names.
    """
    ship(vectors.sparkSession)
    named = _vectors(vectors, "vec_id", group)
    named = named.select(F.col("vec_id").alias("_id"), F.col(f"`{group}`").alias("_group"), "_vector")
    if books.dim is None:
        nothing = F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")
        coded = named.select("_id", "_group", *nothing)
    else:
        fits = (F.size("_vector") == books.dim) & below("_vector", _limit(books.settings, books.dim))
        schema = StructType(named.schema.fields[:2]).add("code", "string").add("error", "long")
        known = named.withColumn("_vector", F.when(fits, F.col("_vector")))
        coded = known.mapInArrow(_codes(books, schema.names), schema)
    coded = materialize(coded, "vector-codes")
    totals = coded.groupBy(F.col("_group").alias("_of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(lookup(totals), F.col("_group").eqNullSafe(F.col("_of")))
    return joined.select(
        F.col("_id").alias("vec_id"),
        F.col("_group").alias(group),
        "code",
        "error",
        "label_error",
        F.lit(books.sha256).alias("codebooks_sha256"),
    )
