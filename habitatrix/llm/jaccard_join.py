"""Documents whose word-shingle sets have a Jaccard similarity of 3/4 or more, exactly.

1. Equal sets become one class, by a digest of the set.
2. Two sets can only link if they share ``k`` of the first ``n - ceil(3n/4) + k`` shingles of each, in
   any order common to all sets; ``k`` is ``1 + n // 8``.  A set of which fewer are in any other set
   links with nothing.  The order puts shingles that are frequent in a sample last; the sample decides
   how much work there is, never the result.
3. A shingle and a pair of neighbouring size bands name a tile, so every pair that can link meets in
   one.  Each member of a tile is compared with the tile's smallest class; what links, merges.
4. Only tiles that still hold more than one component compare all members across components.  Those
   with the same smallest class are merged, and large ones are split into blocks of bounded size.
5. A comparison first bounds the overlap from above by hashed bitmaps, as wide as the size band asks
   for: a bit of one set that the other lacks is at least one shingle that is not shared.  What passes
   is intersected exactly, as sorted arrays.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.bitmaps import bitmap_of, may_hold
from habitatrix.llm.components import connected
from habitatrix.llm.hashing import mix, runs, words
from habitatrix.llm.tables import materialize, rows_by_bytes, ship, texts_of, whole_text
from habitatrix.llm.tiles import into_tiles
from habitatrix.session import lookup

WORDS = 5

#: Text that is hashed at a time; the arrays of each task are about 50 times as large.
SLICE = 1 << 19

#: Similarity as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 3, 4


@dataclasses.dataclass(frozen=True)
class Settings:
    sampled: int = 4_000  # sets, about, in which frequent shingles are looked for
    frequent: int = 4  # sampled sets that make a shingle frequent
    per_bucket: int = 600_000  # shingles that one task sorts
    block: int = 512  # sets in one side of a tile


def shingles(data, bounds):
    """Sorted distinct shingle hashes of each text."""

    h, first = words(data, bounds)
    five = runs(h, range(WORDS))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(five[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(runs(h[a:b], range(b - a)) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def bands(n):
    """Size band of each set: linked sets are in the same or neighbouring bands."""

    return np.floor(np.log(np.maximum(n, 1)) / np.log(DENOMINATOR / NUMERATOR) + 1e-9).astype("int64")


def needed(n):
    """Shingles of its prefix that a set must share."""
    return 1 + n // 8


def prefix_length(n):
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + needed(n)


def signature(hashes, band: int):
    """Bitmap as bytes: about four bits for each shingle of the band's largest set."""

    top = (DENOMINATOR / NUMERATOR) ** (band + 1)
    bits = 1 << max(6, int(np.ceil(np.log2(4 * top))))
    flags = np.zeros(bits, dtype=bool)
    flags[(hashes & np.uint64(bits - 1)).astype("int64")] = True
    return np.packbits(flags)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

    for part in rows_by_bytes(batches, "_text", SLICE):
        sets = shingles(*texts_of(part, "_text"))
        d1 = [int(np.bitwise_xor.reduce(mix(s)).view("int64")) if len(s) else 0 for s in sets]
        d2 = [int(mix(s + np.uint64(77)).sum(dtype="uint64").view("int64")) if len(s) else 0 for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())],
            names=["doc_id", "n", "d1", "d2"],
        )


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows_by_bytes(batches, "_text", SLICE):
        for s in shingles(*texts_of(part, "_text")):
            yield pa.RecordBatch.from_arrays([pa.array(s.view("int64"))], names=["h"])


def _prefixes(shared, bits: int, flush: int = 500_000):
    """Prefix shingles of each set, packed by bucket: keys, classes and set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    
        frequent = shared.value
        held: list[tuple] = []
        n_held = 0

        def packed():
            key, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (key >> np.uint64(64 - bits)).astype("int64")
            order = np.argsort(bucket, kind="stable")
            key, doc, n, bucket = key[order], doc[order], n[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            last = np.append(first[1:], len(key))
            spans = list(zip(first.tolist(), last.tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first].astype("int32")),
                    *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, doc, n)),
                ],
                names=["bucket", "keys", "docs", "sizes"],
            )

        for part in rows_by_bytes(batches, "_text", SLICE):
            ids = part.column(0).to_pylist()
            for doc, s in zip(ids, shingles(*texts_of(part, "_text")), strict=True):
                if not len(s):
                    continue
                at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                often = frequent[at] == s if len(frequent) else np.zeros(len(s), dtype=bool)
                prefix = np.concatenate([s[~often], s[often]])[: prefix_length(len(s))]
                held.append((prefix, np.full(len(prefix), doc), np.full(len(prefix), len(s))))
                n_held += len(prefix)
            if n_held >= flush:
                yield packed()
                held, n_held = [], 0
        if held:
            yield packed()

    return run


def _tiles_of_bucket(pdf):
    """Members of every tile of two classes or more; ``once`` marks one row of each shared shingle."""
    import pandas as pd

    kinds = (("keys", "uint64"), ("docs", "int64"), ("sizes", "int64"))
    key, doc, n = (np.frombuffer(b"".join(pdf[c]), dtype=t) for c, t in kinds)
    order = np.lexsort((doc, key))
    key, doc, n = key[order], doc[order], n[order]
    same = key[1:] == key[:-1]
    other = np.append(True, ~same | (doc[1:] != doc[:-1]))  # a repeated row of the input counts once
    key, doc, n = key[other], doc[other], n[other]
    same = key[1:] == key[:-1]
    often = np.append(False, same) | np.append(same, False)
    key, doc, n = key[often], doc[often], n[often]
    band, m = bands(n), len(key)
    tile = np.concatenate([band, band - 1])
    order = np.lexsort((np.tile(doc, 2), tile, np.tile(key, 2)))
    tile, at = tile[order], order % m if m else order
    new = np.append(True, (key[at][1:] != key[at][:-1]) | (tile[1:] != tile[:-1]))[: len(at)]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    kept = np.repeat(size > 1, size)
    tile, at, upper = tile[kept], at[kept], (order < m)[kept]
    # of a shingle's two rows the upper band's counts, or the only one
    both = np.bincount(at, minlength=m)[at] > 1
    return pd.DataFrame(
        {"h": key[at].view("int64"), "tile": tile.astype("int32"), "doc": doc[at], "n": n[at], "once": upper | ~both}
    )


def _wanted(shared):
    """Whole sets, with bitmaps, of texts that are likely among the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    
        bitmap = shared.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            some = batch.filter(pa.array(may_hold(bitmap, ids.astype("int64"))))
            for part in rows_by_bytes([some], "_text", SLICE):
                sets = shingles(*texts_of(part, "_text"))
                n = np.array([len(s) for s in sets])
                lower = [signature(s, b).tobytes() for s, b in zip(sets, bands(n).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n),
                        pa.array(lower, pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc", "n", "bits", "hashes"],
                )

    return run


def fold(bits, width: int):
    """A bitmap (one or one a row, as bytes) reduced to ``width`` bytes."""

    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, width), axis=-2)


def _may_link(n_a, n_b, only_a, only_b):
    """Upper bound of the overlap against the overlap that a link needs."""

    most = np.minimum(n_a - only_a, n_b - only_b)
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n_a + n_b)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose bitmaps leave a link possible."""

    for batch in batches:
        kept = np.zeros(batch.num_rows, dtype=bool)
        columns = (batch.column(i).to_pylist() for i in range(2, 6))
        for i, (n_a, n_b, bits_a, bits_b) in enumerate(zip(*columns, strict=True)):
            x, y = np.frombuffer(bits_a, dtype="uint8"), np.frombuffer(bits_b, dtype="uint8")
            width = min(len(x), len(y))
            x, y = fold(x, width), fold(y, width)
            kept[i] = _may_link(n_a, n_b, int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()))
        yield batch.select([0, 1]).filter(pa.array(kept))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that link, by intersecting their sorted arrays."""

    for batch in batches:
        kept = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), dtype="uint64") for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept[i] = DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)
        yield batch.select([0, 1]).filter(pa.array(kept))


def _across(pdf):
    """Pairs of one tile that are in different components and whose bitmaps leave a link possible."""
    import pandas as pd

    i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
    raw = [np.frombuffer(b, dtype="uint8") for b in pdf["bits"]]
    width = min(map(len, raw))
    bits = np.stack([fold(b, width) for b in raw])
    bits = np.pad(bits, ((0, 0), (0, -width % 8))).view("uint64")
    doc, root, n, own = (pdf[c].to_numpy() for c in ("doc", "root", "n", "_own"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    a_all, b_all = [], []
    for x in left:
        y = right[(root[right] != root[x]) & ((doc[right] > doc[x]) if i == j else True)]
        y = y[(DENOMINATOR * n[y] >= NUMERATOR * n[x]) & (DENOMINATOR * n[x] >= NUMERATOR * n[y])]
        only_x = np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype="int64")
        only_y = np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype="int64")
        y = y[_may_link(n[x], n[y], only_x, only_y)]
        a_all.append(np.full(len(y), doc[x]))
        b_all.append(doc[y])
    a, b = np.concatenate([doc[:0], *a_all]), np.concatenate([doc[:0], *b_all])
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those that link."""

    def side(name: str, column: str) -> DataFrame:
        return sets.select(F.col("doc").alias(name), F.col(column).alias(f"{column}_{name}"))

    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    both = both.where(f"{DENOMINATOR} * n_a >= {NUMERATOR} * n_b AND {DENOMINATOR} * n_b >= {NUMERATOR} * n_a")
    possible = both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded, "a bigint, b bigint")
    full = possible.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b")
    return full.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_exact, "a bigint, b bigint")


def _open(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """(h, tile, doc, root) of the tiles that hold several components; equal tiles once."""
    roots = connected(links).select(F.col("node").alias("doc"), F.col("component").alias("root"))
    rooted = tiles.select("h", "tile", "doc").join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    mixed = rooted.groupBy("h", "tile").agg(
        F.min("root").alias("lo"),
        F.max("root").alias("hi"),
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"),
    )
    mixed = mixed.where("lo <> hi").groupBy("tile", "size", "who").agg(F.min("h").alias("h"))
    return materialize(rooted.join(mixed.select("h", "tile"), ["h", "tile"]), "open-tiles")


def components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of other bytes than blank and 09-0D, lower-cased in A-Z.  A text's set has its
    distinct five-word shingles, or its whole word sequence if that is shorter; without words it is
    empty and links with nothing.  ``component_id`` is the smallest id reachable by links.  Rows with
    a NULL id are left out; rows that share an id should have the same text.
    """
    spark, s = docs.sparkSession, settings
    ship(spark)
    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("_text")
    )
    rows = materialize(named.mapInArrow(_sets, "doc_id bigint, n bigint, d1 bigint, d2 bigint"), "sets")
    key = ["n", "d1", "d2"]
    classes = materialize(rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("doc")), "classes")
    copies = rows.join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti").select("doc_id").distinct()
    firsts = named.join(lookup(materialize(copies, "copies")), "doc_id", "left_anti")

    length = F.expr(f"n - ceil({NUMERATOR} * n / {DENOMINATOR}) + 1 + n div 8")
    total, postings = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    part = F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1 << 30)) < int((1 << 30) * min(1, s.sampled / max(1, total)))
    often = named.where(part).mapInArrow(_all_shingles, "h bigint").groupBy("h").count()
    frequent = often.where(F.col("count") >= s.frequent).select("h").toPandas()["h"].to_numpy().astype("int64")
    frequent = spark.sparkContext.broadcast(np.sort(frequent.view("uint64")))
    bits = max(4, (int(postings) // s.per_bucket).bit_length())
    packed = firsts.mapInArrow(_prefixes(frequent, bits), "bucket int, keys binary, docs binary, sizes binary")
    shared = packed.groupBy("bucket").applyInPandas(
        _tiles_of_bucket, "h bigint, tile int, doc bigint, n bigint, once boolean"
    )
    shared = materialize(shared, "shared-shingles")
    members = shared.where("once").groupBy("doc").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    members = materialize(members.where("k >= 1 + n div 8").select("doc"), "members")
    kept = shared.select("h", "tile", "doc").join(lookup(members), "doc", "left_semi")
    leaders = kept.groupBy("h", "tile").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("size"))
    tiles = materialize(kept.join(leaders.where("size > 1").drop("size"), ["h", "tile"]), "tiles")

    # Texts that only seem to be members do no harm: nothing asks for their sets.
    bitmap = spark.sparkContext.broadcast(bitmap_of(members, "doc", members.count()))
    sets = firsts.mapInArrow(_wanted(bitmap), "doc bigint, n bigint, bits binary, hashes binary")
    sets = materialize(sets, "member-sets")

    near = tiles.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    tried = materialize(near, "leader-pairs")
    links = materialize(_linked(tried, sets), "leader-links")
    open_ = _open(tiles, links)
    # Tiles with the same smallest member are merged: their members mostly are the same, too.
    heads = open_.groupBy("h", "tile").agg(F.min("doc").alias("head"))
    merged = open_.join(heads, ["h", "tile"]).select("head", "tile", "doc", "root").distinct()
    dealt = into_tiles(merged, ["head", "tile"], "doc", s.block).join(sets.select("doc", "n", "bits"), "doc")
    rest = dealt.groupBy("head", "tile", "_i", "_j").applyInPandas(_across, "a bigint, b bigint").distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "block-pairs")
    links = links.unionByName(materialize(_linked(rest, sets), "block-links"))
    found = connected(links).select(F.col("node").alias("doc"), "component")
    known = classes.join(found, "doc", "left").select(*key, F.coalesce("component", "doc").alias("component_id"))
    out = rows.join(known, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents of a component that are not its first."""
    found = components(docs, settings)
    copies = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(lookup(copies), "doc_id", "left_anti").select(docs.columns)
