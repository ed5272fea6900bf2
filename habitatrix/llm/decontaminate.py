"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased (A-Z) runs of letters, digits and non-ASCII bytes, so case and punctuation do
not matter.  A document is contaminated by an item if some window of ``overlap`` tokens of the item
lies in the document with at most ``substitutions`` tokens changed; a shorter item must lie there as
a whole, with proportionally fewer changes, and one of 11 tokens or fewer without any.

Fixed masks ignore token positions: for every way to place the allowed substitutions in a window,
one of ``MASKS`` avoids them at some shift, so the joined hashes miss no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.bitmaps import bitmap_of, may_hold
from habitatrix.llm.hashing import WORDLIKE, mix, runs, words
from habitatrix.llm.tables import materialize, rows_by_bytes, ship, texts_of, whole_text
from habitatrix.session import lookup

OVERLAP = 13
SUBSTITUTIONS = 2

#: Span 11; 1 is a token that counts, 0 one that is ignored.
MASKS = ("11000011111", "10011101011", "11110011001", "10111100101")
SPAN = len(MASKS[0])

#: Probes of the seeds' bitmap; one seed in 65,000 passes wrongly, and is dropped by the join.
PROBES = 4

TOKENS = "item_id bigint, n_tokens int, tokens binary"


def allowed(window: int) -> int:
    """Substitutions that a window of so many tokens may have."""
    return SUBSTITUTIONS * window // OVERLAP if window > SPAN else 0


def _seeds(hashes, first, shorter: tuple[int, ...]):
    """(hash, position) of every seed that lies inside one text."""
    import numpy as np

    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    masks = [(k, [i for i, c in enumerate(m) if c == "1"], SPAN) for k, m in enumerate(MASKS)]
    masks += [(100 + n, list(range(n)), n) for n in shorter]
    for k, offsets, span in masks:
        h = runs(hashes, offsets)[: max(0, len(hashes) - span + 1)]
        at = np.flatnonzero(row[: len(h)] == row[span - 1 : span - 1 + len(h)])
        yield mix(h[at] + np.uint64(k)).view("int64"), at


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows_by_bytes(batches, "_text"):
        hashes, first = words(*texts_of(part, "_text"), WORDLIKE)
        ends = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
        tokens = [hashes[a:b].tobytes() for a, b in ends]
        n = pa.array([len(t) // 8 for t in tokens], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), n, pa.array(tokens, pa.binary())], names=["item_id", "n_tokens", "tokens"]
        )


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for item, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = np.frombuffer(tokens, dtype="uint64")
            for h, at in _seeds(hashes, np.array([0, n]), (n,) if 0 < n < SPAN else ()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.full(len(h), item)), pa.array(at.astype("int32"))],
                    names=["seed", "item_id", "at"],
                )


def _hits(shared, shorter: tuple[int, ...]):
    """Regions of a document around seeds that may be in the benchmark."""
    margin, apart = OVERLAP, 2 * OVERLAP + SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bitmap = shared.value
        for part in rows_by_bytes(batches, "_text"):
            hashes, first = words(*texts_of(part, "_text"), WORDLIKE)
            seeds, at = [], []
            for h, place in _seeds(hashes, first, shorter):
                held = np.flatnonzero(may_hold(bitmap, h, PROBES))
                seeds.append(h[held])
                at.append(place[held])
            seeds, at = np.concatenate(seeds), np.concatenate(at)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            seeds, at = seeds[order], at[order]
            row = np.searchsorted(first, at, side="right") - 1
            new = np.append(True, (row[1:] != row[:-1]) | (at[1:] - at[:-1] > apart))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at))
            ids = part.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in ("doc_id", "region", "tokens", "hits")}
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                r = row[a]
                lo = max(int(first[r]), int(at[a]) - margin)
                hi = min(int(first[r + 1]), int(at[b - 1]) + SPAN + margin)
                out["doc_id"].append(ids[r])
                out["region"].append(lo - int(first[r]))
                out["tokens"].append(hashes[lo:hi].tobytes())
                places = (at[a:b] - lo).tolist()
                out["hits"].append([{"seed": s, "at": p} for s, p in zip(seeds[a:b].tolist(), places, strict=True)])
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out)
            )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        rows = []
        for doc, region, shift, tokens, item, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = np.frombuffer(tokens, dtype="uint64"), np.frombuffer(wanted, dtype="uint64")
            lo, hi = max(0, shift), min(len(x), shift + len(y))
            window = min(OVERLAP, len(y))
            if hi - lo < window:
                continue
            same = np.concatenate([[0], np.cumsum(x[lo:hi] == y[lo - shift : hi - shift])])
            matched = same[window:] - same[:-window]
            good = np.flatnonzero(matched >= window - allowed(window))
            if len(good):
                rows.append((doc, item, len(good), int(matched[good].max()), region + lo + int(good[0])))
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "n_windows", "n_matched", "first_token"],
            )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated (doc_id, item_id): ``n_windows``, ``n_matched`` and ``first_token``.

    ``n_windows`` counts qualifying windows over all alignments, ``n_matched`` is the most equal tokens
    in one, ``first_token`` where the first begins in the document.  Seeds are joined by hash.  Only the
    seeds' bitmap, of at most 64 MB, is sent to every task; both tables may be of any size.  NULL and
    empty texts match nothing; repeated rows count once for each of their occurrences' windows; NULL
    ids are ignored; further columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("_text"))
    items = materialize(
        items.where("item_id IS NOT NULL").distinct().mapInArrow(_item_tokens, TOKENS).where("n_tokens > 0"), "items"
    )
    seeds = materialize(items.mapInArrow(_item_seeds, "seed bigint, item_id bigint, at int"), "item-seeds")
    shorter = tuple(sorted(r[0] for r in items.where(F.col("n_tokens") < SPAN).select("n_tokens").distinct().collect()))
    bitmap = spark.sparkContext.broadcast(bitmap_of(seeds, "seed", seeds.count(), 64, PROBES))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("_text"))
    regions = narrow.where("doc_id IS NOT NULL").mapInArrow(
        _hits(bitmap, shorter),
        "doc_id bigint, region int, tokens binary, hits array<struct<seed: bigint, at: int>>",
    )
    regions = materialize(regions, "regions")
    places = F.explode("hits").alias("hit")
    hits = regions.select("doc_id", "region", places).select("doc_id", "region", "hit.seed", F.col("hit.at").alias("d"))
    aligned = hits.join(seeds, "seed").select("doc_id", "region", "item_id", (F.col("d") - F.col("at")).alias("shift"))
    found = (
        aligned.distinct()
        .join(regions.select("doc_id", "region", "tokens").dropDuplicates(), ["doc_id", "region"])
        .join(items.select("item_id", F.col("tokens").alias("wanted")), "item_id")
        .select("doc_id", "region", "shift", "tokens", "item_id", "wanted")
        .mapInArrow(_verify, "doc_id bigint, item_id bigint, n_windows bigint, n_matched int, first_token int")
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.sum("n_windows").alias("n_windows"),
        F.max("n_matched").alias("n_matched"),
        F.min("first_token").alias("first_token"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; all other rows stay as they are."""
    bad = materialize(overlaps(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(lookup(bad), "doc_id", "left_anti").select(docs.columns)
