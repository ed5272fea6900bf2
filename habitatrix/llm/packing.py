"""Sum-of-squares packing of tokenized documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.chunked import ByteEncoder, opened
from habitatrix.llm.tables import materialize, rows_by_bytes, ship, texts_of, whole_text

#: Pieces that one packing task takes; a shard wastes a few sequences at most.
SHARD_PIECES = 60_000

#: Bytes of text that a worker encodes at a time; its arrays are many times as large.
SLICE = 1 << 19

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(model: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(ByteEncoder, model)
        for part in rows_by_bytes(batches, "_text", SLICE):
            rows: list[tuple] = []
            doc_ids = part.column(0).to_pylist()
            encoded = encoder.encode(part.column(1).to_pylist(), *texts_of(part, "_text"))
            for doc, ids in zip(doc_ids, encoded, strict=True):
                ids += end
                n = len(ids) // 4
                at, to, k = 0, n % capacity or min(n, capacity), 0
                while at < n:
                    rows.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to, k = to, to + capacity, k + 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def cut(docs: DataFrame, model: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids with ``end_id`` after them; only longer ones are cut.

    The first piece has the remainder, the others are full.  NULL texts are empty.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("_text"))
    return narrow.mapInArrow(_pieces(model, capacity, end_id), PIECE_SCHEMA)


def sum_of_squares(lengths, capacity: int):
    """Bin and offset of each item, longest items first.

    ``open_bins[g]`` counts the bins with gap ``g``.  An item goes to the open bin that leaves the sum
    of the squared counts smallest; ties take the smaller gap.  A bin is opened when none has room.
    """
    import numpy as np

    n = len(lengths)
    bins, offsets = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")
    open_bins = np.zeros(capacity + 1, dtype="int64")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        room = open_bins[size:] > 0
        if room.any():
            # moving a bin from gap g to g - size changes the sum by 2 * (N[g - size] - N[g] + 1)
            change = 2 * (open_bins[: capacity + 1 - size] - open_bins[size:] + 1)
            change[0] = 1 - 2 * open_bins[size]  # a full bin has no gap
            change[~room] = np.iinfo("int64").max
            gap = int(np.argmin(change)) + size
            k = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, k, made = capacity, made, made + 1
        bins[i], offsets[i] = k, capacity - gap
        if gap > size:
            stacks[gap - size].append(k)
            open_bins[gap - size] += 1
    return bins, offsets


def _pack(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "start"], ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (pdf["_shard"].to_numpy().astype("int64") << 32) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="_shard")

    return run


def pack(
    docs: DataFrame, model: str, capacity: int = 2048, end_id: int = 0, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """One row per piece with its ``sequence_id`` and its ``offset`` in that sequence.

    Pieces are dealt to shards by a hash; each shard has ``shard_pieces`` rows on average, whatever
    the input, and packs by itself.  Only lengths and checksums are shuffled, never texts.  An empty
    table gives an empty one; repeated rows are packed as often as they occur; NULL ids stay.
    """
    ship(docs.sparkSession)
    pieces = materialize(cut(docs, model, capacity, end_id), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", F.lit("shard")), F.lit(shards)).cast("int")
    return (
        pieces.withColumn("_shard", dealt)
        .groupBy("_shard")
        .applyInPandas(_pack(capacity), f"{PIECE_SCHEMA}, sequence_id bigint, offset bigint")
    )
