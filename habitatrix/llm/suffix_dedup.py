"""Remove the bytes of 50-byte strings that also start in an earlier document.

A sparse suffix array does it.  Every 50-byte window has an anchor: the leftmost smallest hash among
its 24-byte strings.  Equal windows have equal anchors, so only suffixes at anchors are sorted, about
one in fourteen.

1. Hashes of the anchors' 24 bytes are counted over documents; suffixes whose beginning is in one
   document only are dropped.
2. Suffixes that are equal, bytes before them included, need only hashes: all but the smallest document
   repeat, and that one goes on if other suffixes begin with the same 24 bytes.
3. What is left is range-partitioned, by sampled splitters, on the suffix's leading bytes and then on
   the bytes before it, read backwards.  Each bucket is sorted by multikey quicksort, eight bytes a
   key, and each window around an anchor is compared among the suffixes that begin alike.
4. Suffixes that begin like the first or the last one of a bucket may go on in the next: their
   windows are compared across the boundary, by their whole bytes, the smallest document of each window
   only.  A beginning that very many suffixes share is split over buckets and ends up there too.

Of equal suffixes in a batch only the smallest document is compared; the others are known to repeat.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.hashing import Spans, mix, powers
from habitatrix.llm.tables import materialize, release, rows_by_bytes, ship, texts_of, whole_text

WINDOW, GRAM = 50, 24
SIDE = WINDOW - GRAM
SUFFIX = WINDOW + SIDE + 2  # suffix, bytes before it backwards, and how many there are on either side
EVERY = (1 << (SIDE + 1)) - 1

#: Text that a kernel takes at a time, and suffixes whose windows it hashes at a time.
SLICE, BLOCK = 1 << 18, 10_000


@dataclasses.dataclass(frozen=True)
class Settings:
    per_bucket: int = 1_000_000  # anchors that one task counts
    per_range: int = 50_000  # suffixes that one task sorts
    bucket_bits: int = 6  # at least so many: a document's shared anchors are one row for each bucket


def anchors(data, bounds):
    """Positions and 24-byte hashes of the anchors of all windows, and the text of each."""
    import numpy as np

    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="uint64"), np.zeros(0, dtype="int64")
    grams = Spans(data).fixed(GRAM)
    low, at = grams, np.arange(len(grams), dtype="int32")
    width = 1
    while width < SIDE + 1:
        step = min(width, SIDE + 1 - width)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        width += step
    inside = np.zeros(len(data), dtype=bool)
    starts = np.flatnonzero(np.diff(bounds) >= WINDOW)
    change = np.zeros(len(data) + 1, dtype="int32")
    np.add.at(change, bounds[starts], 1)
    np.add.at(change, bounds[starts + 1] - WINDOW + 1, -1)
    inside = np.cumsum(change)[:n] > 0
    where = at[:n][inside]
    where = where[np.append(True, where[1:] != where[:-1])[: len(where)]].astype("int64")
    return where, grams[where], np.searchsorted(bounds, where, side="right") - 1


def suffixes(data, bounds, where, row):
    """The sort keys of anchors, as a matrix of bytes, and their hashes."""
    import numpy as np

    padded = np.concatenate([np.zeros(SIDE, "uint8"), data, np.zeros(WINDOW, "uint8")])
    out = np.zeros((len(where), SUFFIX), dtype="uint8")
    before = np.minimum(where - bounds[row], SIDE)
    after = np.minimum(bounds[row + 1] - where - GRAM, SIDE)
    out[:, :WINDOW] = padded[(where + SIDE)[:, None] + np.arange(WINDOW)]
    out[:, WINDOW:-2] = padded[(where + SIDE - 1)[:, None] - np.arange(SIDE)]
    out[:, GRAM:WINDOW][np.arange(SIDE) >= after[:, None]] = 0
    out[:, WINDOW:-2][np.arange(SIDE) >= before[:, None]] = 0
    out[:, -2], out[:, -1] = before, after
    h = np.zeros(len(where), dtype="uint64")
    for k in range(0, SUFFIX, 8):
        word = np.zeros((len(where), 8), dtype="uint8")
        word[:, : min(8, SUFFIX - k)] = out[:, k : k + 8]
        h = mix(h ^ word.view("uint64")[:, 0])
    return out, h


def multikey_sort(keys):
    """Order of the rows of a byte matrix; eight bytes are one key, and only ties look at the next."""
    import numpy as np

    n, width = keys.shape
    padded = np.pad(keys, ((0, 0), (0, -width % 8)))
    words = np.ascontiguousarray(padded).view(">u8").astype("uint64")
    order = np.argsort(words[:, 0], kind="stable")
    start = np.append(True, words[order[1:], 0] != words[order[:-1], 0])[:n]
    for k in range(1, words.shape[1]):
        group = np.cumsum(start)
        tied = np.flatnonzero(~(start & np.append(start[1:], True)))
        if not len(tied):
            break
        some = order[tied]
        again = np.lexsort((words[some, k], group[tied]))
        order[tied] = some[again]
        word, own = words[order[tied], k], group[tied]
        start[tied[1:]] |= (word[1:] != word[:-1]) & (own[1:] == own[:-1])
    return order, start


def _counted(bits: int, flush: int = 300_000):
    """Anchor hashes, once for each document, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[tuple] = []

        def packed():
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (key >> np.uint64(32)).astype("int64")
            order = np.argsort(bucket, kind="stable")
            key, doc, bucket = key[order].astype("uint32"), doc[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            spans = list(zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first].astype("int32")),
                    *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, doc)),
                ],
                names=["bucket", "keys", "docs"],
            )

        for part in rows_by_bytes(batches, "_text", SLICE):
            data, bounds = texts_of(part, "_text")
            _, h, row = anchors(data, bounds)
            h = h >> np.uint64(32 - bits)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
            held.append((h[new], np.asarray(part.column(0))[row[new]]))
            if sum(len(x[0]) for x in held) >= flush:
                yield packed()
                held = []
        if sum(len(x[0]) for x in held):
            yield packed()

    return run


def _shared(pdf):
    """Of one bucket, each document's hashes that other documents have too."""
    import numpy as np
    import pandas as pd

    key = np.frombuffer(b"".join(pdf["keys"]), dtype="uint32")
    doc = np.frombuffer(b"".join(pdf["docs"]), dtype="int64")
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    mixed = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), size)
    key, doc = key[mixed].astype("uint64") | np.uint64(int(pdf["bucket"].iloc[0]) << 32), doc[mixed]
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    spans = zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False)
    return pd.DataFrame({"doc_id": doc[first], "keys": [key[a:b].tobytes() for a, b in spans]})


def _members(column):
    """All 64-bit values in a list of packed arrays."""
    import numpy as np

    return np.frombuffer(b"".join(column or ()), dtype="uint64")


def _by_document(doc, name):
    """Document ids in order, with the names of each packed."""
    import numpy as np

    order = np.argsort(doc, kind="stable")
    doc, name = doc[order], name[order]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    spans = zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=False)
    return doc[first], [name[a:b].tobytes() for a, b in spans]


def _named(bits: int):
    """Hashes of the suffixes with a shared beginning, packed by bucket of that beginning.

    ``again_…`` are those that a smaller document of the batch has too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for part in rows_by_bytes(batches, "_text", SLICE):
            data, bounds = texts_of(part, "_text")
            where, h, row = anchors(data, bounds)
            h = h >> np.uint64(32 - bits)
            keep = np.zeros(len(h), dtype=bool)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i, keys in enumerate(part.column(2).to_pylist()):
                own = slice(at[i], at[i + 1])
                keep[own] = np.isin(h[own], _members(keys))
            where, row, h = where[keep], row[keep], h[keep]
            if not len(where):
                continue
            _, name = suffixes(data, bounds, where, row)
            doc = np.asarray(part.column(0))[row]
            bucket = (h >> np.uint64(32)).astype("int64")
            order = np.lexsort((doc, name, bucket))
            name, doc, h, bucket = name[order].view("int64"), doc[order], h[order], bucket[order]
            same = name[1:] == name[:-1]
            new = np.append(True, ~same)
            other = np.append(True, ~same | (doc[1:] != doc[:-1]))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            columns: list[list] = [[] for _ in range(5)]
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
                kept = a + np.flatnonzero(new[a:b])
                rest = a + np.flatnonzero(~new[a:b] & other[a:b])
                for to, x in zip(columns, (h[kept], name[kept], doc[kept], name[rest], doc[rest]), strict=True):
                    to.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first].astype("int32")), *(pa.array(c, pa.binary()) for c in columns)],
                names=["bucket", "grams", "names", "docs", "again_names", "again_docs"],
            )

    return run


def _resolved(pdf):
    """Names that repeat a smaller document's, and those that must be compared by their bytes."""
    import numpy as np
    import pandas as pd

    kinds = (("grams", "uint64"), ("names", "int64"), ("docs", "int64"), ("again_names", "int64"), ("again_docs", "int64"))
    gram, name, doc, again, again_doc = (np.frombuffer(b"".join(pdf[c]), dtype=t) for c, t in kinds)
    order = np.lexsort((doc, name, gram))
    gram, name, doc = gram[order], name[order], doc[order]
    begin = np.append(True, gram[1:] != gram[:-1])
    new = begin | np.append(True, name[1:] != name[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = np.cumsum(begin) - 1
    several = (np.bincount(group, new) > 1)[group]
    more = doc > least
    out = []
    for need, d, n in (
        (False, np.concatenate([doc[more], again_doc]), np.concatenate([name[more], again])),
        (True, doc[new & several], name[new & several]),
    ):
        ids, packed = _by_document(d, n)
        out.append(pd.DataFrame({"doc_id": ids, "names": packed, "need": need}))
    return pd.concat(out)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes whose names a document was asked for."""
    import numpy as np

    for part in rows_by_bytes(batches, "_text", SLICE):
        data, bounds = texts_of(part, "_text")
        where, _, row = anchors(data, bounds)
        raw, name = suffixes(data, bounds, where, row)
        keep = np.zeros(len(name), dtype=bool)
        at = np.searchsorted(row, np.arange(part.num_rows + 1))
        for i, asked in enumerate(part.column(2).to_pylist()):
            own = slice(at[i], at[i + 1])
            keep[own] = np.isin(name[own], _members(asked))
        raw, name, row = raw[keep], name[keep].view("int64"), row[keep]
        order = np.lexsort((name, row))
        raw, name, row = raw[order], name[order], row[order]
        new = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))[: len(name)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x.tobytes() for x in raw[new]], pa.binary()),
                pa.array(name[new]),
                pa.array(np.asarray(part.column(0))[row[new]]),
            ],
            names=["suffix", "name", "doc_id"],
        )


def _window_hashes(keys):
    """Hash of the window that begins ``o`` bytes before the anchor, for each suffix and ``o``."""
    import numpy as np

    whole = np.concatenate([keys[:, WINDOW:-2][:, ::-1], keys[:, :WINDOW]], axis=1)
    value = mix((whole.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros((len(keys), whole.shape[1] + 1), dtype="uint64")
    np.cumsum(value * powers(whole.shape[1]), axis=1, out=sums[:, 1:])
    back = powers(whole.shape[1], inverse=True)
    for o in range(SIDE + 1):
        yield whole[:, SIDE - o :][:, :WINDOW], mix((sums[:, SIDE - o + WINDOW] - sums[:, SIDE - o]) * back[SIDE - o])


def _blocks(rows, group):
    """Cut ``rows`` into blocks of about ``BLOCK`` that keep each group whole."""
    import numpy as np

    if not len(rows):
        return []
    begin = np.flatnonzero(np.append(True, group[rows][1:] != group[rows][:-1]))
    return np.split(rows, begin[np.flatnonzero(np.diff(begin // BLOCK)) + 1])


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each suffix of one range, as bits; at its ends, windows to compare further."""
    import numpy as np

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    keys = np.frombuffer(b"".join(table.column(0).to_pylist()), dtype="uint8").reshape(-1, SUFFIX)
    name, doc = table.column(1).to_numpy(), table.column(2).to_numpy()
    order, start = multikey_sort(keys)
    keys, name, doc = keys[order], name[order], doc[order]
    first = np.flatnonzero(start)
    own = np.cumsum(start) - 1
    least = np.minimum.reduceat(doc, first)
    begin = keys[first, :GRAM]
    new = np.append(True, (begin[1:] != begin[:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    edge = (group == 0) | (group == group[-1])
    bits = np.zeros(len(first), dtype="int64")
    for some in _blocks(np.flatnonzero(~edge & (size[group] > 1)), group):
        k = keys[first[some]]
        for o, (_, h) in enumerate(_window_hashes(k)):
            valid = np.flatnonzero((k[:, -2] >= o) & (k[:, -1] >= SIDE - o))
            by = valid[np.argsort(h[valid], kind="stable")]
            head = np.append(True, h[by][1:] != h[by][:-1])[: len(by)]
            if len(by):
                low = np.minimum.reduceat(least[some[by]], np.flatnonzero(head))[np.cumsum(head) - 1]
                bits[some[by]] |= np.where(low < least[some[by]], 1 << o, 0)
    ends = np.flatnonzero(edge)
    for at in range(0, len(ends), BLOCK):
        some = ends[at : at + BLOCK]
        k, own_least = keys[first[some]], least[some]
        for o, (window, h) in enumerate(_window_hashes(k)):
            valid = np.flatnonzero((k[:, -2] >= o) & (k[:, -1] >= SIDE - o))
            by = valid[np.argsort(h[valid], kind="stable")]
            if not len(by):
                continue
            head = np.append(True, h[by][1:] != h[by][:-1])
            low = np.minimum.reduceat(own_least[by], np.flatnonzero(head))[np.cumsum(head) - 1]
            again = low < own_least[by]
            bits[some[by[again]]] |= 1 << o
            asked = by[~again]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own_least[asked]),
                    pa.array(name[first[some[asked]]]),
                    pa.array(np.full(len(asked), 1 << o)),
                    pa.array([w.tobytes() for w in window[asked]], pa.binary()),
                ],
                names=["doc_id", "name", "bits", "window"],
            )
    out = np.where(doc > least[own], EVERY, bits[own])
    said = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[said]), pa.array(name[said]), pa.array(out[said]), pa.nulls(len(said), pa.binary())],
        names=["doc_id", "name", "bits", "window"],
    )


def _lists(column):
    """All values of a column of lists of integers, and where each row's begin and end."""
    import numpy as np

    flat, size = column.flatten(), column.value_lengths().fill_null(0)
    return np.asarray(flat), np.concatenate([[0], np.cumsum(np.asarray(size))])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte spans to remove from each text and what is left of it."""
    import numpy as np

    for part in rows_by_bytes(batches, "_text", SLICE):
        data, bounds = texts_of(part, "_text")
        raw = np.zeros(len(data) + 1, dtype="int64")
        whole = part.column(2).to_pylist()
        (said, ends), (flags, _) = _lists(part.column(3)), _lists(part.column(4))
        wanted = np.diff(ends) > 0
        wanted |= np.fromiter(map(bool, whole), dtype=bool, count=len(whole))
        if wanted.any():
            where, _, row = anchors(data, bounds)
            where, row = where[wanted[row]], row[wanted[row]]
            _, name = suffixes(data, bounds, where, row)
            name = name.view("int64")
            bits = np.zeros(len(name), dtype="int64")
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i in np.flatnonzero(wanted):
                own = slice(at[i], at[i + 1])
                if whole[i]:
                    bits[own] = np.where(np.isin(name[own], _members(whole[i]).view("int64")), EVERY, 0)
                known, flag = said[ends[i] : ends[i + 1]], flags[ends[i] : ends[i + 1]]
                if len(known):
                    order = np.argsort(known)
                    known, flag = known[order], flag[order]
                    place = np.minimum(np.searchsorted(known, name[own]), len(known) - 1)
                    bits[own] |= np.where(known[place] == name[own], flag[place], 0)
            low, high = bounds[row], bounds[row + 1]
            for o in range(SIDE + 1):
                begin = where - o
                begin = begin[((bits >> o) & 1 != 0) & (begin >= low) & (begin + WINDOW <= high)]
                np.add.at(raw, begin, 1)
                np.add.at(raw, begin + WINDOW, -1)
        gone = np.cumsum(raw)[:-1] > 0
        spans, digest, n_removed = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            g = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype("int8")))
            spans.append([{"start": s, "stop": e} for s, e in turn.reshape(-1, 2).tolist()])
            n_removed.append(int(g.sum()))
            digest.append(hashlib.sha256(data[a:b][~g].tobytes()).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(np.diff(bounds)),
                pa.array(n_removed, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(spans, kind),
            ],
            names=["doc_id", "n_bytes", "n_removed", "kept_sha256", "removed"],
        )


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept_sha256, removed) for every row of ``docs`` (``doc_id``, ``text``).

    ``removed`` lists the maximal byte ranges covered by 50-byte strings that also start in a document
    with a smaller id.  Repeats inside one document do not count, and what one document loses still
    counts for others.  NULL texts are empty; texts of fewer than 50 bytes lose nothing.  Rows with a
    NULL id are left out; rows with the same id count as one document.
    """
    spark, s = docs.sparkSession, settings
    ship(spark)
    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("_text")
    )
    total = named.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    bits = max(s.bucket_bits, (int(total) * 2 // (SIDE + 2) // s.per_bucket).bit_length())
    counted = named.mapInArrow(_counted(bits), "bucket int, keys binary, docs binary")
    shared = materialize(counted.groupBy("bucket").applyInPandas(_shared, "doc_id bigint, keys binary"), "shared-anchors")
    by_doc = shared.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    packed = named.join(by_doc, "doc_id").mapInArrow(
        _named(bits), "bucket int, grams binary, names binary, docs binary, again_names binary, again_docs binary"
    )
    resolved = packed.groupBy("bucket").applyInPandas(_resolved, "doc_id bigint, names binary, need boolean")
    resolved = materialize(resolved, "resolved-suffixes")
    del counted, by_doc, packed
    release(spark)
    asked = resolved.where("need")
    n = asked.agg(F.coalesce(F.sum(F.octet_length("names")), F.lit(0))).first()[0] // 8
    asked = asked.groupBy("doc_id").agg(F.collect_list("names").alias("asked"))
    rows = named.join(asked, "doc_id").mapInArrow(_suffix_rows, "suffix binary, name bigint, doc_id bigint")
    # written down, as finding the splitters of the ranges reads them once more; and the joined texts can go
    rows = materialize(rows, "suffix-rows")
    del asked
    release(spark)
    told = rows.repartitionByRange(max(8, -(-n // s.per_range)), "suffix").mapInArrow(
        _sorted_buckets, "doc_id bigint, name bigint, bits bigint, window binary"
    )
    told = materialize(told, "sorted-suffixes")
    del rows
    release(spark)
    edges = told.where("window IS NOT NULL")
    least = edges.groupBy("window").agg(F.min("doc_id").alias("least"))
    across = edges.join(least, "window").where("least < doc_id").select("doc_id", "name", "bits")
    known = told.where("window IS NULL").select("doc_id", "name", "bits").unionByName(across)
    known = known.groupBy("doc_id", "name").agg(F.bit_or("bits").alias("bits"))
    known = known.groupBy("doc_id").agg(F.collect_list("name").alias("told"), F.collect_list("bits").alias("bits"))
    whole = resolved.where("NOT need").groupBy("doc_id").agg(F.collect_list("names").alias("whole"))
    by_doc = materialize(whole.join(known, "doc_id", "full_outer").select("doc_id", "whole", "told", "bits"), "repeats")
    release(spark)
    return named.join(by_doc, "doc_id", "left").mapInArrow(
        _removed,
        "doc_id bigint, n_bytes bigint, n_removed bigint, kept_sha256 string, "
        "removed array<struct<start: bigint, stop: bigint>>",
    )
