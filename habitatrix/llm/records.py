"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A folder holds ``part-….records`` and ``part-….index`` files in ascending order of their documents, and
``_records.json``, which names the valid ones in that order.  All numbers are little-endian.

* record: length (8 bytes), masked CRC-32C of those bytes (4), payload, masked CRC-32C of the payload (4);
* payload: document id (8), flags (4; bit 0: the id is not NULL), token ids of 2 or 4 bytes each;
* index entry (28 bytes): offset of the record in its file (8), token ids before it in its file (8), number
  of its token ids (8), masked CRC-32C of those 24 bytes (4).

Tasks write files under names of their own, and the job names them in ``_records.json`` at its end, so a
task that is run again, or twice at once, leaves nothing that a reader sees.  Folders are reached through
``pyarrow.fs``: paths that every machine mounts, or a URI that it knows (``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from habitatrix.llm.chunked import ByteEncoder, opened
from habitatrix.llm.tables import rows_by_bytes, ship, texts_of, whole_text

FORMAT = "token_records"
MANIFEST = "_records.json"

#: Text that goes into one file, and the least for which another file is worth a task.
FILE_BYTES = 512 << 20
LEAST_FILE_BYTES = 4 << 20

#: Bytes of records that a reader holds, and that one reading task takes.
READ_BYTES = 4 << 20
SPLIT_BYTES = 64 << 20

HEAD, TAIL, PAYLOAD_HEAD = 12, 4, 12
ENTRY = [("offset", "<u8"), ("start", "<u8"), ("tokens", "<u8"), ("check", "<u4")]
ENTRY_BYTES = 28

SCHEMA = "position bigint, doc_id bigint, start bigint, tokens bigint, ids binary"


def filesystem(path: str):
    """The file system of ``path`` and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def frames(doc_ids, known, data, bounds, width: int):
    """Bytes of all records of a batch of little-endian 32-bit ids, and the offset of each record."""
    import numpy as np

    from habitatrix.llm.checksums import crc32c, masked

    n = len(doc_ids)
    ids = np.frombuffer(data.tobytes(), dtype="<u4")
    if width == 2 and len(ids) and ids.max() > 0xFFFF:
        raise ValueError("token ids beyond 65,535 need a width of 4 bytes")
    body = ids.astype("<u2").view("uint8") if width == 2 else data
    ends = bounds // 4 * width
    size = np.diff(ends)
    payload = PAYLOAD_HEAD + size
    record = HEAD + payload + TAIL
    start = np.cumsum(record) - record
    out = np.zeros(int(record.sum()), dtype="uint8")

    def put(at, values):
        raw = np.ascontiguousarray(values).view("uint8").reshape(n, -1)
        out[at[:, None] + np.arange(raw.shape[1])] = raw

    put(start, payload.astype("<u8"))
    put(start + 8, masked(crc32c(out, start, start + 8)).astype("<u4"))
    put(start + HEAD, doc_ids.astype("<i8"))
    put(start + HEAD + 8, known.astype("<u4"))
    first = start + HEAD + PAYLOAD_HEAD
    out[np.repeat(first - ends[:-1], size) + np.arange(len(body))] = body
    tail = start + HEAD + payload
    put(tail, masked(crc32c(out, start + HEAD, tail)).astype("<u4"))
    return out, start


def entries(offsets, starts, tokens):
    """Index entries with their checksums."""
    import numpy as np

    from habitatrix.llm.checksums import crc32c, masked

    out = np.zeros(len(offsets), dtype=ENTRY)
    out["offset"], out["start"], out["tokens"] = offsets, starts, tokens
    at = np.arange(len(out)) * ENTRY_BYTES
    out["check"] = masked(crc32c(out.view("uint8"), at, at + ENTRY_BYTES - TAIL))
    return out


def _verified_entries(raw: bytes, where: str):
    import numpy as np

    found = np.frombuffer(raw, dtype=ENTRY)
    if not np.array_equal(entries(found["offset"], found["start"], found["tokens"])["check"], found["check"]):
        raise ValueError(f"damaged index: {where}")
    return found


def unframed(data, offsets, width: int, where: str):
    """Document ids, whether they are known, and the ids of each record as little-endian 32-bit bytes."""
    import numpy as np

    from habitatrix.llm.checksums import crc32c, masked

    def take(at, n, kind):
        return np.ascontiguousarray(data[at[:, None] + np.arange(n)]).view(kind).ravel()

    length = take(offsets, 8, "<u8").astype("int64")
    sound = np.array_equal(masked(crc32c(data, offsets, offsets + 8)), take(offsets + 8, 4, "<u4"))
    end = offsets + HEAD + length
    if not sound or (len(end) and end.max() + TAIL > len(data)):
        raise ValueError(f"damaged length in {where}")
    if not np.array_equal(masked(crc32c(data, offsets + HEAD, end)), take(end, 4, "<u4")):
        raise ValueError(f"damaged record in {where}")
    doc_ids = take(offsets + HEAD, 8, "<i8")
    known = take(offsets + HEAD + 8, 4, "<u4") & 1 == 1
    first = offsets + HEAD + PAYLOAD_HEAD
    kind = f"<u{width}"
    ids = [np.frombuffer(data[a:b].tobytes(), dtype=kind).astype("<u4").tobytes() for a, b in zip(first, end, strict=True)]
    return doc_ids, known, ids


@dataclasses.dataclass
class Written(WriterCommitMessage):
    order: int
    name: str
    records: int
    tokens: int
    size: int


class RecordWriter(DataSourceArrowWriter):
    """Writes (``doc_id``, ``ids``) or, with a tokenizer file as ``model``, (``doc_id``, ``text``).

    A text becomes ids, with ``end_id`` after them, where it is written: no other process holds them.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.width, self.overwrite = options["path"], int(options.get("width", 4)), overwrite
        self.model, self.end_id = options.get("model"), int(options.get("end_id", 0))

    def _parts(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.model is None:
            yield from rows_by_bytes([batch], "ids")
            return
        encoder, end = opened(ByteEncoder, self.model), self.end_id.to_bytes(4, "little")
        for part in rows_by_bytes([batch], "text"):
            ids = encoder.encode(part.column("text").to_pylist(), *texts_of(part, "text"))
            made = pa.array([i + end for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], names=["doc_id", "ids"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        records = tokens = size = 0
        with (
            fs.open_output_stream(f"{folder}/{name}.records") as to,
            fs.open_output_stream(f"{folder}/{name}.index") as index,
        ):
            for whole in iterator:
                for batch in self._parts(whole):
                    data, bounds = texts_of(batch, "ids")
                    doc = batch.column(batch.schema.get_field_index("doc_id"))
                    known = doc.is_valid().to_numpy(zero_copy_only=False)
                    raw, offsets = frames(doc.fill_null(0).to_numpy(), known, data, bounds, self.width)
                    n = np.diff(bounds) // 4
                    to.write(raw.tobytes())
                    index.write(entries(offsets + size, tokens + np.cumsum(n) - n, n).tobytes())
                    records, tokens, size = records + len(n), tokens + int(n.sum()), size + len(raw)
        return Written(part, name, records, tokens, size)

    def commit(self, messages) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        named = f"{folder}/{MANIFEST}"
        if not self.overwrite and _exists(fs, named):
            self.abort(messages)
            raise ValueError(f"{self.path} already holds records")
        kept = sorted((m for m in messages if m and m.records), key=lambda m: m.order)
        files = [{"name": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.size} for m in kept]
        made = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as to:
            to.write(json.dumps({"width": self.width, "files": files}).encode())
        fs.move(made, named)
        self._delete_others({f["name"] for f in files})

    def abort(self, messages) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            for end in ("records", "index") if m else ():
                if _exists(fs, f"{folder}/{m.name}.{end}"):
                    fs.delete_file(f"{folder}/{m.name}.{end}")

    def _delete_others(self, names: set[str]) -> None:
        """Files of failed or repeated tasks, and of what was there before."""
        from pyarrow.fs import FileSelector

        fs, folder = filesystem(self.path)
        for f in fs.get_file_info(FileSelector(folder)):
            stem, _, end = f.base_name.rpartition(".")
            if end in ("records", "index") and stem.startswith("part-") and stem not in names:
                fs.delete_file(f.path)


def _exists(fs, path: str) -> bool:
    from pyarrow.fs import FileType

    return fs.get_file_info(path).type == FileType.File


@dataclasses.dataclass
class Stretch(InputPartition):
    """Reading positions ``first`` to ``end``."""

    first: int
    end: int


class RecordReader(DataSourceReader):
    """Records in file order, or with ``seed`` in a permutation of all of them.

    The permutation is computed, so a task finds its records by their index entries without any shuffle.
    """

    def __init__(self, options):
        self.path = options["path"]
        fs, folder = filesystem(self.path)
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            told = json.loads(f.read())
        self.width, self.files = told["width"], told["files"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.seed = int(options["seed"]) if "seed" in options else None

    def partitions(self):
        total = sum(f["records"] for f in self.files)
        cuts = {0, total}
        if self.seed is None:
            before = 0
            for f in self.files:
                parts = max(1, min(f["records"], -(-f["bytes"] // self.split)))
                cuts |= {before + f["records"] * k // parts for k in range(parts)}
                before += f["records"]
        else:
            parts = max(1, min(total, -(-sum(f["bytes"] for f in self.files) // self.split)))
            cuts |= {total * k // parts for k in range(parts)}
        ordered = sorted(cuts)
        return [Stretch(a, b) for a, b in zip(ordered[:-1], ordered[1:], strict=True)] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if partition.first == partition.end:
            return
        fs, folder = filesystem(self.path)
        records = np.cumsum([0, *(f["records"] for f in self.files)])
        tokens = np.cumsum([0, *(f["tokens"] for f in self.files)])
        if self.seed is None:
            at = int(np.searchsorted(records, partition.first, side="right")) - 1
            yield from self._sequential(fs, folder, at, partition, int(records[at]), int(tokens[at]))
        else:
            yield from self._shuffled(fs, folder, partition, records, tokens)

    def _sequential(self, fs, folder, at, partition, before, base):
        import numpy as np

        name = f"{folder}/{self.files[at]['name']}"
        with fs.open_input_file(f"{name}.index") as index, fs.open_input_file(f"{name}.records") as source:
            first = partition.first
            while first < partition.end:
                n = min(partition.end - first, READ_BYTES // ENTRY_BYTES)
                index.seek((first - before) * ENTRY_BYTES)
                found = _verified_entries(index.read(n * ENTRY_BYTES), name)
                ends = np.append(found["offset"][1:], _record_end(found[-1], self.width)).astype("int64")
                i = 0
                while i < n:
                    begin = int(found["offset"][i])
                    j = max(i + 1, int(np.searchsorted(ends, begin + READ_BYTES, side="right")))
                    source.seek(begin)
                    data = np.frombuffer(source.read(int(ends[j - 1]) - begin), dtype="uint8")
                    some = found[i:j]
                    got = unframed(data, some["offset"].astype("int64") - begin, self.width, name)
                    yield _batch(np.arange(first + i, first + j), base + some["start"].astype("int64"), some["tokens"], *got)
                    i = j
                first += n

    def _shuffled(self, fs, folder, partition, records, tokens):
        import numpy as np

        open_files: dict = {}
        total = int(records[-1])
        for first in range(partition.first, partition.end, 1024):
            position = np.arange(first, min(first + 1024, partition.end))
            number = permuted(position, total, self.seed)
            file = np.searchsorted(records, number, side="right") - 1
            held, size = [], 0
            for k, (f, i) in enumerate(zip(file.tolist(), (number - records[file]).tolist(), strict=True)):
                if f not in open_files:
                    if len(open_files) >= 64:
                        for handle in open_files.pop(next(iter(open_files))):
                            handle.close()
                    name = f"{folder}/{self.files[f]['name']}"
                    open_files[f] = fs.open_input_file(f"{name}.index"), fs.open_input_file(f"{name}.records")
                index, source = open_files[f]
                index.seek(i * ENTRY_BYTES)
                entry = _verified_entries(index.read(ENTRY_BYTES), self.files[f]["name"])
                source.seek(int(entry["offset"][0]))
                raw = source.read(_record_end(entry[0], self.width) - int(entry["offset"][0]))
                held.append((raw, int(tokens[f]) + int(entry["start"][0]), int(entry["tokens"][0]), k))
                size += len(raw)
                if size >= READ_BYTES or k == len(position) - 1:
                    data = np.frombuffer(b"".join(h[0] for h in held), dtype="uint8")
                    length = np.array([len(h[0]) for h in held])
                    got = unframed(data, np.cumsum(length) - length, self.width, self.path)
                    where = position[[h[3] for h in held]]
                    yield _batch(where, np.array([h[1] for h in held]), np.array([h[2] for h in held]), *got)
                    held, size = [], 0
        for pair in open_files.values():
            for handle in pair:
                handle.close()


def _record_end(entry, width: int) -> int:
    return int(entry["offset"]) + HEAD + PAYLOAD_HEAD + int(entry["tokens"]) * width + TAIL


def _batch(position, start, tokens, doc_ids, known, ids) -> pa.RecordBatch:
    columns = [
        pa.array(position, pa.int64()),
        pa.array(doc_ids, pa.int64(), mask=~known),
        pa.array(start, pa.int64()),
        pa.array(tokens.astype("int64")),
        pa.array(ids, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["position", "doc_id", "start", "tokens", "ids"])


def permuted(position, total: int, seed: int):
    """The image of each position under a permutation of ``range(total)``.

    Four Feistel rounds permute the next power of four; images outside the range go round again.
    """
    import numpy as np

    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(seed).integers(1, 1 << 63, 4, dtype="uint64")
    out = np.asarray(position, dtype="uint64").copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            mixed = (right + np.uint64(1)) * (key | np.uint64(1))
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)
            left, right = right, left ^ (mixed & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= total]
    return out.astype("int64")


class TokenRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TokenRecords)


def write(docs: DataFrame, model: str, path: str, end_id: int = 0, width: int = 4, overwrite: bool = False) -> None:
    """Write the ids of every whole text, and ``end_id`` after them, in ascending order of ``doc_id``.

    Texts are range-partitioned by id and by a digest of the text, so that a repeated id does not fill
    one task, sorted, and encoded where they are written.  NULL texts are empty, NULL ids come last,
    repeated rows are written as often as they occur, an empty table makes a folder without files, and
    further columns are not read.  ``doc_id`` must be of an integer type.  Ids of up to 65,535 may be
    stored in a ``width`` of 2 bytes; a larger one is then an error.
    """
    spark = docs.sparkSession
    register(spark)
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("records hold 64-bit document ids")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_FILE_BYTES)
    files = max(1, wanted, -(-size // FILE_BYTES))
    keys = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    placed = narrow.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    mode = "overwrite" if overwrite else "append"
    told = {"width": width, "model": model, "end_id": end_id}
    placed.write.format(FORMAT).options(**told).mode(mode).save(path)


def read(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """``position``, ``doc_id``, ``start``, ``tokens`` and ``ids`` of every record; checksums are verified.

    ``start`` counts the token ids of all documents before a record, ``ids`` are little-endian 32-bit
    numbers, and ``position`` is the place in reading order: that of the files or, with ``seed``, shuffled.
    """
    register(spark)
    reader = spark.read.format(FORMAT)
    if seed is not None:
        reader = reader.option("seed", seed)
    return reader.load(path)
