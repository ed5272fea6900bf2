"""Binary token records: format, checksums, order, shuffled reads, repeated tasks."""

import random
import struct
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from habitatrix.llm import checksums, records

MODEL = tokenizer("byte_bpe_50k.json")
TEXT = "doc_id bigint, text string"


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def plain_mask(c):
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def documents(seed, n=60):
    rng = random.Random(seed)
    words = ["the", " of", "naïve", "日本語", "  ", "\n", "x" * 30, "<|endoftext|>", "🙂", "12,5"]
    rows = [(i * 31 % 97, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(200, None), (201, ""), (202, "long text " * 60_000), (-5, "first")]


def expected(rows):
    model = Tokenizer.from_file(MODEL)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def digests(frame):
    got = frame.select("position", "doc_id", "start", "tokens", F.crc32("ids").alias("crc")).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.position)]


def test_checksums():
    assert plain_crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 30_000).astype("uint8")
    ends = np.cumsum(rng.integers(4, 900, 60))
    ends = ends[ends < len(data)]
    starts = np.concatenate([[0], ends[:-1]])
    got = checksums.crc32c(data, starts, ends)
    assert got.tolist() == [plain_crc32c(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert checksums.masked(got).tolist() == [plain_mask(int(c)) for c in got]
    with pytest.raises(ValueError):
        checksums.crc32c(data, [0], [3])


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(records, "LEAST_FILE_BYTES", 100_000)
    rows = documents(width)
    docs = spark.createDataFrame(rows, TEXT).repartition(6).withColumns({"ids": F.lit(1), "_text": F.lit("x"), "a b": F.lit(2)})
    folder = str(tmp_path / "records")
    records.write(docs, MODEL, folder, width=width)
    found = records.read(spark, folder)
    assert digests(found) == expected(rows)
    files = sorted((tmp_path / "records").glob("part-*.records"))
    assert len(files) > 1
    # the first record, byte by byte
    raw = files[0].read_bytes()
    length, check = struct.unpack("<QI", raw[:12])
    payload = raw[12 : 12 + length]
    assert check == plain_mask(plain_crc32c(raw[:8]))
    assert struct.unpack("<I", raw[12 + length : 16 + length])[0] == plain_mask(plain_crc32c(payload))
    ids = Tokenizer.from_file(MODEL).encode("first", add_special_tokens=False).ids
    assert struct.unpack(f"<qI{len(ids) + 1}{'H' if width == 2 else 'I'}", payload) == (-5, 1, *ids, 0)


def test_shuffled_reads(spark, tmp_path):
    rows = documents(7)
    folder = str(tmp_path / "records")
    records.write(spark.createDataFrame(rows, TEXT), MODEL, folder)
    once, other = (records.read(spark, folder, seed=s) for s in (1, 2))
    order = [r[0] for r in digests(once)]
    assert sorted(digests(once)) == sorted(expected(rows)) and sorted(digests(other)) == sorted(expected(rows))
    assert order != sorted(order) and order != [r[0] for r in digests(other)]
    assert digests(records.read(spark, folder, seed=1)) == digests(once)
    split = spark.read.format(records.FORMAT).option("split_bytes", 2_000)
    assert digests(split.load(folder)) == expected(rows)
    assert digests(split.option("seed", 1).load(folder)) == digests(once)


@pytest.mark.parametrize("total", [1, 2, 3, 64, 1000, 70_001])
def test_permutation(total):
    assert np.array_equal(np.sort(records.permuted(np.arange(total), total, 5)), np.arange(total))


def test_damage_and_repeats(spark, tmp_path):
    rows = documents(3, 20)
    folder = tmp_path / "records"
    docs = spark.createDataFrame(rows, TEXT)
    records.write(docs, MODEL, str(folder))
    # what a lost or repeated task left behind is neither read nor kept
    (folder / "part-00000-lost.records").write_bytes(b"half a record")
    assert digests(records.read(spark, str(folder))) == expected(rows)
    with pytest.raises(Exception, match="already holds"):
        records.write(docs, MODEL, str(folder))
    assert digests(records.read(spark, str(folder))) == expected(rows)
    records.write(docs.where("doc_id < 50"), MODEL, str(folder), overwrite=True)
    assert digests(records.read(spark, str(folder))) == expected([r for r in rows if r[0] < 50])
    assert not list(folder.glob("*lost*"))
    file = sorted(folder.glob("part-*.records"))[0]
    raw = bytearray(file.read_bytes())
    raw[40] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        records.read(spark, str(folder)).collect()


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(3, "b"), (None, "n"), (3, "b"), (3, "a"), (None, None), (1, "c")], TEXT)
    records.write(docs, MODEL, str(tmp_path / "some"))
    got = digests(records.read(spark, str(tmp_path / "some")))
    assert [r[0] for r in got] == [1, 3, 3, 3, None, None] and [r[1] for r in got[:4]] == [0, 2, 4, 6]
    assert sorted(r[2] for r in got) == [1, 2, 2, 2, 2, 2]
    records.write(docs.limit(0), MODEL, str(tmp_path / "none"))
    assert records.read(spark, str(tmp_path / "none")).collect() == []
    assert records.read(spark, str(tmp_path / "none"), seed=1).collect() == []
    with pytest.raises(TypeError):
        records.write(docs.withColumn("doc_id", F.lit("x")), MODEL, str(tmp_path / "text"))
    with pytest.raises(Exception, match="width"):
        ids = spark.createDataFrame([(1, bytearray(struct.pack("<I", 70_000)))], "doc_id bigint, ids binary")
        records.register(spark)
        ids.write.format(records.FORMAT).option("width", 2).mode("append").save(str(tmp_path / "wide"))
