"""Vector codes and whitening against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitatrix.llm import bidiagonal, vector_codes, whitening
from habitatrix.llm.vector_codes import Settings, Slices

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if usable(v)]
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = {(i, p): nearest(p, cut[i][p])[1] for i in cut for p in range(parts)}
        new = [list(b) for b in books]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in cut if found[i, p] == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = {}
    for i, _, g in kept:
        found = [nearest(p, cut[i][p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), g
    sums = {}
    for _, e, g in out.values():
        sums[g] = sums.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, sums[g], digest) for i, (c, e, g) in out.items()}


def vectors(seed, n, dim=32):
    rng = random.Random(seed)
    rows = [(i * 7 % 101 - 20, [rng.choice([rng.gauss(0, 0.2), 0.125, -0.125]) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]
    rows[-1] = (rows[-1][0], rows[-2][1], None)
    # as float32, like the column
    return [(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows]


@pytest.mark.parametrize("n", [3, 100])
def test_codes_equal_plain(spark, n):
    rows = vectors(n, n)
    odd = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, None), (903, [math.inf] + [0.0] * 31, 2)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"_vector": F.lit(1), "a b": F.lit("x"), "code": F.lit(2)})
    books = vector_codes.fit(frame)
    got = vector_codes.encode(frame.repartition(5), books)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    found = {r.vec_id: tuple(r)[2:] for r in got.collect()}
    assert found == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    rows = vectors(1, 40)
    ragged = [(800, [0.5] * 31, 1), (801, [], 1), (802, [1e30] * 32, 1), (None, rows[0][1], 1), rows[3]]
    frame = spark.createDataFrame(rows + ragged, SCHEMA)
    got = vector_codes.encode(frame, vector_codes.fit(frame)).collect()
    assert len(got) == len(rows) + 5
    assert {r.vec_id for r in got if r.code is None and r.error is None} == {800, 801, 802}
    assert len({tuple(r) for r in got if r.vec_id == rows[3][0]}) == 1
    for empty in (frame.limit(0), frame.where("vec_id IN (801)")):
        books = vector_codes.fit(empty)
        assert books.books == () and books.sha256 == hashlib.sha256(b"").hexdigest()
        assert [r.code for r in vector_codes.encode(empty, books).collect()] == [None] * empty.count()
    text_ids = frame.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")).withColumn("label", F.struct(F.lit(1).alias("a b")))
    assert vector_codes.encode(text_ids, vector_codes.fit(text_ids)).where("code IS NOT NULL").count() == len(rows) + 2


@pytest.mark.parametrize("radius", [None, 1, 1000])
def test_slices_find_the_nearest(radius):
    rng = np.random.default_rng(3)
    for width in (1, 4, 9):
        entries = rng.integers(-30, 30, (64, width))
        entries[10], entries[40] = entries[3], entries[3]
        points = rng.integers(-60, 60, (3000, width))
        points[:64] = entries
        points[100] = 10**6
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        best, distance = Slices(entries, radius).nearest(points)
        assert np.array_equal(best, far.argmin(axis=1)) and np.array_equal(distance, far.min(axis=1))
        inside = np.abs(points[:, None] - entries[None]).max(axis=2) <= 7
        mask = Slices(entries).candidates(points, np.full(len(points), 7))
        assert np.array_equal(mask, (inside * (np.uint64(1) << np.arange(64, dtype="uint64"))).sum(axis=1, dtype="uint64"))


def test_settings_refuse_more_entries_than_bits():
    with pytest.raises(ValueError):
        Settings(entries=65)


SPECTRA = {
    "plain": lambda rng: rng.standard_normal((300, 40)),
    "graded": lambda rng: rng.standard_normal((300, 40)) * 10.0 ** -np.linspace(0, 9, 40),
    "low rank": lambda rng: rng.standard_normal((300, 7)) @ rng.standard_normal((7, 40)),
    "few rows": lambda rng: rng.standard_normal((6, 40)),
    "tied": lambda rng: np.linalg.qr(rng.standard_normal((40, 40)))[0] * np.repeat([5.0, 4.0, 1.0], [10, 10, 20])[:, None],
    "equal": lambda rng: np.eye(40),
    "zero columns": lambda rng: rng.standard_normal((300, 40)) * (np.arange(40) % 3 > 0),
    "zero": lambda rng: np.zeros((5, 40)),
    "integers": lambda rng: rng.integers(-1, 2, (12, 40)).astype(float),
}


@pytest.mark.parametrize("kind", SPECTRA)
def test_singular_vectors(kind):
    x = SPECTRA[kind](np.random.default_rng(5))
    r = np.zeros((40, 40))
    top = np.linalg.qr(x, mode="r")
    r[: len(top)] = top
    values, v = bidiagonal.right_singular(r)
    expected = np.linalg.svd(r, compute_uv=False) ** 2
    scale = max(expected[0], 1e-300)
    assert np.abs(values - expected).max() <= 1e-12 * scale
    assert np.abs(v.T @ v - np.eye(40)).max() <= 1e-8
    assert np.abs(r.T @ (r @ v) - v * values).max() <= 1e-8 * scale
    if kind == "graded":
        assert np.allclose(np.sqrt(values), np.sqrt(expected), rtol=1e-5)


def plain_whitening(rows, k):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows])
    n, total = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total)) for v in x]
    centred = x - total / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    return deviation, centred @ directions[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_whitening_equals_plain(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 1 + d / 5))) for d in range(40)], None) for i in range(400)]
    odd = [(900, None, 1), (901, [None] * 40, 1), (902, [math.nan] * 40, 1), (903, [math.inf] * 40, 1), (904, [1e30] * 40, 1)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"_id": F.lit(1), "whitened": F.lit(2), "a:b": F.lit(3)})
    got = whitening.components(frame.repartition(7)).collect()
    deviation, white, share = plain_whitening(rows, 32)
    assert len(got) == 400 * 32
    found = np.zeros((400, 32))
    for r in got:
        assert (r.n, r.deviation) == (400, deviation[r.vec_id])
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        found[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() <= 1e-8
    error = {r.identity_error for r in got}
    c = found - found.mean(axis=0)
    assert len(error) == 1 and error.pop() == pytest.approx(np.abs(c.T @ c / 400 - np.eye(32)).max(), abs=1e-12)


def test_whitening_of_odd_tables(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)], 1) for i in range(10)] + [(None, [0.5] * 40, 1), (3, [0.25] * 40, 1)]
    frame = spark.createDataFrame([*rows, rows[0], (50, [0.5] * 39, 1), (51, [], 1)], SCHEMA)
    got = whitening.components(frame).collect()
    # 12 different rows span 11 directions; the repeated one and the NULL id stay
    assert {r.component for r in got} == set(range(1, 12)) and len(got) == 13 * 11
    assert max(r.identity_error for r in got) <= 1e-9
    same = spark.createDataFrame([(i, [0.5] * 40, 1) for i in range(4)], SCHEMA)
    assert whitening.components(same).count() == 0
    assert {len(r.whitened) for r in whitening.whiten(same).collect()} == {0}
    for empty in (frame.limit(0), frame.where("vec_id = 51")):
        assert whitening.components(empty).collect() == [] and whitening.fit(empty) is None
    wide = spark.createDataFrame([(i, [float(i * 2**30 + d) for d in range(3)], 1) for i in range(900)], "vec_id int, embedding array<double>, label int")
    sums = whitening.whiten(wide).collect()
    n, total = 900, [sum(64 * (i * 2**30 + d) + 1_000_000 for i in range(900)) for d in range(3)]
    for r in sums:
        true = sum((n * (64 * (r.vec_id * 2**30 + d) + 1_000_000) - total[d]) ** 2 for d in range(3))
        assert r.deviation == (true if true < 2**63 else None)
    # many small groups give the same triangle as one
    many = frame.where(F.size("embedding") == 40).repartition(40)
    one = whitening.fit(many)
    monkeypatch.setattr(whitening, "GROUP_BYTES", 1)
    several = whitening.fit(many)
    assert np.allclose(one.values, several.values, rtol=1e-9, atol=1e-9)
