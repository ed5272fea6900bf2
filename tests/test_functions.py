import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from habitatrix.functions import geo, stats, text


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_days(spark):
    values = ["2020", "2020-05", "2020-05-07/2020-06-01", "n.d.", None, "in 1999-13-44T00", "12020-1"]
    want = ["2020-01-01", "2020-05-01", "2020-05-07", None, None, "1999-13-44", "1202-01-01"]
    assert column(spark, values, "string", text.day_text) == want


def test_taxon_ids(spark):
    values = ["urn:lsid:dyntaxa.se:Taxon:61", "61", "x", None, "Taxon:7a", "99999999999999999999"]
    assert column(spark, values, "string", text.taxon_number) == [61, 61, None, None, None, None]
    assert column(spark, values, "string", text.lsid_taxon) == ["61"] + [None] * 5


def test_cell_keys(spark):
    df = spark.createDataFrame(
        [(61.7, 16.16), (61.70049, 16.1606), (None, 1.0)], "lat double, lon double"
    )
    rounded = df.select(
        text.grid_round(F.col("lat"), 3).alias("a"), text.grid_round(F.col("lon"), 3).alias("o")
    )
    got = [r[0] for r in rounded.select(text.cell_key(F.col("a"), F.col("o"))).collect()]
    assert got == ["cell_61.7_16.16", "cell_61.7_16.161", None]
    milli = text.with_milli(df, {"lat": "a", "lon": "o"})
    padded = milli.select(text.padded_cell_key(F.col("a"), F.col("o"))).collect()
    assert padded[0][0] == "cell_61.700_16.160"
    assert padded[2][0] is None


def test_three_decimals_like_exact_rounding(spark):
    rng = random.Random(1)
    values = [k / 10000 for k in range(550000, 560000)]
    values += [rng.uniform(-180, 180) for _ in range(2000)] + [0.0, 0.0005, -0.0015, 12.9996]
    df = text.with_milli(
        spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), {"v": "m"}
    )
    got = [r[0] for r in df.orderBy("i").select(text.milli_text(F.col("m"))).collect()]
    want = [f"{v:.3f}" for v in values]
    assert got == [w if float(w) else w.lstrip("-") for w in want]


def test_locality_key_priority(spark):
    df = spark.createDataFrame(
        [("a", "b"), ("", "b c"), (None, ""), (None, None)], "id string, name string"
    )
    key = text.locality_key(F.col("id"), F.col("name"), F.lit(61700), F.lit(16160))
    assert [r[0] for r in df.select(key).collect()] == [
        "a",
        "b c",
        "cell_61.700_16.160",
        "cell_61.700_16.160",
    ]


def test_slugs_and_names(spark):
    assert column(spark, [" Ädellövskog 2 ", None, "--", "A b"], "string", text.habitat_slug) == [
        "dell_vskog",
        "unknown",
        "unknown",
        "a_b",
    ]
    names = ["  Carex   ATHERODES  var x", "Orchis"]
    assert column(spark, names, "string", text.name_norm) == ["carex atherodes var x", "orchis"]
    assert column(spark, names, "string", text.genus_species) == ["carex atherodes", "orchis"]
    odd = unicodedata.normalize("NFD", "Blå é/x.y-z ")
    assert column(spark, [odd, None], "string", text.safe_name) == ["Blå___x.y-z", None]


def test_seed_and_subsample_size(spark):
    import hashlib

    want = int(hashlib.md5(b"Brand_1").hexdigest()[:8], 16) + 165
    assert column(spark, ["Brand_1"], "string", lambda c: text.name_seed(c, 165)) == [want]
    sizes = column(
        spark, [0, 12, 100, 500, 5000], "bigint", lambda c: text.subsample_size(c, 30, 80, 0.1)
    )
    assert sizes == [0, 12, 30, 50, 80]


def test_id_order(spark):
    df = spark.createDataFrame([(["10", "9", "100", "2"],)], "ids array<string>")
    assert df.select(text.length_then_text(F.col("ids"))).first()[0] == ["2", "9", "10", "100"]


def test_projection_control_point(spark):
    grid = geo.Grid(
        lon0_deg=13 + 35 / 60 + 7.692 / 3600,
        k0=1.00000254,
        false_n=-6226307.864,
        false_e=84182.879,
    )
    df = spark.createDataFrame([(66.0, 24.0)], "lat double, lon double")
    r = geo.project(df, "lat", "lon", "n", "e", grid).first()
    assert r["n"] == pytest.approx(1135809.4138, abs=1e-3)
    assert r["e"] == pytest.approx(555304.0166, abs=1e-3)


def test_projection_round_trip(spark):
    df = spark.range(2000).select(
        (55 + F.col("id") % 145 / 10).cast("double").alias("lat"),
        (10 + F.col("id") % 149 / 10).cast("double").alias("lon"),
    )
    back = geo.unproject(geo.project(df, "lat", "lon", "n", "e"), "n", "e", "lat2", "lon2")
    worst = back.select(
        F.max(F.abs(F.col("lat") - F.col("lat2"))), F.max(F.abs(F.col("lon") - F.col("lon2")))
    ).first()
    assert max(worst) < 1e-9
    known = geo.project(
        spark.createDataFrame([(59.33, 18.06)], "lat double, lon double"), "lat", "lon", "n", "e"
    ).first()
    assert (round(known["n"], 3), round(known["e"], 3)) == (6580798.387, 674079.257)


def test_buffer_polygon_against_edges(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(-51, 51), rng.uniform(-51, 51)) for _ in range(4000)]
    pts += [(50.0, 0.0), (0.0, 50.0), (-50.0, 0.0), (0.0, -50.0), (0.0, 0.0), (50.001, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, x double, y double")
    got = [
        (r[0], r[1])
        for r in df.orderBy("i")
        .select(
            geo.in_buffer(F.col("x"), F.col("y"), 50.0),
            geo.in_buffer(F.col("x"), F.col("y"), 50.0, "circle"),
        )
        .collect()
    ]
    corner = [(50 * math.cos(k * math.pi / 32), 50 * math.sin(k * math.pi / 32)) for k in range(65)]

    def inside(x, y):
        return all(
            (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-7
            for (ax, ay), (bx, by) in zip(corner, corner[1:])
        )

    assert [g[0] for g in got] == [inside(*p) for p in pts]
    assert [g[1] for g in got] == [p[0] ** 2 + p[1] ** 2 <= 2500 for p in pts]


def test_strata_are_not_ntile(spark):
    for n in (1, 5, 11, 37, 200):
        got = [
            r[0]
            for r in spark.range(1, n + 1)
            .orderBy("id")
            .select(stats.rank_stratum(F.col("id"), F.lit(n)))
            .collect()
        ]
        assert got == [min(math.ceil(10 * r / n) - 1, 9) for r in range(1, n + 1)]
        if n == 11:
            assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]


def test_margalef_guard(spark):
    df = spark.createDataFrame([(5, 10), (1, 1), (3, 0)], "s bigint, n bigint")
    got = [r[0] for r in df.select(stats.margalef(F.col("s"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(4 / math.log(10))
    assert got[1:] == [None, None]


def test_composed_agrees_with_unicode(spark):
    import unicodedata

    texts = ["éx", "Årsta", "plain", None, "", "각", "ạ́", "Å", "🙂 ö" * 300]
    want = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert column(spark, texts, "string", text.composed) == want
