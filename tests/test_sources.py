import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from habitatrix.operators.region import in_region
from habitatrix.sources import geopackage, lookups, occurrences, tables


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_occurrence_scan(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        occurrences.read_occurrences(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        occurrences.read_occurrences(spark, str(tmp_path / "empty"))
    df = spark.createDataFrame([(60.0, 15.0, "2020")], "decimalLatitude double, decimalLongitude double, eventDate string")
    df.write.parquet(str(tmp_path / "ok" / "a" / "b"))
    df.write.parquet(str(tmp_path / "ok" / "c"))
    assert occurrences.read_occurrences(spark, str(tmp_path / "ok")).count() == 2
    df.drop("eventDate").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="eventDate"):
        occurrences.read_occurrences(spark, str(tmp_path / "bad"))
    df.write.parquet(str(tmp_path / "flat"))
    assert occurrences.read_occurrences(spark, str(tmp_path / "flat"), parts_only=True).count() == 1


def test_banks(spark, tmp_path):
    path = put(tmp_path / "n2k.csv", "taxonID;habitatCode;weight\nurn:Taxon:5;9010;0.5\n6;;\nx;1;2\n7;a;b\n")
    got = [tuple(r) for r in lookups.read_n2k_bank(spark, path).collect()]
    assert got == [(5, None, "9010", 0.5), (6, None, None, 1.0), (None, None, "1", 2.0), (7, None, "a", 1.0)]
    missing = lookups.read_ias_bank(spark, str(tmp_path / "none.csv"))
    assert missing.columns == ["taxon_id", "scientificName", "weight"] and missing.count() == 0


def test_habitat_file_encoding_and_bad_lines(spark, tmp_path):
    text = "taxonID;scientificName;habitat\n1;Blå;Äng\n2;b;c;too;many\n3;short\n"
    for name, enc in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        path = put(tmp_path / name, text.encode(enc))
        raw = lookups.read_habitat_assignments(spark, path)
        assert [tuple(r)[:3] for r in raw.orderBy("_row").collect()] == [
            ("1", "Blå", "Äng"),
            ("3", "short", None),
        ]
        assert lookups.assignment_labels(raw).count() == 2
    assert lookups.read_habitat_assignments(spark, str(tmp_path / "absent.csv")) is None
    header = put(tmp_path / "h.csv", "taxonID;scientificName;habitat\n")
    assert lookups.read_habitat_assignments(spark, header).count() == 0


def test_red_list(spark, tmp_path):
    path = put(tmp_path / "r.csv", "Taxon id;Kategori\n5;NT\n;VU\n5;EN\n7;LC\n")
    assert sorted(r[0] for r in lookups.read_red_list(spark, path).collect()) == ["5", "7"]
    bad = put(tmp_path / "b.csv", "id;Kategori\n5;NT\n")
    with pytest.raises(ValueError, match="Taxon id"):
        lookups.read_red_list(spark, bad)


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_focal_list(spark, tmp_path, sep):
    rows = ["taxonID|name", "5|Carex alba", "x|Poa annua", "5|Carex alba", " 8 |", "|Orchis mas "]
    path = put(tmp_path / "f.csv", "﻿" + "\n".join(r.replace("|", sep) for r in rows) + "\n")
    got = lookups.focal_selectors(spark, [9], ["Zea"], lookups.read_focal_list(spark, path))
    assert {tuple(r) for r in got.collect()} == {
        ("5", "Carex alba"),
        (None, "Poa annua"),
        ("8", None),
        (None, "Orchis mas"),
        ("9", None),
        (None, "Zea"),
    }
    other = put(tmp_path / "g.csv", f"id{sep}scientific_name\n3{sep}B c\n")
    assert [tuple(r) for r in lookups.read_focal_list(spark, other).collect()] == [("3", "B c")]
    assert lookups.read_focal_list(spark, str(tmp_path / "absent")).count() == 0


def lines(spark, *texts):
    return spark.createDataFrame(
        [("f", i, t) for i, t in enumerate(texts)], "folder string, pos int, line string"
    )


def test_text_tables(spark):
    red = tables.parse_red_local(lines(spark, "cell_1_2 3", "Long name here\t4", "bad x", "", "one"))
    assert [tuple(r) for r in red.collect()] == [("f", "cell_1_2", 3.0), ("f", "Long name here", 4.0)]
    totals = tables.parse_totals(lines(spark, "Carex  alba var 7 350 12 3 ", "no numbers", ""))
    assert [tuple(r) for r in totals.collect()] == [
        ("f", "Carex alba var 7", "Carex", "alba var 7", 350.0, 12.0, 3.0)
    ]
    ids = tables.parse_observed_ids(lines(spark, "Brand#3 x 12 12 7"))
    assert [r.taxon_id for r in ids.collect()] == [3, 12, 12, 7]
    got = tables.parse_locality_species(
        lines(spark, "LocalityID SWEREF_N SWEREF_E Species_IDs", " ", "a 1 2", "b 1 2 5 <NA> 7 nan NA")
    )
    assert [(r.pos, r.ids) for r in got.orderBy("pos").collect()] == [(2, []), (3, ["5", "7"])]


def test_folder_files(spark, tmp_path):
    for name in ("A b", "C"):
        (tmp_path / name).mkdir()
        put(tmp_path / name / "totalTargetObs.txt", f"{name} 1 2 3\n")
    got = tables.read_folder_lines(spark, str(tmp_path), "totalTargetObs.txt").collect()
    assert {(r.folder, r.line) for r in got} == {("A b", "A b 1 2 3"), ("C", "C 1 2 3")}


def test_locality_master_rows(spark):
    raw = spark.createDataFrame(
        [("a", "1.5", "3", "x"), ("b", "n/a", "3", "1"), (None, "1", "1", "1"), ("c", "2", "9", "0.5")],
        "LocalityID string, w_inv string, effort_stratum string, n2000_score string",
    )
    got = [(r.LocalityID, r.w_inv, r.n2000_score, r.dominant_habitat) for r in tables.locality_master_rows(raw).collect()]
    assert got == [("a", 1.5, None, "Unknown"), ("c", 2.0, 0.5, "Unknown")]


# -- GeoPackage ---------------------------------------------------------------


def wkb(parts, order="<", z=False):
    def poly(rings):
        out = struct.pack(order + "BII", order == "<", 1003 if z else 3, len(rings))
        for ring in rings:
            closed = ring + ring[:1]
            out += struct.pack(order + "I", len(closed))
            for x, y in closed:
                out += struct.pack(order + ("ddd" if z else "dd"), *((x, y, 7.0) if z else (x, y)))
        return out

    if len(parts) == 1:
        return poly(parts[0])
    return struct.pack(order + "BII", order == "<", 6, len(parts)) + b"".join(map(poly, parts))


def blob(srs, body, envelope=False):
    head = struct.pack("<2sBBi", b"GP", 0, 1 | (2 if envelope else 0), srs)
    return head + (struct.pack("<4d", 0, 0, 0, 0) if envelope else b"") + body


def geopackage_file(path, srs, features):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
    con.execute("INSERT INTO gpkg_contents VALUES ('regions','features')")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('regions','geom',?)", (srs,))
    con.execute("CREATE TABLE regions (fid INTEGER PRIMARY KEY, geom BLOB, region_ID TEXT)")
    con.executemany("INSERT INTO regions (geom, region_ID) VALUES (?,?)", features)
    con.commit()
    con.close()
    return str(path)


def box(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def test_geopackage_region(spark, tmp_path):
    two = wkb([[box(0, 0, 100), box(20, 20, 30)], [box(300, 0, 50)]], order=">")
    path = geopackage_file(
        tmp_path / "r.gpkg",
        3006,
        [
            (blob(3006, two), " Southern "),
            (blob(3006, wkb([[box(50, 50, 100)]], z=True), envelope=True), "southern"),
            (blob(3006, wkb([[box(900, 900, 10)]])), "alpine"),
            (None, "southern"),
        ],
    )
    edges = geopackage.region_edges(geopackage.read_rings(spark, path), "SOUTHERN")
    assert edges.count() == 4 * 4 and edges.select("poly_id").distinct().count() == 3
    pts = spark.createDataFrame(
        [(10.0, 10.0), (30.0, 30.0), (140.0, 140.0), (310.0, 10.0), (905.0, 905.0), (150.0, 50.0)],
        "E double, N double",
    )
    got = {(r.E, r.N) for r in in_region(pts, edges).collect()}
    assert got == {(10.0, 10.0), (140.0, 140.0), (310.0, 10.0), (150.0, 50.0)}
    with pytest.raises(ValueError, match="labelled"):
        geopackage.region_edges(geopackage.read_rings(spark, path), "mars")


def test_geopackage_degrees_and_errors(spark, tmp_path):
    deg = geopackage_file(tmp_path / "d.gpkg", 4326, [(blob(4326, wkb([[box(18, 59, 0.5)]])), "a")])
    edge = geopackage.region_edges(geopackage.read_rings(spark, deg), "a").agg(F.min("y1"), F.max("x1")).first()
    assert 6_500_000 < edge[0] < 6_600_000 and 600_000 < edge[1] < 720_000
    none = geopackage_file(tmp_path / "n.gpkg", 0, [(blob(0, wkb([[box(0, 0, 1)]])), "a")])
    with pytest.raises(Exception, match="coordinate system"):
        geopackage.read_rings(spark, none).count()
    with pytest.raises(Exception, match="no field"):
        geopackage.read_rings(spark, deg, field="nope").count()
    with pytest.raises(Exception, match="no feature layer"):
        geopackage.read_rings(spark, deg, layer="other").count()


UTM33 = """PROJCS["WGS 84 / UTM zone 33N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],
PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],
PARAMETER["central_meridian",15],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]]"""
LOCAL = UTM33.replace('"central_meridian",15', '"central_meridian",18').replace("0.9996", "1").replace("500000", "150000").replace(
    '"latitude_of_origin",0', '"latitude_of_origin",58'
)


def test_geopackage_in_other_grids(spark, tmp_path):
    """A square of a zone grid lands where its corners are in degrees."""
    import sqlite3

    from habitatrix.functions import geo

    for name, wkt, grid in (("utm", UTM33, geo.Grid(inverse_f=298.257223563)), ("local", LOCAL, None)):
        grid = grid or geo.Grid(inverse_f=298.257223563, lon0_deg=18.0, k0=1.0, false_e=150000.0, lat0_deg=58.0)
        at = spark.createDataFrame([(59.0, 17.0)], "lat double, lon double")
        spot = geo.project(at, "lat", "lon", "n", "e", grid).first()
        path = geopackage_file(tmp_path / f"{name}.gpkg", 32633, [(blob(32633, wkb([[box(spot.e, spot.n, 1000)]])), "a")])
        con = sqlite3.connect(path)
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER, definition TEXT)")
        con.execute("DELETE FROM gpkg_spatial_ref_sys")
        con.execute("INSERT INTO gpkg_spatial_ref_sys (srs_name, srs_id, definition) VALUES ('x', 32633, ?)", (wkt,))
        con.commit()
        con.close()
        edges = geopackage.region_edges(geopackage.read_rings(spark, path), "a")
        corner = edges.orderBy("x1", "y1").first()
        want = geo.project(at, "lat", "lon", "n", "e").first()
        if name == "utm":  # the same projection on ellipsoids that differ by less than a millimetre
            assert abs(corner.x1 - want.e) < 0.01 and abs(corner.y1 - want.n) < 0.01
        inside = spark.createDataFrame([(59.004, 17.008), (59.02, 17.0)], "lat double, lon double")
        got = in_region(geo.project(inside, "lat", "lon", "N", "E"), edges).count()
        assert got == 1
        hit = edges.where((F.hypot(F.col("x1") - want.e, F.col("y1") - want.n) < 0.01)).count()
        assert hit == 1


def test_geopackage_refuses_what_it_cannot_place():
    for wkt, why in (
        (None, "no definition"),
        (UTM33.replace("6378137,298.257223563", "6377397.155,299.1528128"), "datum"),
        (UTM33.replace("Transverse_Mercator", "Lambert_Conformal_Conic_2SP"), "not a transverse"),
        (UTM33.replace('UNIT["metre",1]', 'UNIT["foot",0.3048]'), "metres"),
    ):
        with pytest.raises(ValueError, match=why):
            geopackage.grid_of(9999, wkt)
    assert geopackage.grid_of(9999, UTM33[UTM33.index("GEOGCS") :]) is None


def test_grid_with_an_origin(spark):
    from habitatrix.functions import geo

    grid = geo.Grid(lat0_deg=58.0, lon0_deg=18.0, k0=1.0, false_e=150000.0, false_n=1000.0)
    at = spark.createDataFrame([(58.0, 18.0), (60.0, 17.0)], "lat double, lon double")
    there = geo.project(at, "lat", "lon", "n", "e", grid)
    first = there.first()
    assert first.n == pytest.approx(1000.0, abs=1e-4) and first.e == pytest.approx(150000.0, abs=1e-6)
    back = geo.unproject(there.select("n", "e"), "n", "e", "lat", "lon", grid).collect()
    assert [(round(r.lat, 8), round(r.lon, 8)) for r in back] == [(58.0, 18.0), (60.0, 17.0)]


def test_geopackage_pushed_filters(spark, tmp_path):
    """Labels and boxes reach the file: damaged features outside of them are never decoded."""
    import sqlite3

    good = [(blob(3006, wkb([[box(100.0 * i, 0.0, 10.0)]])), f"r{i}") for i in range(6)]
    path = geopackage_file(tmp_path / "p.gpkg", 3006, good)
    con = sqlite3.connect(path)
    con.execute("CREATE VIRTUAL TABLE rtree_regions_geom USING rtree(id, minx, maxx, miny, maxy)")
    con.executemany("INSERT INTO rtree_regions_geom VALUES (?,?,?,?,?)", [(i + 1, 100.0 * i, 100.0 * i + 10, 0, 10) for i in range(6)])
    con.execute("UPDATE regions SET geom = ? WHERE fid = 6", (b"GP\0\x01" + struct.pack("<i", 3006) + b"\x01\xff\xff\xff\xff",))
    con.commit()
    con.close()
    rings = geopackage.read_rings(spark, path)
    with pytest.raises(Exception):
        rings.count()
    assert {r.feature_id for r in rings.where("label = 'r2'").collect()} == {3}
    near = rings.where("max_x >= 195 AND min_x <= 300 AND label <> 'r9'")
    assert {r.feature_id for r in near.collect()} == {3, 4}
    assert rings.where("max_x > 210 AND min_x < 300").count() == 0
