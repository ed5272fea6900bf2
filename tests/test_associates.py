import math
import random

import pytest
from habitatrix.operators import associates as A
from habitatrix.operators.region import in_region
from habitatrix.plans import associate_stage

POINTS = "focal string, vern string, taxon string, LocalityKey string, row_key string, E double, N double"


@pytest.fixture(scope="module")
def world(spark):
    """Focal sites on a few spots, one very dense spot, associates around them."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        spot = (500000.0, 6600000.0) if i % 3 == 0 else (500000.0 + rng.randrange(400), 6600000.0 + rng.randrange(400))
        rows.append(("Focal a" if i % 2 else "Focal b", "v", "1", f"loc {i % 5}", f"f{i}", *spot))
    for i in range(1500):
        dense = i % 3 == 0
        e = 500010.0 if dense else 500000.0 + rng.randrange(500)
        n = 6600010.0 if dense else 6600000.0 + rng.randrange(500)
        taxon = None if i % 11 == 0 else str(10 + i % 30)
        key = None if i % 13 == 0 else ("" if i % 17 == 0 else f"k{i % 7}")
        rows.append((f"sp{i % 40}", None, taxon, key, f"o{i}", e, n))
    points = spark.createDataFrame(rows, POINTS)
    red = spark.createDataFrame([(str(t),) for t in range(10, 40, 4)], "taxon_id string")
    selectors = spark.createDataFrame([(None, "Focal a"), ("1", None)], "taxon_id string, name string")
    marked = A.mark_focal(points, selectors)
    return rows, A.focal_points(marked), A.associate_points(marked), red


def expected_hits(sites, rows, red):
    out = []
    for s in sites:
        for name, _, taxon, key, _, e, n in rows:
            if name.startswith("Focal") or (e - s.E) ** 2 + (n - s.N) ** 2 > 2500:
                continue
            out.append((s.focal, s.fid, taxon, key, e, n, taxon in red))
    return out


@pytest.fixture(scope="module")
def built(world):
    _, focal, others, red = world
    return associate_stage.build(focal, others, red, sample=20, shape="circle")


@pytest.fixture(scope="module")
def brute(world, built):
    rows, _, _, red = world
    return expected_hits(built.sites.collect(), rows, {r[0] for r in red.collect()})


def test_sampling(world):
    _, focal, _, _ = world
    one = A.sample_sites(focal, seed=1, size=20)
    assert {r["count"] for r in one.groupBy("focal").count().collect()} == {20}
    assert sorted(r.fid for r in one.where("focal = 'Focal a'").collect()) == list(range(20))
    again = A.sample_sites(focal.repartition(9), seed=1, size=20)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    other = A.sample_sites(focal, seed=2, size=20)
    assert sorted(map(tuple, one.collect())) != sorted(map(tuple, other.collect()))
    runs = A.sample_sites(focal, runs=3, size=500)
    assert runs.groupBy("run", "focal").count().collect().__len__() == 6


def test_hits_match_brute_force(built, brute):
    got = {
        (r.focal, r.fid, r.taxon, r.LocalityKey): r.n_hits
        for r in A.buffer_hits(built.contacts, built.sites).collect()
    }
    want = {}
    for f, i, t, k, *_ in brute:
        want[(f, i, t, k)] = want.get((f, i, t, k), 0) + 1
    assert got == want


def test_frequencies_and_lists(built, brute):
    freq = {}
    for f, _, t, *_ in brute:
        if t:
            freq[(f, t)] = freq.get((f, t), 0) + 1
    kept = {k for k, n in freq.items() if n >= 15}
    assert {(r.focal, r.taxon): r.n_hits for r in built.hits.collect()} == freq
    for r in built.found.collect():
        assert r.ids == sorted(t for f, t in kept if f == r.focal)
        assert r.focal_obs == 30
        assert (r.n_assoc, r.n_red) == (len(r.ids), len(r.red_ids))
        assert set(r.red_ids) == {t for t in r.ids if (int(t) - 10) % 4 == 0}
    every = A.all_observations(built.contacts, built.sites, built.kept)
    assert {
        (r.focal, r.taxon): r["count"] for r in every.groupBy("focal", "taxon").count().collect()
    } == {k: freq[k] for k in kept}


def test_red_per_locality(built, brute):
    want = {}
    for f, _, t, k, _, _, red in brute:
        if red and k is not None:
            want.setdefault((f, k), set()).add(t)
    got = {(r.focal, r.LocalityID): r.n_red for r in A.red_species_local(built.contacts, built.sites).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_species_per_site(built, brute):
    want = {}
    for f, i, t, *_ in brute:
        if t:
            want.setdefault((f, i), set()).add(t)
    rows = A.locality_species_all(built.contacts, built.sites).collect()
    assert len(rows) == 40
    for r in rows:
        assert r.ids == sorted(want.get((r.focal, r.fid), set()), key=lambda s: (len(s), s))
        assert " " not in r.LocalityID


def test_red_medians_and_repaired_keys(built, brute):
    import statistics

    from habitatrix.functions import geo

    spark = built.sites.sparkSession
    spots = sorted({(e, n) for *_, e, n, _ in brute})
    df = geo.unproject(spark.createDataFrame(spots, "E double, N double"), "N", "E", "la", "lo")
    cell = {
        (r.E, r.N): f"cell_{r.la:.3f}_{r.lo:.3f}" for r in df.collect()
    }
    want = {}
    for f, _, t, k, e, n, red in brute:
        if red:
            loc = k if k not in (None, "", "NA") else cell[(e, n)]
            want.setdefault((f, loc), []).append((t, e, n))
    got = A.locality_species_red(built.contacts, built.sites).collect()
    assert len(got) == len(want)
    for r in got:
        rows = want[(r.focal, r.LocalityID)]
        assert r.ids == sorted({t for t, _, _ in rows})
        assert r.SWEREF_E == round(statistics.median(e for _, e, _ in rows))
        assert r.SWEREF_N == round(statistics.median(n for _, _, n in rows))


def test_result_ignores_partitioning(world, built):
    _, focal, others, red = world
    again = associate_stage.build(
        focal.repartition(5), others.repartition(11), red, sample=20, shape="circle"
    )
    assert sorted(map(tuple, again.hits.collect())) == sorted(map(tuple, built.hits.collect()))


def test_join_plan_is_an_equi_join(world):
    _, focal, others, red = world
    sites = A.sample_sites(focal)
    plan = A.site_contacts(others, sites, red)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shuffled_cells_give_the_same(world, built, monkeypatch):
    _, focal, others, red = world
    monkeypatch.setattr("habitatrix.session.fits_broadcast", lambda *a, **k: False)
    again = A.site_contacts(others, built.sites, red, shape="circle")
    assert sorted(map(str, again.collect())) == sorted(map(str, built.contacts.collect()))


def test_focal_meta_uses_first_file(spark):
    rows = [
        ("a", None, "5", "p1", 2),
        ("a", None, None, "p1", 1),
        ("a", "later", "6", "p2", 1),
        ("b", "two", None, "p2", 2),
        ("b", "one", "7", "p2", 1),
    ]
    df = spark.createDataFrame(rows, "focal string, vern string, taxon string, part string, row int")
    got = {r.focal: (r.focal_obs, r.vern, r.taxon) for r in A.focal_meta(df).collect()}
    assert got == {"a": (3, None, "5"), "b": (2, "one", "7")}


def test_region_with_hole_overlap_and_edges(spark):
    def ring(poly, *pts):
        return [(poly, *map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:] + pts[:1])]

    edges = ring("a", (0, 0), (1000, 0), (1000, 1000), (0, 1000))
    edges += ring("a", (300, 300), (600, 300), (600, 600), (300, 600))
    edges += ring("b", (500, 500), (1500, 500), (500, 1500))
    edge_df = spark.createDataFrame(edges, "poly_id string, x1 double, y1 double, x2 double, y2 double")
    pts = [(float(x), float(y)) for x in range(-50, 1600, 50) for y in range(-50, 1600, 50)]
    got = {(r.E, r.N) for r in in_region(spark.createDataFrame(pts, "E double, N double"), edge_df).collect()}

    def want(x, y):
        hole = 300 < x < 600 and 300 < y < 600
        return (0 <= x <= 1000 and 0 <= y <= 1000 and not hole) or (x >= 500 and y >= 500 and x + y <= 2000)

    assert got == {p for p in pts if want(*p)}


def test_full_stage_from_raw_records(spark):
    """Raw degrees in, region applied to focal sites only, second pass pre-filtered."""
    from habitatrix.functions import geo
    from habitatrix.session import materialize

    base = spark.createDataFrame(
        [
            ("f1", "Taxon:1", "Focal a", 500000.0, 6600000.0),
            ("f2", "Taxon:1", "Focal a", 520000.0, 6600000.0),  # outside the region
            *[(f"o{i}", f"urn:Taxon:{i % 2 + 5}", "other", 500000.0 + i, 6600020.0) for i in range(40)],
            *[(f"p{i}", "urn:Taxon:9", "other", 520000.0, 6600001.0) for i in range(30)],
        ],
        "occurrenceID string, taxonID string, scientificName string, E double, N double",
    )
    occ = materialize(
        geo.unproject(base, "N", "E", "decimalLatitude", "decimalLongitude").drop("E", "N")
    )
    square = [(499000.0, 6599000.0), (501000.0, 6599000.0), (501000.0, 6601000.0), (499000.0, 6601000.0)]
    edges = spark.createDataFrame(
        [("r", *a, *b) for a, b in zip(square, square[1:] + square[:1])],
        "poly_id string, x1 double, y1 double, x2 double, y2 double",
    )
    red = spark.createDataFrame([("5",)], "taxon_id string")
    selectors = spark.createDataFrame([(None, "Focal a")], "taxon_id string, name string")
    built = associate_stage.build_from_occurrences(occ, selectors, red, edges)
    found = built.found.first()
    assert (found.focal_obs, found.ids, found.red_ids) == (1, ["5", "6"], ["5"])
    keys = {r.LocalityKey for r in built.contacts.collect()}
    exact = {f"cell_{r.decimalLatitude:.3f}_{r.decimalLongitude:.3f}" for r in occ.collect()}
    assert keys <= exact and len(keys) > 0


def test_records_are_written_without_columns_that_nobody_reads(spark, monkeypatch):
    written, write = {}, associate_stage.materialize

    def noted(df, label="step"):
        written[label] = set(df.columns)
        return write(df, label)

    monkeypatch.setattr(associate_stage, "materialize", noted)
    monkeypatch.setattr(A, "materialize", noted)
    records = [("f1", "Taxon:1", "Focal a", "v", 59.0, 17.0), *[(f"o{i}", "urn:Taxon:5", "other", "w", 59.0001, 17.0) for i in range(16)]]
    occ = spark.createDataFrame(
        records, "occurrenceID string, taxonID string, scientificName string, vernacularName string, decimalLatitude double, decimalLongitude double"
    )
    red = spark.createDataFrame([("5",)], "taxon_id string")
    selectors = spark.createDataFrame([(None, "Focal a")], "taxon_id string, name string")
    found = associate_stage.build_from_occurrences(occ, selectors, red).found.first()
    assert (found.focal_obs, found.ids, found.red_ids) == (1, ["5"], ["5"])
    assert written["near-records"] == {"taxon", "LocalityKey", "lat", "lon"}
    assert not written["focal-points"] & {"vern", "taxon"}
    assert not written["draws"] & {"vern", "taxon"}


def test_bounds_are_safe(spark):
    from habitatrix.functions import geo

    corners = spark.createDataFrame(
        [(11.0, 55.5), (24.0, 55.5), (11.0, 69.0), (24.0, 69.0), (17.5, 69.0)], "lon double, lat double"
    )
    sites = geo.project(corners, "lat", "lon", "N", "E")
    safe, narrow = (A.buffer_bounds(sites, corners_only=c).first() for c in (False, True))
    assert safe.lat_max >= 69.05 - 1e-6
    assert safe.lat_max == pytest.approx(69.05, abs=1e-6)
    assert not math.isclose(narrow.lat_min, safe.lat_min, abs_tol=1e-6)


def test_sample_without_record_keys_is_spread(spark):
    from pyspark.sql import functions as F

    for key in (F.lit(None).cast("string"), F.lit("same")):
        focal = spark.range(4000).select(
            F.lit("sp").alias("focal"), F.lit("v").alias("vern"), F.lit("1").alias("taxon"),
            F.lit("L").alias("LocalityKey"), key.alias("row_key"),
            F.col("id").cast("double").alias("E"), F.lit(0.0).alias("N"),
        )
        got = [r.E for r in A.sample_sites(focal, size=200).collect()]
        assert len(got) == 200
        assert 1600 < sum(got) / len(got) < 2400


def test_text_coordinates_near_buffers(spark):
    occ = spark.createDataFrame(
        [("60.0", "15.0"), ("n/a", "15.0"), ("70.0", "15.0"), (None, None)],
        "decimalLatitude string, decimalLongitude string",
    )
    bounds = spark.createDataFrame([(14.0, 59.0, 16.0, 61.0)], "lon_min double, lat_min double, lon_max double, lat_max double")
    assert [r.decimalLatitude for r in A.near_buffers(occ, bounds).collect()] == ["60.0"]


def test_region_cells_agree_with_parity(spark):
    """Random stars with holes, overlaps and round corners; narrow and wide cells."""
    rng = random.Random(31)
    polygons = []
    for k in range(12):
        cx, cy, n = rng.uniform(0, 9000), rng.uniform(0, 9000), rng.randrange(3, 40)
        ring = [(cx + rng.uniform(200, 3000) * math.cos(2 * math.pi * i / n), cy + rng.uniform(200, 3000) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        if k % 3 == 0:
            ring = [(round(px, -3), round(py, -3)) for px, py in ring]
        rings = [ring]
        if k % 2:
            rings.append([(cx + 90 * math.cos(-i), cy + 90 * math.sin(-i)) for i in range(6)])
        polygons.append(rings)
    polygons.append([[(0, 0), (20000, 0), (20000, 400), (0, 400)]])
    edges = [
        (str(k), *a, *b) for k, rings in enumerate(polygons) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]) if a != b
    ]
    frame = spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else float(v), e)) for e in edges], "poly_id string, x1 double, y1 double, x2 double, y2 double")
    pts = [(rng.uniform(-4000, 21000), rng.uniform(-4000, 13000)) for _ in range(1500)]
    pts += [(float(rng.randrange(-4, 14) * 1000), float(rng.randrange(-4, 14) * 1000)) for _ in range(200)]
    points = spark.createDataFrame(pts, "E double, N double")

    def inside(x, y):
        for k in range(len(polygons)):
            mine = [e[1:] for e in edges if e[0] == str(k)]
            for x1, y1, x2, y2 in mine:
                if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return True
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in mine) % 2:
                return True
        return False

    want = {p for p in pts if inside(*p)}
    assert 100 < len(want) < 1500
    for width in (200.0, 777.0, 50_000.0, None):
        assert {(r.E, r.N) for r in in_region(points, frame, width=width).collect()} == want, width


def _two_ways(spark, monkeypatch, listed):
    monkeypatch.setattr(A, "_LISTED", listed)
    rows = [("a", "1", 1), ("a", None, 2), (None, "2", 3), (None, None, 4), ("b", "2", 5), ("c", "3", 6), ("c", "", 7)]
    points = spark.createDataFrame(rows, "focal string, taxon string, i int")
    selectors = spark.createDataFrame([("2", None), (None, "a"), (None, "a"), (None, "x'y")], "taxon_id string, name string")
    marked = A.mark_focal(points, selectors)
    return [sorted(r.i for r in df.collect()) for df in (marked.where("is_focal"), A.focal_points(marked), A.associate_points(marked))]


@pytest.mark.parametrize("listed", [1_000, 1, 0])
def test_marks_by_list_and_by_join_agree(spark, monkeypatch, listed):
    assert _two_ways(spark, monkeypatch, listed) == [[1, 2, 3, 5], [1, 2, 5], [4, 6, 7]]


def test_no_selectors_mark_nothing(spark):
    points = spark.createDataFrame([("a", "1")], "focal string, taxon string")
    none = spark.createDataFrame([], "taxon_id string, name string")
    assert [r.is_focal for r in A.mark_focal(points, none).collect()] == [False]


def test_species_are_selected_below_the_joins_of_points(spark):
    """Or all records are shuffled before most of them are dropped."""
    names = spark.range(50).selectExpr("id AS part", "concat('sp', id) AS focal", "string(id) AS taxon")
    points = spark.range(1000).selectExpr("id % 50 AS part", "id AS row").join(names.hint("merge"), "part")
    selectors = spark.createDataFrame([(None, "sp3"), ("7", None)], "taxon_id string, name string")
    focal = A.focal_points(A.mark_focal(points, selectors))
    plan = focal._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert len(joins) == 1 and not any("Filter" in line for line in plan[: joins[0]])
    assert any("Filter" in line and "sp3" in line for line in plan[joins[0] :])
    assert focal.count() == 40


def test_focal_records_are_counted_once(world, monkeypatch):
    _, focal, others, red = world
    calls, plain = [], A.focal_totals
    monkeypatch.setattr(A, "focal_totals", lambda df: calls.append(df) or plain(df))
    stage = associate_stage.build(focal, others, red, sample=20)
    assert {(r.focal, r.focal_obs) for r in stage.found.collect()} == {("Focal a", 30), ("Focal b", 30)}
    assert len(calls) == 1


def test_hits_combine_before_they_are_shuffled(spark):
    """Rows are dealt by run, species and taxon (or locality) only, never by position."""
    contacts = spark.createDataFrame(
        [(1.0, 1.0, "7", "L1", True, 1.0, 2.0, 3), (1.0, 1.0, "7", "L1", True, 1.0, 3.0, 1), (5.0, 1.0, "8", "L1", True, 5.0, 1.0, 1)],
        "site_e double, site_n double, taxon string, LocalityKey string, is_red boolean, E double, N double, records bigint",
    )
    sites = spark.createDataFrame(
        [(1, "a", 0, "L1", 1.0, 1.0), (1, "a", 1, "L1", 1.0, 1.0), (1, "a", 2, "L1", 5.0, 1.0)],
        "run int, focal string, fid bigint, LocalityKey string, E double, N double",
    )
    hits, red = A.taxon_hits(contacts, sites), A.red_species_local(contacts, sites)
    for df, shuffles in ((hits, 1), (red, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(run") == shuffles
        assert plan.count("Exchange hashpartitioning(site_e") <= 1  # the few owners of positions
    assert {(r.taxon, r.n_hits) for r in hits.collect()} == {("7", 8), ("8", 1)}
    assert [(r.LocalityID, r.n_red) for r in red.collect()] == [("L1", 2)]
