"""Exports that several runs share: names, one-line files, waves, positions, encodings."""

import threading

import pytest
from pyspark.sql import functions as F

from habitatrix import sinks
from habitatrix.config import EnrichmentSettings
from habitatrix.operators import bootstrap
from habitatrix.operators.subsample import subsample_summary
from habitatrix.plans import associate_stage, composite_stage
from habitatrix.session import materialize
from habitatrix.sources import lookups, tables

SITES = "run int, focal string, fid bigint, LocalityKey string, E double, N double"
CONTACTS = "E double, N double, taxon string, LocalityKey string, is_red boolean, n bigint"


@pytest.fixture(scope="module")
def result(spark):
    """Two species with two runs each; every taxon is found more than 15 times at every site."""
    sites = [(r, f, i, f"place {i}", 1000.0 * i, 50.0 * k) for k, f in enumerate(("Carex alba", "Orchis mas")) for r in (1, 2) for i in range(12)]
    e = [(r, f) for r in (1, 2) for f in ("Carex alba", "Orchis mas")]
    frame = materialize(spark.createDataFrame(sites, SITES))
    points = frame.select("E", "N", "LocalityKey").distinct()
    taxa = spark.createDataFrame([(str(t), t % 3 == 0) for t in range(2, 9)], "taxon string, is_red boolean")
    focal = frame.select("focal", "E", "N", "LocalityKey")
    others = points.crossJoin(taxa).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    built = associate_stage.build(
        frame.where("run = 1").select(
            "focal", F.concat_ws("-", "focal", "fid").alias("row_key"), "LocalityKey", "E", "N", F.lit("a").alias("part"),
            F.lit(None).cast("string").alias("vernacular"), F.lit(None).cast("string").alias("taxon"),
        ),
        others.select("E", "N", "LocalityKey", "taxon"),
        taxa.where("is_red").select(F.col("taxon").alias("taxon_id")),
        runs=2,
    )
    assert len(e) == 4 and focal.count() == 48
    return built


def words(path):
    return path.read_text(encoding="utf-8").splitlines()[0].split()


def test_two_runs_into_one_output(spark, result, tmp_path):
    out = str(tmp_path / "out")
    found = []

    def job():
        found.append({r.folder for r in associate_stage.write(result, out).collect()})

    jobs = [threading.Thread(target=job) for _ in range(2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    job()
    names = {f"{n}{s}" for n in ("Carex_alba", "Orchis_mas") for s in ("", *[f"__{k:03d}" for k in range(1, 6)])}
    assert len(found) == 3 and set().union(*found) == names and sum(map(len, found)) == 12
    for table in associate_stage.TABLES:
        lines = associate_stage.read_lines(spark, out, table).groupBy("folder").count().collect()
        assert {r.folder for r in lines} == names, table
        assert len({r["count"] for r in lines if r.folder.startswith("Carex")}) == 1


def test_names_are_moved_only_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data").write_text(name)
    target = str(tmp_path / "000001")
    assert sinks._move_new(spark, str(tmp_path / "a"), target)
    assert not sinks._move_new(spark, str(tmp_path / "b"), target)
    assert (tmp_path / "000001" / "data").read_text() == "a"


def test_one_line_and_the_exported_layout(spark, result, tmp_path):
    out, dest = str(tmp_path / "out"), tmp_path / "files"
    associate_stage.write(result, out)
    sizes = associate_stage.export(spark, out, str(dest)).collect()
    assert len(sizes) == 4 * len(associate_stage.TABLES)
    every = result.foldered(associate_stage.A.all_observations(result.contacts, result.sites, result.kept)).collect()
    for folder in ("Carex_alba", "Orchis_mas__001"):
        raw = (dest / folder / "allObservations.txt").read_text()
        assert raw.count("\n") == 0
        taxa = sorted(r.taxon for r in every if r.folder == folder)
        assert words(dest / folder / "allObservations.txt") == [*folder.split("__")[0].split("_"), *taxa] and len(taxa) > 100
        assert words(dest / folder / "totalTargetObs.txt")[-2:] == ["7", "2"]
        assert (dest / folder / "LocalitySpecies_ALL.txt").read_text().startswith("LocalityID SWEREF_N")
    for exported, root in ((True, out), (False, str(dest))):
        read, direct = composite_stage.read_folder_tables(spark, root, exported), composite_stage.folder_tables(result)
        for name in ("red_local", "totals"):
            a = getattr(direct, name)
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, getattr(read, name).select(a.columns).collect()))
        ids = {(r.folder, r.taxon_id) for r in read.observed.distinct().collect()}
        assert ids == {(r.folder, r.taxon_id) for r in direct.observed.distinct().collect()}


def test_a_folder_of_many_parts(spark, tmp_path):
    """A large folder is written by several tasks, in order, and joined to one file."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("folder"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_lines(df, f"{tmp_path}/t", F.col("k").cast("string"), order=(F.col("k"),), header="H")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "t" / "folder=y").glob("part-*"))) > 1
    sinks.join_parts(spark, str(tmp_path), ["t"], f"{tmp_path}/files").collect()
    got = (tmp_path / "files" / "y" / "t.txt").read_text().split()
    assert got == ["H", *[str(i) for i in range(3000) if i % 10]]


def test_positions_do_not_depend_on_splits(spark, result, tmp_path):
    out = str(tmp_path / "out")
    associate_stage.write(result, out)
    listed = composite_stage.folder_tables(result).localities
    want = sorted(map(tuple, subsample_summary(listed).collect()))
    for size in ("64b", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = composite_stage.read_folder_tables(spark, out).localities
            assert {(r.folder, r.pos) for r in read.collect()} == {(r.folder, r.pos) for r in listed.collect()}
            assert sorted(map(tuple, subsample_summary(read).collect())) == want
            (tmp_path / f"{size}.csv").write_text("taxonID;scientificName;habitat\n" + "".join(f"1;Name x;h{i}\n" for i in range(50)))
            raw = lookups.read_habitat_assignments(spark, f"{tmp_path}/{size}.csv")
            assert [r[0] for r in raw.orderBy("_row").select("habitat").collect()] == [f"h{i}" for i in range(50)]
            assert [r.habitat for r in composite_stage.enrichment.habitat_map(raw).collect()] == ["h0"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_encoding_of_each_file(spark, tmp_path):
    folder = tmp_path / "bank files"
    folder.mkdir()
    head = "taxonID;scientificName;weight\n"
    (folder / "a.csv").write_bytes((head + "1;Åkervädd;1\n").encode("latin-1"))
    (folder / "b.csv").write_bytes((head + "2;Blåklocka;2\n3;too;many;fields\n").encode("utf-8"))
    got = {(r.taxon_id, r.scientificName) for r in lookups.read_ias_bank(spark, str(folder)).collect()}
    assert got == {(1, "Åkervädd"), (2, "Blåklocka")}
    assert {r.scientificName for r in lookups.read_ias_bank(spark, str(folder / "a.csv")).collect()} == {"Åkervädd"}


@pytest.fixture(scope="module")
def prepared(spark, result):
    lm = spark.createDataFrame(
        [(f"place {i}", 1.0 + i % 3, float(i % 4), "fen", float(i)) for i in range(30)],
        "LocalityID string, w_inv double, effort_stratum double, dominant_habitat string, n2000_score double",
    )
    mapping = spark.createDataFrame(
        [(1.0, "Carex alba", "fen", "carex alba", "carex alba", 0), (2.0, "Orchis mas", "fen", "orchis mas", "orchis mas", 1)],
        "taxon_id double, scientificName string, habitat string, name_norm string, gs_key string, _row int",
    )
    return composite_stage.prepare(composite_stage.folder_tables(result), materialize(lm), mapping)


S = EnrichmentSettings(bootstraps=5, min_localities=3)


def test_killed_and_run_again(spark, prepared, tmp_path, monkeypatch):
    out = str(tmp_path / "index")
    logged = composite_stage.append_progress
    calls = []

    def stops(rows, path):
        calls.append(path)
        if len(calls) == 2:
            raise KeyboardInterrupt
        logged(rows, path)

    monkeypatch.setattr(composite_stage, "append_progress", stops)
    with pytest.raises(KeyboardInterrupt):
        composite_stage.logged_rows(prepared, out, S, wave=2)
    first = {r.folder: r.timestamp for r in composite_stage.read_progress(spark, f"{out}/progress").collect()}
    assert len(first) == 2
    monkeypatch.setattr(composite_stage, "append_progress", logged)
    rows = composite_stage.logged_rows(prepared, out, S, wave=1).collect()
    log = composite_stage.read_progress(spark, f"{out}/progress").collect()
    assert len(rows) == len(log) == 4 and len({r.folder for r in log}) == 4
    assert {r.folder: r.timestamp for r in log if r.folder in first} == first
    assert len(log[0]) == 43 and all(r.A1_debug.startswith("OK") for r in log)
    whole = composite_stage.rows_of(prepared, prepared.folders, S)
    assert {r.folder: r.mean_loglift_CI_low for r in whole.collect()} == {r.folder: r.mean_loglift_CI_low for r in rows}


def test_a_failing_folder_is_alone(spark, prepared, monkeypatch):
    real = bootstrap.a1_intervals

    def fails(focal, points, s):
        if points.where("folder = 'Orchis_mas'").count():
            raise ArithmeticError("no such weight")
        return real(focal, points, s)

    monkeypatch.setattr(bootstrap, "a1_intervals", fails)
    rows = {r.folder: r for r in composite_stage.rows_of(prepared, prepared.folders, S).collect()}
    assert len(rows) == 4
    for folder, r in rows.items():
        assert r.A5_debug.startswith("OK")
        if folder == "Orchis_mas":
            assert r.A1_debug == "ERROR: ArithmeticError" and r.mean_loglift is None
        else:
            assert r.A1_debug.startswith("OK") and r.mean_loglift_CI_low is not None


def test_numbered_keeps_order(spark):
    df = spark.createDataFrame([("f", (1, 5), "b"), ("f", (0, 9), "a"), ("g", (2, 2), "c")], "folder string, pos struct<a:int,b:int>, LocalityID string")
    assert {(r.folder, r.pos, r.LocalityID) for r in tables.numbered(df).collect()} == {("f", 0, "a"), ("f", 1, "b"), ("g", 0, "c")}
