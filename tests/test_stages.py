"""All four stages from files to files, and the driver contract."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from habitatrix import session, sinks
from habitatrix.functions import geo, text
from habitatrix.operators import enrichment
from habitatrix.plans import associate_stage, composite_stage, locality_stage, stability_stage
from habitatrix.session import materialize
from habitatrix.sources import lookups, occurrences


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    rng = random.Random(12)
    rows = []
    for i in range(900):
        e, n = 500000.0 + rng.randrange(60) * 40, 6600000.0 + rng.randrange(20) * 40
        focal = i % 6 == 0
        name = ("Carex alba" if i % 12 else "Orchis mas") if focal else f"Plant {i % 9}"
        taxon = (1 if i % 12 else 2) if focal else 10 + i % 9
        rows.append((f"o{i}", f"urn:lsid:x:Taxon:{taxon}", name, "vern", f"20{10 + i % 9}-0{1 + i % 9}", e, n))
    df = spark.createDataFrame(
        rows,
        "occurrenceID string, taxonID string, scientificName string, vernacularName string, eventDate string, E double, N double",
    )
    occ = geo.unproject(df, "N", "E", "decimalLatitude", "decimalLongitude").drop("E", "N")
    materialize(occ).coalesce(2).write.parquet(str(root / "occ"))
    put = {
        "ias.csv": "taxonID;scientificName;weight\n11;a;1\n",
        "n2k.csv": "taxonID;scientificName;habitatCode;weight\n12;b;9010;0.5\n13;c;9020;\n",
        "hab.csv": "taxonID;scientificName;habitat\n"
        + "1;Carex alba;fen\n2;Orchis mas;fen\n"
        + "".join(f"{10 + i};Plant {i};{'fen' if i % 2 else 'wood'}\n" for i in range(9)),
        "red.csv": "Taxon id;Kategori\n" + "".join(f"{t};NT\n" for t in (10, 13, 15, 17)),
        "focal.csv": "﻿taxonID;name\n1;Carex alba\n;Orchis mas\n",
    }
    for name, body in put.items():
        (root / name).write_text(body, encoding="utf-8")
    return root


def test_files_to_report(spark, files, tmp_path):
    out = str(tmp_path)
    strata = locality_stage.run(
        spark,
        out,
        occurrence_path=f"{files}/occ",
        ias_path=f"{files}/ias.csv",
        n2k_path=f"{files}/n2k.csv",
        habitat_path=f"{files}/hab.csv",
    )
    n_localities = sum(r.n_localities for r in strata.collect())
    master = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/LocalityMaster")
    assert master.count() == n_localities and len(master.columns) == 23

    occ = occurrences.read_occurrences(spark, f"{files}/occ")
    selectors = lookups.focal_selectors(spark, rows=lookups.read_focal_list(spark, f"{files}/focal.csv"))
    red = lookups.read_red_list(spark, f"{files}/red.csv")
    result = associate_stage.build_from_occurrences(occ, selectors, red, runs=3)
    associate_stage.write(result, f"{out}/folders")

    direct = composite_stage.folder_tables(result)
    read = composite_stage.read_folder_tables(spark, f"{out}/folders")
    for name in ("red_local", "totals"):
        a = getattr(direct, name)
        b = getattr(read, name).select(*a.columns)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert read.localities.count() == direct.localities.count()
    assert {r.folder for r in direct.totals.collect()} == {
        f"{n}{s}" for n in ("Carex_alba", "Orchis_mas") for s in ("", "__001", "__002")
    }

    index = composite_stage.run(
        spark, f"{out}/index", f"{out}/folders", f"{out}/LocalityMaster", f"{files}/hab.csv"
    )
    rows = index.collect()
    assert len(rows) == 6 and {r.main_hab for r in rows} == {"fen"}
    for r in rows:
        assert r.A1_debug.startswith("OK") and r.LSA_debug == "OK"
        assert r.mean_loglift_CI_low <= r.mean_loglift_CI_high
        assert r.composite_index is not None
    log = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/index/progress")
    assert log.count() == 6 and "timestamp" in log.columns

    top = stability_stage.run(
        spark, f"{out}/index/composite", f"{out}/report", obs_column="No_localities_absent"
    )
    assert top.count() == 0  # fewer than 350 observations: everything is filtered
    report = stability_stage.build(index.drop("No_obs"))
    assert {r.n_runs for r in report.collect()} == {3}


def test_folders_never_clash(spark):
    sites = spark.createDataFrame(
        [(r, f, 0, "k", 0.0, 0.0) for r in (1, 2) for f in ("A b", "A_b", "C")],
        "run int, focal string, fid bigint, LocalityKey string, E double, N double",
    )
    frames = associate_stage.Associates(sites, sites, sites, sites)
    got = {r.folder for r in frames.foldered(sites.select("run", "focal")).collect()}
    assert got == {"A_b", "A_b__001", "A_b__002", "A_b__003", "C", "C__001"}


def test_cell_keys_join_in_both_spellings(spark):
    df = spark.createDataFrame(
        [("cell_61.7_16.16",), ("cell_61.700_16.160",), ("cell_5_-7.25",), ("Lake cell_1_2",), (None,)], "k string"
    )
    got = [r[0] for r in df.select(text.canonical_cell(F.col("k"))).collect()]
    assert got == ["cell_61.700_16.160"] * 2 + ["cell_5.000_-7.250", "Lake cell_1_2", None]
    red = spark.createDataFrame([("f", "cell_61.700_16.160", 1.0)], "folder string, LocalityID string, value double")
    lm = spark.createDataFrame(
        [("cell_61.7_16.16", 1.0, 1.0, "h", 0.0)],
        "LocalityID string, w_inv double, effort_stratum double, dominant_habitat string, n2000_score double",
    )
    assert enrichment.focal_localities(red, lm).first().LocalityID == "cell_61.7_16.16"
    assert enrichment.focal_localities(red, lm, exact_keys=True).count() == 0


def test_every_query_has_sql():
    from checks.oracles import build
    from checks.queries import REGISTRY

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(REGISTRY) <= set(queries)
    assert set(REGISTRY) == set(build())


def test_queries_agree_on_the_smallest_tables(spark):
    from checks.verify import compare, duck

    sf_dir = "/root/testdata/sf0.001"
    con, queries, oracles = duck(sf_dir), entry.queries(), entry.oracle_sql()
    for name in ("locality_master", "locality_events", "assoc_freq", "stability_report", "jenks"):
        ok, n, _, note = compare(spark, con, sf_dir, name, queries[name], oracles[name])
        assert ok, (name, note)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 80


def test_folder_that_looks_like_a_number(spark, tmp_path):
    df = spark.createDataFrame([("007", "b", 2), ("007", "a", 1), ("x", "c", 1)], "folder string, v string, k int")
    more = spark.createDataFrame([("empty",)], "folder string")
    out = str(tmp_path / "t")
    sinks.write_lines(df, f"{out}/table", F.col("v"), order=(F.col("k"),), header="H", folders=df.select("folder").union(more))
    got = associate_stage.read_lines(spark, out, "table").orderBy("pos").collect()
    lines = {}
    for r in got:
        lines.setdefault(r.folder, []).append(r.line)
    assert lines == {"007": ["H", "a", "b"], "x": ["H", "c"], "empty": ["H"]}


def test_scratch_of_another_session_stays(spark, monkeypatch):
    monkeypatch.setattr(session, "_PROCESS", "own")
    mine = session.materialize(spark.range(3), "mine")
    other = f"{session.scratch_root(spark)}/habitatrix/other-application/step"
    spark.range(2).write.parquet(other)
    assert mine.count() == 3
    session.drop_scratch(spark)
    assert spark.read.parquet(other).count() == 2
    assert not os.path.exists(session.session_scratch(spark))
