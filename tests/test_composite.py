import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from habitatrix import sinks
from habitatrix.operators import composite, stability, subsample
from habitatrix.plans import stability_stage
from habitatrix.sources import tables
from habitatrix.streaming import progress

ROWS = "folder string, main_hab string, mean_loglift double, n2k_mean_loglift double, Habitat_purity double"


def z_of(spark, values, habitat="h"):
    rows = [(str(i), habitat, v, 1.0, None) for i, v in enumerate(values)]
    out = composite.robust_z(spark.createDataFrame(rows, ROWS), composite.METRICS)
    return [r.Z_exceed for r in out.orderBy(F.col("folder").cast("int")).collect()]


def test_robust_z(spark):
    assert z_of(spark, [1.0, 2.0, 9.0]) == pytest.approx([-0.6745, 0, 4.7215])
    assert z_of(spark, [1.0, 1.0, 1.0, 5.0]) == pytest.approx([0, 0, 0, 2])
    assert z_of(spark, [None, None]) == [0, 0]
    assert z_of(spark, [3.0, None]) == [0, 0]
    assert z_of(spark, [1.0, 2.0, 9.0, None])[3] is None


def test_small_habitats_use_all_rows(spark):
    rng = random.Random(6)
    rows = [(f"a{i}", "big", rng.random(), 1.0, 1.0) for i in range(7)]
    rows += [(f"b{i}", "small", rng.random() * 5, 1.0, 1.0) for i in range(4)]
    out = composite.robust_z(spark.createDataFrame(rows, ROWS), composite.METRICS).collect()

    def z(x, xs):
        m = statistics.median(xs)
        return 0.6745 * (x - m) / statistics.median(abs(v - m) for v in xs)

    every = [r[2] for r in rows]
    big = [r[2] for r in rows if r[1] == "big"]
    for r in out:
        assert r.Z_exceed == pytest.approx(z(r.mean_loglift, big if r.main_hab == "big" else every))


def test_composite_and_summary(spark):
    rows = [(str(i), "h", float(i), float(i * i), None if i == 3 else 0.5) for i in range(8)]
    out = composite.composite(spark.createDataFrame(rows, ROWS)).cache()
    got = {r.folder: r for r in out.collect()}
    # no spread at all: everyone, also the row without a value, scores 0
    assert got["3"].Z_HAB_purity == 0 and got["3"].z_imputed and not got["2"].z_imputed
    r = got["7"]
    assert r.composite_index == pytest.approx(0.4 * r.Z_exceed + 0.4 * r.Z_N2000)
    # four usable values: the top two limits coincide, so classes stop at 3
    assert got["0"].composite_class is None and r.composite_class == 3
    line = composite.habitat_summary(out).first()
    xs = sorted(g.composite_index for g in got.values())
    assert (line.n, line.min, line.max) == (8, xs[0], xs[-1])
    assert line.std == pytest.approx(statistics.stdev(xs))
    assert line.q50 == pytest.approx(statistics.median(xs))
    missing = spark.createDataFrame([("a", "h", 1.0, None, 1.0), ("b", "h", 2.0, 3.0, 0.0), ("c", "h", 4.0, 5.0, 0.1)], ROWS)
    assert composite.composite(missing).where("folder = 'a'").first().composite_index is None


def test_subsample(spark):
    rng = random.Random(2)
    sites = [("f", i, [str(rng.randrange(40)) for _ in range(i % 5)]) for i in range(340)]
    sites += [("tiny", i, ["1", "2"]) for i in range(5)] + [("bare", i, []) for i in range(3)]
    df = spark.createDataFrame(sites, "folder string, pos bigint, ids array<string>")
    drawn = subsample.draw_subsamples(df).groupBy("folder", "rep").agg(F.countDistinct("pos").alias("k"))
    sizes = {}
    for r in drawn.collect():
        sizes.setdefault(r.folder, set()).add(r.k)
    assert sizes == {"f": {34}, "tiny": {5}, "bare": {3}}
    got = {r.folder: r for r in subsample.subsample_summary(df).collect()}
    assert got["f"].LSA_m_localities == 340 and got["f"].LSA_repeats == 10
    assert abs(got["f"].alpha_mean_spp_per_locality_mean - 2) < 0.3
    assert got["f"].gamma_unique_species_min <= got["f"].gamma_unique_species_mean <= 40
    assert got["f"].gamma_cv == pytest.approx(
        got["f"].gamma_unique_species_sd / got["f"].gamma_unique_species_mean
    )
    assert got["tiny"].gamma_unique_species_mean == 2 and got["tiny"].alpha_norm_range == 0
    assert got["bare"].gamma_unique_species_mean == 0 and got["bare"].gamma_cv == 0
    again = subsample.subsample_summary(df.repartition(7)).where("folder = 'f'").first()
    assert tuple(again) == tuple(got["f"])


RUNS = "focal_id string, composite_index string, composite_class string, No_obs string"


def test_stability(spark):
    rows = [("a", v, c, "400") for v, c in [("1", "3"), ("2", "4"), ("-1", None), ("0", "1")]]
    rows += [("b", "2", None, "400"), ("c", "x", None, "400"), ("d", "1", None, "349"), (None, "5", "2", "350")]
    rows += [("e", "-2", "1", "999"), ("e", "2", "1", "999"), ("e", "0", "1", None)]
    raw = spark.createDataFrame(rows, RUNS)
    got = {r.focal_id: r for r in stability_stage.build(raw).collect()}
    assert set(got) == {"a", "b", None, "e"}
    a = got["a"]
    assert (a.n_runs, a.mean, a["range"]) == (4, 0.5, 3.0)
    assert a.sd == pytest.approx(statistics.stdev([1, 2, -1, 0]))
    assert (a.stability_pos, a.stability_ge1, a.stability_same_sign) == (0.5, 0.5, 0.5)
    assert a.stability_class3plus == pytest.approx(2 / 3)
    assert a.stability_score == pytest.approx(0.5)
    assert a.instability_score == pytest.approx(a.sd / 0.5 * 0.5)
    assert (got["b"].sd, got["b"].stability_class3plus, got["b"].stability_score) == (0, None, 1)
    assert got["e"].relative_sd == pytest.approx(math.sqrt(8) / 1e-12)
    assert got["e"].stability_same_sign == 0.0  # mean 0: share of exact zeros
    top = stability.top_unstable(stability_stage.build(raw), 2).collect()
    assert [r.focal_id for r in top] == ["e", "a"]


def test_observation_filter(spark):
    raw = spark.createDataFrame([("a", "350", "1"), ("b", "10", "1"), ("b", None, "1")], "focal_id string, n_sites string, v string")
    kept = stability.drop_undersampled(raw)
    assert [r.focal_id for r in kept.collect()] == ["a"]
    assert [r.focal_id for r in stability.removed_groups(raw, kept, ["focal_id"]).collect()] == ["b"]
    with pytest.warns(UserWarning, match="skipped"):
        assert stability.drop_undersampled(raw.drop("n_sites")).count() == 3
    with pytest.raises(ValueError, match="value"):
        tables.run_rows(raw, "value", "cls", ["focal_id"])


def test_progress_log(spark, tmp_path):
    log = str(tmp_path / "log")
    assert progress.read_progress(spark, log).count() == 0
    rows = spark.createDataFrame([("007", 1.239, None), ("g", 2.0, 3.0)], "folder string, mean_loglift double, frac double")
    for _ in range(2):  # a repeated job leaves every row once
        progress.append_progress(rows, log)
    progress.append_progress(rows.where("folder = 'g'").withColumn("folder", F.lit("a b/c")), log)
    got = {r.folder: r for r in progress.read_progress(spark, log).collect()}
    assert set(got) == {"007", "g", "a b/c"} and progress.read_progress(spark, log).count() == 3
    assert got["007"]["mean_loglift_0to4"] == "1.24" and got["007"]["frac_enriched_tau0.30"] == "nan"
    assert len(got["g"]) == 43 and list(got["g"].asDict())[:4] == ["timestamp", "folder", "focal_id", "main_habitat"]
    assert {"bootstraps", "w_habitat", "a"} <= {
        r.name for r in sinks.settings_table(spark, {"a": "b"}).collect()
    }
