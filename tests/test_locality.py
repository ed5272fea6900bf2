import math

import pytest
from pyspark.sql import functions as F

from habitatrix.operators import locality as L

OCC = "taxonID string, decimalLatitude double, decimalLongitude double, eventDate string"


@pytest.fixture(scope="module")
def obs(spark):
    rows = [
        ("urn:lsid:dyntaxa.se:Taxon:61", 61.70049, 16.16, "2020"),
        ("62", 61.7, 16.16, "2020-05"),
        ("62", 61.7, 16.16, "2020-05"),
        (None, 61.7, 16.16, "2020-05-07/2020-06-01"),
        (None, 61.7, 16.16, "2020-05-07"),
        ("63", None, 16.1, "2021"),
        ("62", None, 16.3, "2021-02"),
        ("63", 61.9, None, None),
        ("65", 61.8, 16.1, None),
        ("66", 61.8, 16.1, None),
    ]
    return L.observations(spark.createDataFrame(rows, OCC))


@pytest.fixture(scope="module")
def banks(spark):
    ias = spark.createDataFrame([(61, 1.0), (61, 2.0), (63, 1.0)], "taxon_id bigint, weight double")
    n2k = spark.createDataFrame(
        [(62, 0.25), (62, 0.5), (63, 1.0), (None, 9.0)], "taxon_id bigint, weight double"
    )
    hab = spark.createDataFrame(
        [(61, "b"), (62, "a"), (62, "a"), (65, "z"), (66, "c")], "taxon_id bigint, habitat string"
    )
    return ias, n2k, hab


def by_id(df):
    return {r.LocalityID: r for r in df.collect()}


def test_numeric_id_column_wins(spark):
    df = spark.createDataFrame([("Taxon:5", 7, 60.0, 15.0, "2020")], "taxonID string, taxonID_num int," + OCC[15:])
    assert L.observations(df).first().taxon_id == 7


def test_events(obs):
    got = {(r.LocalityID, r.date_s): (r.checklist_id, r.n_records, r.n_species) for r in L.locality_events(obs).collect()}
    key = "cell_61.7_16.16"
    assert got[(key, "2020-05-01")] == (f"{key}_2020-05-01", 2, 1)
    assert got[(key, "2020-05-07")] == (f"{key}_2020-05-07", 2, 1)  # NULL taxon is one value
    assert got[(None, "2021-01-01")] == (None, 1, 1)
    assert len(got) == 5


def test_core(obs):
    got = by_id(L.locality_core(obs))
    a = got["cell_61.7_16.16"]
    assert (a.n_records, a.n_events, a.n_species) == (5, 3, 3)
    assert (a.first_event, a.last_event) == ("2020-01-01", "2020-05-07")
    assert a.effort_index == 0.5 * 3 + 0.5 * 1
    dark = got["cell_61.8_16.1"]
    assert (dark.n_events, dark.first_event, dark.effort_index) == (0, None, 0.0)
    loose = got[None]
    assert (loose.n_records, loose.n_species, loose.lat_r) == (3, 2, 61.9)
    assert loose.lon_r == pytest.approx(16.2)


def test_master(obs, banks):
    got = by_id(L.locality_master(obs, *banks))
    a = got["cell_61.7_16.16"]
    assert (a.n_species_IAS, a.n_species_nonIAS, a.n_species_N2K) == (1, 2, 1)
    assert a.n2000_score == 0.5
    assert a.IAS_share_species == pytest.approx(1 / 3)
    assert a.Margalef_local == pytest.approx(2 / math.log(5))
    # two identical assignment rows of taxon 62 count twice, the NULL taxon once
    assert (a.dominant_habitat, a.dominant_habitat_purity) == ("a", 0.5)
    tie = got["cell_61.8_16.1"]
    assert (tie.dominant_habitat, tie.dominant_habitat_purity, tie.w_inv) == ("c", 0.5, 1.0)
    loose = got[None]
    assert (loose.n_species_IAS, loose.n2000_score) == (0, 0.0)
    assert (loose.dominant_habitat, loose.dominant_habitat_purity) == ("Unknown", 0.0)
    assert sorted(r.effort_stratum for r in got.values()) == [3, 6, 9]


def test_habitat_sources(obs, banks, spark):
    ias, n2k, hab = banks
    none = by_id(L.locality_master(obs, ias, n2k, None))
    empty = by_id(L.locality_master(obs, ias, n2k, hab.limit(0)))
    for got in (none, empty):
        assert {(r.dominant_habitat, r.dominant_habitat_purity) for r in got.values()} == {("Unknown", 0.0)}


def test_null_label_can_win(obs, spark):
    hab = spark.createDataFrame([(61, "b")], "taxon_id bigint, habitat string")
    found = L.with_locality_id(L.dominant_habitat(obs, hab))
    r = by_id(found)["cell_61.7_16.16"]
    assert (r.dominant_habitat, r.dominant_habitat_purity) == ("Unknown", pytest.approx(2 / 3))


@pytest.mark.parametrize("n", [1, 2, 11, 57])
def test_effort_ranks(spark, n):
    core = spark.range(n).select(
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("LocalityID"),
        (F.col("id") % 4).cast("double").alias("effort_index"),
    )
    got = L.with_effort(core).orderBy("effort_index", "LocalityID").collect()
    assert [r.effort_stratum for r in got] == [
        min(math.ceil(10 * (i + 1) / n) - 1, 9) for i in range(n)
    ]
    xs = sorted(r.effort_index for r in got)
    med = (xs[(n - 1) // 2] + xs[n // 2]) / 2
    want = [1.0 if r.effort_index == 0 else min(max(med / r.effort_index, 0.2), 5.0) for r in got]
    assert [r.w_inv for r in got] == pytest.approx(want)
    assert sum(r.n_localities for r in L.strata_histogram(L.with_effort(core)).collect()) == n


def _shuffles(df):
    """Exchanges by locality between the tables that are written down and the result."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k_lat")


def test_localities_are_dealt_once(spark):
    """One shuffle for the days and one for the taxa of a locality, whatever is aggregated from them."""
    rows = [(59.1 + i % 7 / 1000, 17.1, 59.1, 17.1, f"2020-0{1 + i % 9}-11", i % 5) for i in range(200)]
    rows += [(None, None, 59.2, None, None, 3), (None, None, None, 17.2, "2020-13-01", None)]
    obs = spark.createDataFrame(
        rows, "k_lat double, k_lon double, lat_r double, lon_r double, date_s string, taxon_id bigint"
    )
    counts = L.observation_counts(obs)
    assert counts.count() == len({r[:2] + r[4:] for r in rows[:200]}) + 2
    assert _shuffles(L.locality_core(counts)) == 2
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "taxon_id bigint, habitat string")
    best = L.dominant_habitat(counts, labels)
    assert _shuffles(best) == 1
    core = {r["LocalityID"]: r for r in L.locality_core(counts).collect()}
    assert core["cell_59.1_17.1"]["first_event"] == "2020-01-11"
    assert (core[None]["n_events"], core[None]["last_event"]) == (1, "2020-13-01")
    assert (core[None]["lat_r"], core[None]["lon_r"]) == (59.2, 17.2)
    # taxa 0 and 4 have no label and taxon 3 a missing one: three of five
    named = {(r["dominant_habitat"], r["dominant_habitat_purity"]) for r in best.where("k_lat IS NOT NULL").collect()}
    assert named == {("Unknown", 0.6)}
