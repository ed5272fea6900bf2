"""One registered query per operator, over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.views import Views
from habitatrix import config as C
from habitatrix.functions import geo, stats, text
from habitatrix.operators import associates as A
from habitatrix.operators import bootstrap, classes, composite, enrichment, region, stability
from habitatrix.operators import locality as L
from habitatrix.operators import subsample
from habitatrix.plans import associate_stage, composite_stage, stability_stage
from habitatrix.session import materialize, scratch_path
from habitatrix.sources import lookups, occurrences, tables

REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


def r6(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# -- stage 1 ------------------------------------------------------------------


@query
def locality_events(v: Views) -> DataFrame:
    return L.locality_events(v.obs())


@query
def scan_occurrence(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "occurrences")
    v.occ().drop("E", "N", "part").write.parquet(f"{path}/sub")
    occ = occurrences.read_occurrences(v.spark, path)
    return occ.groupBy("scientificName").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count("decimalLatitude").alias("n_located"),
        F.count("eventDate").alias("n_dated"),
    )


@query
def locality_core(v: Views) -> DataFrame:
    return L.locality_core(v.obs()).select(
        "LocalityID",
        *r6("lat_r", "lon_r"),
        "first_event",
        "last_event",
        "n_records",
        "n_events",
        "n_species",
    )


@query
def effort_index(v: Views) -> DataFrame:
    return L.locality_core(v.obs()).select("LocalityID", *r6("effort_index"))


@query
def effort_weight(v: Views) -> DataFrame:
    return L.with_effort(L.locality_core(v.obs())).select("LocalityID", *r6("w_inv"))


@query
def effort_strata(v: Views) -> DataFrame:
    return L.with_effort(L.locality_core(v.obs())).select(
        "LocalityID", *r6("effort_index"), "effort_stratum"
    )


@query
def strata_histogram(v: Views) -> DataFrame:
    return L.strata_histogram(L.with_effort(L.locality_core(v.obs())))


@query
def margalef(v: Views) -> DataFrame:
    core = L.locality_core(v.obs())
    value = stats.margalef(F.col("n_species"), F.col("n_records"))
    return core.select("LocalityID", F.round(value, 6).alias("margalef_local"))


@query
def ias_flags(v: Views) -> DataFrame:
    return L.locality_core(v.obs(), v.ias(), v.n2k()).select("LocalityID", "n_species_IAS")


@query
def n2k_score(v: Views) -> DataFrame:
    return L.locality_core(v.obs(), v.ias(), v.n2k()).select(
        "LocalityID", "n_species_N2K", *r6("n2000_score")
    )


@query
def dominant_habitat(v: Views) -> DataFrame:
    found = L.with_locality_id(L.dominant_habitat(v.obs(), v.labels()))
    return found.select(
        "LocalityID",
        F.col("dominant_habitat").alias("habitat"),
        F.round("dominant_habitat_purity", 6).alias("purity"),
    )


@query
def locality_master(v: Views) -> DataFrame:
    master = L.locality_master(v.obs(), v.ias(), v.n2k(), v.labels())
    doubles = {f.name for f in master.schema.fields if f.dataType.typeName() == "double"}
    return master.select(*[r6(c)[0] if c in doubles else c for c in master.columns])


# -- scalar functions ---------------------------------------------------------


@query
def taxon_id_extract(v: Views) -> DataFrame:
    mixed = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey").cast("string")).otherwise(
        F.concat(F.lit("urn:lsid:dyntaxa.se:Taxon:"), F.col("l_partkey").cast("string"))
    )
    return (
        v.table("lineitem")
        .select(text.taxon_number(mixed).alias("loose"), text.lsid_taxon(mixed).alias("strict"))
        .groupBy("loose", "strict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def date_normalize(v: Views) -> DataFrame:
    return v.occ().groupBy("eventDate").agg(F.count(F.lit(1)).alias("n")).select(
        "eventDate", text.day_text(F.col("eventDate")).alias("date_s"), "n"
    )


@query
def date_in_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.day_text(F.col("text")).alias("date_s"))


@query
def cell_key(v: Views) -> DataFrame:
    return L.with_locality_id(v.obs()).groupBy("LocalityID").agg(F.count(F.lit(1)).alias("n"))


@query
def locality_key(v: Views) -> DataFrame:
    """Named localities for some rows, padded coordinates for the others."""
    c = v.table("lineitem").select(
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("L"), F.col("l_suppkey").cast("string")))
        .when(F.col("l_linenumber") == 2, F.lit(""))
        .alias("localityID"),
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit("Site "), F.col("l_suppkey").cast("string")))
        .when(F.col("l_linenumber") == 3, F.lit(""))
        .alias("locality"),
        (F.lit(55.0) + (F.col("l_partkey") % 20000).cast("double") / 10000).alias("lat"),
        (F.lit(11.0) + (F.col("l_orderkey") % 20000).cast("double") / 10000).alias("lon"),
    )
    c = text.with_milli(c, {"lat": "lat_m", "lon": "lon_m"})
    key = text.locality_key(F.col("localityID"), F.col("locality"), F.col("lat_m"), F.col("lon_m"))
    return c.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def habitat_slug(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id",
        F.md5(text.habitat_slug(F.col("text")).cast("binary")).alias("text_slug"),
        text.habitat_slug(F.concat("lang", F.lit(" / "), "source")).alias("slug"),
    )


@query
def name_keys(v: Views) -> DataFrame:
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), F.col("p_type"), F.lit(" "), "p_brand")
    return v.table("part").select(
        "p_partkey", text.name_norm(name).alias("name_norm"), text.genus_species(name).alias("gs_key")
    )


@query
def safe_name(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query
def stable_seed(v: Views) -> DataFrame:
    return v.table("customer").select(
        "c_custkey", text.name_seed(F.col("c_name"), C.SUBSAMPLE_SEED).alias("seed")
    )


@query
def lsa_j(v: Views) -> DataFrame:
    counts = v.table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("m"))
    return counts.select(
        "l_suppkey",
        "m",
        text.subsample_size(
            F.col("m"), C.SUBSAMPLE_MIN, C.SUBSAMPLE_MAX, C.SUBSAMPLE_FRACTION
        ).alias("j"),
    )


@query
def project_tm(v: Views) -> DataFrame:
    spots = v.occ().select("decimalLatitude", "decimalLongitude").dropna().distinct()
    placed = geo.project(spots, "decimalLatitude", "decimalLongitude", "north", "east")
    return placed.select(
        F.round("decimalLatitude", 3).alias("lat"),
        F.round("decimalLongitude", 3).alias("lon"),
        F.round("north", 3).alias("north"),
        F.round("east", 3).alias("east"),
    )


@query
def inverse_tm(v: Views) -> DataFrame:
    spots = geo.unproject(v.occ().select("E", "N").distinct(), "N", "E", "lat", "lon")
    return spots.select("E", "N", *r6("lat", "lon", digits=8))


# -- lookup files -------------------------------------------------------------


@query
def bank_lookup(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "bank")
    v.n2k().select(
        F.concat(F.lit("urn:lsid:dyntaxa.se:Taxon:"), F.col("taxon_id").cast("string")).alias("taxonID"),
        F.when(F.col("weight") != 0.25, F.col("weight").cast("string")).alias("weight"),
        F.lit("x").alias("ignored"),
    ).write.option("sep", ";").option("header", True).csv(path)
    return lookups.read_n2k_bank(v.spark, path).select("taxon_id", "habitatCode", *r6("weight"))


@query
def redlist_ids(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "redlist")
    v.table("part").select(
        F.when(F.col("p_size") % 7 == 0, F.col("p_partkey").cast("string"))
        .when(F.col("p_size") % 7 == 1, F.lit("n/a"))
        .alias("Taxon id"),
        F.col("p_name").alias("Svenskt namn"),
    ).write.option("sep", ";").option("header", True).csv(path)
    return lookups.read_red_list(v.spark, path)


@query
def focal_list(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "focal")
    v.table("part").select(
        F.when(F.col("p_partkey") % 3 == 0, F.lit("?")).otherwise(
            F.concat(F.lit(" "), (F.col("p_partkey") % 500).cast("string"))
        ).alias("TaxonID"),
        F.when(F.col("p_partkey") % 5 != 0, F.concat("p_name", F.lit(" "))).alias("scientificName"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    merged = lookups.focal_selectors(
        v.spark, [7, 100_000], ["Extra name"], lookups.read_focal_list(v.spark, path)
    )
    return merged


@query
def lm_load(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "lm")
    v.table("lineitem").select(
        F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("cell_"), F.col("l_orderkey").cast("string"))).alias(
            "LocalityID"
        ),
        F.when(F.col("l_linenumber") == 1, F.lit("bad")).otherwise(F.col("l_tax").cast("string")).alias(
            "w_inv"
        ),
        (F.col("l_quantity") % 10).cast("int").cast("string").alias("effort_stratum"),
        F.col("l_discount").cast("string").alias("n2000_score"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    return (
        tables.read_locality_master(v.spark, path)
        .groupBy("effort_stratum", "dominant_habitat")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("w_inv"), 4).alias("w"),
            F.round(F.sum("n2000_score"), 4).alias("score"),
        )
    )


def _lines(df: DataFrame, folder, line, pos=None) -> DataFrame:
    return df.select(
        folder.alias("folder"), (F.lit(0) if pos is None else pos).alias("pos"), line.alias("line")
    )


@query
def red_local_load(v: Views) -> DataFrame:
    li = v.table("lineitem")
    value = F.when(F.col("l_linenumber") == 7, F.lit("x")).otherwise(
        F.col("l_quantity").cast("int").cast("string")
    )
    key = F.concat(F.lit("cell "), F.col("l_suppkey").cast("string"))
    lines = _lines(li, F.col("l_returnflag"), F.concat(key, F.lit(" "), value))
    return (
        tables.parse_red_local(lines)
        .groupBy("folder", "LocalityID")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    )


@query
def parse_totals(v: Views) -> DataFrame:
    part = v.table("part")
    line = F.concat_ws(
        " ",
        "p_name",
        "p_type",
        F.col("p_partkey").cast("string"),
        F.col("p_size").cast("string"),
        F.lit("7"),
    )
    return tables.parse_totals(_lines(part, F.col("p_partkey").cast("string"), line))


@query
def parse_ids(v: Views) -> DataFrame:
    lines = v.table("orders").select(
        F.col("o_orderkey").cast("string").alias("folder"),
        F.concat_ws(
            " ", F.lit("Brand#3"), F.col("o_custkey").cast("string"), "o_orderpriority"
        ).alias("line"),
    )
    return tables.parse_observed_ids(lines)


@query
def parse_locspecies(v: Views) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    line = (
        F.when(kind == 0, F.lit("LocalityID SWEREF_N SWEREF_E Species_IDs"))
        .when(kind == 1, F.lit("   "))
        .when(kind == 2, F.lit("<NA> 1 2"))
        .otherwise(
            F.concat_ws(
                " ",
                F.lit("cell_x 10  20"),
                F.col("o_custkey").cast("string"),
                F.lit("<NA> nan"),
                F.col("o_orderkey").cast("string"),
            )
        )
    )
    got = tables.parse_locality_species(
        _lines(v.table("orders"), F.col("o_orderstatus"), line, F.col("o_orderkey"))
    )
    return got.select("folder", "pos", "LocalityID", F.array_join("ids", " ").alias("ids"))


# -- stage 2 ------------------------------------------------------------------


@query
def bbox_filter(v: Views) -> DataFrame:
    wide = v.table("lineitem").select(
        F.col("l_suppkey"),
        (F.lit(54.0) + (F.col("l_partkey") % 170).cast("double") / 10).alias("decimalLatitude"),
        (F.lit(8.0) + (F.col("l_orderkey") % 200).cast("double") / 10).alias("decimalLongitude"),
    )
    return A.in_bbox(wide).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def _count_points(df: DataFrame) -> DataFrame:
    return df.groupBy("focal", "taxon").agg(F.count(F.lit(1)).alias("n"))


@query
def focal_filter(v: Views) -> DataFrame:
    return _count_points(v.focal())


@query
def assoc_filter(v: Views) -> DataFrame:
    return _count_points(v.others())


@query
def red_flag(v: Views) -> DataFrame:
    return (
        A.mark_red(v.others(), v.red_ids())
        .groupBy("taxon", "is_red")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def focal_meta(v: Views) -> DataFrame:
    focal = v.focal().withColumn("row", F.col("row_key"))
    hidden = F.when(~F.col("row_key").startswith("1"), F.col("vern"))
    return A.focal_meta(focal.withColumn("vern", hidden))


@query
def site_sample(v: Views) -> DataFrame:
    return v.sites()


@query
def multi_run(v: Views) -> DataFrame:
    sites = v.sites(C.N_RUNS)
    contacts = A.site_contacts(v.others(), materialize(sites, "sites"), v.red_ids())
    kept = A.kept_taxa(A.taxon_hits(contacts, sites))
    return kept.groupBy("run", "focal").agg(
        F.count(F.lit(1)).alias("n_kept"), F.sum("n_hits").alias("n_hits")
    )


@query
def bbox_prefilter(v: Views) -> DataFrame:
    bounds = A.buffer_bounds(v.sites(), corners_only=True)
    return bounds.select(*[F.round(c, 6).alias(c) for c in bounds.columns])


@query
def near_buffers(v: Views) -> DataFrame:
    """Records within two degrees of the sampled sites."""
    inside = A.near_buffers(v.occ(), A.buffer_bounds(v.sites(), margin=2.0))
    return inside.groupBy("scientificName").agg(F.count(F.lit(1)).alias("n"))


def _from_degrees(v: Views) -> associate_stage.Associates:
    """Every focal record in the region is a site."""
    return associate_stage.build_from_occurrences(
        v.occ_degrees(), v.degree_selectors(), v.red_ids(), v.region(), sample=10**9
    )


@query
def degrees_found(v: Views) -> DataFrame:
    found = _from_degrees(v).found
    return found.select(
        "focal", "focal_obs", F.array_join("ids", " ").alias("ids"), F.array_join("red_ids", " ").alias("red_ids"), "n_assoc", "n_red"
    )


@query
def degrees_red_local(v: Views) -> DataFrame:
    built = _from_degrees(v)
    return A.red_species_local(built.contacts, built.sites).select("focal", "LocalityID", "n_red")


@query
def degrees_near(v: Views) -> DataFrame:
    """Records that the second pass starts from, with the margin of the method."""
    occ = v.occ_degrees()
    rows = A.mark_focal(A.occurrence_rows(occ), v.degree_selectors())
    focal = region.in_region(A.to_points(A.focal_points(rows)), v.region())
    inside = A.near_buffers(occ, A.buffer_bounds(focal))
    return inside.groupBy("scientificName").agg(F.count(F.lit(1)).alias("n"))


def _stage2(v: Views, runs: int = 1):
    sites = materialize(v.sites(runs), "sites")
    return A.site_contacts(v.others(), sites, v.red_ids()), sites


@query
def buffer_join(v: Views) -> DataFrame:
    contacts, sites = _stage2(v)
    return A.buffer_hits(contacts, sites).select(
        "focal", "fid", "taxon", "LocalityKey", "is_red", "n_hits"
    )


@query
def region_filter(v: Views) -> DataFrame:
    return (
        region.in_region(v.points(), _region(v))
        .groupBy("focal")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _region(v: Views) -> DataFrame:
    """One rectangle with a hole and one triangle per supplier nation."""
    e0 = F.lit(500000.0) + (F.col("s_nationkey") * 397).cast("double")
    n0 = F.lit(6580000.0) + (F.col("s_nationkey") * 311).cast("double")
    size = F.lit(900.0)

    def ring(*corners):
        pts = [F.struct(x.alias("x"), y.alias("y")) for x, y in corners]
        return F.array(
            *[
                F.struct(
                    a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
                )
                for a, b in zip(pts, pts[1:] + pts[:1])
            ]
        )

    outer = ring((e0, n0), (e0 + size, n0), (e0 + size, n0 + size), (e0, n0 + size))
    a, b = F.lit(300.0), F.lit(600.0)
    hole = ring((e0 + a, n0 + a), (e0 + b, n0 + a), (e0 + b, n0 + b), (e0 + a, n0 + b))
    tri = ring((e0 - 500, n0 - 500), (e0 + 400, n0 - 500), (e0 - 500, n0 + 400))
    nations = v.table("supplier").select("s_nationkey").distinct()
    polys = nations.select(
        F.explode(
            F.array(
                F.struct(F.lit("r").alias("kind"), F.concat(outer, hole).alias("edges")),
                F.struct(F.lit("t").alias("kind"), tri.alias("edges")),
            )
        ).alias("p"),
        "s_nationkey",
    )
    return polys.select(
        F.concat_ws("/", F.col("s_nationkey").cast("string"), "p.kind").alias("poly_id"),
        F.explode("p.edges").alias("e"),
    ).select("poly_id", "e.*")


@query
def assoc_freq(v: Views) -> DataFrame:
    contacts, sites = _stage2(v)
    return A.kept_taxa(A.taxon_hits(contacts, sites)).select("focal", "taxon", "n_hits")


def _found(v: Views):
    contacts, sites = _stage2(v)
    kept = A.kept_taxa(A.taxon_hits(contacts, sites))
    return A.finds(kept, sites, v.totals())


@query
def unique_finds(v: Views) -> DataFrame:
    return A.unique_finds(_found(v)).drop("run")


@query
def red_finds(v: Views) -> DataFrame:
    return A.red_finds(_found(v)).drop("run")


@query
def total_target_obs(v: Views) -> DataFrame:
    return A.total_target_obs(_found(v)).drop("run")


@query
def all_observations(v: Views) -> DataFrame:
    contacts, sites = _stage2(v)
    contacts = materialize(contacts, "contacts")
    kept = A.kept_taxa(A.taxon_hits(contacts, sites))
    return A.all_observations(contacts, sites, kept).drop("run")


@query
def red_species_local(v: Views) -> DataFrame:
    return A.red_species_local(*_stage2(v)).drop("run")


@query
def locality_species_all(v: Views) -> DataFrame:
    rows = A.locality_species_all(*_stage2(v))
    return rows.select(
        "focal", "fid", "LocalityID", "SWEREF_N", "SWEREF_E", F.array_join("ids", " ").alias("ids")
    )


@query
def locality_species_red(v: Views) -> DataFrame:
    contacts, sites = _stage2(v)
    rows = A.locality_species_red(materialize(contacts, "contacts"), sites)
    return rows.select(
        "focal", "LocalityID", "SWEREF_N", "SWEREF_E", F.array_join("ids", " ").alias("ids")
    )


# -- stage 3 ------------------------------------------------------------------


def _lm(v: Views) -> DataFrame:
    """Stage-1 master as stage 3 loads it."""
    master = L.locality_master(v.obs(), v.ias(), v.n2k(), v.labels())
    return materialize(tables.locality_master_rows(master), "lm")


def _folders(v: Views, runs: int = C.N_RUNS):
    """Stage-2 tables for several runs."""
    built = associate_stage.build(v.focal(), v.others(), v.red_ids(), runs=runs)
    return composite_stage.folder_tables(built)


def _stage3(v: Views):
    lm, data = _lm(v), _folders(v)
    focal = materialize(enrichment.focal_localities(data.red_local, lm), "focal")
    mapping = enrichment.habitat_map(v.assignments())
    folders = materialize(
        enrichment.infer_habitat(data.totals, mapping).select("folder", "main_hab"), "folders"
    )
    return focal, lm, folders, data, mapping


@query
def focal_localities(v: Views) -> DataFrame:
    focal = _stage3(v)[0]
    return focal.select(
        "folder", "LocalityID", "value", *r6("w_inv"), "effort_stratum", "dominant_habitat"
    )


@query
def exceedance(v: Views) -> DataFrame:
    counts = v.table("lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.countDistinct("l_linenumber").alias("value")
    )
    return (
        enrichment.exceedance(counts, "value")
        .groupBy("l_returnflag", "t")
        .agg(F.sum("exceeds").alias("n_above"), F.count(F.lit(1)).alias("n"))
    )


def _tally_out(df: DataFrame, prefixes: str) -> list:
    names = ["nw", *[f"c{t}" for t in C.THRESHOLDS]]
    return [
        F.round(F.col(f"{p}_{c}").cast("double"), 6).alias(f"{p}_{c}") for p in prefixes for c in names
    ]


@query
def a1_background(v: Views) -> DataFrame:
    focal, _, folders, _, _ = _stage3(v)
    out = enrichment.a1_background(focal, folders)
    return out.select("folder", "main_hab", "b_n", *_tally_out(out, "b"))


@query
def a1_point(v: Views) -> DataFrame:
    focal, _, folders, _, _ = _stage3(v)
    return enrichment.a1_point(focal, folders).select(
        "folder",
        "main_hab",
        "n_focal",
        "n_background",
        *r6("mean_loglift", "lifted", "frac"),
        "A1_debug",
    )


@query
def a5_split(v: Views) -> DataFrame:
    focal, lm, folders, _, _ = _stage3(v)
    out = enrichment.a5_split(focal, lm, folders)
    return out.select("folder", "pool", "n_pool_localities", "o_n", "b_n", *_tally_out(out, "ob"))


@query
def a5_point(v: Views) -> DataFrame:
    focal, lm, folders, _, _ = _stage3(v)
    return enrichment.a5_point(focal, lm, folders).select(
        "folder", "pool", "n_in_pool", "n_rest", *r6("n2k_mean_loglift"), "A5_debug"
    )


@query
def infer_habitat(v: Views) -> DataFrame:
    """Exact names, genus + species prefixes and names without any match."""
    part = v.table("part")
    raw = part.select(
        F.col("p_partkey").alias("_row"),
        F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 700).cast("string")).alias("taxonID"),
        F.when(
            F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
        )
        .otherwise(F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")))
        .alias("scientificName"),
        F.when(F.col("p_size") % 11 != 0, F.concat(F.lit("hab"), (F.col("p_partkey") % 9).cast("string"))).alias(
            "habitat"
        ),
    )
    folders = part.select(
        F.col("p_partkey").cast("string").alias("folder"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("  ", F.upper("p_name"), F.col("p_size").cast("string")))
        .when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_brand", "p_type", F.lit("ssp")))
        .otherwise(F.concat("p_name", F.lit("us")))
        .alias("focal_id"),
    )
    return enrichment.infer_habitat(folders, enrichment.habitat_map(raw))


@query
def habitat_purity(v: Views) -> DataFrame:
    _, _, folders, data, mapping = _stage3(v)
    return enrichment.habitat_purity(data.observed, folders, mapping).select(
        "folder", *r6("Habitat_purity")
    )


def _rounded_ends(cuts: DataFrame) -> DataFrame:
    return cuts.select("folder", *r6(*[c for c in cuts.columns if c != "folder"]))


@query
def a1_ci(v: Views) -> DataFrame:
    focal, _, folders, _, _ = _stage3(v)
    points = materialize(enrichment.a1_point(focal, folders), "a1")
    return _rounded_ends(bootstrap.a1_intervals(focal, points))


@query
def a5_ci(v: Views) -> DataFrame:
    focal, lm, folders, _, _ = _stage3(v)
    points = materialize(enrichment.a5_point(focal, lm, folders), "a5")
    return _rounded_ends(bootstrap.a5_intervals(focal, lm, points))


@query
def bg_alloc(v: Views) -> DataFrame:
    """Background rows per stratum from focal counts per stratum."""
    li = v.table("lineitem")
    stratum = (F.col("l_quantity") % 10).cast("bigint")
    draws = (
        li.groupBy(
            F.col("l_suppkey").cast("string").alias("folder"),
            F.col("l_linenumber").cast("int").alias("rep"),
            stratum.alias("stratum"),
        )
        .agg(F.count(F.lit(1)).alias("k"))
    )
    available = (
        li.where("l_suppkey % 7 <> l_quantity % 10")
        .groupBy(F.col("l_suppkey").cast("string").alias("folder"), stratum.alias("stratum"))
        .agg(F.count(F.lit(1)).alias("available"))
    )
    size = li.groupBy(F.col("l_suppkey").cast("string").alias("folder")).agg(
        F.least(F.count(F.lit(1)), F.lit(C.BACKGROUND_CAP)).alias("draw_size")
    )
    return bootstrap.allocate(draws, available, size).select(
        "folder", "rep", "stratum", "k", "alloc"
    )


@query
def lsa_summary(v: Views) -> DataFrame:
    data = _folders(v)
    out = subsample.subsample_summary(data.localities)
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.select(
        "folder", "LSA_debug", "LSA_m_localities", "LSA_j_subsample", "LSA_repeats", *r6(*doubles)
    )


def _metric_rows(v: Views) -> DataFrame:
    """One row per brand and line number with three metrics, some missing."""
    li, part = v.table("lineitem"), v.table("part")
    line = F.col("l_linenumber")
    grouped = (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "l_linenumber")
        .agg(
            F.avg("l_discount").alias("d"),
            F.avg("l_tax").alias("t"),
            F.avg("l_quantity").alias("q"),
        )
    )
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint")
    return grouped.select(
        F.concat_ws("__", "p_brand", line.cast("string")).alias("folder"),
        F.when(brand == 3, F.concat(F.lit("rare"), line.cast("string")))
        .otherwise(F.concat(F.lit("hab"), (brand % 5).cast("string")))
        .alias("main_hab"),
        F.when(line != 7, F.round("d", 6)).alias("mean_loglift"),
        F.round("t", 6).alias("n2k_mean_loglift"),
        F.when(brand % 5 != 2, F.lit(0.25)).alias("Habitat_purity"),
        F.round("q", 6).alias("q"),
    )


@query
def robust_z(v: Views) -> DataFrame:
    z = list(composite.METRICS.values())
    return composite.robust_z(_metric_rows(v), composite.METRICS).select("folder", "main_hab", *r6(*z))


@query
def jenks(v: Views) -> DataFrame:
    brand = F.substring_index("folder", "__", 1).alias("brand")
    rows = _metric_rows(v).groupBy(brand).agg(F.round(F.avg("q") - 25.4, 6).alias("x"))
    return classes.with_class(rows, "x", "x_class")


def _composite(v: Views) -> DataFrame:
    lm, data = _lm(v), _folders(v)
    mapping = enrichment.habitat_map(v.assignments())
    rows = composite_stage.folder_rows(data, lm, mapping, intervals=False)
    return composite.composite(rows)


@query
def composite_index(v: Views) -> DataFrame:
    out = _composite(v)
    return out.select(
        "folder",
        "focal_id",
        "main_hab",
        "No_obs",
        "No_asc_spp",
        "No_redlisted",
        "n_focal",
        "n_background",
        "n_pool_localities",
        *r6("Habitat_purity", "mean_loglift", "n2k_mean_loglift"),
        *r6("Z_exceed", "Z_N2000", "Z_HAB_purity", "composite_index"),
        "composite_class",
        "A1_debug",
        "A5_debug",
    )


@query
def composite_full(v: Views) -> DataFrame:
    """Every column of the index table: counts, sub-sampling, both metrics with their intervals, scores."""
    lm, data = _lm(v), _folders(v)
    rows = composite_stage.folder_rows(data, lm, enrichment.habitat_map(v.assignments()))
    out = composite.composite(rows)
    names = [ours or name for name, ours in C.PROGRESS_COLUMNS if name != "timestamp"]
    names += ["Z_exceed", "Z_N2000", "Z_HAB_purity", "composite_index", "composite_class"]
    doubles = {f.name for f in out.schema.fields if f.dataType.typeName() == "double"}
    return out.select(*[F.round(n, 6).alias(n) if n in doubles else F.col(n) for n in names])


@query
def habitat_summary(v: Views) -> DataFrame:
    rows = composite.with_index(composite.robust_z(_metric_rows(v), composite.METRICS))
    out = composite.habitat_summary(rows)
    return out.select("main_hab", "n", *r6("mean", "std", "min", "q25", "q50", "q75", "max"))


# -- stage 4 ------------------------------------------------------------------


def _runs(v: Views) -> DataFrame:
    """Repeated index values: one run per supplier and line number."""
    li = v.table("lineitem")
    grouped = li.groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(
        F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select(
        F.when(F.col("l_suppkey") % 17 != 0, F.concat(F.lit("sp"), F.col("l_suppkey").cast("string"))).alias(
            "focal_id"
        ),
        F.when(F.col("l_linenumber") == 6, F.lit("n/a"))
        .otherwise(F.round(F.col("d") * 40 - F.lit(1.9), 6).cast("string"))
        .alias("composite_index"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("n") % 5).cast("string")).alias(
            "composite_class"
        ),
        (F.col("n") * 20).cast("string").alias("No_obs"),
    )


@query
def runs_load(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "runs")
    _runs(v).write.option("sep", "\t").option("header", True).csv(path)
    return tables.run_rows(
        tables.read_tsv(v.spark, path), "composite_index", "composite_class", ["focal_id"]
    )


@query
def undersample_filter(v: Views) -> DataFrame:
    runs = _runs(v)
    kept = stability.drop_undersampled(runs)
    removed = stability.removed_groups(runs, kept, ["focal_id"]).select(F.count(F.lit(1)).alias("k"))
    return kept.agg(F.count(F.lit(1)).alias("kept_rows")).select(
        "kept_rows", removed.scalar().alias("removed_groups")
    )


_STABILITY = (
    "mean sd min max range relative_sd stability_pos stability_ge1 stability_same_sign "
    "stability_class3plus"
).split()


@query
def stability_scores(v: Views) -> DataFrame:
    rows = tables.run_rows(_runs(v), "composite_index", "composite_class", ["focal_id"])
    return stability.stability_scores(rows, ["focal_id"]).select(
        "focal_id", "n_runs", *r6(*_STABILITY, digits=10)
    )


@query
def stability_report(v: Views) -> DataFrame:
    return stability_stage.build(_runs(v)).select(
        "focal_id",
        "n_runs",
        *r6(*_STABILITY, digits=10),
        "mean_class",
        "mean_class3plus",
        *r6("stability_score", "instability_score", digits=10),
    )


@query
def top_unstable(v: Views) -> DataFrame:
    return stability.top_unstable(stability_stage.build(_runs(v))).select(
        "focal_id", "n_runs", *r6("mean", "sd", "range", "relative_sd", "instability_score", digits=10)
    )
