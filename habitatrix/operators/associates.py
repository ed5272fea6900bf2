"""Stage 2: taxa recorded within a fixed radius of sampled focal sites.

Frames used here:

* points    ``focal, vern, taxon, LocalityKey, row_key, E, N`` and, when read from
  raw records, ``lat_m, lon_m`` for records without a named locality
* sites     ``run, focal, fid, LocalityKey, E, N``  (at most 350 per run and focal)
* contacts  ``site_e, site_n, taxon, LocalityKey, is_red, E, N, records``

Contacts are keyed by site *position*: all sites at one spot (of any run or
species) share their rows, and equal observations are counted, not repeated.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatrix import config as C
from habitatrix.functions import geo, text
from habitatrix.operators.ordering import grouped_median
from habitatrix.session import lookup, materialize

#: Grid cells around sampled sites: four numbers per row.
_CELL_ROWS = 2_000_000
_REPEAT_BLOCK = 10_000
#: So many selectors are tested as a condition, more are joined.
_LISTED = 1_000
_SPOT = ["site_e", "site_n"]
_OWNER = ["run", "focal"]


# -- points -------------------------------------------------------------------


def in_bbox(occ: DataFrame) -> DataFrame:
    """Numeric coordinates inside the coarse national box (bounds included)."""
    lat = F.col("decimalLatitude").try_cast("double")
    lon = F.col("decimalLongitude").try_cast("double")
    return occ.where(
        lon.between(C.LON_MIN, C.LON_MAX) & lat.between(C.LAT_MIN, C.LAT_MAX)
    )


def occurrence_rows(occ: DataFrame) -> DataFrame:
    """Narrow rows of every usable record, still in degrees.

    Selecting focal species works on these rows, so only the records that a pass
    needs are projected afterwards by ``to_points``.
    """

    def optional(name: str) -> Column | None:
        return F.col(name) if name in occ.columns else None

    def text_or_null(c: Column | None) -> Column:
        return (F.lit(None) if c is None else c).cast("string")

    taxon = text.lsid_taxon(F.col("taxonID")) if "taxonID" in occ.columns else F.lit(None)
    name = optional("scientificName")
    if name is None:
        name = F.coalesce(taxon, F.lit("unknown"))
    whole = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in sorted(occ.columns)])
    key = optional("occurrenceID")
    key = whole if key is None else F.coalesce(key.cast("string"), whole)
    return in_bbox(occ).select(
        name.alias("focal"),
        text_or_null(optional("vernacularName")).alias("vern"),
        taxon.cast("string").alias("taxon"),
        text.named_locality(optional("localityID"), optional("locality")).alias("LocalityKey"),
        key.cast("string").alias("row_key"),
        F.col("decimalLatitude").try_cast("double").alias("lat"),
        F.col("decimalLongitude").try_cast("double").alias("lon"),
    )


def to_points(rows: DataFrame) -> DataFrame:
    """Add metres ``E``/``N`` and thousandths of a degree, drop the degrees."""
    milli = text.with_milli(rows, {"lat": "lat_m", "lon": "lon_m"})
    return geo.project(milli, "lat", "lon", "N", "E").drop("lat", "lon")


def _cell_columns(points: DataFrame) -> list[str]:
    return [c for c in ("lat_m", "lon_m") if c in points.columns]


def _with_key(df: DataFrame) -> DataFrame:
    """Fill a missing locality name with the padded cell.

    The text is built late, for the few rows that survive the spatial join.
    """
    if not _cell_columns(df):
        return df
    cell = text.padded_cell_key(F.col("lat_m"), F.col("lon_m"))
    return df.withColumn("LocalityKey", F.coalesce("LocalityKey", cell)).drop("lat_m", "lon_m")


def mark_focal(points: DataFrame, selectors: DataFrame) -> DataFrame:
    """Add ``is_focal``: the id or the name is selected (NULL never is).

    A list of up to ``_LISTED`` selectors becomes a condition on the two columns.  The optimizer takes it, and
    the semi-join on cells behind it, below the joins that made ``points``; a join here would hold both back.
    """
    ids = selectors.where(F.col("taxon_id").isNotNull()).select(
        F.col("taxon_id").alias("taxon")
    ).distinct()
    names = selectors.where(F.col("name").isNotNull()).select(F.col("name").alias("focal")).distinct()
    listed = [sorted(r[0] for r in df.limit(_LISTED + 1).collect()) for df in (ids, names)]
    if max(map(len, listed)) <= _LISTED:
        hits = [
            F.coalesce(F.col(c).isin(values), F.lit(False)) for c, values in zip(("taxon", "focal"), listed) if values
        ]
        return points.select(*points.columns, reduce(or_, hits, F.lit(False)).alias("is_focal"))
    hit = F.lit(True)
    return (
        points.join(lookup(ids.withColumn("_by_id", hit)), "taxon", "left")
        .join(lookup(names.withColumn("_by_name", hit)), "focal", "left")
        .select(*points.columns, F.coalesce("_by_id", "_by_name", F.lit(False)).alias("is_focal"))
    )


def focal_points(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("is_focal") & F.col("focal").isNotNull()).drop("is_focal")


def associate_points(marked: DataFrame) -> DataFrame:
    """Records of no focal species at all, not just not of the current one."""
    return marked.where(~F.col("is_focal")).drop("is_focal")


def mark_red(df: DataFrame, red_ids: DataFrame) -> DataFrame:
    red = red_ids.select(F.col("taxon_id").alias("taxon"), F.lit(True).alias("_red"))
    return df.join(lookup(red), "taxon", "left").select(
        *df.columns, F.coalesce("_red", F.lit(False)).alias("is_red")
    )


def focal_totals(focal: DataFrame) -> DataFrame:
    return focal.groupBy("focal").agg(F.count(F.lit(1)).alias("focal_obs"))


def focal_meta(focal: DataFrame, part: str = "part", row: str = "row") -> DataFrame:
    """Record count, and the first vernacular name and taxon of the first file.

    Later files are not consulted, even if the first one has only NULLs.
    """

    def first_seen(c: str) -> Column:
        pick = F.min(F.struct(part, F.col(c).isNull().alias("absent"), row, F.col(c).alias("v")))
        return pick["v"]

    return focal.groupBy("focal").agg(
        F.count(F.lit(1)).alias("focal_obs"),
        first_seen("vern").alias("vern"),
        first_seen("taxon").alias("taxon"),
    )


# -- sites --------------------------------------------------------------------


def draw_key(seed: int, *parts: Column) -> Column:
    """Pseudo-random sort key; MD5 text, so any SQL engine can repeat a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sample_sites(
    focal: DataFrame,
    seed: int = C.SEED,
    runs: int = 1,
    size: int = C.SAMPLE_SITES,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Up to ``size`` sites per run and species, drawn without replacement.

    The smallest draw keys win.  The position is part of the draw, so records that
    share a key, or lack one, differ too.  Keys are spread evenly, so those below
    a limit that about twice ``size`` records of a species pass hold the smallest
    ones: a record is dropped where it is read, and what is sorted does not grow
    with the species.  A run that the limit left short, which is all but
    impossible, is drawn again without it.  ``totals`` are the ``focal_totals`` of the
    same records, if they are there already.
    """
    if totals is None:
        totals = materialize(focal_totals(focal), "focal-totals")
    counts = lookup(totals.select("focal", F.col("focal_obs").alias("_n")))
    share = F.lit(2.0 * size + 100) / F.col("_n")
    # compared as text with the first eight digits of a key; "g" is above all of them
    limit = F.when(share < 1, F.lpad(F.lower(F.hex(F.floor(share * float(1 << 32)).cast("bigint"))), 8, "0")).otherwise("g")
    drawn = focal.select("focal", "LocalityKey", *_cell_columns(focal), "row_key", "E", "N")
    each = drawn.join(counts, drawn["focal"].eqNullSafe(counts["focal"])).drop(counts["focal"])
    # the record's part of the key is made below the generator, once for all runs; NULLs are skipped as in one key
    own = [F.col(c).cast("string") for c in ("row_key", "E", "N")]
    each = each.withColumn("_own", F.when(F.coalesce(*own).isNotNull(), F.concat_ws("|", *own)))
    each = each.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    keyed = each.withColumn("_draw", draw_key(seed, F.col("run"), F.col("_own"))).drop("_own")
    passed = materialize(keyed.where(F.col("_draw") < limit).drop("_n"), "draws")
    whole = counts.select("focal", "_n", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    found = passed.groupBy(*_OWNER).agg(F.count(F.lit(1)).alias("_found"))
    same = (F.col("w.run") == F.col("f.run")) & F.col("w.focal").eqNullSafe(F.col("f.focal"))
    short = whole.alias("w").join(found.alias("f"), same, "left")
    short = short.where(F.coalesce("_found", F.lit(0)) < F.least(F.lit(size), "_n")).select("w.run", "w.focal")
    if short.limit(1).count():
        again = lookup(materialize(short.select(F.col("run").alias("_run"), F.col("focal").alias("_focal")), "short"))
        which = (F.col("run") == F.col("_run")) & F.col("focal").eqNullSafe(F.col("_focal"))
        rest = passed.join(again, which, "left_anti")
        passed = rest.unionByName(keyed.join(again, which, "left_semi").drop("_n"))
    order = Window.partitionBy(*_OWNER).orderBy("_draw", "row_key", "E", "N")
    first = passed.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= size)
    return (
        _with_key(first)
        .select(
            "run",
            "focal",
            (F.col("_rn") - 1).cast("bigint").alias("fid"),
            "LocalityKey",
            "E",
            "N",
        )
    )


def site_spots(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("E").alias("site_e"), F.col("N").alias("site_n")).distinct()


def site_owners(sites: DataFrame) -> DataFrame:
    """Runs and species with sites at a position, and how many there."""
    return sites.groupBy(
        F.col("E").alias("site_e"), F.col("N").alias("site_n"), *_OWNER
    ).agg(F.count(F.lit(1)).alias("sites_here"))


def buffer_bounds(
    sites: DataFrame, radius: float = C.BUFFER_M, margin: float = C.BBOX_MARGIN_DEG,
    corners_only: bool = False,
) -> DataFrame:
    """One row with the degree box around all buffers.

    Parallels curve on the map, so projecting back only the four corners of the
    metric box loses a strip along its top.  The default projects every site and
    is safe; ``corners_only`` gives the narrower box.
    """
    if corners_only:
        box = sites.agg(
            F.array(F.min("E") - radius, F.max("E") + radius).alias("es"),
            F.array(F.min("N") - radius, F.max("N") + radius).alias("ns"),
        )
        spots = box.select(F.explode("es").alias("E"), "ns").select(
            "E", F.explode("ns").alias("N")
        )
    else:
        spots = sites
    return geo.unproject(spots.select("E", "N"), "N", "E", "lat", "lon").agg(
        (F.min("lon") - margin).alias("lon_min"),
        (F.min("lat") - margin).alias("lat_min"),
        (F.max("lon") + margin).alias("lon_max"),
        (F.max("lat") + margin).alias("lat_max"),
    )


def near_buffers(occ: DataFrame, bounds: DataFrame) -> DataFrame:
    """Records in the degree box; the bounds reach the scan of numeric columns.

    Text coordinates are read leniently, like everywhere else.
    """
    low_lon, low_lat, high_lon, high_lat = (
        bounds.select(c).scalar() for c in ("lon_min", "lat_min", "lon_max", "lat_max")
    )
    lon, lat = (F.col(c).try_cast("double") for c in ("decimalLongitude", "decimalLatitude"))
    return occ.where(lon.between(low_lon, high_lon) & lat.between(low_lat, high_lat))


#: A degree of latitude is longer than this everywhere.
_DEGREE_M = 110_000.0


def near_sites(rows: DataFrame, sites: DataFrame, radius: float = C.BUFFER_M) -> DataFrame:
    """Rows in degrees whose cell, or a neighbour of it, holds a site.

    A cell is as wide as the radius or wider at every latitude of the box, so nothing inside a buffer is
    lost, and only what is left has to be projected.
    """
    tall = radius / _DEGREE_M
    wide = tall / math.cos(math.radians(C.LAT_MAX))
    spots = geo.unproject(site_spots(sites), "site_n", "site_e", "_lat", "_lon")
    step = F.sequence(F.lit(-1), F.lit(1))
    cells = spots.select(
        geo.grid_cell(F.col("_lat"), tall).alias("_y"), geo.grid_cell(F.col("_lon"), wide).alias("_x")
    ).distinct()
    around = (
        cells.withColumn("_dx", F.explode(step))
        .withColumn("_dy", F.explode(step))
        .select((F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y"))
        .distinct()
    )
    placed = rows.withColumns({"_x": geo.grid_cell(F.col("lon"), wide), "_y": geo.grid_cell(F.col("lat"), tall)})
    return placed.join(lookup(materialize(around, "site-cells"), _CELL_ROWS), ["_x", "_y"], "left_semi").select(*rows.columns)


# -- spatial join -------------------------------------------------------------


def site_cells(sites: DataFrame, radius: float) -> DataFrame:
    """The 3 x 3 grid cells around every distinct site position."""
    step = F.sequence(F.lit(-1), F.lit(1))
    return (
        site_spots(sites)
        .withColumn("dx", F.explode(step))
        .withColumn("dy", F.explode(step))
        .select(
            *_SPOT,
            (geo.grid_cell(F.col("site_e"), radius) + F.col("dx")).alias("cx"),
            (geo.grid_cell(F.col("site_n"), radius) + F.col("dy")).alias("cy"),
        )
    )


def site_contacts(
    associates: DataFrame,
    sites: DataFrame,
    red_ids: DataFrame,
    radius: float = C.BUFFER_M,
    shape: str = "polygon64",
) -> DataFrame:
    """Associates inside the buffer of each site position, with counts.

    1. a semi-join on the grid cell drops records far from every site,
    2. equal (position, taxon, locality) records are combined before any pairing,
    3. an equi-join on the cell plus the exact predicate makes the pairs.
    """
    cells = site_cells(sites, radius)
    same = ["taxon", "LocalityKey", *_cell_columns(associates), "E", "N"]
    own_cell = {"cx": geo.grid_cell(F.col("E"), radius), "cy": geo.grid_cell(F.col("N"), radius)}
    nearby = (
        associates.select(*same)
        .withColumns(own_cell)
        .join(lookup(cells.select("cx", "cy").distinct(), _CELL_ROWS), ["cx", "cy"], "left_semi")
        .groupBy(*same)
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumns(own_cell)
    )
    inside = geo.in_buffer(
        F.col("E") - F.col("site_e"), F.col("N") - F.col("site_n"), radius, shape
    )
    return (
        mark_red(_with_key(nearby), red_ids)
        .join(lookup(cells, _CELL_ROWS), ["cx", "cy"], "inner")
        .where(inside)
        .select(*_SPOT, "taxon", "LocalityKey", "is_red", "E", "N", "records")
    )


def buffer_hits(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Counts per (site, taxon, locality): every (record, buffer) pair counts."""
    flat = contacts.groupBy(*_SPOT, "taxon", "LocalityKey", "is_red").agg(
        F.sum("records").alias("n_hits")
    )
    placed = sites.select(
        *_OWNER, "fid", F.col("E").alias("site_e"), F.col("N").alias("site_n")
    )
    return flat.join(lookup(placed), _SPOT, "inner").drop(*_SPOT)


# -- outputs ------------------------------------------------------------------


def taxon_hits(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Hits per run, focal species and taxon; unknown taxa are left out."""
    # straight to the few rows of (run, species, taxon), which combine in the map tasks; positions x taxa would not
    return (
        contacts.where(F.col("taxon").isNotNull())
        .join(lookup(site_owners(sites)), _SPOT, "inner")
        .groupBy(*_OWNER, "taxon", "is_red")
        .agg(F.sum(F.col("records") * F.col("sites_here")).alias("n_hits"))
    )


def kept_taxa(hits: DataFrame, at_least: int = C.MIN_HITS) -> DataFrame:
    return hits.where(F.col("n_hits") >= at_least)


def finds(kept: DataFrame, sites: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per run and focal species: kept ids, red ids and the counts.

    Species without any kept taxon stay, with empty lists.
    """
    lists = kept.groupBy(*_OWNER).agg(
        F.array_sort(F.collect_list("taxon")).alias("ids"),
        F.array_sort(F.collect_list(F.when(F.col("is_red"), F.col("taxon")))).alias("red_ids"),
    )
    none = F.array().cast("array<string>")
    return (
        sites.select(*_OWNER)
        .distinct()
        .join(totals, "focal", "inner")
        .join(lists, _OWNER, "left")
        .select(
            *_OWNER,
            "focal_obs",
            F.coalesce("ids", none).alias("ids"),
            F.coalesce("red_ids", none).alias("red_ids"),
        )
        .withColumns({"n_assoc": F.size("ids").cast("bigint"), "n_red": F.size("red_ids").cast("bigint")})
    )


def unique_finds(found: DataFrame) -> DataFrame:
    return found.select(*_OWNER, F.array_join("ids", " ").alias("ids"))


def red_finds(found: DataFrame) -> DataFrame:
    return found.select(*_OWNER, F.array_join("red_ids", " ").alias("ids"))


def total_target_obs(found: DataFrame) -> DataFrame:
    return found.select(*_OWNER, "focal_obs", "n_assoc", "n_red")


def all_observations(contacts: DataFrame, sites: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept ids with duplicates, one row per hit.

    Rows, not one list per species: a list would hold every hit of a common
    species in one task.  Repetition starts from (position, taxon) counts and is
    spread in blocks, so a dominant taxon is written by many tasks.
    """
    block = F.lit(_REPEAT_BLOCK)
    counted = (
        contacts.groupBy(*_SPOT, "taxon")
        .agg(F.sum("records").alias("records"))
        .join(lookup(site_owners(sites)), _SPOT, "inner")
        .join(lookup(kept.select(*_OWNER, "taxon")), [*_OWNER, "taxon"], "left_semi")
        .select(*_OWNER, "taxon", (F.col("records") * F.col("sites_here")).alias("copies"))
    )
    n_tasks = int(contacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = counted.withColumn(
        "first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"), block))
    ).repartition(n_tasks)
    last = F.least(F.col("first") + block - 1, F.col("copies"))
    return blocks.withColumn("copy", F.explode(F.sequence("first", last))).select(
        *_OWNER, "taxon"
    )


def red_species_local(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct red-listed taxa per locality, without the frequency rule."""
    seen = contacts.where(F.col("is_red") & F.col("LocalityKey").isNotNull())
    keys = [*_OWNER, "LocalityID"]
    # dealt once, by locality; the taxa of one are told apart where they are
    return (
        seen.select(*_SPOT, F.col("LocalityKey").alias("LocalityID"), "taxon")
        .join(lookup(site_owners(sites)), _SPOT, "inner")
        .select(*keys, "taxon")
        .repartition(*keys)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_red"))
    )


def locality_species_all(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per sampled site, also when nothing was found there."""
    at_spot = (
        contacts.where(F.col("taxon").isNotNull())
        .groupBy(*_SPOT)
        .agg(text.length_then_text(F.collect_set("taxon")).alias("ids"))
    )
    placed = sites.withColumns({"site_e": F.col("E"), "site_n": F.col("N")})
    return placed.join(at_spot, _SPOT, "left").select(
        *_OWNER,
        "fid",
        F.replace(F.coalesce("LocalityKey", F.lit("<NA>")), F.lit(" "), F.lit("_")).alias(
            "LocalityID"
        ),
        text.half_even_int(F.col("N")).alias("SWEREF_N"),
        text.half_even_int(F.col("E")).alias("SWEREF_E"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("ids"),
    )


def locality_species_red(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Red-listed taxa and median position per locality.

    Records without a usable key get the padded cell of their own position.
    """
    named = F.nullif(F.nullif(F.col("LocalityKey"), F.lit("")), F.lit("NA"))
    located = text.with_milli(
        geo.unproject(contacts.where(F.col("is_red")), "N", "E", "_lat", "_lon"),
        {"_lat": "_lat_m", "_lon": "_lon_m"},
    )
    own_cell = text.padded_cell_key(F.col("_lat_m"), F.col("_lon_m"))
    rows = (
        located.join(lookup(site_owners(sites)), _SPOT, "inner")
        .select(
            *_OWNER,
            F.coalesce(named, own_cell, F.lit("")).alias("LocalityID"),
            "taxon",
            "E",
            "N",
            (F.col("records") * F.col("sites_here")).alias("w"),
        )
        .groupBy(*_OWNER, "LocalityID", "taxon", "E", "N")
        .agg(F.sum("w").alias("w"))
    )
    keys = [*_OWNER, "LocalityID"]
    ids = (
        rows.select(*keys, "taxon")
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("taxon")).alias("ids"))
    )
    north = grouped_median(rows, keys, "N", "w", "mid_n")
    east = grouped_median(rows, keys, "E", "w", "mid_e")
    return (
        ids.join(north, keys, "inner")
        .join(east, keys, "inner")
        .select(
            *keys,
            F.rint("mid_n").cast("bigint").alias("SWEREF_N"),
            F.rint("mid_e").cast("bigint").alias("SWEREF_E"),
            "ids",
        )
    )
