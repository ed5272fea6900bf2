"""Stage 3: from per-folder tables and the locality master to the index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix import sinks
from habitatrix.config import EnrichmentSettings
from habitatrix.operators import bootstrap, enrichment
from habitatrix.operators.composite import composite, habitat_summary
from habitatrix.operators.ordering import ordinal
from habitatrix.operators.subsample import subsample_summary
from habitatrix.plans.associate_stage import Associates
from habitatrix.plans.associate_stage import read_lines
from habitatrix.session import materialize
from habitatrix.sources import lookups, tables
from habitatrix.streaming.progress import append_progress, read_progress

#: Folders that are computed together and then logged.
WAVE_FOLDERS = 1000


@dataclass
class FolderTables:
    """What stage 2 hands over, keyed by folder."""

    red_local: DataFrame  # folder, LocalityID, value
    totals: DataFrame  # folder, focal_id, No_obs, No_asc_spp, No_redlisted
    observed: DataFrame  # folder, taxon_id
    localities: DataFrame | None = None  # folder, pos, ids


def folder_tables(result: Associates) -> FolderTables:
    """Hand over in memory, without a detour through text."""
    from habitatrix.operators import associates as A

    red = result.foldered(A.red_species_local(result.contacts, result.sites))
    sites = result.foldered(A.locality_species_all(result.contacts, result.sites))
    return FolderTables(
        red.select("folder", "LocalityID", F.col("n_red").cast("double").alias("value")),
        result.foldered(result.found).select(
            "folder",
            F.col("focal").alias("focal_id"),
            F.col("focal_obs").cast("double").alias("No_obs"),
            F.col("n_assoc").cast("double").alias("No_asc_spp"),
            F.col("n_red").cast("double").alias("No_redlisted"),
        ),
        result.foldered(result.kept).select(
            "folder", F.col("taxon").try_cast("bigint").alias("taxon_id")
        ),
        sites.select("folder", F.col("fid").alias("pos"), "ids"),
    )


def read_folder_tables(spark: SparkSession, root: str, exported: bool = True) -> FolderTables:
    """Read text tables: our own export, or one sub-folder with files per species."""

    def lines(table: str) -> DataFrame:
        if exported:
            return read_lines(spark, root, table)
        return tables.read_folder_lines(spark, root, f"{table}.txt")

    return FolderTables(
        tables.parse_red_local(lines("RedSpeciesLocal")),
        tables.parse_totals(lines("totalTargetObs")).join(
            lines("allObservations").select("folder").distinct(), "folder", "left_semi"
        ),
        tables.parse_observed_ids(lines("allObservations")),
        tables.numbered(tables.parse_locality_species(lines("LocalitySpecies_ALL"))),
    )


@dataclass
class Prepared:
    """Tables that all folders share, written down once."""

    data: FolderTables
    focal: DataFrame  # every folder's localities: the background of the others
    folders: DataFrame
    lm: DataFrame
    mapping: DataFrame | None


def prepare(data: FolderTables, lm: DataFrame, mapping: DataFrame | None) -> Prepared:
    """A folder needs at least one locality of the master and its totals."""
    focal = materialize(enrichment.focal_localities(data.red_local, lm), "focal")
    used = focal.select("folder").distinct()
    folders = materialize(
        enrichment.infer_habitat(data.totals.join(used, "folder", "left_semi"), mapping), "folders"
    )
    focal = focal.join(folders.select("folder"), "folder", "left_semi")
    return Prepared(data, focal, folders, lm, mapping)


def _a1(p: Prepared, units: DataFrame, s: EnrichmentSettings, intervals: bool) -> DataFrame:
    points = materialize(enrichment.a1_point(p.focal, units.select("folder", "main_hab"), s), "a1")
    if intervals:
        points = points.join(bootstrap.a1_intervals(p.focal, points, s), "folder", "left")
    return points.drop("main_hab")


def _a5(p: Prepared, units: DataFrame, s: EnrichmentSettings, intervals: bool) -> DataFrame:
    keyed = units.select("folder", "main_hab")
    mine = p.focal.join(keyed.select("folder"), "folder", "left_semi")
    points = materialize(enrichment.a5_point(mine, p.lm, keyed, s), "a5")
    if intervals:
        points = points.join(bootstrap.a5_intervals(mine, p.lm, points, s), "folder", "left")
    return points.drop("pool", "n_in_pool", "n_rest")


def isolated(metric: Callable[[DataFrame], DataFrame], units: DataFrame, status: str) -> DataFrame:
    """Rows of ``metric`` over ``units``; a folder on which it fails gets ``ERROR: ...`` as ``status``.

    A failing set of folders is cut in halves until the failing ones are alone, so the others are
    computed together.
    """
    try:
        return materialize(metric(units), "metric")
    except Exception as err:
        failed = units.orderBy("folder")
        n = failed.count()
        if n == 0:
            raise
        if n == 1:
            return failed.select("folder", F.lit(f"ERROR: {type(err).__name__}").alias(status))
        low = materialize(failed.limit(n // 2), "half")
        high = materialize(units.join(low.select("folder"), "folder", "left_anti"), "half")
        parts = isolated(metric, low, status), isolated(metric, high, status)
        return parts[0].unionByName(parts[1], allowMissingColumns=True)


_A1_COLUMNS = {"n_focal": "bigint", "n_background": "bigint"} | dict.fromkeys(("mean_loglift", "lifted", "frac"), "double")
_A5_COLUMNS = {"n_pool_localities": "bigint", "n2k_mean_loglift": "double"}


def _complete(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add what is missing where a metric failed on every folder."""
    absent = {c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def rows_of(
    p: Prepared,
    units: DataFrame,
    s: EnrichmentSettings = EnrichmentSettings(),
    intervals: bool = True,
) -> DataFrame:
    """One row per folder of ``units`` with all metrics, intervals, counts and status texts."""
    a1 = _complete(isolated(lambda u: _a1(p, u, s, intervals), units, "A1_debug"), _A1_COLUMNS)
    a5 = _complete(isolated(lambda u: _a5(p, u, s, intervals), units, "A5_debug"), _A5_COLUMNS)
    rows = units.join(a1, "folder", "left").join(a5, "folder", "left")
    keyed = units.select("folder", "main_hab")
    if p.mapping is None:
        rows = rows.withColumn("Habitat_purity", F.lit(None).cast("double"))
    else:
        rows = rows.join(
            enrichment.habitat_purity(p.data.observed, keyed, p.mapping), "folder", "left"
        )
    if p.data.localities is not None:
        listed = p.data.localities.join(keyed.select("folder"), "folder", "left_semi")
        rows = rows.join(subsample_summary(listed), "folder", "left").withColumn(
            "LSA_debug", F.coalesce("LSA_debug", F.lit("MISSING_LOCALITYSPECIES_ALL"))
        )
    return rows


def folder_rows(
    data: FolderTables,
    lm: DataFrame,
    mapping: DataFrame | None,
    s: EnrichmentSettings = EnrichmentSettings(),
    intervals: bool = True,
) -> DataFrame:
    """One row per folder that has a locality of the master and totals."""
    p = prepare(data, lm, mapping)
    return rows_of(p, p.folders, s, intervals)


def logged_rows(
    p: Prepared,
    out: str,
    s: EnrichmentSettings = EnrichmentSettings(),
    wave: int = WAVE_FOLDERS,
) -> DataFrame:
    """Rows of all folders, computed and logged ``wave`` folders at a time.

    Each wave is written to ``<out>/rows`` and ``<out>/progress``, split by folder, before the next one
    starts.  A run that was killed goes on with the folders that the log lacks; a wave that was cut off
    between the two is done again and replaces what it left.
    """
    spark = p.folders.sparkSession
    done = read_progress(spark, f"{out}/progress").select("folder").distinct()
    todo = materialize(ordinal(p.folders.join(done, "folder", "left_anti"), [], ["folder"], "_number"), "todo")
    waves = -(-todo.count() // wave)
    for k in range(waves):
        units = todo.where((F.col("_number") > k * wave) & (F.col("_number") <= (k + 1) * wave)).drop("_number")
        rows = materialize(rows_of(p, units, s), "rows")
        sinks.replace_folders(rows.repartition("folder").write).parquet(f"{out}/rows")
        append_progress(rows, f"{out}/progress")
    # the type of a folder is not guessed from its name
    schema = spark.read.parquet(f"{out}/rows").drop("folder").schema.add("folder", "string")
    read = spark.read.schema(schema).parquet(f"{out}/rows")
    return read.join(p.folders.select("folder"), "folder", "left_semi")


def run(
    spark: SparkSession,
    out: str,
    folder_root: str,
    master_path: str,
    habitat_path: str,
    wave: int = WAVE_FOLDERS,
) -> DataFrame:
    """Files to files; returns the index table.  A run that was killed goes on where it stopped."""
    lm = materialize(tables.read_locality_master(spark, master_path), "lm")
    raw = lookups.read_habitat_assignments(spark, habitat_path)
    mapping = None if raw is None else materialize(enrichment.habitat_map(raw), "habitats")
    prepared = prepare(read_folder_tables(spark, folder_root), lm, mapping)
    rows = logged_rows(prepared, out, wave=wave)
    result = materialize(composite(rows), "composite")
    sinks.write_tsv(result, f"{out}/composite")
    sinks.write_tsv(habitat_summary(result), f"{out}/by_habitat")
    sinks.write_tsv(
        sinks.settings_table(spark, {"folders": folder_root, "locality_master": master_path}),
        f"{out}/settings",
    )
    return result
