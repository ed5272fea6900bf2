"""Stage 2: sampled focal sites, their associates and the per-folder tables.

All species and all repeated runs are one job: they only differ in key columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitatrix import config as C
from habitatrix import sinks
from habitatrix.functions import text
from habitatrix.operators import associates as A
from habitatrix.operators.region import in_region
from habitatrix.session import lookup, materialize
from habitatrix.sources.occurrences import file_position


@dataclass
class Associates:
    """Frames of one stage-2 run; the first three are written to scratch once."""

    sites: DataFrame
    contacts: DataFrame
    hits: DataFrame
    totals: DataFrame

    @property
    def kept(self) -> DataFrame:
        return A.kept_taxa(self.hits)

    @property
    def found(self) -> DataFrame:
        return A.finds(self.kept, self.sites, self.totals)

    @property
    def names(self) -> DataFrame:
        """Base name of the export folder of each (run, focal)."""
        pairs = self.sites.select("run", "focal").distinct()
        return pairs.select(text.safe_name(F.col("focal")).alias("base"), "run", "focal")

    def foldered(self, df: DataFrame, names: DataFrame | None = None) -> DataFrame:
        """Replace (run, focal) by the export folder.

        ``names`` gives the folders that were claimed for an export.  Without it the
        first user of a name gets it plain, later runs (and other species with the
        same safe name) get a numbered suffix.
        """
        if names is None:
            order = Window.partitionBy("base").orderBy("run", "focal")
            used = self.names.withColumn("_use", F.row_number().over(order))
            names = used.withColumn("folder", sinks.folder_name(F.col("base"), F.col("_use")))
        named = names.select("run", "focal", "folder")
        return df.join(lookup(named), ["run", "focal"], "inner").drop("run")


def build(
    focal: DataFrame,
    associates: DataFrame,
    red_ids: DataFrame,
    *,
    runs: int = 1,
    seed: int = C.SEED,
    sample: int = C.SAMPLE_SITES,
    radius: float = C.BUFFER_M,
    shape: str = "polygon64",
) -> Associates:
    """From projected points to contacts and hit counts."""
    totals = materialize(A.focal_totals(focal), "focal-totals")
    sites = materialize(A.sample_sites(focal, seed, runs, sample, totals), "sites")
    contacts = materialize(
        A.site_contacts(associates, sites, red_ids, radius, shape), "contacts"
    )
    hits = materialize(A.taxon_hits(contacts, sites), "hits")
    return Associates(sites, contacts, hits, totals)


def build_from_occurrences(
    occ: DataFrame,
    selectors: DataFrame,
    red_ids: DataFrame,
    edges: DataFrame | None = None,
    **options,
) -> Associates:
    """Full stage: focal sites inside the region, associates near them anywhere.

    The second pass starts from the degree box of the sampled sites, which the
    parquet reader can use to skip row groups, and keeps what is in a cell with a site.
    """
    sample_keys = ("seed", "runs", "sample")
    focal = A.to_points(A.focal_points(A.mark_focal(A.occurrence_rows(occ), selectors)))
    if edges is not None:
        focal = in_region(focal, edges)
    # the draw and the totals both read them; neither asks for names and taxa, which the input's joins then don't carry
    focal = materialize(focal.drop("vern", "taxon"), "focal-points")
    totals = materialize(A.focal_totals(focal), "focal-totals")
    sampling = {k: options[k] for k in sample_keys if k in options}
    sites = materialize(
        A.sample_sites(
            focal,
            sampling.get("seed", C.SEED),
            sampling.get("runs", 1),
            sampling.get("sample", C.SAMPLE_SITES),
            totals,
        ),
        "sites",
    )
    nearby = A.near_buffers(occ, A.buffer_bounds(sites, options.get("radius", C.BUFFER_M)))
    marked = A.mark_focal(A.occurrence_rows(nearby), selectors)
    radius = options.get("radius", C.BUFFER_M)
    # written down, as the projection and the grouping that follow are too much for one generated method
    near = A.near_sites(A.associate_points(marked), sites, radius).drop("focal", "vern", "row_key")
    near = materialize(near, "near-records")
    contacts = materialize(
        A.site_contacts(
            A.to_points(near),
            sites,
            red_ids,
            radius,
            options.get("shape", "polygon64"),
        ),
        "contacts",
    )
    hits = materialize(A.taxon_hits(contacts, sites), "hits")
    return Associates(sites, contacts, hits, totals)


TABLES = (
    "uniqueFinds",
    "redFinds",
    "totalTargetObs",
    "allObservations",
    "RedSpeciesLocal",
    "LocalitySpecies_ALL",
    "LocalitySpecies_RED",
)

#: Tables whose folders are one long line.
ONE_LINE = ("allObservations",)


def write(result: Associates, out: str) -> DataFrame:
    """The seven text tables, each split by folder; returns (run, focal, folder).

    Folder names are claimed, so what other runs wrote to ``out`` stays, also those at the same time.
    """
    names = materialize(sinks.claim_folders(result.names, out).select("run", "focal", "folder"), "folder-names")

    def foldered(df: DataFrame) -> DataFrame:
        return result.foldered(df, names)

    found = materialize(foldered(result.found), "found")

    def named(column: str):
        return F.concat_ws(" ", "focal", F.array_join(column, " "))

    sinks.write_lines(found, f"{out}/uniqueFinds", named("ids"))
    sinks.write_lines(found, f"{out}/redFinds", named("red_ids"))
    sinks.write_lines(
        found, f"{out}/totalTargetObs", F.concat_ws(" ", "focal", "focal_obs", "n_assoc", "n_red")
    )
    every = foldered(A.all_observations(result.contacts, result.sites, result.kept))
    sinks.write_lines(
        every,
        f"{out}/allObservations",
        F.col("taxon"),
        folders=found.select("folder", F.col("focal").alias("header")),
        sep=" ",
    )
    red = foldered(A.red_species_local(result.contacts, result.sites))
    sinks.write_lines(
        red,
        f"{out}/RedSpeciesLocal",
        F.concat_ws(" ", "LocalityID", "n_red"),
        order=(F.col("LocalityID"),),
    )
    listed = F.concat_ws(" ", "LocalityID", "SWEREF_N", "SWEREF_E", F.array_join("ids", " "))
    at_sites = foldered(A.locality_species_all(result.contacts, result.sites))
    sinks.write_lines(
        at_sites,
        f"{out}/LocalitySpecies_ALL",
        F.rtrim(listed),
        order=(F.col("fid"),),
        header=" ".join(C.SPECIES_LIST_HEADER),
        folders=found.select("folder"),
    )
    tabbed = F.concat_ws("\t", "LocalityID", "SWEREF_N", "SWEREF_E", F.array_join("ids", " "))
    per_locality = foldered(A.locality_species_red(result.contacts, result.sites))
    sinks.write_lines(
        per_locality,
        f"{out}/LocalitySpecies_RED",
        tabbed,
        order=(F.col("LocalityID"),),
        header="\t".join(C.SPECIES_LIST_HEADER),
        folders=found.select("folder"),
    )
    return names


def export(spark: SparkSession, out: str, dest: str) -> DataFrame:
    """Tables that ``write`` made, as ``<dest>/<folder>/<table>.txt``; returns (folder, table, bytes)."""
    return materialize(sinks.join_parts(spark, out, TABLES, dest), "exported")


def read_lines(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Lines of one written table, or words of a table that is one line: ``folder, pos, line``."""
    sep = " " if table in ONE_LINE else "\n"
    # a folder may look like a number, so its type is not guessed
    lines = spark.read.schema("value string, folder string").option("lineSep", sep).text(f"{out}/{table}")
    return lines.select("folder", file_position().alias("pos"), F.col("value").alias("line"))
