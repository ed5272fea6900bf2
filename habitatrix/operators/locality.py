"""Stage 1: localities, daily checklists, effort weights and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatrix import config as C
from habitatrix.functions import stats, text
from habitatrix.operators.ordering import ordinal
from habitatrix.session import lookup, materialize

_CELL = ["k_lat", "k_lon"]

#: Bits of the number of a habitat label; the last number is for taxa without one.
_LABEL_BITS = 24
_NO_LABEL = (1 << _LABEL_BITS) - 1


def observations(occ: DataFrame, decimals: int = C.GRID_DECIMALS) -> DataFrame:
    """Narrow one row per record: rounded cell, day text, taxon number.

    ``k_lat``/``k_lon`` identify the locality and are both NULL when either
    coordinate is missing, so the key text is only built after aggregation.
    """
    lat = text.grid_round(F.col("decimalLatitude"), decimals)
    lon = text.grid_round(F.col("decimalLongitude"), decimals)
    if "taxonID_num" in occ.columns:
        taxon = F.col("taxonID_num").try_cast("bigint")
    else:
        taxon = text.taxon_number(F.col("taxonID"))
    return occ.select(
        F.when(lon.isNotNull(), lat).alias("k_lat"),
        F.when(lat.isNotNull(), lon).alias("k_lon"),
        lat.alias("lat_r"),
        lon.alias("lon_r"),
        text.day_text(F.col("eventDate")).alias("date_s"),
        taxon.alias("taxon_id"),
    )


def observation_counts(obs: DataFrame) -> DataFrame:
    """Records per (cell, day, taxon) as ``n``, written once; ``day`` is a number (``_day_number``).

    Everything that stage 1 needs follows from this table, so the records are read
    once.  A table that has ``n`` already is returned as it is.
    """
    if "n" in obs.columns:
        return obs
    # days as numbers, and coordinates beside the cell only where it lacks one: the rows that are shuffled are short
    half = [F.when(F.col(k).isNull(), F.col(c)).alias(c) for k, c in zip(_CELL, ("lat_r", "lon_r"))]
    short = obs.select(*_CELL, *half, _day_number("date_s").alias("day"), "taxon_id")
    counted = short.groupBy(*_CELL, "lat_r", "lon_r", "day", "taxon_id").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.select(
        *_CELL,
        *[F.coalesce(k, c).alias(c) for k, c in zip(_CELL, ("lat_r", "lon_r"))],
        "day",
        "taxon_id",
        "n",
    )
    # rows of a locality side by side take a fraction of the space, here and in the shuffles that follow
    whole = whole.sortWithinPartitions(*_CELL)
    return materialize(whole, "observation-counts")


def _records(obs: DataFrame) -> Column:
    return F.sum("n") if "n" in obs.columns else F.count(F.lit(1))


def with_locality_id(df: DataFrame) -> DataFrame:
    return df.withColumn("LocalityID", text.cell_key(F.col("k_lat"), F.col("k_lon")))


def locality_events(obs: DataFrame) -> DataFrame:
    """One row per locality and day with record and taxon counts.

    Two plain aggregations (locality, day, taxon) -> (locality, day): a NULL taxon
    counts as one value, and a hot locality is combined before every shuffle.
    """
    if "n" in obs.columns:
        obs = obs.withColumn("date_s", _day_text("day"))
    per_taxon = (
        obs.where(F.col("date_s").isNotNull())
        .groupBy(*_CELL, "date_s", "taxon_id")
        .agg(_records(obs).alias("n"))
    )
    daily = per_taxon.groupBy(*_CELL, "date_s").agg(
        F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_species")
    )
    return with_locality_id(daily).select(
        "LocalityID",
        "date_s",
        F.concat("LocalityID", F.lit("_"), "date_s").alias("checklist_id"),
        "n_records",
        "n_species",
    )


# -- lookups ------------------------------------------------------------------


def ias_taxa(bank: DataFrame) -> DataFrame:
    return bank.where(F.col("taxon_id").isNotNull()).select("taxon_id").distinct()


def n2k_weights(bank: DataFrame) -> DataFrame:
    """Best weight per taxon: a bank row exists per taxon and habitat."""
    return (
        bank.where(F.col("taxon_id").isNotNull())
        .groupBy("taxon_id")
        .agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("n2k_weight"))
    )


def habitat_labels(assignments: DataFrame) -> DataFrame:
    """(taxon, habitat) with the number of identical assignment rows."""
    return (
        assignments.where(F.col("taxon_id").isNotNull())
        .groupBy("taxon_id", "habitat")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _taxa(obs: DataFrame) -> DataFrame:
    """Distinct (locality, taxon), dealt by locality; what is grouped by locality next stays where it is."""
    return obs.select(*_CELL, "taxon_id").repartition(*_CELL).distinct()


def _day_number(date_s: str) -> Column:
    """The digits of ``YYYY-MM-DD`` (as ``day_text`` gives it) as one number in the same order."""
    return F.replace(date_s, F.lit("-"), F.lit("")).cast("int")


def _day_text(day: str) -> Column:
    """``YYYY-MM-DD`` from the number that its digits are."""
    digits = F.lpad(F.col(day).cast("string"), 8, "0")
    return F.concat(digits.substr(1, 4), F.lit("-"), digits.substr(5, 2), F.lit("-"), digits.substr(7, 2))


def flagged_taxa(obs: DataFrame, ias: DataFrame, n2k: DataFrame) -> DataFrame:
    """Distinct (locality, taxon) with IAS flag and N2K weight."""
    flags = (
        ias_taxa(ias)
        .withColumn("is_IAS", F.lit(True))
        .join(n2k_weights(n2k), "taxon_id", "full_outer")
    )
    return _taxa(obs).join(lookup(flags), "taxon_id", "left").select(
        *_CELL, "taxon_id", F.coalesce("is_IAS", F.lit(False)).alias("is_IAS"), "n2k_weight"
    )


# -- localities ---------------------------------------------------------------


def locality_core(
    obs: DataFrame, ias: DataFrame | None = None, n2k: DataFrame | None = None
) -> DataFrame:
    """Per locality: counts, first and last day, IAS and N2K summaries.

    Visits (locality, day) and taxa (locality, taxon) are each dealt by locality once; their
    aggregations and the union of both need no further shuffle.
    """
    obs = observation_counts(obs)
    # days as numbers, so that the first and the last need no sort
    visits = obs.select(*_CELL, "day", "n").repartition(*_CELL)
    if ias is None or n2k is None:
        taxa = _taxa(obs).select(
            *_CELL,
            F.lit(False).alias("is_IAS"),
            F.lit(None).cast("double").alias("n2k_weight"),
        )
    else:
        taxa = flagged_taxa(obs, ias, n2k).drop("taxon_id")
    zero = F.lit(0).cast("bigint")
    per_day = visits.groupBy(*_CELL, "day").agg(F.sum("n").alias("n_records"))
    stacked = per_day.withColumn("n_species", zero).unionByName(
        taxa.withColumns({"n_records": zero, "n_species": F.lit(1).cast("bigint")}),
        allowMissingColumns=True,
    )
    merged = stacked.groupBy(*_CELL).agg(
        F.min("day").alias("first_event"),
        F.max("day").alias("last_event"),
        F.sum("n_records").alias("n_records"),
        F.count("day").alias("n_events"),
        F.sum("n_species").alias("n_species"),
        F.count_if("is_IAS").alias("n_species_IAS"),
        F.count("n2k_weight").alias("n_species_N2K"),
        F.coalesce(F.sum("n2k_weight"), F.lit(0.0)).alias("n2000_score"),
    )
    named = with_locality_id(merged).withColumns({c: _day_text(c) for c in ("first_event", "last_event")})
    # rows without a locality form one group of their own, but that group never
    # matches in a join, hence its bank columns are empty
    known = F.col("LocalityID").isNotNull()
    blank = {
        c: F.when(known, F.col(c)).otherwise(F.lit(0).cast(named.schema[c].dataType))
        for c in ("n_species_IAS", "n_species_N2K", "n2000_score")
    }
    # rounding makes both coordinates constant inside a named locality; only the
    # group without a name needs a true median (few distinct rounded values)
    middle = [F.percentile(c, 0.5, F.col("n")).alias(c) for c in ("lat_r", "lon_r")]
    mid = obs.where(F.col("k_lat").isNull()).agg(*middle).select(F.struct("lat_r", "lon_r")).scalar()
    return named.withColumns(blank).withColumns(
        {
            "lat_r": F.when(known, F.col("k_lat")).otherwise(mid["lat_r"]),
            "lon_r": F.when(known, F.col("k_lon")).otherwise(mid["lon_r"]),
            "effort_index": stats.effort_index(F.col("n_events"), F.col("n_species")),
        }
    )


def dominant_habitat(obs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Most frequent habitat label among the taxa of each locality.

    Taxa without a label form a NULL group that counts in the denominator and may
    win (shown as ``Unknown``).  Ties: label ascending, NULL last.
    """
    labels = habitat_labels(assignments)
    # one row per habitat of the lookup; a label is its number in ascending order, so that the best is the
    # minimum of one number and no sort is needed
    named = labels.where(F.col("habitat").isNotNull()).select("habitat").distinct()
    names = materialize(named.withColumn("rank", F.row_number().over(Window.orderBy("habitat")).cast("bigint")), "habitats")
    numbered = labels.join(lookup(names), "habitat", "left").select("taxon_id", "rank", "times")
    rank = F.coalesce("rank", F.lit(_NO_LABEL)).alias("rank")
    tallied = (
        _taxa(obs)
        .join(lookup(numbered), "taxon_id", "left")
        .groupBy(*_CELL, rank)
        .agg(F.sum(F.coalesce("times", F.lit(1))).alias("n"))
    )
    best = F.min(F.shiftleft(-F.col("n"), _LABEL_BITS) + F.col("rank"))
    any_label = labels.select(F.count(F.lit(1)) > 0).scalar()
    cells = tallied.groupBy(*_CELL).agg(best.alias("best"), F.sum("n").alias("total"))
    cells = cells.withColumn("rank", F.col("best").bitwiseAND(F.lit(_NO_LABEL)))
    return cells.join(lookup(names), "rank", "left").select(
        *_CELL,
        F.coalesce("habitat", F.lit("Unknown")).alias("dominant_habitat"),
        F.when(any_label, -F.shiftright("best", _LABEL_BITS) / F.col("total").cast("double"))
        .otherwise(F.lit(0.0))
        .alias("dominant_habitat_purity"),
    )


def effort_ranks(core: DataFrame) -> DataFrame:
    """Global rank of every locality by effort, ties by LocalityID, NULL last."""
    # written down, as finding the splitters of the ranges reads it once more
    return ordinal(materialize(core, "localities"), [], ["effort_index", "LocalityID"], "effort_rank")


def with_effort(core: DataFrame) -> DataFrame:
    """Add ``w_inv`` and ``effort_stratum``; both follow from one global rank."""
    ranked = effort_ranks(core)
    total = ranked.select(F.count(F.lit(1))).scalar()
    low = F.floor((total + 1) / 2)
    high = F.floor(total / 2) + 1
    median = (
        ranked.where(F.col("effort_rank").isin(low, high))
        .select(F.avg("effort_index"))
        .scalar()
    )
    return ranked.withColumns(
        {
            "w_inv": stats.inverse_effort_weight(F.col("effort_index"), median),
            "effort_stratum": stats.rank_stratum(F.col("effort_rank"), total),
        }
    )


def strata_histogram(master: DataFrame) -> DataFrame:
    return master.groupBy("effort_stratum").agg(F.count(F.lit(1)).alias("n_localities"))


def locality_master(
    obs: DataFrame, ias: DataFrame, n2k: DataFrame, assignments: DataFrame | None
) -> DataFrame:
    """The 23-column locality table."""
    obs = observation_counts(obs)
    core = with_effort(locality_core(obs, ias, n2k))
    if assignments is None:
        placed = core.withColumns(
            {"dominant_habitat": F.lit("Unknown"), "dominant_habitat_purity": F.lit(0.0)}
        )
    else:
        placed = core.join(dominant_habitat(obs, assignments), _CELL, "left")
    non_ias = F.greatest(F.col("n_species") - F.col("n_species_IAS"), F.lit(0))
    return placed.withColumns(
        {
            "SWEREF_N": F.lit(None).cast("string"),
            "SWEREF_E": F.lit(None).cast("string"),
            "county_id": F.lit(None).cast("string"),
            "n_species_nonIAS": non_ias,
            "IAS_share_species": stats.ratio(F.col("n_species_IAS"), F.col("n_species")),
            "Margalef_local": stats.margalef(F.col("n_species"), F.col("n_records")),
            "Margalef_exIAS": stats.margalef(non_ias, F.col("n_records")),
            "dominant_habitat": F.coalesce("dominant_habitat", F.lit("Unknown")),
            "dominant_habitat_purity": F.coalesce("dominant_habitat_purity", F.lit(0.0)),
        }
    ).select(*C.LOCALITY_MASTER_COLUMNS)
