"""Parameters of the four stages, with their default values.

The numbers, labels and column lists below are fixed values: results only agree
with published runs of the method when they are used unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

# -- stage 1: localities ------------------------------------------------------
GRID_DECIMALS = 3
REQUIRED_OCCURRENCE_COLUMNS = ("decimalLatitude", "decimalLongitude", "eventDate")
WEIGHT_FLOOR = 0.2
WEIGHT_CEILING = 5.0
N_STRATA = 10

LOCALITY_MASTER_COLUMNS = (
    "LocalityID",
    "SWEREF_N",
    "SWEREF_E",
    "lat_r",
    "lon_r",
    "county_id",
    "first_event",
    "last_event",
    "n_records",
    "n_events",
    "n_species",
    "n_species_IAS",
    "n_species_nonIAS",
    "IAS_share_species",
    "n_species_N2K",
    "n2000_score",
    "effort_index",
    "w_inv",
    "effort_stratum",
    "Margalef_local",
    "Margalef_exIAS",
    "dominant_habitat",
    "dominant_habitat_purity",
)

# -- stage 2: associates ------------------------------------------------------
LON_MIN, LAT_MIN, LON_MAX, LAT_MAX = 10.0, 55.0, 25.0, 69.5
BUFFER_M = 50.0
SAMPLE_SITES = 350
MIN_HITS = 15
BBOX_MARGIN_DEG = 0.05

FOCAL_ID_HEADERS = ("taxonID", "TaxonID", "taxonId", "id")
FOCAL_NAME_HEADERS = ("name", "scientificName", "scientific_name")
RED_LIST_ID_HEADER = "Taxon id"

# Fixed value: header of both species lists.
SPECIES_LIST_HEADER = ("LocalityID", "SWEREF_N", "SWEREF_E", "Species_IDs")

# -- stage 3: enrichment and composite ----------------------------------------
THRESHOLDS = (0, 1, 2, 3, 4)
MAX_THRESHOLD = 15
TAU_RED = 0.30
TAU_N2K = 0.25
PRIOR_A, PRIOR_B = 0.5, 0.5
MIN_LOCALITIES = 30
BOOTSTRAPS = 50
BACKGROUND_CAP = 1000
SEED = 42

W_EXCEED, W_N2K, W_HABITAT = 0.4, 0.4, 0.2
MAD_SCALE = 0.6745
MIN_GROUP_FOR_Z = 5
N_CLASSES = 4

SUBSAMPLE_REPEATS = 10
SUBSAMPLE_FRACTION = 0.10
SUBSAMPLE_MIN = 30
SUBSAMPLE_MAX = 80
SUBSAMPLE_SEED = SEED + 123

# Fixed value: columns of the progress table and, where ours has another name, that name.
PROGRESS_COLUMNS = (
    ("timestamp", None),
    ("folder", None),
    ("focal_id", None),
    ("main_habitat", "main_hab"),
    ("No_obs", None),
    ("No_asc_spp", None),
    ("No_redlisted", None),
    ("Habitat_purity", None),
    ("LSA_debug", None),
    ("LSA_m_localities", None),
    ("LSA_j_subsample", None),
    ("LSA_repeats", None),
    ("gamma_unique_species_mean", None),
    ("gamma_unique_species_sd", None),
    ("gamma_cv", None),
    ("gamma_norm_range", None),
    ("gamma_unique_species_min", None),
    ("gamma_unique_species_max", None),
    ("gamma_unique_species_range", None),
    ("alpha_mean_spp_per_locality_mean", None),
    ("alpha_mean_spp_per_locality_sd", None),
    ("alpha_cv", None),
    ("alpha_norm_range", None),
    ("alpha_mean_spp_per_locality_min", None),
    ("alpha_mean_spp_per_locality_max", None),
    ("alpha_mean_spp_per_locality_range", None),
    ("mean_loglift_0to4", "mean_loglift"),
    ("mean_loglift_0to4_CI_low", "mean_loglift_CI_low"),
    ("mean_loglift_0to4_CI_high", "mean_loglift_CI_high"),
    ("lifted_PM_tau0.30", "lifted"),
    ("lifted_PM_tau0.30_CI_low", "lifted_CI_low"),
    ("lifted_PM_tau0.30_CI_high", "lifted_CI_high"),
    ("frac_enriched_tau0.30", "frac"),
    ("frac_enriched_tau0.30_CI_low", "frac_CI_low"),
    ("frac_enriched_tau0.30_CI_high", "frac_CI_high"),
    ("N2000_mean_loglift_0to4", "n2k_mean_loglift"),
    ("N2000_CI_low", "n2k_CI_low"),
    ("N2000_CI_high", "n2k_CI_high"),
    ("N_focal_localities", "n_focal"),
    ("N_background_localities", "n_background"),
    ("N_LM_hab_localities", "n_pool_localities"),
    ("A1_debug", None),
    ("A5_debug", None),
)

TOO_FEW = "TOO_FEW_FOCAL_LOCALITIES"
NO_BACKGROUND = "NO_BACKGROUND_LOCALITIES_SAME_HABITAT"
NO_LM_ROWS = "NO_LM_ROWS_WITH_N2000_SCORE"
NO_FOCAL_IN_LM = "NO_FOCAL_LOCALITIES_IN_LM"
NO_BACKGROUND_IN_LM = "NO_BACKGROUND_LOCALITIES_IN_LM"

# -- stage 4: stability -------------------------------------------------------
OBS_COLUMN_CANDIDATES = (
    "No_obs",
    "No_Obs",
    "no_obs",
    "n_obs",
    "No_observations",
    "no_observations",
    "observations",
    "No_localities",
    "no_localities",
    "n_localities",
    "n_sites",
    "No_sites",
)
STRONG_VALUE = 1.0
HIGH_CLASS = 3
EPS = 1e-12
N_RUNS = 10


@dataclass(frozen=True)
class EnrichmentSettings:
    """What the enrichment metrics and their intervals depend on."""

    thresholds: tuple[int, ...] = THRESHOLDS
    prior_a: float = PRIOR_A
    prior_b: float = PRIOR_B
    min_localities: int = MIN_LOCALITIES
    bootstraps: int = BOOTSTRAPS
    background_cap: int | None = BACKGROUND_CAP  # None: no cap
    seed: int = SEED
