"""Occurrence-like views over the driver tables.

Every lineitem row is read as one observation: the part gives taxon and name, the
order's customer the locality, the ship date the day.  ``E``/``N`` spread the
records over a ten-kilometre square.  All views cover the whole tables, and localities
grow with the customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix.operators import associates as A
from habitatrix.operators import locality as L
from habitatrix.session import materialize

N_FOCAL_BRANDS = 8


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._totals: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- observations ---------------------------------------------------------

    def occ(self) -> DataFrame:
        part, orders = self.table("part"), self.table("orders")
        li = self.table("lineitem")
        day = F.col("l_shipdate").cast("date").cast("string")
        line = F.col("l_linenumber")
        place = F.col("o_custkey")
        taxon = F.lit(1000) + F.col("p_size") * 2 + F.col("p_partkey") % 2
        return (
            li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws(
                    "|",
                    *[
                        F.col(c).cast("bigint").cast("string")
                        for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
                    ],
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
                    day,
                ).alias("occurrenceID"),
                F.when(
                    F.col("p_size") != 50,
                    F.concat(F.lit("urn:lsid:dyntaxa.se:Taxon:"), taxon.cast("string")),
                ).alias("taxonID"),
                F.col("p_brand").alias("scientificName"),
                F.col("p_name").alias("vernacularName"),
                F.when(
                    ~((line == 7) & (F.col("l_suppkey") % 10 == 0)),
                    F.lit(55.5) + ((place * 7919) % 12007).cast("double") / 1000,
                ).alias("decimalLatitude"),
                (F.lit(11.0) + ((place * 104729) % 13007).cast("double") / 1000).alias(
                    "decimalLongitude"
                ),
                F.when(line == 1, F.substring(day, 1, 4))
                .when(line == 2, F.substring(day, 1, 7))
                .when(line != 3, F.concat(day, F.lit("T00:00:00")))
                .alias("eventDate"),
                (
                    F.lit(500000) + (F.col("l_orderkey") * 7919 + line * 104729) % 9973
                ).cast("double").alias("E"),
                (
                    F.lit(6580000) + (F.col("l_partkey") * 6101 + F.col("l_orderkey") * 31) % 9967
                ).cast("double").alias("N"),
                F.col("l_returnflag").alias("part"),
            )
        )

    def occ_degrees(self) -> DataFrame:
        """Records whose places are known in degrees only, some named, some far away or outside the country."""
        part, orders, li = self.table("part"), self.table("orders"), self.table("lineitem")
        place, line, supp = F.col("o_custkey"), F.col("l_linenumber"), F.col("l_suppkey")
        taxon = F.lit(1000) + F.col("p_size") * 2 + F.col("p_partkey") % 2
        lat = F.lit(59.0) + ((place * 7919) % 401).cast("double") * 0.0003
        lon = F.lit(17.0) + ((place * 104729) % 409).cast("double") * 0.0007
        return (
            li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("occurrenceID"),
                F.when(F.col("p_size") != 50, F.concat(F.lit("urn:lsid:dyntaxa.se:Taxon:"), taxon.cast("string"))).alias("taxonID"),
                F.col("p_brand").alias("scientificName"),
                F.col("p_name").alias("vernacularName"),
                F.when(place % 3 == 0, F.concat(F.lit("Lake "), (place % 50).cast("string"))).alias("locality"),
                F.when((line == 6) & (supp % 10 == 1), 50.0).when(line == 5, lat + 3).otherwise(lat).alias("decimalLatitude"),
                F.when(line == 4, lon + (supp % 200).cast("double") * 0.0007).otherwise(lon).alias("decimalLongitude"),
            )
        )

    def degree_selectors(self) -> DataFrame:
        """Two species by name, and four taxa by id whatever their name."""
        ids = self.taxa().where("taxon_id % 29 = 0").select(F.col("taxon_id").cast("string"), F.lit(None).cast("string").alias("name"))
        names = self.selectors().where("name IN ('Brand#11', 'Brand#22', 'Brand#1', 'Brand#2')")
        return ids.unionByName(names)

    def region(self) -> DataFrame:
        """Edges in metres of one box per nation."""
        k = F.col("n_nationkey")
        x0, y0 = (F.lit(614000) + k % 5 * 1000).cast("double"), (F.lit(6541000) + F.floor(k / 5) * 1500).cast("double")
        corners = [(x0, y0), (x0 + 800, y0), (x0 + 800, y0 + 1200), (x0, y0 + 1200)]
        edges = [
            F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
            for a, b in zip(corners, [*corners[1:], corners[0]])
        ]
        box = self.table("nation").select(k.cast("string").alias("poly_id"), F.lit("all").alias("label"), F.explode(F.array(*edges)).alias("e"))
        return box.select("poly_id", "label", "e.*")

    def obs(self) -> DataFrame:
        return L.observations(self.occ())

    def points(self) -> DataFrame:
        """Projected points; the locality key is the stage-1 cell."""
        occ = self.occ()
        obs_key = F.concat(
            F.lit("cell_"),
            F.round(F.col("decimalLatitude"), 3).cast("string"),
            F.lit("_"),
            F.round(F.col("decimalLongitude"), 3).cast("string"),
        )
        return occ.select(
            F.col("scientificName").alias("focal"),
            F.col("vernacularName").alias("vern"),
            F.regexp_extract("taxonID", "([0-9]+)$", 1).alias("taxon"),
            obs_key.alias("LocalityKey"),
            F.col("occurrenceID").alias("row_key"),
            "E",
            "N",
            "part",
        )

    # -- lookups --------------------------------------------------------------

    def taxa(self) -> DataFrame:
        taxon = F.lit(1000) + F.col("p_size") * 2 + F.col("p_partkey") % 2
        return (
            self.table("part")
            .where("p_size <> 50")
            .select(taxon.cast("bigint").alias("taxon_id"))
            .distinct()
        )

    def ias(self) -> DataFrame:
        return self.taxa().where("taxon_id % 11 = 0").withColumn("weight", F.lit(1.0))

    def n2k(self) -> DataFrame:
        weights = F.array(F.lit(0.25), F.lit(0.25) + (F.col("taxon_id") % 10) / F.lit(20.0))
        return self.taxa().where("taxon_id % 5 = 0").withColumn("weight", F.explode(weights))

    def labels(self) -> DataFrame:
        return self.taxa().where("taxon_id % 13 <> 0").withColumn(
            "habitat", F.concat(F.lit("hab"), (F.col("taxon_id") % 6).cast("string"))
        )

    def red_ids(self) -> DataFrame:
        return self.taxa().where("taxon_id % 7 = 0").select(F.col("taxon_id").cast("string"))

    def assignments(self) -> DataFrame:
        """Raw habitat rows in part order, then one row per brand."""
        part = self.table("part")
        taxon = (F.lit(1000) + F.col("p_size") * 2 + F.col("p_partkey") % 2).cast("bigint")
        brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint")
        rows = part.where("p_size <> 50").select(
            F.col("p_partkey").alias("_row"),
            taxon.cast("string").alias("taxonID"),
            F.concat("p_name", F.lit(" "), taxon.cast("string")).alias("scientificName"),
            F.when(
                taxon % 13 != 0, F.concat(F.lit("hab"), (taxon % 6).cast("string"))
            ).alias("habitat"),
        )
        brands = (
            part.select(brand.alias("b"), "p_brand")
            .distinct()
            .select(
                (F.lit(10**12) + F.col("b")).alias("_row"),
                F.col("b").cast("string").alias("taxonID"),
                F.col("p_brand").alias("scientificName"),
                F.concat(F.lit("hab"), (F.col("b") % 6).cast("string")).alias("habitat"),
            )
        )
        return rows.unionByName(brands)

    def selectors(self) -> DataFrame:
        """Focal species: the first brands, as they occur in ``part``."""
        number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint")
        return (
            self.table("part")
            .where(number <= N_FOCAL_BRANDS)
            .select(F.lit(None).cast("string").alias("taxon_id"), F.col("p_brand").alias("name"))
            .distinct()
        )

    # -- stage-2 frames -------------------------------------------------------

    def marked(self) -> DataFrame:
        taxon = F.nullif(F.col("taxon"), F.lit(""))
        return A.mark_focal(self.points().withColumn("taxon", taxon), self.selectors())

    def focal(self) -> DataFrame:
        return A.focal_points(self.marked())

    def others(self) -> DataFrame:
        return A.associate_points(self.marked())

    def totals(self) -> DataFrame:
        """Records per focal species, counted once for the draws and the finds."""
        if self._totals is None:
            self._totals = materialize(A.focal_totals(self.focal()), "focal-totals")
        return self._totals

    def sites(self, runs: int = 1) -> DataFrame:
        return A.sample_sites(self.focal(), runs=runs, totals=self.totals())
