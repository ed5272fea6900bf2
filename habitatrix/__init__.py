"""Species-occurrence indicator analytics on Spark DataFrames.

The package is organised by what a user does with it:

* ``sources``    read occurrence parquet, lookup CSVs, text tables, GeoPackages
* ``functions``  column expressions (keys, dates, projection, statistics)
* ``operators``  DataFrame -> DataFrame steps
* ``plans``      the four stages, wired from sources to sinks
* ``streaming``  the append-only progress log
"""
