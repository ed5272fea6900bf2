"""GeoPackage polygons as a Spark data source (format ``gpkg_rings``).

One row per polygon edge.  Filters on labels and boxes are pushed into the file.  The feature table is split by row-id range, so each
task decodes its own share of the geometries; the file has to lie in a folder
that every executor can open.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitatrix.functions import geo
from habitatrix.session import materialize

_SCHEMA = (
    "feature_id bigint, label string, part int, ring int, srs_id int, "
    "x1 double, y1 double, x2 double, y2 double, definition string, "
    "min_x double, min_y double, max_x double, max_y double"
)

# The target system, degrees on its ellipsoid, and ellipsoids that are the same within a millimetre.
_TARGET, _DEGREES = 3006, 4326
_AXIS, _INVERSE_F = 6378137.0, (298.257222101, 298.257223563)


def _source_class():
    # defined here so that it is shipped by value: executors need no install
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class RowRange(InputPartition):
        def __init__(self, first, last):
            self.first, self.last = first, last

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"]
            self.layer = options.get("layer")
            self.field = options.get("field", "region_ID")
            self.size = int(options.get("features_per_task", "256"))
            self.label, self.box = None, []

        def pushFilters(self, filters):
            """Labels and boxes narrow the features that are decoded; Spark still checks every row."""
            compared = {"GreaterThanOrEqual": ">=", "GreaterThan": ">=", "LessThanOrEqual": "<=", "LessThan": "<="}
            for f in filters:
                kind, name = type(f).__name__, getattr(f, "attribute", (None,))[0]
                if kind == "EqualTo" and name == "label":
                    self.label = f.value
                elif kind in compared and name in ("min_x", "min_y", "max_x", "max_y"):
                    self.box.append((name.replace("_", ""), compared[kind], float(f.value)))
                yield f

        def _condition(self, con, table, column):
            """SQL text and values; the index of boxes rounds outwards, so no feature is missed."""
            text, values = "", []
            if self.label is not None:
                text += f""" AND (typeof("{self.field}") <> 'text' OR "{self.field}" = ?)"""
                values.append(self.label)
            index = f"rtree_{table}_{column}"
            if self.box and con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (index,)).fetchone():
                # the exact bound is checked by Spark; one unit in the last place of a single is let through
                bounds = " AND ".join(f"{n} {o} ?" for n, o, _ in self.box)
                text += f' AND rowid IN (SELECT id FROM "{index}" WHERE {bounds})'
                values += [v + (-1 if o == ">=" else 1) * (abs(v) * 1e-6 + 1e-6) for _, o, v in self.box]
            return text, values

        def _open(self):
            import sqlite3

            return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

        def _layer(self, con):
            rows = con.execute(
                "SELECT c.table_name, g.column_name, g.srs_id FROM gpkg_contents c "
                "JOIN gpkg_geometry_columns g ON g.table_name = c.table_name "
                "WHERE c.data_type = 'features' ORDER BY c.rowid"
            ).fetchall()
            picked = [r for r in rows if self.layer in (None, r[0])]
            if not picked:
                raise ValueError(f"no feature layer {self.layer or ''} in {self.path}")
            return picked[0]

        def partitions(self):
            con = self._open()
            try:
                table, _, srs = self._layer(con)
                names = [r[1] for r in con.execute(f'PRAGMA table_info("{table}")')]
                if self.field not in names:
                    raise ValueError(f"layer {table} has no field {self.field}: {names}")
                if srs in (None, 0, -1):
                    raise ValueError(f"layer {table} has no coordinate system")
                low, high = con.execute(
                    f'SELECT min(rowid), max(rowid) FROM "{table}"'
                ).fetchone()
            finally:
                con.close()
            if low is None:
                raise ValueError(f"layer {table} is empty")
            return [
                RowRange(a, min(a + self.size - 1, high))
                for a in range(low, high + 1, self.size)
            ]

        def read(self, partition):
            import struct

            envelope_doubles = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}

            def rings(blob, at):
                """Yield (next offset, part, ring, points) of a WKB polygon tree."""
                order = "<" if blob[at] == 1 else ">"
                (kind,) = struct.unpack_from(order + "I", blob, at + 1)
                at += 5
                extra, kind = divmod(kind & 0x1FFFFFFF, 1000)
                has_z = extra in (1, 3)
                has_m = extra in (2, 3)
                dims = 2 + has_z + has_m
                out = []
                (count,) = struct.unpack_from(order + "I", blob, at)
                at += 4
                if kind == 3:
                    for ring in range(count):
                        (n,) = struct.unpack_from(order + "I", blob, at)
                        flat = struct.unpack_from(f"{order}{n * dims}d", blob, at + 4)
                        out.append((0, ring, list(zip(flat[::dims], flat[1::dims]))))
                        at += 4 + 8 * n * dims
                elif kind in (6, 7):
                    for part in range(count):
                        at, inner = rings(blob, at)
                        out.extend((part, r, pts) for _, r, pts in inner)
                else:
                    raise ValueError(f"geometry type {kind} is not a polygon")
                return at, out

            con = self._open()
            try:
                table, column, layer_srs = self._layer(con)
                systems = {}
                if con.execute("SELECT 1 FROM sqlite_master WHERE name = 'gpkg_spatial_ref_sys'").fetchone():
                    systems = dict(con.execute("SELECT srs_id, definition FROM gpkg_spatial_ref_sys"))
                condition, values = self._condition(con, table, column)
                found = con.execute(
                    f'SELECT rowid, "{self.field}", "{column}" FROM "{table}" '
                    f"WHERE rowid BETWEEN ? AND ?{condition} ORDER BY rowid",
                    (partition.first, partition.last, *values),
                )
                for fid, label, blob in found:
                    if blob is None:
                        continue
                    flags = blob[3]
                    if flags & 0x10:  # empty geometry
                        continue
                    byte_order = "<" if flags & 1 else ">"
                    (srs,) = struct.unpack_from(byte_order + "i", blob, 4)
                    start = 8 + 8 * envelope_doubles[(flags >> 1) & 7]
                    decoded = rings(blob, start)[1]
                    xs = [x for _, _, pts in decoded for x, _ in pts]
                    ys = [y for _, _, pts in decoded for _, y in pts]
                    box = (min(xs), min(ys), max(xs), max(ys)) if xs else (None,) * 4
                    for part, ring, pts in decoded:
                        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
                            yield (
                                fid,
                                None if label is None else str(label),
                                part,
                                ring,
                                srs or layer_srs,
                                x1,
                                y1,
                                x2,
                                y2,
                                systems.get(srs or layer_srs),
                                *box,
                            )
            finally:
                con.close()

    class GeoPackageRings(DataSource):
        @classmethod
        def name(cls):
            return "gpkg_rings"

        def schema(self):
            return _SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return GeoPackageRings


def read_rings(
    spark: SparkSession, path: str, layer: str | None = None, field: str = "region_ID"
) -> DataFrame:
    """Edges of all polygons, each with the box of its feature.

    Conditions on ``label`` and on the box (``min_x`` ...) reach the file: the latter by its spatial index.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source_class())
    reader = spark.read.format("gpkg_rings").option("field", field)
    if layer:
        reader = reader.option("layer", layer)
    return reader.load(path)


def grid_of(srs_id: int, definition: str | None) -> geo.Grid | None:
    """The transverse Mercator grid of a coordinate system; None for degrees.

    The definition is well-known text of the first version.  Systems on another ellipsoid would need a
    datum shift, and other projections another formula; both are refused.
    """
    if srs_id == _TARGET:
        return geo.SWEREF99_TM
    if srs_id == _DEGREES:
        return None
    text = definition or ""

    def numbers(keyword: str, count: int) -> list[float] | None:
        tail = r"\s*,\s*".join([r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"] * count)
        found = re.search(keyword + r"\s*,\s*" + tail, text, re.IGNORECASE)
        return [float(x) for x in found.groups()] if found else None

    ellipsoid = numbers(r'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"', 2)
    if ellipsoid is None:
        raise ValueError(f"unsupported srs_id {srs_id}: no definition")
    a, inverse_f = ellipsoid
    if a != _AXIS or min(abs(inverse_f - f) for f in _INVERSE_F) > 1e-6:
        raise ValueError(f"unsupported srs_id {srs_id}: its ellipsoid needs a datum shift")
    if re.match(r"\s*GEOG", text, re.IGNORECASE):
        return None
    if not re.search(r'PROJECTION\s*\[\s*"Transverse[_ ]Mercator"', text, re.IGNORECASE):
        raise ValueError(f"unsupported srs_id {srs_id}: not a transverse Mercator projection")

    def parameter(name: str, default: float) -> float:
        found = numbers(rf'PARAMETER\s*\[\s*"{name}"', 1)
        return default if found is None else found[0]

    units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+)', text)
    if units and float(units[-1]) != 1.0:
        raise ValueError(f"unsupported srs_id {srs_id}: lengths are not in metres")
    return geo.Grid(
        a=a,
        inverse_f=inverse_f,
        lon0_deg=parameter("central_meridian", 0.0),
        k0=parameter("scale_factor", 1.0),
        false_n=parameter("false_northing", 0.0),
        false_e=parameter("false_easting", 0.0),
        lat0_deg=parameter("latitude_of_origin", 0.0),
    )


def _in_metres(rings: DataFrame, grid: geo.Grid | None) -> DataFrame:
    """Both ends of every edge in SWEREF 99 TM.

    The result is written down: a filter on a coordinate would carry the whole series with it.
    """
    if grid == geo.SWEREF99_TM:
        return rings
    for x, y in (("x1", "y1"), ("x2", "y2")):
        lat, lon = y, x
        if grid is not None:
            lat, lon = "_lat", "_lon"
            rings = geo.unproject(rings, y, x, lat, lon, grid)
        rings = geo.project(rings, lat, lon, "_n", "_e").withColumns({x: F.col("_e"), y: F.col("_n")})
    return materialize(rings, "edges")


def region_edges(rings: DataFrame, choice: str | None = None) -> DataFrame:
    """Edges in SWEREF 99 TM metres of the polygons labelled ``choice``.

    A layer may use degrees or any transverse Mercator grid on the same ellipsoid; its few coordinate
    systems are looked up first.
    """
    picked = rings
    if choice is not None:
        picked = rings.where(F.lower(F.trim("label")) == F.lit(choice.strip().lower()))
        if picked.limit(1).count() == 0:
            raise ValueError(f"no polygon is labelled {choice!r}")
    systems = picked.groupBy("srs_id").agg(F.max("definition").alias("definition")).collect()
    out = None
    for r in systems:
        mine = picked if len(systems) == 1 else picked.where(F.col("srs_id") == r.srs_id)
        part = _in_metres(mine, grid_of(r.srs_id, r.definition))
        out = part.select(*rings.columns) if out is None else out.unionByName(part.select(*rings.columns))
    return (picked if out is None else out).select(
        F.concat_ws("/", "feature_id", "part").alias("poly_id"),
        F.lower(F.trim("label")).alias("label"),
        "x1",
        "y1",
        "x2",
        "y2",
    )
