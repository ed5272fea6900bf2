"""Transverse Mercator projection and buffer predicates as column arithmetic.

The projection is the public Gauss conformal series on the GRS 80 ellipsoid, as
published by the Swedish mapping authority; the defaults give SWEREF 99 TM.
Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """One transverse Mercator grid (fixed values: SWEREF 99 TM)."""

    a: float = 6378137.0
    inverse_f: float = 298.257222101
    lon0_deg: float = 15.0
    k0: float = 0.9996
    false_n: float = 0.0
    false_e: float = 500000.0
    lat0_deg: float = 0.0

    @property
    def n(self) -> float:
        f = 1.0 / self.inverse_f
        return f / (2.0 - f)

    @property
    def e2(self) -> float:
        f = 1.0 / self.inverse_f
        return f * (2.0 - f)

    @property
    def radius(self) -> float:
        n = self.n
        return self.k0 * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def origin_n(self) -> float:
        """What is added to metres from the equator: the false northing counts from the origin's latitude."""
        if self.lat0_deg == 0.0:
            return self.false_n
        phi = math.radians(self.lat0_deg)
        powers = sum(k * math.sin(phi) ** (2 * i) for i, k in enumerate(self.conformal()))
        xi = phi - math.sin(phi) * math.cos(phi) * powers
        arc = xi + sum(k * math.sin(2 * i * xi) for i, k in enumerate(self.forward(), start=1))
        return self.false_n - self.radius * arc

    def conformal(self) -> list[float]:
        e = self.e2
        return [
            e,
            (5 * e**2 - e**3) / 6,
            (104 * e**3 - 45 * e**4) / 120,
            1237 * e**4 / 1260,
        ]

    def geodetic(self) -> list[float]:
        e = self.e2
        return [
            e + e**2 + e**3 + e**4,
            -(7 * e**2 + 17 * e**3 + 30 * e**4) / 6,
            (224 * e**3 + 889 * e**4) / 120,
            -4279 * e**4 / 1260,
        ]

    def forward(self) -> list[float]:
        n = self.n
        return [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ]

    def backward(self) -> list[float]:
        n = self.n
        return [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ]


SWEREF99_TM = Grid()


def _even_powers(c: Column, coef: list[float]) -> Column:
    # Horner form in sin^2
    s2 = F.sin(c) * F.sin(c)
    out = F.lit(coef[-1])
    for k in reversed(coef[:-1]):
        out = out * s2 + F.lit(k)
    return F.sin(c) * F.cos(c) * out


def _series(xi: Column, eta: Column, coef: list[float], north: bool) -> Column:
    out = F.lit(0.0)
    for i, k in enumerate(coef, start=1):
        x, y = xi * F.lit(2.0 * i), eta * F.lit(2.0 * i)
        term = F.sin(x) * F.cosh(y) if north else F.cos(x) * F.sinh(y)
        out = out + F.lit(k) * term
    return out


def project(
    df: DataFrame, lat: str, lon: str, north: str, east: str, grid: Grid = SWEREF99_TM
) -> DataFrame:
    """Degrees to metres: adds the columns ``north`` and ``east``.

    One projection per intermediate value: the planner keeps them apart because
    each is used several times, so the generated code stays small.
    """
    kept = [c for c in df.columns if c not in (north, east)]
    phi, dl, conf, xi, eta = (F.col(c) for c in ("_phi", "_dl", "_conf", "_xi", "_eta"))
    staged = (
        df.withColumns(
            {"_phi": F.radians(lat), "_dl": F.radians(F.col(lon) - F.lit(grid.lon0_deg))}
        )
        .withColumn("_conf", phi - _even_powers(phi, grid.conformal()))
        .withColumns(
            {
                "_xi": F.atan2(F.tan(conf), F.cos(dl)),
                "_eta": F.atanh(F.cos(conf) * F.sin(dl)),
            }
        )
    )
    n = F.lit(grid.radius) * (xi + _series(xi, eta, grid.forward(), True))
    e = F.lit(grid.radius) * (eta + _series(xi, eta, grid.forward(), False))
    return staged.select(
        *kept,
        (n + F.lit(grid.origin_n)).alias(north),
        (e + F.lit(grid.false_e)).alias(east),
    )


def unproject(
    df: DataFrame, north: str, east: str, lat: str, lon: str, grid: Grid = SWEREF99_TM
) -> DataFrame:
    """Metres to degrees: adds the columns ``lat`` and ``lon``."""
    kept = [c for c in df.columns if c not in (lat, lon)]
    xi0, eta0, xi, eta, conf = (F.col(c) for c in ("_xi0", "_eta0", "_xi", "_eta", "_conf"))
    staged = (
        df.withColumns(
            {
                "_xi0": (F.col(north) - F.lit(grid.origin_n)) / F.lit(grid.radius),
                "_eta0": (F.col(east) - F.lit(grid.false_e)) / F.lit(grid.radius),
            }
        )
        .withColumns(
            {
                "_xi": xi0 - _series(xi0, eta0, grid.backward(), True),
                "_eta": eta0 - _series(xi0, eta0, grid.backward(), False),
            }
        )
        .withColumn("_conf", F.asin(F.sin(xi) / F.cosh(eta)))
    )
    turned = F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return staged.select(
        *kept,
        F.degrees(conf + _even_powers(conf, grid.geodetic())).alias(lat),
        (turned + F.lit(grid.lon0_deg)).alias(lon),
    )


def in_buffer(de: Column, dn: Column, radius: float, shape: str = "polygon64") -> Column:
    """Is the offset inside a buffer of ``radius``?

    ``polygon64`` is the 64-gon inscribed in the circle that a round buffer with
    16 segments per quadrant produces; ``circle`` is the exact disc.
    """
    disc = de * de + dn * dn <= F.lit(radius * radius)
    if shape == "circle":
        return disc
    if shape != "polygon64":
        raise ValueError(f"unknown buffer shape {shape!r}")
    step = math.pi / 32
    angle = F.pmod(F.atan2(dn, de), F.lit(2 * math.pi))
    off = angle - F.floor(angle / F.lit(step)).cast("double") * F.lit(step)
    reach = F.hypot(de, dn) * F.cos(off - F.lit(step / 2))
    # the cheap disc test first: trigonometry only runs for true candidates; the
    # nanometre keeps vertices inside whatever the last bit of the cosine is
    return disc & (reach <= F.lit(radius * math.cos(step / 2) + 1e-9))


def grid_cell(c: Column, size: float) -> Column:
    """Cell number; never NULL.

    A nullable join key would make the planner push "is not null" down through
    the projection and so evaluate its whole series a second time.
    """
    return F.coalesce(F.floor(c / F.lit(float(size))), F.lit(-(2**62))).cast("bigint")
