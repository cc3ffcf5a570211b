"""Map projections as columns: Lambert conformal conic on a sphere, and the view of a geostationary satellite on an ellipsoid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lambert:
    """Metres east and north of (lat0, lon0) on a cone through two parallels; the defaults are those of a common regional model."""

    lat0: float = 38.5
    lon0: float = -97.5
    first: float = 38.5
    second: float = 38.5
    radius: float = 6_371_229.0

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, the radius of the parallel at which a unit tangent stands, and of lat0."""
        tangent = lambda lat: math.tan(math.pi / 4 + math.radians(lat) / 2)
        a, b = math.radians(self.first), math.radians(self.second)
        n = math.sin(a) if self.first == self.second else math.log(math.cos(a) / math.cos(b)) / math.log(tangent(self.second) / tangent(self.first))
        scale = self.radius * math.cos(a) * tangent(self.first) ** n / n
        return n, scale, scale / tangent(self.lat0) ** n

    def xy(self, lat: Column, lon: Column) -> Column:
        """(x, y); null at the far pole, where there is none."""
        n, scale, base = self._cone()
        far = -90.0 if n > 0 else 90.0
        rho = scale / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(n))
        turn = n * F.radians(F.pmod(lon - self.lon0 + 180.0, F.lit(360.0)) - 180.0)
        return F.when(lat != far, F.struct((rho * F.sin(turn)).alias("x"), (base - rho * F.cos(turn)).alias("y")))

    def place(self, x: Column, y: Column) -> Column:
        """(lat, lon)."""
        n, scale, base = self._cone()
        sign = math.copysign(1.0, n)
        rho = sign * F.sqrt(x * x + (base - y) * (base - y))
        turn = F.atan2(sign * x, sign * (base - y))
        lat = F.when(rho == 0, sign * 90.0).otherwise(F.degrees(2 * F.atan(F.pow(scale / F.when(rho != 0, rho), F.lit(1 / n)))) - 90.0)
        return F.struct(lat.alias("lat"), (F.pmod(self.lon0 + F.degrees(turn) / n + 180.0, F.lit(360.0)) - 180.0).alias("lon"))


@dataclass(frozen=True)
class Geostationary:
    """Scan angles in radians, x to the east and y to the north, of a satellite over (0, lon0)."""

    lon0: float = -75.0
    equator: float = 6_378_137.0
    pole: float = 6_356_752.31414
    distance: float = 42_164_160.0  # from the earth's centre

    def xy(self, lat: Column, lon: Column) -> Column:
        """(x, y); null where the earth hides the place."""
        ratio = (self.equator / self.pole) ** 2
        geocentric = F.atan(F.tan(F.radians(lat)) / ratio)
        own = self.pole / F.sqrt(1 - (1 - 1 / ratio) * F.cos(geocentric) * F.cos(geocentric))
        turn = F.radians(lon - self.lon0)
        ahead, west, north = self.distance - own * F.cos(geocentric) * F.cos(turn), -own * F.cos(geocentric) * F.sin(turn), own * F.sin(geocentric)
        seen = self.distance * (self.distance - ahead) >= west * west + ratio * north * north
        x = F.asin(-west / F.sqrt(ahead * ahead + west * west + north * north))
        return F.when(seen, F.struct(x.alias("x"), F.atan(north / ahead).alias("y")))

    def place(self, x: Column, y: Column) -> Column:
        """(lat, lon); null where the line of sight misses the earth."""
        ratio = (self.equator / self.pole) ** 2
        a = F.sin(x) * F.sin(x) + F.cos(x) * F.cos(x) * (F.cos(y) * F.cos(y) + ratio * F.sin(y) * F.sin(y))
        b = -2 * self.distance * F.cos(x) * F.cos(y)
        root = b * b - 4 * a * (self.distance**2 - self.equator**2)
        way = (-b - F.sqrt(F.when(root >= 0, root))) / (2 * a)
        ahead, west, north = way * F.cos(x) * F.cos(y), -way * F.sin(x), way * F.cos(x) * F.sin(y)
        lat = F.degrees(F.atan(ratio * north / F.sqrt((self.distance - ahead) * (self.distance - ahead) + west * west)))
        lon = F.pmod(self.lon0 - F.degrees(F.atan2(west, self.distance - ahead)) + 180.0, F.lit(360.0)) - 180.0
        return F.when(root >= 0, F.struct(lat.alias("lat"), lon.alias("lon")))
