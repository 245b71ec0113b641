"""Position of the sun by the NOAA approximation, day phase and shadows, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heights in m whose shadows are given.
HEIGHTS = (1.8, 5.0, 10.0)
LOWEST = 0.5


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def position(lat: Column, lon: Column, ts: Column) -> Column:
    """Elevation and azimuth in degrees, to two places; ``ts`` in a UTC session."""
    minutes = F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0
    g = F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - 1 + (minutes / 60.0 - 12.0) / 24.0)
    drift = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2.0 * g) - 0.040849 * F.sin(2.0 * g))
    tilt = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2.0 * g) + 0.000907 * F.sin(2.0 * g)
    hour = (minutes + drift + 4.0 * lon) / 4.0 - 180.0
    p = F.radians(lat)
    up = _clamped(F.sin(p) * F.sin(tilt) + F.cos(p) * F.cos(tilt) * F.cos(F.radians(hour)))
    zenith = F.acos(up)
    side = 180.0 - F.degrees(F.acos(_clamped((F.sin(p) * F.cos(zenith) - F.sin(tilt)) / (F.cos(p) * F.sin(zenith)))))
    azimuth = F.when(F.sin(zenith) == 0, 0.0).when(hour > 0, 360.0 - side).otherwise(side)
    return F.struct(F.round(90.0 - F.degrees(zenith), 2).alias("elevation"), F.round(azimuth, 2).alias("azimuth"))


def day_phase(elevation: Column) -> Column:
    return F.when(elevation > 6.0, "Daylight").when(elevation > 0.0, "Golden Hour").when(elevation >= -6.0, "Civil Twilight").otherwise("Night")


def shadow_factor(elevation: Column) -> Column:
    """Length of a shadow in heights; null while the sun is down."""
    return F.when(elevation > 0, F.round(1.0 / F.tan(F.radians(elevation)), 2))


def shadow(elevation: Column, azimuth: Column) -> Column:
    """Bearing and lengths of shadows; null with the sun at LOWEST degrees or lower."""
    factor = 1.0 / F.tan(F.radians(elevation))
    lengths = [F.round(factor * h, 2).alias(f"length_{str(h).replace('.', '_')}m") for h in HEIGHTS]
    return F.when(elevation > LOWEST, F.struct(F.round(F.pmod(azimuth + 180.0, F.lit(360.0)), 2).alias("bearing"), F.round(factor, 3).alias("multiplier"), *lengths))
