"""Geodesy, compass and camera optics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radii in km: distances, and distances to places; metres for destinations.
RADIUS_KM, PLACE_RADIUS_KM, RADIUS_M = 6371.0, 6371.0088, 6371008.8
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
NEAR_ZERO = 0.0001
#: A 35 mm frame: width, height, diagonal.
FRAME = (36.0, 24.0, (36.0**2 + 24.0**2) ** 0.5)
#: Focal lengths below so many mm are taken for those of a phone's sensor.
PHONE_MM, PHONE_CROP, USUAL_MM = 10.0, 5.6, 50.0
ARC_POINTS = 16
MILES_PER_KM = 0.621371


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM, clamp: bool = False) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    if clamp:
        a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def distances(km: Column) -> Column:
    return F.struct(
        F.round(km, 3).alias("distance_km"),
        F.round(km * MILES_PER_KM, 3).alias("distance_miles"),
        F.round(km * 0.539957, 3).alias("distance_nautical_miles"),
        F.round(km * 1000.0, 1).alias("distance_meters"),
    )


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def cardinal(degrees: Column) -> Column:
    place = F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16))
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (place + 1).cast("int"))


def coordinate_status(lat: Column, lon: Column) -> Column:
    """VALID, NULL_ISLAND or OUT_OF_BOUNDS; missing and not-a-number coordinates are out of bounds."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    zero = (F.abs(lat) < NEAR_ZERO) & (F.abs(lon) < NEAR_ZERO)
    return F.when(~F.coalesce(inside, F.lit(False)), "OUT_OF_BOUNDS").when(zero, "NULL_ISLAND").otherwise("VALID")


def usable(lat: Column, lon: Column) -> Column:
    return coordinate_status(lat, lon) == "VALID"


def speed_kmh(lat1: Column, lon1: Column, lat2: Column, lon2: Column, seconds: Column) -> Column:
    """Speed between two fixes; null below a second or where a fix is unusable."""
    km = haversine(lat1, lon1, lat2, lon2)
    return F.when(usable(lat1, lon1) & usable(lat2, lon2) & (F.abs(seconds) >= 1.0), km / F.abs(seconds) * 3600.0)


def destination(lat: Column, lon: Column, degrees: Column, metres: Column) -> Column:
    """The point ``metres`` away along a great circle."""
    d, b, p = metres / RADIUS_M, F.radians(degrees), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(east).alias("lon"))


def effective_focal_length(equivalent: Column, physical: Column) -> Column:
    phone = F.when(physical < PHONE_MM, physical * PHONE_CROP).otherwise(physical)
    return F.greatest(F.lit(1.0), F.when(equivalent > 0, equivalent).when(physical > 0, phone).otherwise(F.lit(USUAL_MM)).cast("double"))


def fields_of_view(focal: Column) -> Column:
    names = ("hfov", "vfov", "dfov")
    return F.struct(*[F.degrees(2.0 * F.atan(F.lit(side) / (2.0 * focal))).alias(n) for n, side in zip(names, FRAME, strict=True)])


def viewing_cone(lat: Column, lon: Column, heading: Column, hfov: Column, metres: float = 300.0) -> Column:
    """A closed polygon: the origin, points along the arc from left to right, the origin."""
    left = F.pmod(heading - hfov / 2.0, F.lit(360.0))
    arc = F.transform(
        F.sequence(F.lit(0), F.lit(ARC_POINTS)),
        lambda i: destination(lat, lon, F.pmod(left + i / float(ARC_POINTS) * hfov, F.lit(360.0)), F.lit(metres)),
    )
    origin = F.array(F.struct(lat.alias("lat"), lon.alias("lon")))
    return F.concat(origin, arc, origin)


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of [lon, lat] pairs, by the crossings of a ray; rings of under three points hold nothing."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.when(i == 0, n).otherwise(i).cast("int"))
        spans = (a[1] > lat) != (b[1] > lat)
        return F.when(spans, lon < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1]) + a[0]).otherwise(F.lit(False))

    times = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda k, i: k + crosses(i).cast("int"))
    return F.when(n < 3, F.lit(False)).otherwise(times % 2 == 1)


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the holes."""
    holes = F.exists(F.slice(rings, F.lit(2), F.greatest(F.size(rings), F.lit(1))), lambda r: in_ring(lat, lon, r))
    return in_ring(lat, lon, rings[0]) & ~holes


def cartesian(lat: Column, lon: Column) -> Column:
    p, q = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z"))


def nominal_zone(lon: Column) -> Column:
    """A zone name from the longitude alone; the sign is that of the offset, not the inverted one of POSIX."""
    hours = F.bround(lon / 15.0, 0).cast("int")
    return F.concat(F.lit("Etc/GMT"), F.when(hours >= 0, "+").otherwise("-"), F.abs(hours).cast("string"))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def rational(num: Column, den: Column) -> Column:
    return F.when(den == 0, num.cast("double")).otherwise(num / den)


def _dms(value: Column, positive: str, negative: str) -> Column:
    size = F.abs(value)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    seconds = (size - whole - minutes / 60.0) * 3600.0
    return F.concat(F.format_string("%d°%d'%.1f\"", whole, minutes, seconds), F.when(value >= 0, positive).otherwise(negative))


def dms_text(lat: Column, lon: Column) -> Column:
    return F.concat_ws(", ", _dms(lat, "N", "S"), _dms(lon, "E", "W"))


def pair_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lon)


def location_score(status: Column, dop: Column, has_time: Column, elevation: Column, phase: Column) -> Column:
    """Score of a fix: the coordinates, satellite time, dilution of precision, agreement of sun and phase."""
    by_dop = F.when(dop.isNull(), 0.0).when(dop < 2.0, 0.15).when(dop < 5.0, 0.1).when(dop < 10.0, 0.0).otherwise(-0.1)
    agree = (elevation > 0) == phase.isin("Daylight", "Golden Hour")
    by_sun = F.when(elevation.isNull() | phase.isNull(), 0.0).when(agree, 0.1).otherwise(-0.15)
    score = 0.5 + F.when(has_time, 0.2).otherwise(0.0) + by_dop + by_sun
    return F.when(status != "VALID", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def location_level(status: Column, score: Column) -> Column:
    return F.when(status != "VALID", "REJECTED").when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def gnss_score(status: Column, mode: Column, satellites: Column, dop: Column) -> Column:
    """Integrity of a receiver's telemetry; 0.75 and more is probable."""
    return F.lit(0.5) + F.when(status == "A", 0.15).otherwise(0.0) + F.when(mode == "3", 0.15).otherwise(0.0) + F.when(satellites.isNotNull(), 0.1).otherwise(0.0) + F.when(dop.between(0.5, 8.0), 0.1).otherwise(0.0)


def map_urls(lat: Column, lon: Column) -> Column:
    """Links to a point on five map services."""
    hack = F.format_string("%.4f_%s_%.4f_%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))
    return F.struct(
        F.format_string("https://www.openstreetmap.org/?mlat=%1$.6f&mlon=%2$.6f#map=16/%1$.6f/%2$.6f", lat, lon).alias("openstreetmap"),
        F.format_string("https://www.google.com/maps?q=%.6f,%.6f", lat, lon).alias("google_maps"),
        F.format_string("https://maps.apple.com/?q=%.6f,%.6f", lat, lon).alias("apple_maps"),
        F.format_string("https://www.bing.com/maps?cp=%.6f~%.6f&lvl=16", lat, lon).alias("bing_maps"),
        F.concat(F.lit("https://geohack.toolforge.org/geohack.php?params="), hack).alias("geohack"),
    )
