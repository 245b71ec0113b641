"""Points against places, facilities, fences and addresses.

Near searches go through grid cells as equi-join keys: a point looks into its own cell and those around it, so nothing
is joined with everything and either side may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import geo

#: Degrees around a point that are searched in turn, and the distance that ends the search there.
WINDOWS, NEAR_KM = (1.0, 3.0, 10.0, 45.0), 150.0
#: Narrower and middle steps: they end a search only where nothing outside can be nearer.
STEPS = (0.05, 0.2, 1.0, 3.0, 10.0, 20.0, 45.0)
#: Places that a point meets on average in a step of these that is worth its work.
LEAST_MET = 0.05
KM_PER_DEGREE = 111.0


def _reach_km(lat: Column, degrees: float) -> Column:
    """How far it is at least from a point to the edge of the box of ``degrees`` around it."""
    east = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.lit(degrees))))
    return geo.PLACE_RADIUS_KM * F.least(F.radians(F.lit(degrees)), east)


def _step(points: DataFrame, places: DataFrame, degrees: float) -> DataFrame:
    """``points`` (point_id, lat, lon, found) with the nearest place of the box, where it ends the search.

    Points that have found theirs go along as single rows, in cells of their own that no place is in.
    """
    y, x = F.floor(F.col("lat") / degrees), F.floor(F.col("lon") / degrees)
    around = F.array(*[F.struct((y + j).alias("y"), (x + i).alias("x")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    nowhere = F.array(F.struct(F.xxhash64("point_id").alias("y"), F.lit(1 << 40).alias("x")))
    rows = points.withColumn("_cell", F.explode(F.when(F.col("found").isNull(), around).otherwise(nowhere)))
    cells = places.select("place_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.floor(F.col("lat") / degrees).alias("_y"), F.floor(F.col("lon") / degrees).alias("_x"))
    both = rows.join(cells, (F.col("_cell.y") == F.col("_y")) & (F.col("_cell.x") == F.col("_x")), "left")
    boxed = (F.abs(F.col("_lat") - F.col("lat")) <= degrees) & (F.abs(F.col("_lon") - F.col("lon")) <= degrees)
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), geo.PLACE_RADIUS_KM, clamp=True)
    best = F.min(F.when(boxed, F.struct(km.alias("km"), "place_id"))).alias("_best")
    out = both.groupBy("point_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("found", ignorenulls=True).alias("found"), best)
    ends = (F.col("_best.km") <= _reach_km(F.col("lat"), degrees)) if degrees < WINDOWS[-1] else F.lit(True)
    if degrees in WINDOWS:
        ends = ends | (F.col("_best.km") <= NEAR_KM)
    return out.withColumn("found", F.coalesce("found", F.when(ends, F.col("_best")))).drop("_best")


def nearest_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """(point_id, place_id, distance_km, approximate): the nearest place of the first window that has one near enough, or else of the widest.

    Cells grow in steps, and only points without an answer look into the next; so the pairs that a point meets do not grow
    with the number of places, but where they stand close together within a twentieth of a degree, and near the poles, where
    boxes of degrees are narrow.
    """
    none = F.lit(None).cast("struct<km:double,place_id:" + places.schema["place_id"].dataType.simpleString() + ">")
    rows = points.select("point_id", "lat", "lon").withColumn("found", none)
    per_degree = places.count() / (360.0 * 180.0)
    for degrees in STEPS:
        if degrees in WINDOWS or 9 * degrees**2 * per_degree >= LEAST_MET:  # else a step that hardly any point would end in
            rows = _step(rows, places, degrees)
    found = rows.where("found is not null")
    return found.select("point_id", "found.place_id", F.round("found.km", 3).alias("distance_km"), (F.col("found.km") > NEAR_KM).alias("approximate"))


def _columns(band: Column, degrees: float) -> Column:
    """Into how many cells a band of latitude is cut, each as wide as a circle of ``degrees`` in it or beside it reaches."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * degrees)
    reach = F.sin(F.radians(F.lit(degrees))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
    return F.when(reach >= 1.0, 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 / F.degrees(F.asin(F.least(reach, F.lit(1.0)))))).cast("int")).cast("int")


def nearest_facility(points: DataFrame, facilities: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(point_id, kind, place_id, distance_km): the nearest facility of each kind within its limit in km.

    Points meet facilities by bands of latitude and, in each, cells of longitude, both as wide as the widest limit; cells
    go round at 180 degrees.
    """
    band = max(limits.values()) / KM_PER_DEGREE
    cell = lambda lon, n: F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("int")
    rows = facilities.select("place_id", "kind", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), F.floor(F.col("lat") / band).alias("_py"))
    rows = rows.withColumn("_px", cell(F.col("place_lon"), _columns(F.col("_py"), band)))
    y = F.floor(F.col("lat") / band)
    near = points.select("point_id", "lat", "lon").withColumn("_y", F.explode(F.array(y - 1, y, y + 1))).withColumn("_n", _columns(F.col("_y"), band))
    at = cell(F.col("lon"), F.col("_n"))
    near = near.withColumn("_x", F.explode(F.array_distinct(F.array(*[F.pmod(at + k, F.col("_n")) for k in (-1, 0, 1)]))))
    both = near.join(rows, (F.col("_y") == F.col("_py")) & (F.col("_x") == F.col("_px")))
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"), geo.PLACE_RADIUS_KM, clamp=True)
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()])
    best = both.withColumn("km", km).where(F.col("km") <= most).groupBy("point_id", "kind").agg(F.min(F.struct("km", "place_id")).alias("b"))
    return best.select("point_id", "kind", "b.place_id", F.round("b.km", 3).alias("distance_km"))


def facility_context(points: DataFrame, facilities: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(point_id, summary): what is near, in the order of ``limits``."""
    near = nearest_facility(points, facilities, limits)
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(limits)])
    text = F.concat(F.col("kind"), F.lit(" "), F.col("place_id").cast("string"), F.lit(" ("), F.round("distance_km", 1).cast("string"), F.lit(" km)"))
    rows = near.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), text.alias("t")))).alias("all"))
    return rows.select("point_id", F.array_join(F.transform("all", lambda x: x["t"]), "; ").alias("summary"))


def in_fences(points: DataFrame, fences: DataFrame) -> DataFrame:
    """(point_id, fence_id, inside): the first fence that holds a point, if any.

    ``fences`` has fence_id and rings (the outer ring, then holes) of [lon, lat] pairs. They meet points by whole degrees of
    latitude of their extent.
    """
    lats = F.transform(F.col("rings")[0], lambda p: p[1])
    rows = fences.select("fence_id", "rings", F.explode(F.sequence(F.floor(F.array_min(lats)), F.floor(F.array_max(lats)))).alias("_fy"))
    near = points.select("point_id", "lat", "lon").join(rows, F.floor(F.col("lat")) == F.col("_fy"))
    hits = near.where(geo.in_polygon(F.col("lat"), F.col("lon"), F.col("rings"))).groupBy("point_id").agg(F.min("fence_id").alias("fence_id"))
    return points.select("point_id").join(hits, "point_id", "left").withColumn("inside", F.col("fence_id").isNotNull())


def ip_verdict(km: Column) -> Column:
    return F.when(km <= 60.0, "CORROBORATED_METRO").when(km <= 300.0, "REGIONAL_PROXIMITY").when(km <= 1200.0, "NATIONAL_PROXIMITY").otherwise("DISCREPANCY_ANOMALY")


def ip_correlation(points: DataFrame, ip_lat: float, ip_lon: float) -> DataFrame:
    """Usable points against the place of a network address."""
    own = points.where(geo.usable(F.col("lat"), F.col("lon")))
    at = (F.lit(ip_lat), F.lit(ip_lon), F.col("lat"), F.col("lon"))
    km, course = F.round(geo.haversine(*at), 3), geo.bearing(*at)
    return own.select("point_id", km.alias("distance_km"), F.round(course, 2).alias("bearing"), geo.cardinal(course).alias("cardinal"), ip_verdict(km).alias("verdict"), (km > 1200.0).alias("suspicious"))


def added(known: DataFrame, new: DataFrame) -> DataFrame:
    """The new places that differ from known ones and from each other by name, country, and place to two decimals.

    Of those with one key the first by ``ordinal`` counts.
    """
    keyed = lambda df: df.withColumns({"_n": F.lower(F.trim("name")), "_c": F.upper("country_code"), "_y": F.round("lat", 2), "_x": F.round("lon", 2)})
    keys = ["_n", "_c", "_y", "_x"]
    first = keyed(new).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))).where("_k = 1").drop("_k")
    return first.join(keyed(known).select(*keys), keys, "left_anti").drop(*keys)


def merged(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known places and those that ``added`` gives."""
    return known.unionByName(added(known, new).select(*known.columns))


def parse_places(lines: DataFrame) -> DataFrame:
    """Places out of NDJSON lines (column value): GeoJSON features, Overture or flat objects; without name or place, none."""
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("value", p), F.lit("")) for p in paths])
    out = lines.select(
        get("$.properties.name", "$.names.primary", "$.properties.names.primary", "$.name", "$.display_name").alias("name"),
        get("$.properties.country", "$.country").alias("country"),
        F.upper(get("$.properties.country_code", "$.properties.iso_a2", "$.country_code", "$.cc")).alias("country_code"),
        get("$.properties.admin1", "$.properties.region", "$.admin1", "$.region").alias("admin1"),
        get("$.geometry.coordinates[1]", "$.lat", "$.latitude").try_cast("double").alias("lat"),
        get("$.geometry.coordinates[0]", "$.lon", "$.lng", "$.longitude").try_cast("double").alias("lon"),
        get("$.properties.timezone", "$.timezone").alias("timezone"),
        get("$.properties.population", "$.population").try_cast("long").alias("population"),
    )
    return out.where("name is not null and lat is not null and lon is not null")


def chosen(found: DataFrame, other: DataFrame) -> DataFrame:
    """(point_id, place_id, distance_km, approximate, distance_miles, origin) of the nearer of two answers; ``found`` wins ties."""
    rows = found.withColumns({"origin": F.lit("index"), "_n": F.lit(0)}).unionByName(other.withColumns({"origin": F.lit("list"), "_n": F.lit(1)}))
    best = rows.groupBy("point_id").agg(F.min_by(F.struct("place_id", "distance_km", "approximate", "origin"), F.struct("distance_km", "_n")).alias("b"))
    return best.select("point_id", "b.*", F.round(F.col("b.distance_km") * geo.MILES_PER_KM, 3).alias("distance_miles"))


def in_order(places: DataFrame) -> DataFrame:
    """Places by country, region and name, nulls as empty text."""
    return places.orderBy(*[F.coalesce(F.col(c), F.lit("")) for c in ("country", "admin1", "name")])


def ingested(known: DataFrame, new: DataFrame, limit: int | None = None) -> DataFrame:
    """``merged``, with the first ``limit`` by ordinal of the places that were not known."""
    own = added(known, new)
    own = own if limit is None else own.orderBy("ordinal").limit(limit)
    return known.unionByName(own.select(*known.columns))


def zones(points: DataFrame, places: DataFrame) -> DataFrame:
    """(point_id, zone): that of the nearest place, or one by the longitude alone."""
    near = nearest_place(points, places).join(places.select("place_id", "timezone"), "place_id").select("point_id", "timezone")
    return points.join(near, "point_id", "left").select("point_id", F.coalesce(F.nullif("timezone", F.lit("")), geo.nominal_zone(F.col("lon"))).alias("zone"))
