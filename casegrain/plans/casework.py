"""From files to findings and verdicts: the operators put together.

Every tier is a DataFrame of findings; a tier that isn't asked for is not part of the plan. Verdicts read all findings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions import bits, geo, raster, solar, timeparse
from casegrain.operators import artefacts, encoders, places, records, verdict
from casegrain.sources import files as sources
from casegrain.sources import jpegtables

FINDING = "sha256 string, ordinal long, tier int, name string, confidence string, extractor string, caveat string, value string"
CAVEAT = "Derived from what the file says about itself, which can be edited."
TIERS = (1, 2, 3, 4, 5, 6, 7)
#: Extra analysers by tier: functions from the case's tables to findings.
Analyser = Callable[[dict[str, DataFrame]], DataFrame]
ANALYSERS: dict[str, tuple[int, Analyser]] = {}
MAIN_TAGS = "Make Model Software DateTime DateTimeOriginal DateTimeDigitized Artist Copyright LensModel BodySerialNumber Orientation".split()


def register(name: str, tier: int, analyser: Analyser) -> None:
    """Adds an analyser; it runs with the tier it is registered for."""
    if tier not in TIERS:
        raise ValueError("tier must be 1 to 7")
    ANALYSERS[name] = (tier, analyser)


def finding(rows: DataFrame, tier: int, name: str | Column, confidence: str, extractor: str, value: Column, ordinal: Column | None = None, caveat: str | None = None) -> DataFrame:
    """Findings from rows with sha256; confidences below "observed" need a caveat."""
    if confidence != "observed" and not (caveat or "").strip():
        raise ValueError(f"{confidence} findings need a caveat")
    named = F.lit(name) if isinstance(name, str) else name
    return rows.select("sha256", (F.lit(0) if ordinal is None else ordinal).cast("long").alias("ordinal"), F.lit(tier).alias("tier"), named.alias("name"), F.lit(confidence).alias("confidence"), F.lit(extractor).alias("extractor"), F.lit(caveat).alias("caveat"), value.cast("string").alias("value"))


def _rationals(text: Column) -> Column:
    pair = lambda p: geo.rational(F.split(p, "/")[0].cast("double"), F.try_element_at(F.split(p, "/"), F.lit(2)).cast("double"))
    return F.transform(F.split(text, ", "), lambda p: F.coalesce(pair(p), p.try_cast("double")))


def _degrees(text: Column, ref: Column) -> Column:
    v = _rationals(text)
    part = lambda k: F.coalesce(F.try_element_at(v, F.lit(k)), F.lit(0.0))
    return F.when(text.isNotNull(), geo.dms_to_decimal(part(1), part(2), part(3), ref))


GPS_NAMES = [f"GPS{n}" for n in ("Latitude", "LatitudeRef", "Longitude", "LongitudeRef", "Altitude", "AltitudeRef", "DateStamp", "TimeStamp", "Status", "MeasureMode", "Satellites", "DOP", "ImgDirection")]
TIME_NAMES = ["DateTimeOriginal", "DateTime", "ModifyDate", "OffsetTimeOriginal"]


def facts(fields: DataFrame) -> DataFrame:
    """One row per file: place, times and camera out of its fields."""
    m = records.field_map(fields, [*GPS_NAMES, *TIME_NAMES, "Make", "Model", "BodySerialNumber", "FocalLength", "FocalLengthIn35mmFilm"])
    first = lambda c: F.try_element_at(_rationals(F.col(c)), F.lit(1))
    clock = F.array_join(F.transform(_rationals(F.col("GPSTimeStamp")), lambda x: x.cast("string")), ":")
    return m.select(
        "sha256",
        _degrees(F.col("GPSLatitude"), F.col("GPSLatitudeRef")).alias("lat"),
        _degrees(F.col("GPSLongitude"), F.col("GPSLongitudeRef")).alias("lon"),
        (first("GPSAltitude") * F.when(F.col("GPSAltitudeRef") == "1", -1.0).otherwise(1.0)).alias("altitude_m"),
        timeparse.gps_time(F.col("GPSDateStamp"), clock).alias("gps_ts"),
        timeparse.shifted(timeparse.parsed(F.col("DateTimeOriginal")), F.col("OffsetTimeOriginal")).alias("original"),
        timeparse.parsed(F.coalesce("ModifyDate", "DateTime")).alias("modified"),
        F.col("GPSStatus").alias("gps_status"), F.col("GPSMeasureMode").alias("gps_mode"), F.col("GPSSatellites").alias("gps_satellites"), first("GPSDOP").alias("dop"), first("GPSImgDirection").alias("heading"),
        F.col("Make").alias("make"), F.col("Model").alias("model"), F.col("BodySerialNumber").alias("serial"), first("FocalLength").alias("focal_mm"), F.col("FocalLengthIn35mmFilm").try_cast("double").alias("focal_35mm"),
    )


def tier1(case: dict[str, DataFrame]) -> DataFrame:
    f = case["fields"]
    short = F.lower(records.short_name(F.col("name")))
    named = f.where((F.col("standard") == "EXIF") & ((F.col("name").startswith("GPS:")) | records.short_name(F.col("name")).isin(MAIN_TAGS)))
    exif = finding(named, 1, F.concat(F.lit("exif_"), short), "observed", "exif", F.col("value_str"), F.col("ordinal"))
    others = [("XMP", "xmp_packet_present"), ("ICC", "icc_profile_header"), ("C2PA", "c2pa_manifest_presence")]
    rest = [finding(f.where(F.col("standard") == s).groupBy("sha256").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n")), 1, name, "observed", s.lower(), F.col("n"), F.col("ordinal")) for s, name in others]
    return records.all_findings([exif, *rest])


def quant_of(case: dict[str, DataFrame]) -> DataFrame:
    """(print_id, lum, chrom, segments, subsampling, optimized, sof) of JPEG files, from their units."""
    u = case["units"]
    byte = lambda p, k: F.conv(F.hex(F.substring(p, k, 1)), 16, 10).cast("int")
    tables = u.where("name = 'DQT' and length(payload) >= 65")
    values = F.transform(F.sequence(F.lit(2), F.lit(65)), lambda i: byte(F.col("payload"), i))
    both = tables.groupBy("sha256").agg(F.min_by(values, F.when(byte(F.col("payload"), 1) % 16 == 0, F.col("ordinal"))).alias("lum"), F.min_by(values, F.when(byte(F.col("payload"), 1) % 16 == 1, F.col("ordinal"))).alias("chrom"))
    order = u.groupBy("sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("segments"))
    frame = u.where("name rlike '^SOF[0-9]+$'").groupBy("sha256").agg(F.min_by(F.struct("name", F.hex("payload").alias("h")), "ordinal").alias("s"))
    factor = F.substring(F.col("s.h"), 15, 2)
    sub = F.when(factor == "22", "4:2:0").when(factor == "21", "4:2:2").when(factor == "11", "4:4:4").when(factor == "41", "4:1:1").when(factor == "12", "4:4:0")
    restart = u.where("name = 'DRI' and length(payload) >= 2").groupBy("sha256").agg(F.max_by(F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).cast("int"), "ordinal").alias("restart"))
    codes = u.where("name = 'DHT'").select("sha256", "ordinal", F.explode(huffman_tables("payload")).alias("t"))
    codes = codes.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("t.key", F.col("ordinal"), "t.hash"))).alias("dht"), F.max("t.optimized").alias("optimized"))
    out = both.join(order, "sha256", "left").join(frame, "sha256", "left").join(restart, "sha256", "left").join(codes, "sha256", "left")
    return out.select(F.col("sha256").alias("print_id"), "lum", "chrom", "segments", sub.alias("subsampling"), "optimized", F.col("s.name").alias("sof"), "restart", "dht")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("optimized", T.BooleanType())])))
def huffman_tables(payload: pd.Series) -> pd.Series:
    """Each table of a DHT segment: its class and id, the hash of its counts and symbols, whether they aren't the standard's."""
    one = lambda t: {"key": t[0] * 16 + t[1], "hash": hashlib.sha256(bytes(t[2]) + bytes(t[3])).hexdigest(), "optimized": t[4]}
    return pd.Series([[one(t) for t in jpegtables.huffman(bytes(p))] if p is not None else [] for p in payload], dtype=object)


def tier2(case: dict[str, DataFrame]) -> DataFrame:
    p = quant_of(case)
    hashed = lambda c: F.sha2(F.array_join(F.transform(c, lambda v: v.cast("string")), ","), 256)
    tables = F.filter(F.array(F.struct(F.lit(0).alias("key"), hashed(F.col("lum")).alias("hash")), F.struct(F.lit(1).alias("key"), hashed(F.col("chrom")).alias("hash"))), lambda t: t["hash"].isNotNull())
    whole = encoders.composite_hash(F.lit("JPEG"), tables, F.coalesce(F.transform("dht", lambda t: F.struct(t["key"].alias("key"), t["hash"].alias("hash"))), F.array().cast("array<struct<key:int,hash:string>>")), F.col("subsampling"), F.col("segments"), F.col("restart"))
    out = [finding(p.select(F.col("print_id").alias("sha256"), whole.alias("v")), 2, "encoder_composite_fingerprint", "observed", "fingerprint", F.col("v"))]
    if "corpus" in case:
        a = encoders.attribution(encoders.candidates(p, case["corpus"])).withColumnRenamed("print_id", "sha256")
        value = F.to_json(F.struct("outcome", "entry_id", "category", "score", "categories"))
        out.append(finding(a, 2, "encoder_attribution", "indicative", "matcher", value, caveat="Tables resemble those of an encoder; others may use the same."))
    return records.all_findings(out)


def tier3(case: dict[str, DataFrame]) -> DataFrame:
    t = artefacts.trailing(case["files"], case["units"])
    trailing = finding(t, 3, "trailing_data_detected", "observed", "artefacts", F.to_json(F.struct("offset", "length", "kind", "entropy", "preview", "digest")), F.col("offset"))
    units = case["units"].join(case["files"].select("sha256", "format").dropDuplicates(["sha256"]), "sha256")
    odd = records.container_anomalies(units)
    anomalies = finding(odd, 3, F.concat(F.lit("container_anomaly_"), F.col("anomaly")), "indicative", "artefacts", F.col("n"), caveat=CAVEAT)
    thumbs = case["fields"].where("name = 'IFD1:JPEGInterchangeFormat'")
    mpf = case["blocks"].where("kind = 'MPF'")
    return records.all_findings([trailing, anomalies, finding(thumbs, 3, "exif_thumbnail_extracted", "observed", "artefacts", F.col("value_str"), F.col("ordinal")), finding(mpf, 3, "mpf_secondary_images", "observed", "artefacts", F.col("length"), F.col("ordinal"))])


def tier4(case: dict[str, DataFrame]) -> DataFrame:
    f = case["files"].where("content is not null")

    @F.pandas_udf("string")
    def stream(form: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([artefacts.data_hash(a, bytes(b)) for a, b in zip(form, content, strict=True)], dtype=object)

    hashed = f.select("sha256", stream("format", "content").alias("h")).where("h is not null")
    out = [finding(f, 4, "file_sha256", "observed", "hash", F.col("sha256")), finding(hashed, 4, "image_data_stream_sha256", "observed", "hash", F.col("h"))]
    if "pixels" in case:
        value = F.to_json(F.struct("ahash", "dhash", "phash"))
        out.append(finding(case["pixels"], 4, "perceptual_hashes", "derived", "raster", value, caveat="Hashes of the decoded picture; small edits leave them alike."))
    return records.all_findings(out)


def tier5(case: dict[str, DataFrame]) -> DataFrame:
    own = case["facts"].where("lat is not null and lon is not null")
    status = geo.coordinate_status(F.col("lat"), F.col("lon"))
    good, bad = own.where(status == "VALID"), own.where(status != "VALID")
    add = lambda df, name, value, confidence="derived": finding(df, 5, name, confidence, "place", value, caveat=None if confidence == "observed" else CAVEAT)
    when = F.coalesce("gps_ts", "original")
    sun = good.withColumn("when", when).where("when is not null").withColumn("sun", solar.position(F.col("lat"), F.col("lon"), F.col("when"))).withColumn("phase", solar.day_phase(F.col("sun.elevation")))
    lit = sun.withColumn("shade", solar.shadow(F.col("sun.elevation"), F.col("sun.azimuth"))).where("shade is not null")
    score = geo.location_score(F.lit("VALID"), F.col("dop"), F.col("gps_ts").isNotNull(), F.lit(None).cast("double"), F.lit(None).cast("string"))
    gnss = geo.gnss_score(F.col("gps_status"), F.col("gps_mode"), F.col("gps_satellites"), F.col("dop"))
    seen = good.where("heading is not null").withColumn("fov", geo.fields_of_view(geo.effective_focal_length(F.col("focal_35mm"), F.col("focal_mm"))))
    crossed = own.where(F.to_date("gps_ts") != F.to_date("original"))
    out = [
        add(bad, "gps_fix_uninitialized", F.concat_ws(",", "lat", "lon")),
        add(good, "gps_coordinates_claimed", F.to_json(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "altitude_m", geo.dms_text(F.col("lat"), F.col("lon")).alias("dms"))), "observed"),
        add(good.where("altitude_m is not null"), "gps_altitude_claimed", F.col("altitude_m"), "observed"),
        add(good, "gps_sensor_telemetry_integrity", F.round(gnss, 2)),
        add(sun, "solar_position_expected", F.to_json(F.struct("sun.elevation", "sun.azimuth", "phase"))),
        add(lit, "astronomical_shadow_geometry", F.to_json("shade")),
        add(seen, "optical_viewing_cone", F.to_json(geo.viewing_cone(F.col("lat"), F.col("lon"), F.col("heading"), F.col("fov.hfov")))),
        add(crossed, "temporal_crosscheck_divergence", F.concat_ws(" / ", F.col("gps_ts").cast("string"), F.col("original").cast("string")), "indicative"),
        add(good, "gps_location_confidence", F.to_json(F.struct(F.round(score, 2).alias("score"), geo.location_level(F.lit("VALID"), score).alias("level")))),
    ]
    if "places" in case:
        near = places.nearest_place(good.select(F.col("sha256").alias("point_id"), "lat", "lon"), case["places"]).withColumnRenamed("point_id", "sha256")
        out.append(add(near, "offline_reverse_geocode", F.to_json(F.struct("place_id", "distance_km", "approximate"))))
    late = case["facts"].join(case["files"].select("sha256", "mtime"), "sha256").where("original is not null").where(timeparse.mtime_before_capture(F.col("mtime"), F.col("original")))
    out.append(add(late, "filesystem_mtime_precedes_capture", F.col("mtime"), "indicative"))
    return records.all_findings(out)


def tier6(case: dict[str, DataFrame]) -> DataFrame:
    with_fields = case["files"].select("sha256").distinct().join(case["fields"].groupBy("sha256").agg(F.count("*").alias("n")), "sha256", "left")
    inverted = case["facts"].where("modified < original")
    thumbs = case["fields"].where("name = 'IFD1:JPEGInterchangeFormat'")
    return records.all_findings([
        finding(with_fields, 6, "metadata_status", "observed", "indicators", F.when(F.col("n") > 0, "present").otherwise("absent")),
        finding(inverted, 6, "indicator_timeline_inversion", "indicative", "indicators", F.concat_ws(" < ", F.col("modified").cast("string"), F.col("original").cast("string")), caveat=CAVEAT),
        finding(thumbs, 6, "indicator_embedded_thumbnail_present", "indicative", "indicators", F.col("value_str"), caveat=CAVEAT),
    ])


PIXELS = "sha256 string, width int, height int, ahash string, dhash string, phash string, colour string, lsb_density double, lsb_anomaly boolean, fft_ratio double, fft_grid boolean, ghost boolean, mosaic boolean, copies int, encrypted boolean, covert double"


def pixels(images: DataFrame) -> DataFrame:
    """Statistics of decoded pictures: rows (sha256, image) of Spark's image source; a picture that can't be read is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rgb = raster.from_image(bytes(r.data), r.height, r.width, r.nChannels)
                low, fft, noise, pov, planes = raster.last_bits(rgb), raster.spectrum_peak(rgb), raster.scrambled(rgb), raster.pairs_of_values(rgb), raster.bit_planes(rgb)
                full = sum(p[0][1] > 0.99 and 0.45 <= p[0][0] <= 0.55 for p in planes)
                jump = sum(p[0][1] > 0.98 and p[1][1] < 0.70 for p in planes)
                risk = 0.1 + (0.35 if full >= 2 else 0.15 * full) + 0.4 * any(x["uniform"] for x in pov) + 0.2 * jump
                rows.append((r.sha256, r.width, r.height, raster.average_hash(rgb), raster.difference_hash(rgb), raster.perceptual_hash(rgb), "#%02x%02x%02x" % raster.mean_colour(rgb), low["density"], low["anomaly"], fft["ratio"], fft["grid"], raster.ghost(rgb)["suspected"], raster.mosaic(rgb)["present"], len(raster.copy_move(rgb)), noise["encrypted"], min(1.0, risk)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIXELS.split(", ")])

    flat = images.where("image.nChannels in (1, 3, 4) and image.height > 0").select("sha256", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, PIXELS)


def tier7(case: dict[str, DataFrame]) -> DataFrame:
    if "pixels" not in case:
        return finding(case["files"].limit(0), 7, "image_dimensions", "observed", "raster", F.lit(None))
    p = case["pixels"]
    add = lambda name, value, confidence="indicative": finding(p, 7, name, confidence, "raster", value, caveat=None if confidence == "observed" else "Statistics of pixels; textures and processing can cause them.")
    return records.all_findings([
        add("image_dimensions", F.concat_ws("x", "width", "height"), "observed"),
        add("dominant_color_palette", F.col("colour"), "observed"),
        add("lsb_entropy_screening", F.to_json(F.struct("lsb_density", "lsb_anomaly"))),
        add("fft_synthetic_artifact_screening", F.to_json(F.struct("fft_ratio", "fft_grid"))),
        add("jpeg_ghost_splicing_analysis", F.col("ghost")),
        add("cfa_bayer_demosaicing_analysis", F.col("mosaic")),
        add("copymove_cloning_analysis", F.col("copies")),
        add("encrypted_or_scrambled_image", F.to_json(F.struct("encrypted"))),
    ])


BUILT_IN = {1: tier1, 2: tier2, 3: tier3, 4: tier4, 5: tier5, 6: tier6, 7: tier7}


def opened(files: DataFrame, folder: str | None = None, **more: DataFrame) -> dict[str, DataFrame]:
    """The tables of a case of identified files; ``more`` may have corpus, places and images (sha256, image).

    The walk and the parse, which all tiers read, are done once: written to ``folder`` and reread, or else
    kept by Spark, which computes lost parts again from the files.
    """

    held = []

    def once(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return held[-1]
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    walked = once(sources.events(files), "events")
    case = {"files": files, "units": sources.units(walked), "blocks": sources.blocks(walked)}
    parsed = once(sources.parsed(case["blocks"]), "parsed")
    case |= {"fields": sources.fields(parsed), "diagnostics": sources.diagnostics(walked, parsed)} | more
    case["facts"] = once(facts(case["fields"]), "facts")
    if "images" in more:
        case["pixels"] = once(pixels(more["images"]), "pixels")
    return Case(case, held)


class Case(dict):
    """The tables of a case by name; ``close`` frees those that Spark keeps."""

    def __init__(self, tables: dict[str, DataFrame], held: list[DataFrame]):
        super().__init__(tables)
        self.held = held

    def close(self) -> None:
        while self.held:
            self.held.pop().unpersist()


def findings(case: dict[str, DataFrame], tiers: tuple[int, ...] = TIERS) -> DataFrame:
    parts = [BUILT_IN[t](case) for t in tiers] + [fn(case) for tier, fn in ANALYSERS.values() if tier in tiers]
    return records.all_findings(parts)


def signals(case: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """The signals of verdicts, one row per file, folded from findings."""
    has = lambda name: F.max(F.col("name") == name)
    value = lambda name, path: F.get_json_object(F.min_by("value", F.when(F.col("name") == name, F.col("ordinal"))), f"$.{path}")
    truth = lambda name, path: F.coalesce(value(name, path).try_cast("boolean"), F.lit(False))
    attributed = lambda path: value("encoder_attribution", path)
    folded = found.groupBy("sha256").agg(
        has("trailing_data_detected").alias("trailing"),
        has("indicator_timeline_inversion").alias("inversion"),
        truth("lsb_entropy_screening", "lsb_anomaly").alias("lsb_anomaly"),
        truth("fft_synthetic_artifact_screening", "fft_grid").alias("fft_grid"),
        truth("encrypted_or_scrambled_image", "encrypted").alias("encrypted"),
        F.coalesce(attributed("outcome") == "AMBIGUOUS", F.lit(False)).alias("ambiguous"),
        F.from_json(attributed("categories"), "array<string>").alias("collision_categories"),
        F.when(attributed("outcome") != "INSUFFICIENT", attributed("entry_id")).alias("device_model"),
        F.when(attributed("outcome") != "INSUFFICIENT", attributed("category")).alias("category"),
        has("c2pa_manifest_presence").alias("c2pa"),
        has("gps_coordinates_claimed").alias("gps"),
        has("gps_fix_uninitialized").alias("gps_uninitialized"),
        value("gps_location_confidence", "level").alias("gps_level"),
    )
    meta = case["fields"].select("sha256").distinct().withColumn("has_metadata", F.lit(True))
    return case["files"].select("sha256").distinct().join(folded, "sha256", "left").join(meta, "sha256", "left")


def verdicts(case: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    return verdict.with_verdict(signals(case, found)).select("sha256", "encoder_kind", "verdict_label", "is_authentic", "confidence_score", "risk_level")


def events(case: dict[str, DataFrame], case_id: Column | None = None) -> DataFrame:
    """Events of a case for timelines: (case_id, ordinal, ts, source, lat, lon, sha256, file_name).

    Ordinals grow in order of paths; they come from a sort in ranges, so a collection is many tasks, and have gaps where a range ends.
    """
    f = case["files"].join(case["facts"], "sha256", "left")
    chosen = timeparse.primary(F.col("original"), F.col("modified"), F.col("mtime"))
    rows = f.withColumns({"_p": chosen, "case_id": F.lit("case") if case_id is None else case_id})
    rows = rows.orderBy("case_id", "path", "sha256").withColumn("ordinal", F.monotonically_increasing_id() + 1)
    return rows.select("case_id", "ordinal", F.col("_p.ts").alias("ts"), F.col("_p.source").alias("source"), "lat", "lon", "sha256", F.element_at(F.split("path", "/"), -1).alias("file_name"))


DIFFERENCE = "pair_id string, altered double, ssim double, same_pixels boolean"


def compared(case: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """How the files of each pair (pair_id, a, b: hashes) differ, from bytes to pixels, and the verdict.

    (pair_id, a, b, size_delta, sha256_match, data_match, ahash_distance, dhash_distance, phash_distance, dqt_distance,
    dqt_similarity, altered, ssim, verdict); pixels count only in a case that has images.
    """
    sizes = case["files"].groupBy("sha256").agg(F.max("length").alias("length"))
    data = tier4({"files": case["files"].dropDuplicates(["sha256"])}).where("name = 'image_data_stream_sha256'").select("sha256", F.col("value").alias("data"))
    tables = quant_of(case).select(F.col("print_id").alias("sha256"), "lum")
    one = sizes.join(data, "sha256", "left").join(tables, "sha256", "left")
    looks = ("ahash", "dhash", "phash")
    if "pixels" in case:
        one = one.join(case["pixels"].select("sha256", *[bits.hex_to_long(F.col(c)).alias(c) for c in looks]).dropDuplicates(["sha256"]), "sha256", "left")
    else:
        one = one.withColumns(dict.fromkeys(looks, F.lit(None).cast("long")))
    side = lambda k: one.select(*[F.col(c).alias(f"{c}_{k}") for c in one.columns])
    both = pairs.join(side("a"), F.col("a") == F.col("sha256_a")).join(side("b"), F.col("b") == F.col("sha256_b"))
    if "images" in case:
        both = both.join(pixel_differences(case["images"], pairs), "pair_id", "left")
    else:
        both = both.withColumns({"altered": F.lit(None).cast("double"), "ssim": F.lit(None).cast("double"), "same_pixels": F.lit(None).cast("boolean")})
    table = records.table_distance(F.col("lum_a"), F.col("lum_b"))
    far = {f"{c}_distance": bits.hamming(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in looks}
    out = both.withColumns({"size_delta": F.col("length_b") - F.col("length_a"), "sha256_match": F.col("a") == F.col("b"), "data_match": F.coalesce(F.col("data_a") == F.col("data_b"), F.lit(False)), "_t": table, **far})
    verdict_ = records.diff_verdict(F.col("sha256_match"), F.col("data_match"), F.col("same_pixels"), F.col("altered"), F.col("ssim"), F.col("phash_distance"))
    return out.select("pair_id", "a", "b", "size_delta", "sha256_match", "data_match", *far, F.col("_t.distance").alias("dqt_distance"), F.col("_t.similarity").alias("dqt_similarity"), "altered", "ssim", verdict_.alias("verdict"))


def pixel_differences(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, altered, ssim, same_pixels) of pairs whose pictures both decode; a pair of pictures is in memory at a time."""
    side = lambda k: images.where("image.nChannels in (1, 3, 4) and image.height > 0").select(F.col("sha256").alias(k), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias(f"i{k}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x, y = (raster.from_image(bytes(i["data"]), i["height"], i["width"], i["nChannels"]) for i in (r.ia, r.ib))
                d = raster.difference(x, y)
                rows.append((r.pair_id, d.get("altered_pct"), d.get("ssim"), d.get("identical")))
            yield pd.DataFrame(rows, columns=["pair_id", "altered", "ssim", "same_pixels"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("pair_id", "ia", "ib").mapInPandas(run, DIFFERENCE)
