"""Verdicts on records from their findings' signals.

One row per record with these signals (null is unknown): trailing, inversion, lsb_anomaly, fft_grid, encrypted, ambiguous,
collision_categories, device_model, category, c2pa, gps, gps_uninitialized, gps_level, has_metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of signals, then words that name kinds of encoders.
BASE, TRAILING, INVERSION, LSB = 0.50, 0.35, 0.20, 0.15
HARDWARE, C2PA, GPS = 0.25, 0.20, 0.10
GENERATED, GRID_MOST, AMBIGUOUS_MOST, EDITED, TRANSCODED, AUTHENTIC_LEAST = 0.10, 0.20, 0.30, 0.40, 0.50, 0.90
CAMERAS = "iPhone Galaxy Pixel Canon Nikon Sony Fujifilm Xiaomi Redmi OnePlus Oppo Huawei GoPro DJI Panasonic Olympus Ricoh Leica Hasselblad Ring Nest Vivo Motorola Nothing".split()
GENERATORS = ["Midjourney", "Stable Diffusion", "DALL-E", "DALL·E", "Firefly", "Imagen", "Flux", "AI Generator", "ai_generator"]
EDITORS = ["Photoshop", "Lightroom", "Capture One", "Affinity Photo", "DxO", "Luminar"]
CODECS = "GIMP MozJPEG IJG libjpeg Pillow ImageMagick codec_library".split()
SOCIAL = "WhatsApp Telegram Twitter Discord Instagram Signal Facebook Snapchat TikTok LinkedIn social_media".split()


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def encoder_kind() -> Column:
    """What the attribution says: words in the model's name or the category, kind by kind."""
    model, category = F.coalesce("device_model", F.lit("")), F.coalesce("category", F.lit(""))
    kinds = (("generator", GENERATORS, "ai_generator"), ("editor", EDITORS, "editing_software"), ("codec", CODECS, "codec_library"), ("camera", CAMERAS, "camera_hardware"), ("social", SOCIAL, "social_media"))
    known = F.col("device_model").isNotNull() | F.col("category").isNotNull()
    fits = lambda words, c: reduce(lambda a, b: a | b, [model.contains(w) for w in words]) | (category == c)
    kind = F.coalesce(*[F.when(fits(words, c), name) for name, words, c in kinds], F.lit("other"))
    mixed = F.when(F.array_contains(F.coalesce("collision_categories", F.array().cast("array<string>")), "ai_generator"), "ambiguous_generator").otherwise("ambiguous")
    return F.when(_yes("ambiguous"), mixed).when(known, kind).otherwise("none")


def with_verdict(records: DataFrame) -> DataFrame:
    """Adds encoder_kind, verdict_label, is_authentic, confidence_score and risk_level. Later evidence replaces what earlier evidence scored where it is decisive."""
    out = records.withColumn("encoder_kind", encoder_kind())
    kind = F.col("encoder_kind")
    score = BASE - F.when(_yes("trailing"), TRAILING).otherwise(0.0) - F.when(_yes("inversion"), INVERSION).otherwise(0.0) - F.when(_yes("lsb_anomaly"), LSB).otherwise(0.0)
    score = F.when(_yes("fft_grid"), F.least(score, F.lit(GRID_MOST))).otherwise(score)
    score = (
        F.when(kind == "ambiguous_generator", F.least(score, F.lit(AMBIGUOUS_MOST)))
        .when(kind == "generator", GENERATED)
        .when(kind == "editor", EDITED)
        .when(kind.isin("codec", "social"), TRANSCODED)
        .when(kind == "camera", score + HARDWARE)
        .otherwise(score)
    )
    located = _yes("gps") & ~_yes("gps_uninitialized") & ~F.coalesce(F.col("gps_level").isin("REJECTED", "LOW"), F.lit(False))
    score = score + F.when(_yes("c2pa"), C2PA).otherwise(0.0) + F.when(located, GPS).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    generated = _yes("fft_grid") | kind.isin("generator", "ambiguous_generator")
    camera, meta = kind == "camera", _yes("has_metadata")
    label = (
        F.when(_yes("encrypted"), "ENCRYPTED_OR_SCRAMBLED_CARRIER")
        .when(_yes("trailing"), "TAMPERED_TRAILING_PAYLOAD")
        .when(generated, "AI_SYNTHETIC_GENERATION")
        .when(camera & ~_yes("inversion") & meta, "AUTHENTIC_CAMERA_CAPTURE")
        .when(~meta & ~camera, "UNVERIFIED_METADATA_STRIPPED")
        .when(_yes("inversion"), "MODIFIED_METADATA_INCONSISTENT")
        .otherwise("INCONCLUSIVE_SIGNALS")
    )
    out = out.withColumns({"verdict_label": label, "_score": score})
    label = F.col("verdict_label")
    usual = F.when(kind == "editor", "MEDIUM").when(_yes("inversion"), "MEDIUM").otherwise("LOW")
    risk = (
        F.when(label == "TAMPERED_TRAILING_PAYLOAD", "CRITICAL")
        .when(label.isin("ENCRYPTED_OR_SCRAMBLED_CARRIER", "AI_SYNTHETIC_GENERATION"), "HIGH")
        .when(label.isin("UNVERIFIED_METADATA_STRIPPED", "MODIFIED_METADATA_INCONSISTENT"), "MEDIUM")
        .when(label == "AUTHENTIC_CAMERA_CAPTURE", "LOW")
        .otherwise(usual)
    )
    authentic = F.when(label == "AUTHENTIC_CAMERA_CAPTURE", True).when(label.isin("TAMPERED_TRAILING_PAYLOAD", "AI_SYNTHETIC_GENERATION", "MODIFIED_METADATA_INCONSISTENT"), False).when((label == "INCONCLUSIVE_SIGNALS") | (label == "UNVERIFIED_METADATA_STRIPPED"), F.lit(None).cast("boolean"))
    score = F.when(label == "AUTHENTIC_CAMERA_CAPTURE", F.greatest("_score", F.lit(AUTHENTIC_LEAST))).otherwise(F.col("_score"))
    return out.withColumns({"is_authentic": authentic, "confidence_score": F.round(score, 2), "risk_level": risk}).drop("_score")
