"""Statistics of bytes: formats by leading bytes, entropy, payloads, bit planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading bytes in hex, in the order in which they are tried; brands of ISO media; expected suffixes.
MAGIC = (("FFD8FF", "JPEG"), ("89504E470D0A1A0A", "PNG"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("474946383761", "GIF"), ("474946383961", "GIF"), ("424D", "BMP"), ("38425053", "PSD"))
HEIC_BRANDS, AVIF_BRANDS = ["heic", "heix", "hevc", "hevx", "heim", "heis", "mif1"], ["avif", "avis"]
SUFFIXES = {"JPEG": ["jpg", "jpeg", "jpe", "jfif"], "PNG": ["png"], "TIFF": ["tif", "tiff", "dng", "nef", "cr2", "arw"], "WEBP": ["webp"], "HEIC": ["heic", "heif"], "AVIF": ["avif"], "GIF": ["gif"], "BMP": ["bmp", "dib"], "PSD": ["psd"], "PPTX": ["pptx"], "DOCX": ["docx"], "XLSX": ["xlsx"], "ZIP": ["zip"], "SVG": ["svg"]}
MIME = {"JPEG": "image/jpeg", "PNG": "image/png", "TIFF": "image/tiff", "WEBP": "image/webp", "HEIC": "image/heic", "AVIF": "image/avif", "GIF": "image/gif", "BMP": "image/bmp", "PSD": "image/vnd.adobe.photoshop", "SVG": "image/svg+xml", "ZIP": "application/zip"}
PAYLOADS = (("504B0304", "ZIP_ARCHIVE"), ("52617221", "RAR_ARCHIVE"), ("377ABCAF271C", "7Z_ARCHIVE"), ("25504446", "PDF_DOCUMENT"), ("FFD8FF", "JPEG_IMAGE"), ("89504E47", "PNG_IMAGE"))
HEAD, OFFICE_HEAD = 64, 65_536
HIGH_ENTROPY, LOW_ENTROPY = 7.5, 2.0


def sniffed(head: Column) -> Column:
    """The format from a file's first bytes in hex (upper case); UNKNOWN if none fits. Office files are told by names in the archive's start."""
    begins = lambda h: head.startswith(h)
    has = lambda text: head.contains(text.encode().hex().upper())
    brand = F.substring(head, 17, 8)
    brands = lambda names: brand.isin([n.encode().hex().upper() for n in names])
    box = F.substring(head, 9, 8) == "66747970"
    out = F.when(begins(MAGIC[0][0]), MAGIC[0][1])
    for magic, name in MAGIC[1:4]:
        out = out.when(begins(magic), name)
    out = out.when(begins("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP").when(box & brands(HEIC_BRANDS), "HEIC").when(box & brands(AVIF_BRANDS), "AVIF")
    for magic, name in MAGIC[4:]:
        out = out.when(begins(magic), name)
    zipped = begins("504B0304")
    out = out.when(zipped & has("ppt/"), "PPTX").when(zipped & has("word/"), "DOCX").when(zipped & has("xl/"), "XLSX").when(zipped, "ZIP")
    return out.when(has("<svg"), "SVG").otherwise("UNKNOWN")


def head_of(content: Column) -> Column:
    """What ``sniffed`` needs of a file: its first 64 KB in hex."""
    return F.hex(F.substring(content, 1, OFFICE_HEAD))


def mime_type(form: Column) -> Column:
    return F.coalesce(*[F.when(form == k, v) for k, v in MIME.items()], F.lit("application/octet-stream"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mismatched(form: Column, path: Column) -> Column:
    """Whether a known format has another suffix; a path without suffix matches."""
    fits = F.coalesce(*[F.when(form == k, suffix(path).isin(v)) for k, v in SUFFIXES.items()], F.lit(True))
    return (suffix(path) != "") & ~fits


def byte_counts(blobs: DataFrame) -> DataFrame:
    """(id, byte, n): a histogram for each blob (id, hex); ids are unique. Counted in numpy where the blob is, without a shuffle."""

    @F.pandas_udf("array<bigint>")
    def counted(column: pd.Series) -> pd.Series:
        return column.map(lambda h: np.bincount(np.frombuffer(bytes.fromhex(h), np.uint8), minlength=256) if h else np.zeros(0, np.int64))

    rows = blobs.select("id", F.posexplode(counted("hex")).alias("v", "n")).where("n > 0")
    return rows.select("id", F.lpad(F.hex("v"), 2, "0").alias("byte"), "n")


def entropy(blobs: DataFrame) -> DataFrame:
    """(id, n_bytes, entropy): Shannon entropy in bits a byte, 0 for empty blobs."""
    counts = byte_counts(blobs)
    sums = counts.groupBy("id").agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    out = blobs.select("id").join(sums, "id", "left")
    value = F.when(F.col("n_bytes") > 0, F.log2("n_bytes") - F.col("s") / F.col("n_bytes")).otherwise(0.0)
    return out.select("id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), value.alias("entropy"))


def payload_kind(head: Column, bits: Column) -> Column:
    """What trailing bytes are: by magic, as printable text, by entropy."""
    out = F.when(head.startswith(PAYLOADS[0][0]), PAYLOADS[0][1])
    for magic, name in PAYLOADS[1:]:
        out = out.when(head.startswith(magic), name)
    text = head.rlike("^(?:0[9AD]|[2-6][0-9A-F]|7[0-9A-E])++$")
    return out.when(text, "ASCII_TEXT").when(bits > HIGH_ENTROPY, "ENCRYPTED_OR_COMPRESSED").when(bits < LOW_ENTROPY, "PADDING").otherwise("BINARY_DATA")


def plane_density(blobs: DataFrame) -> DataFrame:
    """(id, plane, density, entropy) of the eight bit planes of a channel's bytes."""
    value = F.conv("byte", 16, 10).cast("int")
    counts = byte_counts(blobs).select("id", "n", value.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("plane"))
    ones = counts.groupBy("id", "plane").agg((F.sum(F.col("n") * F.expr("shiftright(v, plane) & 1")) / F.sum("n")).alias("density"))
    p = F.col("density")
    bits = F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    return ones.withColumn("entropy", bits)


def pair_of_values(blobs: DataFrame) -> DataFrame:
    """(id, chi_square, dof, uniform): the chi-square test of pairs of values that differ in the last bit."""
    counts = byte_counts(blobs).withColumn("v", F.conv("byte", 16, 10).cast("int"))
    pairs = counts.groupBy("id", F.expr("v div 2").alias("pair")).agg(F.sum("n").alias("both"), F.sum(F.when(F.col("v") % 2 == 0, F.col("n")).otherwise(0)).alias("even"))
    expected = F.col("both") / 2.0
    part = (F.col("even") - expected) * (F.col("even") - expected) / expected
    out = pairs.where(expected > 5).groupBy("id").agg(F.sum(part).alias("chi_square"), F.count("*").alias("dof"))
    return out.withColumn("uniform", (F.col("dof") > 30) & (F.col("chi_square") < 0.4 * F.col("dof")))


def covert_risk(high_planes: Column, uniform_channels: Column, discontinuities: Column) -> Column:
    """Risk of hidden data from counts of channels: full last planes, even pairs of values, a jump between planes."""
    score = 0.1 + F.when(high_planes >= 2, 0.35).when(high_planes == 1, 0.15).otherwise(0.0) + F.when(uniform_channels > 0, 0.4).otherwise(0.0) + 0.2 * discontinuities
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def covert_verdict(score: Column) -> Column:
    return F.when(score >= 0.7, "SUSPECTED_COVERT_STEGANOGRAPHY").when(score >= 0.4, "POSSIBLE_LSB_MANIPULATION").otherwise("CLEAN_NATURAL_ENTROPY")
