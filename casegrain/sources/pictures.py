"""Pictures in and out: Spark's image source for reading, a plain PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def png(rgb: np.ndarray) -> bytes:
    """An RGB or RGBA raster of bytes as a PNG."""
    height, width, channels = rgb.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate((np.zeros((height, 1), np.uint8), np.ascontiguousarray(rgb).reshape(height, width * channels)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decoded(spark: SparkSession, targets: list[str]) -> DataFrame:
    """(path, image) of pictures that Spark's image source can read; others are left out."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(targets)
    # The image source writes file:///a where the binary source writes file:/a.
    return rows.select(F.regexp_replace("image.origin", r"^(\w+):///", "$1:/").alias("path"), "image")


def pixel(image, y: int, x: int):
    """The RGB of a pixel of an image column; null outside."""
    at = (F.lit(y) * image["width"] + x) * image["nChannels"]
    byte = lambda k: F.conv(F.hex(F.substring(image["data"], at + 1 + k, F.lit(1))), 16, 10).cast("int")
    inside = (F.lit(y) < image["height"]) & (F.lit(x) < image["width"]) & (image["nChannels"] >= 3)
    return F.when(inside, F.array(byte(2), byte(1), byte(0)))
