"""What files carry beside their picture: trailing data, previews, thumbnails, motion clips; and files without it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.operators import bytestats
from casegrain.sources import containers, metadata

# JPEG segments and PNG chunks that a cleaned file keeps, WebP chunks that it drops, brands of clips.
KEPT_SEGMENTS = {0xC0, 0xC1, 0xC2, 0xC4, 0xDA, 0xDB, 0xDD, 0xE0, 0xEE}
KEPT_CHUNKS = {b"IHDR", b"PLTE", b"IDAT", b"tRNS", b"IEND"}
DROPPED_RIFF = {b"EXIF", b"XMP ", b"ICCP"}
CLIP_BRANDS = "mp42 isom mp41 avc1 qt iso2 MSNV".split()
EXTENSIONS = {"ZIP_ARCHIVE": "zip", "RAR_ARCHIVE": "rar", "7Z_ARCHIVE": "7z", "PDF_DOCUMENT": "pdf", "JPEG_IMAGE": "jpg", "PNG_IMAGE": "png", "ASCII_TEXT": "txt"}
ARTEFACTS = "sha256 string, kind string, offset long, length long, content binary"


def trailing(files: DataFrame, units: DataFrame) -> DataFrame:
    """(sha256, offset, length, kind, entropy, preview, content, digest) of data past a file's end."""
    at = units.where("name = 'TRAILING_DATA'").select("sha256", "offset", "length").distinct()
    rows = files.select("sha256", "content").dropDuplicates(["sha256"]).join(at, "sha256")
    own = F.expr("substring(content, int(offset) + 1, int(length))")
    rows = rows.select("sha256", "offset", "length", own.alias("content"))
    blobs = rows.select(F.col("sha256").alias("id"), F.hex("content").alias("hex"))
    bits = bytestats.entropy(blobs).select(F.col("id").alias("sha256"), F.round("entropy", 4).alias("entropy"))
    out = rows.join(bits, "sha256")
    head = F.hex(F.substring("content", 1, 4096))
    return out.select("sha256", "offset", "length", bytestats.payload_kind(head, F.col("entropy")).alias("kind"), "entropy", F.substring(head, 1, 64).alias("preview"), "content", F.sha2("content", 256).alias("digest"))


def carved_name(stem: Column, offset: Column, kind: Column) -> Column:
    ext = F.coalesce(*[F.when(kind == k, v) for k, v in EXTENSIONS.items()], F.lit("bin"))
    return F.concat(safe_name(stem), F.lit("_carved_0x"), F.lower(F.hex(offset)), F.lit("."), ext)


def safe_name(name: Column) -> Column:
    """A file name without path, control and other unsafe characters."""
    own = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"[^A-Za-z0-9._-]", "_")
    return F.when(F.trim(F.regexp_replace(own, r"[._]", "")) == "", F.lit("unnamed")).otherwise(own)


def cleaned(form: str, data: bytes) -> bytes | None:
    """A JPEG, PNG or WebP without metadata; None for other formats and for files that can't be walked to their end."""
    events = list(containers.walk(form, data))
    if form not in ("JPEG", "PNG", "WEBP") or any(e[0] == "note" for e in events):
        return None
    units = [e for e in events if e[0] == "unit" and e[1] != "TRAILING_DATA"]
    if form == "PNG":
        return data[:8] + b"".join(data[u[2] : u[2] + u[3]] for u in units[1:] if data[u[2] + 4 : u[2] + 8] in KEPT_CHUNKS)
    if form == "WEBP":
        body = b""
        for u in units[1:]:
            part = bytearray(data[u[2] : u[2] + u[3] + u[3] % 2])
            if bytes(part[:4]) in DROPPED_RIFF:
                continue
            if part[:4] == b"VP8X":
                part[8] &= ~0b0010_1100  # ICC, EXIF and XMP flags
            body += bytes(part)
        return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    out, end = b"\xff\xd8", next(u[2] for u in units if u[1] == "EOI")
    scan = False
    for u, after in zip(units[1:], [*units[2:], None], strict=True):
        code = data[u[2] + 1]
        scan = scan or code == 0xDA
        if code in KEPT_SEGMENTS or 0xD0 <= code <= 0xD7:
            # Entropy-coded data follow a scan's header and restart markers.
            last = (after[2] if after else end) if code == 0xDA or 0xD0 <= code <= 0xD7 else u[2] + u[3]
            out += data[u[2] : last]
    return out + b"\xff\xd9" if scan else None


def clean(files: DataFrame) -> DataFrame:
    """(sha256, cleaned, cleaned_sha256); null where a file can't be cleaned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"sha256": pdf["sha256"], "cleaned": [cleaned(f, bytes(c)) for f, c in zip(pdf["format"], pdf["content"], strict=True)]})

    out = files.where("content is not null").select("sha256", "format", "content").mapInPandas(run, "sha256 string, cleaned binary")
    return out.withColumn("cleaned_sha256", F.sha2("cleaned", 256))


def thumbnail(exif: bytes) -> tuple[int, bytes] | None:
    """The JPEG that the second directory of an EXIF block points to."""
    rows = {r[1]: r[2] for r in metadata.exif(exif) if r[0] == "EXIF"}
    at, size = rows.get("IFD1:JPEGInterchangeFormat", ""), rows.get("IFD1:JPEGInterchangeFormatLength", "")
    if at.isdigit() and size.isdigit():
        body = exif[int(at) : int(at) + int(size)]
        if body[:2] == b"\xff\xd8":
            return int(at), body
    return None


def preview(data: bytes) -> tuple[int, bytes] | None:
    """The first JPEG inside a file, past its first eight bytes."""
    at = data.find(b"\xff\xd8\xff", 8)
    end = data.find(b"\xff\xd9", at) if at >= 0 else -1
    return (at, data[at : end + 2]) if end >= 0 else None


def clip(data: bytes, xmp_offset: int | None = None) -> tuple[int, str] | None:
    """Where a motion photo's clip begins, and its kind: by the offset from the end that XMP tells, or by the last ftyp box of a known brand."""
    if xmp_offset and 0 < xmp_offset < len(data) and data[-xmp_offset + 4 : -xmp_offset + 8] == b"ftyp":
        return len(data) - xmp_offset, "mp4"
    at = data.find(b"ftyp", 16)
    while at >= 0:
        brand = data[at + 4 : at + 8].decode("latin-1").strip()
        if brand in CLIP_BRANDS:
            return at - 4, "mov" if brand == "qt" else "mp4"
        at = data.find(b"ftyp", at + 4)
    return None


def xmp_clip_offset(fields: dict[str, str]) -> int | None:
    for name in ("xmp:MicroVideoOffset", "xmp:Length"):
        if fields.get(name, "").isdigit():
            return int(fields[name])
    return None


def extract(files: DataFrame) -> DataFrame:
    """All artefacts of each file: thumbnails, previews, embedded images, raw metadata blocks, clips, trailing data."""

    def found(form: str, data: bytes) -> Iterator[tuple]:
        xmp: dict[str, str] = {}
        for e in containers.walk(form, data):
            if e[0] == "block":
                _, kind, offset, body, _ = e
                yield ("embedded_image" if kind == "EMBEDDED_IMAGE" else f"block_{kind.lower()}", offset, body)
                if kind == "EXIF" and (thumb := thumbnail(body)):
                    yield ("thumbnail", offset + thumb[0], thumb[1])
                if kind == "XMP":
                    xmp |= {r[1]: r[2] for r in metadata.xmp(body) if r[0] == "XMP"}
            elif e[0] == "unit" and e[1] == "TRAILING_DATA":
                yield ("trailing", e[2], data[e[2] : e[2] + e[3]])
        if form in ("JPEG", "TIFF") and (inner := preview(data)):
            yield ("preview", *inner)
        if form in ("JPEG", "HEIC") and (motion := clip(data, xmp_clip_offset(xmp))) and form == "JPEG":
            yield (f"clip_{motion[1]}", motion[0], data[motion[0] :])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(sha, kind, at, len(body), body) for sha, form, content in zip(pdf["sha256"], pdf["format"], pdf["content"], strict=True) for kind, at, body in found(form, bytes(content))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ARTEFACTS.split(", ")])

    return files.select("sha256", "format", "content").mapInPandas(run, ARTEFACTS)


def data_hash(form: str, data: bytes) -> str | None:
    """SHA-256 of the picture's own data: a JPEG's scans, all of a PNG's IDAT chunks."""
    import hashlib

    units = [e for e in containers.walk(form, data) if e[0] == "unit"]
    if form == "PNG":
        body = b"".join(data[u[4] : u[4] + u[5]] for u in units if u[1] == "IDAT")
    elif form == "JPEG":
        start = next((u[2] + u[3] for u in units if u[1] == "SOS"), None)
        end = next((u[2] for u in units if u[1] == "EOI"), len(data))
        body = data[start:end] if start is not None else b""
    else:
        return None
    return hashlib.sha256(body).hexdigest() if body else None
