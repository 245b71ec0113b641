"""Parsers: metadata blocks to fields.

A parser is a generator over a block's bytes of (standard, name, value, value_type, tag_id, offset); offsets are in the
file. A bad block gives what could be read and a ("!", message) row.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

# Limits, then names of tags.
MOST_DIRECTORIES, MOST_ENTRIES, MOST_DEPTH, MOST_VALUES, MOST_RATIONALS = 50, 1024, 10, 128, 32
MOST_XML, MOST_TEXT, NOTES = 2 << 20, 1 << 20, 200
IMAGE_TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "ExifOffset", 0x8822: "ExposureProgram", 0x8825: "GPSInfo",
    0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote",
    0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension",
    0xA003: "PixelYDimension", 0xA005: "InteropOffset", 0xA405: "FocalLengthIn35mmFilm", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
GPS_TAGS = {
    0x00: "GPSVersionID",
    0x01: "GPSLatitudeRef",
    0x02: "GPSLatitude",
    0x03: "GPSLongitudeRef",
    0x04: "GPSLongitude",
    0x05: "GPSAltitudeRef",
    0x06: "GPSAltitude",
    0x07: "GPSTimeStamp",
    0x08: "GPSSatellites",
    0x09: "GPSStatus",
    0x0A: "GPSMeasureMode",
    0x0B: "GPSDOP",
    0x0C: "GPSSpeedRef",
    0x0D: "GPSSpeed",
    0x0E: "GPSTrackRef",
    0x0F: "GPSTrack",
    0x10: "GPSImgDirectionRef",
    0x11: "GPSImgDirection",
    0x12: "GPSMapDatum",
    0x1D: "GPSDateStamp",
    0x1E: "GPSDifferential",
    0x1F: "GPSHPositioningError",
}
INTEROP_TAGS = {0x0001: "InteroperabilityIndex", 0x0002: "InteroperabilityVersion", 0x1000: "RelatedImageFileFormat", 0x1001: "RelatedImageWidth", 0x1002: "RelatedImageLength"}
IPTC_TAGS = {5: "ObjectName", 25: "Keywords", 55: "DateCreated", 60: "TimeCreated", 80: "Byline (Author)", 85: "BylineTitle", 90: "City", 95: "Province/State", 101: "CountryName", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 120: "Caption/Abstract"}
ACTIONS = ["c2pa.created", "c2pa.edited", "c2pa.opened", "c2pa.placed", "c2pa.published", "c2pa.transcoded", "c2pa.converted", "c2pa.resized"]
# makers' blobs: leading bytes, length of the header, names of entries.
MAKERS = (
    (b"Nikon\0\x02", 10, "Nikon", {0x0001: "NikonMakerNoteVersion", 0x0002: "NikonISOSetting", 0x001D: "NikonSerialNumber", 0x0084: "NikonLensInfo", 0x00A7: "NikonShutterCount"}),
    (b"Nikon\0\x01", 8, "Nikon", {0x0001: "NikonMakerNoteVersion", 0x0002: "NikonISOSetting", 0x001D: "NikonSerialNumber", 0x0084: "NikonLensInfo", 0x00A7: "NikonShutterCount"}),
    (b"Apple iOS\0", 14, "Apple", {0x0001: "AppleMakerNoteVersion", 0x0003: "AppleRunTime", 0x000E: "AppleHDRImageType", 0x0017: "AppleSceneFlags"}),
    (b"SONY DSC \0", 12, "Sony", {0x2001: "SonyModelID", 0x2010: "SonySequenceNumber"}),
    (b"SONY MOBILE\0", 12, "Sony", {0x2001: "SonyModelID", 0x2010: "SonySequenceNumber"}),
    (b"", 0, "Canon", {0x0001: "CanonCameraSettings", 0x0004: "CanonShotInfo", 0x0006: "CanonImageType", 0x0007: "CanonFirmwareVersion", 0x000C: "CanonSerialNumber", 0x0095: "CanonLensModel"}),
)
MOST_MAKER_ENTRIES = 256
SUBDIRECTORIES = {0x8769: ("ExifSubIFD", IMAGE_TAGS), 0x8825: ("GPS", GPS_TAGS), 0xA005: ("Interop", INTEROP_TAGS)}
TYPES = {1: ("BYTE", 1, "B"), 2: ("ASCII", 1, "s"), 3: ("SHORT", 2, "H"), 4: ("LONG", 4, "I"), 5: ("RATIONAL", 8, "II"), 7: ("UNDEFINED", 1, "s"), 9: ("SLONG", 4, "i"), 10: ("SRATIONAL", 8, "ii")}

Row = tuple


def _value(raw: bytes, kind: int, order: str) -> tuple[str, str]:
    """Text and type of an entry's bytes."""
    name, size, code = TYPES.get(kind, (f"TYPE_{kind}", 1, "s"))
    if name == "ASCII":
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip(), name
    if code == "s":
        text = raw.rstrip(b"\0")
        plain = text.isascii() and all(32 <= c < 127 for c in text)
        return (text.decode("ascii") if plain and len(text) <= 64 else f"{len(raw)} bytes"), name
    n = min(len(raw) // size, MOST_RATIONALS if size == 8 else MOST_VALUES)
    if len(raw) > size and name != "BYTE":
        name += "[]"
    flat = struct.unpack(order + code * n, raw[: n * size])
    if size == 8:
        pairs = [f"{a}/{b}" for a, b in zip(flat[::2], flat[1::2], strict=True)]
        return ", ".join(pairs), name
    return ", ".join(map(str, flat)), name


def maker_note(blob: bytes, order: str, offset: int = 0) -> Iterator[Row]:
    """Entries of a maker's directory, where the blob is one of a known maker's; places are the blob's own."""
    _, skip, maker, names = next(m for m in MAKERS if blob.startswith(m[0]))
    own, at = blob[skip:], 0
    if maker == "Nikon" and own[:2] in (b"II", b"MM") and len(own) >= 8:
        order = "<" if own[:2] == b"II" else ">"
        at = struct.unpack(order + "I", own[4:8])[0]
    count = struct.unpack(order + "H", own[at : at + 2])[0] if at + 2 <= len(own) else 0
    if not 0 < count <= MOST_MAKER_ENTRIES or at + 2 + 12 * count > len(own):
        return
    for k in range(count):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack(order + "HHI", own[entry : entry + 8])
        size = n * TYPES.get(kind, ("", 1, ""))[1]
        place = entry + 8 if size <= 4 else struct.unpack(order + "I", own[entry + 8 : entry + 12])[0]
        if place + size <= len(own):
            text, name = _value(own[place : place + size], kind, order)
            yield ("EXIF", f"MakerNote:{names.get(tag, f'{maker}Tag_0x{tag:04X}')}", text, name, f"0x{tag:04x}", offset + skip + place)


def exif(data: bytes, offset: int = 0) -> Iterator[Row]:
    """The directories of an EXIF block, the main one's names bare, others' with the directory's name before them."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        yield ("!", "no byte order")
        return
    todo, seen = [(struct.unpack(order + "I", data[4:8])[0], "IFD0", IMAGE_TAGS, 0)], set()
    while todo:
        at, name, tags, depth = todo.pop(0)
        if not at:
            continue
        if at in seen or depth > MOST_DEPTH or len(seen) >= MOST_DIRECTORIES or at + 2 > len(data):
            yield ("!", f"{name}: a cycle or a place outside the block")
            continue
        seen.add(at)
        count = min(struct.unpack(order + "H", data[at : at + 2])[0], MOST_ENTRIES)
        for k in range(count):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                yield ("!", f"{name} is cut short")
                break
            tag, kind, n = struct.unpack(order + "HHI", data[entry : entry + 8])
            size = n * TYPES.get(kind, ("", 1, ""))[1]
            place = entry + 8 if size <= 4 else struct.unpack(order + "I", data[entry + 8 : entry + 12])[0]
            if place + size > len(data):
                yield ("!", f"{name}:0x{tag:04X} lies outside the block")
                continue
            if tag in SUBDIRECTORIES and tags is IMAGE_TAGS:
                sub, known = SUBDIRECTORIES[tag]
                todo.append((struct.unpack(order + "I", data[entry + 8 : entry + 12])[0], sub, known, depth + 1))
            label = tags.get(tag, f"Tag_0x{tag:04X}")
            text, kind_name = _value(data[place : place + size], kind, order)
            if label == "MakerNote":
                text = f"{size} bytes"
                yield from maker_note(data[place : place + size], order, offset + place)
            yield ("EXIF", label if name == "IFD0" else f"{name}:{label}", text, kind_name, f"0x{tag:04x}", offset + place)
        end = at + 2 + 12 * count
        if name == "IFD0" and end + 4 <= len(data):
            todo.append((struct.unpack(order + "I", data[end : end + 4])[0], "IFD1", IMAGE_TAGS, depth + 1))


def _xml(data: bytes) -> ElementTree.Element:
    text = data.decode("utf-8", "replace")
    text = text[max(0, text.find("<")) : text.rfind(">") + 1]
    if len(text) > MOST_XML:
        raise ValueError("too long")
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.IGNORECASE):
        raise ValueError("declarations are not read")
    return ElementTree.fromstring(text)


def xmp(data: bytes, offset: int = 0) -> Iterator[Row]:
    """Texts of elements and attributes, by local names."""
    try:
        root = _xml(data)
    except (ValueError, ElementTree.ParseError) as e:
        yield ("!", f"XMP: {e}")
        return
    local = lambda n: n.rpartition("}")[2]
    for element in root.iter():
        text = (element.text or "").strip()
        if text and local(element.tag) not in ("RDF", "Description", "xmpmeta"):
            yield ("XMP", f"xmp:{local(element.tag)}", text, "STRING", None, offset)
        for key, value in element.attrib.items():
            if local(key) != "about":
                yield ("XMP", f"xmp:{local(key)}", value, "STRING", None, offset)


def iptc(data: bytes, offset: int = 0) -> Iterator[Row]:
    """Datasets of the application record in the resource 0x0404 of an 8BIM chain, or bare ones."""
    spans, at = [], data.find(b"8BIM")
    while 0 <= at <= len(data) - 12:
        ident, name = int.from_bytes(data[at + 4 : at + 6], "big"), data[at + 6] + 1
        head = at + 6 + name + name % 2
        size = int.from_bytes(data[head : head + 4], "big")
        if ident == 0x0404:
            spans.append((head + 4, min(len(data), head + 4 + size)))
        at = data.find(b"8BIM", head + 4 + size)
    for first, last in spans or [(0, len(data))]:
        at = data.find(b"\x1c", first, last)
        while 0 <= at and at + 5 <= last:
            record, key, size = data[at + 1], data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big")
            if at + 5 + size > last:
                yield ("!", "IPTC: a dataset is cut short")
                break
            if record == 2 and key in IPTC_TAGS:
                yield ("IPTC", f"iptc:{IPTC_TAGS[key]}", data[at + 5 : at + 5 + size].decode("utf-8", "replace"), "STRING", f"{record}:{key}", offset + at)
            at = data.find(b"\x1c", at + 5 + size, last)


def icc(data: bytes, offset: int = 0) -> Iterator[Row]:
    if len(data) < 128 or data[36:40] != b"acsp":
        yield ("!", "ICC: no profile header")
        return
    text = lambda a: data[a : a + 4].decode("latin-1").strip("\0 ")
    rows = (("ProfileSize", str(int.from_bytes(data[:4], "big"))), ("Version", f"{data[8]}.{data[9] >> 4}"), ("DeviceClass", text(12)), ("ColorSpace", text(16)), ("ConnectionSpace", text(20)), ("DeviceManufacturer", text(48)), ("DeviceModel", text(52)))
    for name, value in rows:
        yield ("ICC", name, value, "INT" if name == "ProfileSize" else "STRING", None, offset)


def c2pa(data: bytes, offset: int = 0) -> Iterator[Row]:
    """What a manifest says in plain text: its generator, actions and signer's names. Signatures are not checked."""
    yield ("C2PA", "ManifestPresent", "True", "BOOL", None, offset)
    text = data.decode("latin-1")
    if m := re.search(r"claim_generator[^\x20-\x7e]*([\x20-\x7e]{2,})", text):
        yield ("C2PA", "ClaimGenerator", m[1], "STRING", None, offset + m.start())
    if found := [a for a in ACTIONS if a in text]:
        yield ("C2PA", "DeclaredActions", ", ".join(found), "STRING", None, offset)
    for key, value in re.findall(r"\b(CN|OU)=([\x20-\x2b\x2d-\x7e]+)", text)[:8]:
        yield ("C2PA", f"Signer{key}", value.strip(), "STRING", None, offset)


def _inflated(data: bytes) -> bytes:
    out = zlib.decompressobj().decompress(data, MOST_TEXT + 1)
    if len(out) > MOST_TEXT:
        raise ValueError("more than 1 MB of text")
    return out


def png_text(data: bytes, offset: int = 0) -> Iterator[Row]:
    """A PNG chunk of text, time or pixel size; ``data`` begins with the chunk's type."""
    kind, body = data[:4], data[4:]
    try:
        if kind == b"tIME":
            y, *rest = struct.unpack(">HBBBBB", body[:7])
            yield ("PNG", "png:tIME", "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(y, *rest), "TIMESTAMP", None, offset)
        elif kind == b"pHYs":
            x, y, unit = struct.unpack(">IIB", body[:9])
            yield ("PNG", "png:pHYs", f"{x}x{y} per {'meter' if unit == 1 else 'unknown'}", "STRING", None, offset)
        else:
            key, _, rest = body.partition(b"\0")
            if kind == b"zTXt":
                value = _inflated(rest[1:]).decode("latin-1")
            elif kind == b"iTXt":
                packed, (_, _, text) = rest[0], rest[2:].split(b"\0", 2) if rest[2:].count(b"\0") == 2 else (b"", b"", rest[2:].split(b"\0", 2)[-1])
                value = (_inflated(text) if packed else text).decode("utf-8", "replace")
            else:
                value = rest.decode("latin-1")
            yield ("PNG", f"png:{key.decode('latin-1')}", value, "STRING", None, offset)
    except (ValueError, IndexError, struct.error, zlib.error) as e:
        yield ("!", f"PNG {kind.decode('latin-1')}: {e}")


def office_properties(data: bytes, offset: int = 0) -> Iterator[Row]:
    try:
        for element in _xml(data).iter():
            if text := (element.text or "").strip():
                yield ("OFFICE", element.tag.rpartition("}")[2], text, "STRING", None, offset)
    except (ValueError, ElementTree.ParseError) as e:
        yield ("!", f"properties: {e}")


def office_notes(data: bytes, offset: int = 0) -> Iterator[Row]:
    try:
        text = " ".join(t for e in _xml(data).iter() if e.tag.endswith("}t") and (t := (e.text or "").strip()))
        if text:
            yield ("OFFICE", "SpeakerNotes", text[:NOTES], "STRING", None, offset)
    except (ValueError, ElementTree.ParseError) as e:
        yield ("!", f"notes: {e}")


PARSERS: dict[str, Callable[..., Iterator[Row]]] = {
    "EXIF": exif, "XMP": xmp, "XMP_EXT": xmp, "IPTC_8BIM": iptc, "IPTC": iptc, "ICC": icc, "C2PA": c2pa, "PNG_TEXT": png_text, "PNG_NATIVE": png_text,
    "OFFICE_CORE_PROPERTIES": office_properties, "OFFICE_APP_PROPERTIES": office_properties, "OFFICE_SPEAKER_NOTES": office_notes,
}


def parse(kind: str, data: bytes, offset: int = 0) -> Iterator[Row]:
    """Fields of a block; of a kind without a parser none. Embedded images are walked for blocks of their own."""
    if kind == "EMBEDDED_IMAGE":
        from casegrain.sources.containers import walk

        form = "JPEG" if data[:3] == b"\xff\xd8\xff" else "PNG" if data[:4] == b"\x89PNG" else None
        for event in walk(form, data) if form else ():
            if event[0] == "block" and event[1] != "EMBEDDED_IMAGE":
                yield from parse(event[1], event[3], offset + event[2])
        return
    try:
        yield from PARSERS.get(kind, lambda *_: iter(()))(data, offset)
    except (struct.error, IndexError, ValueError) as e:
        yield ("!", f"{kind}: {e}")
