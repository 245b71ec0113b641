"""Walkers: the bytes of a container to its units and metadata blocks.

A walker is a generator over ``bytes`` of events: ("unit", name, offset, length, data_offset, data_length, description),
("block", kind, offset, data, source_unit) and ("note", level, message, offset). It never raises on bad data: what it
finds amiss is a note, and the walk ends there.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

Event = tuple
# Limits of a walk.
MOST_UNITS, MOST_PAYLOAD, MOST_ENTRY, MOST_UNPACKED, MOST_RATIO = 4096, 4096, 16 << 20, 64 << 20, 100

# Names of JPEG markers, and of ISO media boxes' metadata types.
MARKERS = {0xC4: "DHT", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM"}


def marker_name(code: int) -> str:
    if code in MARKERS:
        return MARKERS[code]
    if 0xC0 <= code <= 0xCF:
        return f"SOF{code - 0xC0}"
    if 0xE0 <= code <= 0xEF:
        return f"APP{code - 0xE0}"
    return f"RST{code - 0xD0}" if 0xD0 <= code <= 0xD7 else f"MARKER_0x{code:02X}"


def _unit(name: str, offset: int, length: int, head: int, text: str = "") -> Event:
    return ("unit", name, offset, length, offset + head, length - head, text or name)


def _trailing(data: bytes, at: int, after: str) -> Iterator[Event]:
    if at < len(data):
        yield _unit("TRAILING_DATA", at, len(data) - at, 0, f"{len(data) - at} bytes after {after}")


#: Leading bytes of an APPn payload, by marker: the kind of its block and how much of them isn't the block's.
_APPS: dict[int, tuple[tuple[bytes, str, int], ...]] = {
    0xE0: ((b"JFIF\0", "JFIF", 0),),
    0xE1: ((b"Exif\0\0", "EXIF", 6), (b"http://ns.adobe.com/xap/1.0/\0", "XMP", 29), (b"http://ns.adobe.com/xmp/extension/\0", "XMP_EXT", 35)),
    0xE2: ((b"ICC_PROFILE\0", "ICC", 14), (b"MPF\0", "MPF", 4)),
    0xEB: ((b"JP", "C2PA", 0), (b"", "C2PA", 0)),
    0xED: ((b"Photoshop 3.0\0", "IPTC_8BIM", 14),),
}


def jpeg(data: bytes) -> Iterator[Event]:
    if data[:2] != b"\xff\xd8":
        yield ("note", "error", "no SOI", 0)
        return
    yield _unit("SOI", 0, 2, 2)
    at, n = 2, 1
    while at + 1 < len(data):
        if n >= MOST_UNITS:
            yield ("note", "warning", f"more than {MOST_UNITS} units", at)
            return
        if data[at] != 0xFF:
            yield ("note", "error", "no marker where one should be", at)
            return
        while at + 2 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        code = data[at + 1]
        n += 1
        if code == 0xD9:
            yield _unit("EOI", at, 2, 2)
            yield from _trailing(data, at + 2, "EOI")
            return
        if 0xD0 <= code <= 0xD7 or code == 0x01:
            yield _unit(marker_name(code), at, 2, 2)
            at = _next_marker(data, at + 2)
            continue
        if at + 4 > len(data) or (size := int.from_bytes(data[at + 2 : at + 4], "big")) < 2 or at + 2 + size > len(data):
            yield ("note", "error", f"{marker_name(code)} is cut short", at)
            return
        yield _unit(marker_name(code), at, size + 2, 4)
        body = data[at + 4 : at + 2 + size]
        for lead, kind, skip in _APPS.get(code, ()):
            if body.startswith(lead) and (lead or b"jumb" in body or b"c2pa" in body):
                yield ("block", kind, at + 4 + skip, body[skip:], marker_name(code))
                break
        at += size + 2
        if code == 0xDA:
            at = _next_marker(data, at)
    yield ("note", "warning", "no EOI", len(data))


def _next_marker(data: bytes, at: int) -> int:
    """The place of the next marker in entropy-coded data; stuffed zeros are none."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] not in (0x00, 0xFF):
            return at
        at += 1 if data[at + 1] == 0xFF else 2
    return len(data)


_PNG_BLOCKS = {b"eXIf": "EXIF", b"tEXt": "PNG_TEXT", b"zTXt": "PNG_TEXT", b"iTXt": "PNG_TEXT", b"iCCP": "ICC", b"tIME": "PNG_NATIVE", b"pHYs": "PNG_NATIVE"}


def png(data: bytes) -> Iterator[Event]:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        yield ("note", "error", "no PNG signature", 0)
        return
    yield _unit("PNG_HEADER", 0, 8, 8)
    at, n = 8, 1
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        n += 1
        if at + 12 + size > len(data) or n > MOST_UNITS:
            yield ("note", "error", "a chunk is cut short" if n <= MOST_UNITS else f"more than {MOST_UNITS} units", at)
            return
        name = kind.decode("latin-1")
        yield ("unit", name, at, size + 12, at + 8, size, f"chunk {name}")
        if kind in _PNG_BLOCKS:
            body = data[at + 8 : at + 8 + size]
            yield ("block", _PNG_BLOCKS[kind], at + 8, body if kind == b"eXIf" or kind == b"iCCP" else kind + body, name)
        at += size + 12
        if kind == b"IEND":
            yield from _trailing(data, at, "IEND")
            return
    yield ("note", "warning", "no IEND", at)


def tiff(data: bytes) -> Iterator[Event]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        yield ("note", "error", "no TIFF header", 0)
        return
    yield _unit("TIFF_HEADER", 0, 8, 8, "little endian" if order == "<" else "big endian")
    yield ("block", "EXIF", 0, data, "TIFF_HEADER")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data) or len(seen) >= MOST_UNITS:
            yield ("note", "warning", "a cycle of directories" if at in seen else "a directory outside the file", at)
            return
        seen.add(at)
        count = struct.unpack(order + "H", data[at : at + 2])[0]
        end = at + 2 + 12 * count
        yield _unit(f"IFD{len(seen) - 1}", at, 2 + 12 * count + 4, 2, f"{count} entries")
        if end + 4 > len(data):
            yield ("note", "warning", "a directory is cut short", at)
            return
        at = struct.unpack(order + "I", data[end : end + 4])[0]


def riff(data: bytes) -> Iterator[Event]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        yield ("note", "error", "no RIFF/WEBP header", 0)
        return
    yield _unit("RIFF_HEADER", 0, 12, 8)
    at, end, n = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little")), 1
    kinds = {b"EXIF": "EXIF", b"XMP ": "XMP", b"ICCP": "ICC"}
    while at + 8 <= end and n < MOST_UNITS:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        n += 1
        if at + 8 + size > len(data):
            yield ("note", "error", "a chunk is cut short", at)
            return
        text = name.decode("latin-1")
        yield _unit(f"RIFF_{text.strip()}", at, size + 8, 8, f"chunk {text}")
        if name in kinds:
            body = data[at + 8 : at + 8 + size]
            skip = 6 if name == b"EXIF" and body.startswith(b"Exif\0\0") else 0
            yield ("block", kinds[name], at + 8 + skip, body[skip:], f"RIFF_{text.strip()}")
        at += 8 + size + size % 2
    yield from _trailing(data, max(at, end), "the RIFF chunk")


def bmff(data: bytes) -> Iterator[Event]:
    at = n = 0
    while at + 8 <= len(data):
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= len(data):
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        n += 1
        if size < head or at + size > len(data) or n > MOST_UNITS:
            yield ("note", "error", "a box is cut short", at)
            return
        name = kind.decode("latin-1")
        yield _unit(f"BOX_{name}", at, size, head, f"box {name}")
        body = data[at + head : at + size]
        if kind == b"Exif":
            skip = body.find(b"Exif\0\0") + 6 if b"Exif\0\0" in body[:64] else 4
            yield ("block", "EXIF", at + head + skip, body[skip:], f"BOX_{name}")
        elif kind == b"mime":
            yield ("block", "XMP", at + head, body, f"BOX_{name}")
        at += size
    if at < len(data):
        yield ("note", "warning", "bytes after the last box", at)


def _sub_blocks(data: bytes, at: int) -> int:
    """The place after a chain of GIF sub-blocks, or -1."""
    while at < len(data):
        size = data[at]
        at += size + 1
        if size == 0:
            return at
    return -1


def gif(data: bytes) -> Iterator[Event]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        yield ("note", "error", "no GIF header", 0)
        return
    yield _unit("HEADER", 0, 6, 6, data[:6].decode())
    width, height, flags = struct.unpack("<HHB", data[6:11])
    yield _unit("LSD", 6, 7, 0, f"{width}x{height}")
    table = lambda f: 3 << (f & 7) + 1 if f & 0x80 else 0
    at, frames, n = 13, 0, 2
    if size := table(flags):
        yield _unit("GCT", at, size, 0, f"{size // 3} colours")
        at += size
    names = {0xF9: "GCE", 0xFE: "COMMENT", 0x01: "PLAIN_TEXT", 0xFF: "APP_EXT"}
    while at < len(data) and n < MOST_UNITS:
        n += 1
        if data[at] == 0x3B:
            yield _unit("TRAILER", at, 1, 1)
            yield from _trailing(data, at + 1, "the trailer")
            return
        if data[at] == 0x21 and at + 2 < len(data):
            end, name = _sub_blocks(data, at + 2), names.get(data[at + 1], f"EXT_0x{data[at + 1]:02X}")
        elif data[at] == 0x2C and at + 10 < len(data):
            frames += 1
            end, name = _sub_blocks(data, at + 11 + table(data[at + 9])), f"FRAME_{frames}"
        else:
            end, name = -1, ""
        if end < 0:
            yield ("note", "error", "a block is unknown or cut short", at)
            return
        yield _unit(name, at, end - at, 2)
        if name == "APP_EXT" and data[at + 3 : at + 14] == b"XMP DataXMP":
            yield ("block", "XMP", at + 14, data[at + 14 : end - 258], name)
        at = end
    yield ("note", "warning", "no trailer", at)


def bmp(data: bytes) -> Iterator[Event]:
    if data[:2] != b"BM" or len(data) < 18:
        yield ("note", "error", "no BMP header", 0)
        return
    claimed, pixels, dib = int.from_bytes(data[2:6], "little"), int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    yield _unit("BMP_HEADER", 0, 14, 14, f"{claimed} bytes claimed")
    yield _unit("DIB_HEADER", 14, min(dib, len(data) - 14), 0, f"{dib} bytes")
    end = min(claimed, len(data)) if claimed > pixels else len(data)
    if pixels < len(data):
        yield _unit("PIXEL_ARRAY", pixels, end - pixels, 0)
    yield from _trailing(data, end, "the claimed end")


def office(data: bytes) -> Iterator[Event]:
    """Media, properties and speaker notes of an Office archive, within the limits on names, sizes and ratios."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        entries = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield ("note", "error", f"no archive: {e}", 0)
        return
    left = MOST_UNPACKED
    kinds = {"docProps/core.xml": ("DOCPROPS_CORE", "OFFICE_CORE_PROPERTIES"), "docProps/app.xml": ("DOCPROPS_APP", "OFFICE_APP_PROPERTIES")}
    for entry in entries[:MOST_UNITS]:
        name = entry.filename
        media = "/media/" in name and not name.endswith("/")
        notes = "/notesSlides/" in name and name.endswith(".xml") and "_rels" not in name
        if not (media or notes or name in kinds):
            continue
        if ".." in name.split("/") or name.startswith("/") or "\\" in name:
            yield ("note", "error", f"an entry's name leaves the archive: {name}", entry.header_offset)
            continue
        if entry.file_size > min(MOST_ENTRY, left) or entry.file_size > MOST_RATIO * max(1, entry.compress_size):
            yield ("note", "error", f"bomb: {name} unpacks to {entry.file_size} bytes", entry.header_offset)
            continue
        try:
            body = archive.read(entry)
        except Exception as e:  # noqa: BLE001  archives break in many ways
            yield ("note", "error", f"{name}: {e}", entry.header_offset)
            continue
        left -= len(body)
        base = name.rpartition("/")[2]
        unit = f"EMBEDDED_IMAGE:{base}" if media else kinds.get(name, (f"NOTES:{base}",))[0]
        yield ("unit", unit, entry.header_offset, entry.compress_size, entry.header_offset, len(body), name)
        yield ("block", "EMBEDDED_IMAGE" if media else "OFFICE_SPEAKER_NOTES" if notes else kinds[name][1], entry.header_offset, body, unit)


WALKERS: dict[str, Callable[[bytes], Iterator[Event]]] = {"JPEG": jpeg, "PNG": png, "TIFF": tiff, "WEBP": riff, "HEIC": bmff, "AVIF": bmff, "GIF": gif, "BMP": bmp, "PPTX": office, "DOCX": office, "XLSX": office}


def walk(form: str, data: bytes) -> Iterator[Event]:
    """Events of a file of a known format; a format without a walker gives a note."""
    walker = WALKERS.get(form)
    if walker is None:
        yield ("note", "error", f"no reader for {form}", 0)
        return
    try:
        yield from walker(data)
    except (struct.error, IndexError, ValueError) as e:
        yield ("note", "error", f"{form}: {e}", 0)
