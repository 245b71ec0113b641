"""Walkers and parsers on files built by hand."""

import io
import struct
import zipfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.sources import containers, metadata


def seg(code, body):
    return b"\xff" + bytes([code]) + struct.pack(">H", len(body) + 2) + body


def exif_block(order="<"):
    """Make, a date in a sub-directory, a place."""
    p = lambda f, *a: struct.pack(order + f, *a)
    entries = [(0x010F, 2, 6, 200), (0x8769, 4, 1, 80), (0x8825, 4, 1, 120)]
    head = (b"II" if order == "<" else b"MM") + p("HI", 42, 8)
    ifd0 = p("H", len(entries)) + b"".join(p("HHII", *e) for e in entries) + p("I", 0)
    sub = p("H", 1) + p("HHII", 0x9003, 2, 20, 210) + p("I", 0)
    gps = p("H", 4) + p("HHI", 1, 2, 2) + b"S\0\0\0" + p("HHII", 2, 5, 3, 240) + p("HHI", 3, 2, 2) + b"E\0\0\0" + p("HHII", 4, 5, 3, 264) + p("I", 0)
    out = bytearray(300)
    for at, part in ((0, head), (8, ifd0), (80, sub), (120, gps), (200, b"Canon\0"), (210, b"2024:05:06 07:08:09\0"), (240, p("IIIIII", 48, 1, 30, 1, 0, 1)), (264, p("IIIIII", 2, 1, 0, 1, 36, 1))):
        out[at : at + len(part)] = part
    return bytes(out)


def jpeg(trailing=b""):
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xE1, b"Exif\0\0" + exif_block()) + seg(0xDB, b"\0" + bytes([16]) * 64) + seg(0xC0, b"\x08\0\x10\0\x10\1\1\x11\0") + seg(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9" + trailing


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*more):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + b"".join(more) + chunk(b"IEND", b"")


def units(form, data):
    return [e[1] for e in containers.walk(form, data) if e[0] == "unit"]


def notes(form, data):
    return [e[2] for e in containers.walk(form, data) if e[0] == "note"]


def test_jpeg():
    assert units("JPEG", jpeg()) == ["SOI", "APP0", "APP1", "DQT", "SOF0", "SOS", "RST0", "EOI"] and notes("JPEG", jpeg()) == []
    assert units("JPEG", jpeg(b"PK"))[-1] == "TRAILING_DATA"
    kinds = [e[1] for e in containers.walk("JPEG", jpeg()) if e[0] == "block"]
    assert kinds == ["JFIF", "EXIF"]
    assert notes("JPEG", jpeg()[:60]) and notes("JPEG", b"\xff\xd8\0\0")
    many = b"\xff\xd8" + seg(0xFE, b"") * 5000
    assert any("more than" in n for n in notes("JPEG", many))


def test_png():
    data = png(chunk(b"tEXt", b"Author\0me"), chunk(b"pHYs", struct.pack(">IIB", 2835, 2835, 1)))
    assert units("PNG", data) == ["PNG_HEADER", "IHDR", "tEXt", "pHYs", "IEND"] and notes("PNG", data) == []
    assert units("PNG", data + b"x")[-1] == "TRAILING_DATA"


def test_tiff_with_a_cycle():
    data = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x0100, 4, 1, 5, 8)
    assert units("TIFF", data) == ["TIFF_HEADER", "IFD0"] and "cycle" in notes("TIFF", data)[0]


def test_riff_bmff_gif_bmp():
    body = b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", 4) + b"II*\0"
    assert units("WEBP", b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body) == ["RIFF_HEADER", "RIFF_VP8", "RIFF_EXIF"]
    box = struct.pack(">I", 16) + b"ftypheic\0\0\0\0" + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 20) + b"abcd" + struct.pack(">I", 0) + b"free"
    assert units("HEIC", box) == ["BOX_ftyp", "BOX_mdat", "BOX_free"]
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x02\x4c\x01\0" + b"\x3b!"
    assert units("GIF", gif) == ["HEADER", "LSD", "GCT", "GCE", "FRAME_1", "TRAILER", "TRAILING_DATA"]
    bmp = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<I", 40) + b"\0" * 36 + b"\1\2\3\0" + b"tail"
    assert units("BMP", bmp) == ["BMP_HEADER", "DIB_HEADER", "PIXEL_ARRAY", "TRAILING_DATA"]


def test_office_and_bombs():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ppt/media/a.jpg", jpeg())
        z.writestr("ppt/media/zero.bin", b"\0" * 5_000_000)
        z.writestr("../ppt/media/evil.jpg", b"x")
        z.writestr("docProps/core.xml", "<c xmlns:d='u'><d:creator>Ada</d:creator></c>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", "<n xmlns:a='u'><a:t>hello</a:t><a:t>there</a:t></n>")
    events = list(containers.walk("PPTX", raw.getvalue()))
    assert [e[1] for e in events if e[0] == "unit"] == ["EMBEDDED_IMAGE:a.jpg", "DOCPROPS_CORE", "NOTES:notesSlide1.xml"]
    assert sum("bomb" in e[2] for e in events if e[0] == "note") == 1 and sum("leaves" in e[2] for e in events if e[0] == "note") == 1
    rows = [r for e in events if e[0] == "block" for r in metadata.parse(e[1], e[3], e[2])]
    assert ("OFFICE", "creator", "Ada") in [r[:3] for r in rows] and ("OFFICE", "SpeakerNotes", "hello there") in [r[:3] for r in rows]
    assert ("EXIF", "Make", "Canon") in [r[:3] for r in rows]


def test_exif_in_both_orders():
    for order in "<>":
        rows = {r[1]: r[2] for r in metadata.exif(exif_block(order))}
        assert rows["Make"] == "Canon" and rows["ExifSubIFD:DateTimeOriginal"] == "2024:05:06 07:08:09"
        assert rows["GPS:GPSLatitudeRef"] == "S" and rows["GPS:GPSLatitude"] == "48/1, 30/1, 0/1"


def test_xmp_refuses_declarations():
    good = b"<x:xmpmeta xmlns:x='a'><r:RDF xmlns:r='b'><r:Description xmlns:t='c' t:CreatorTool='GIMP'><t:CreateDate>2024</t:CreateDate></r:Description></r:RDF></x:xmpmeta>"
    assert {r[1]: r[2] for r in metadata.xmp(good)} == {"xmp:CreatorTool": "GIMP", "xmp:CreateDate": "2024"}
    for bad in (b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>", b"<a>", b"<a>" + b"x" * (3 << 20) + b"</a>"):
        assert [r[0] for r in metadata.xmp(bad)] == ["!"]


def test_iptc_icc_c2pa_and_png_text():
    data = b"\x1c\x02\x5a\0\x05Paris\x1c\x02\x19\0\x01k"
    chain = b"8BIM\x04\x04\0\0" + struct.pack(">I", len(data)) + data
    assert [r[1:3] for r in metadata.iptc(chain)] == [("iptc:City", "Paris"), ("iptc:Keywords", "k")]
    profile = bytearray(128)
    profile[:4], profile[8:10], profile[12:24], profile[36:40] = struct.pack(">I", 128), b"\x04\x20", b"mntrRGB XYZ ", b"acsp"
    assert {r[1]: r[2] for r in metadata.icc(bytes(profile))}["Version"] == "4.2"
    rows = {r[1]: r[2] for r in metadata.c2pa(b"jumb\0c2pa claim_generator\0\x6bTool/1.0\0 c2pa.created CN=Some Signer,")}
    assert rows["DeclaredActions"] == "c2pa.created" and rows["SignerCN"] == "Some Signer"
    assert list(metadata.png_text(b"zTXtKey\0\0" + zlib.compress(b"value")))[0][1:3] == ("png:Key", "value")
    assert [r[0] for r in metadata.png_text(b"zTXtKey\0\0" + zlib.compress(b"\0" * (2 << 20)))] == ["!"]
    assert list(metadata.png_text(b"tIME" + struct.pack(">HBBBBB", 2024, 1, 2, 3, 4, 5)))[0][2] == "2024-01-02 03:04:05"
    assert list(metadata.png_text(b"iTXtKey\0\0\0en\0k\0" + "é".encode()))[0][2] == "é"


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(containers.WALKERS)), st.binary(max_size=200), st.integers(0, 400), st.integers(0, 255))
def test_nothing_raises(form, noise, place, value):
    for data in (noise, jpeg(noise), png(chunk(b"tEXt", noise))):
        bad = bytearray(data)
        if place < len(bad):
            bad[place] = value
        for e in containers.walk(form, bytes(bad)):
            if e[0] == "block":
                list(metadata.parse(e[1], e[3], e[2]))
    for kind in metadata.PARSERS:
        list(metadata.parse(kind, noise))
