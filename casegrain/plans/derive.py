"""Evidence-shaped tables derived from the generic ones, so that every operator has data to run on.

Derivations use integer arithmetic, comparisons, or single steps on doubles, so that another engine can repeat them exactly.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions import bits
from casegrain.operators import audit
from casegrain.operators.encoders import CORPUS_SCHEMA, scaled_table
from casegrain.sources import files

HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "49492A00", "474946383961", "424D", "504B0304", "38425053", "")
LABELS = ("AUTHENTIC_CAMERA_CAPTURE", "TAMPERED_TRAILING_PAYLOAD", "AI_SYNTHETIC_GENERATION", "ENCRYPTED_OR_SCRAMBLED_CARRIER", "UNVERIFIED_METADATA_STRIPPED", "MODIFIED_METADATA_INCONSISTENT", "INCONCLUSIVE_SIGNALS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as fixes of a case: some without a place, some at zero."""
    e = table(spark, sf_dir, "events")
    lat = F.pmod(F.col("user_id") * 37 + F.col("event_id") * 13, F.lit(1700)) / 10 - 85
    lon = F.pmod(F.col("user_id") * 53 + F.col("event_id") * 29, F.lit(3580)) / 10 - 179
    none, zero = F.col("event_id") % 11 == 0, F.col("event_id") % 97 == 0
    place = lambda c: F.when(none, F.lit(None)).when(zero, 0.0).otherwise(c)
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").alias("ts"), place(lat).alias("lat"), place(lon).alias("lon"), "event_type", "value")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).select(F.col("ordinal").alias("point_id"), "ts", "lat", "lon")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key.cast("long").alias("place_id"), F.col("n_name").alias("name"), F.upper(F.substring("n_name", 1, 2)).alias("country_code"), (key * 6 - 72).cast("double").alias("lat"), ((key * 41) % 340 - 170).cast("double").alias("lon"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    kind = F.when(key % 2 == 0, "airport").otherwise("port")
    return table(spark, sf_dir, "supplier").select(key.alias("place_id"), kind.alias("kind"), ((key * 7) % 1600 / 10 - 80).alias("lat"), ((key * 31) % 3500 / 10 - 175).alias("lon"))


def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 values from 1 to 255 out of each embedding."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (F.lit(1) + F.floor(F.abs(v.cast("double")) * 1000) % 255).cast("int")).alias("vals"), "label")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("case_id"), bits.sign_bits(F.col("embedding")).alias("hash"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes in hex behind the leading bytes of a format."""
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".png", "", ".gif", ".jpg")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name.alias("path"), F.concat(head, F.hex(F.encode("text", "UTF-8"))).alias("hex"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and value rows of each document; long texts have a field more, one name comes twice."""
    d = table(spark, sf_dir, "documents")
    row = lambda n, name, value, tag: F.struct(F.lit(n).cast("long").alias("ordinal"), F.lit(name).alias("name"), value.alias("value_str"), F.lit(tag).alias("tag_id"))
    rows = F.array(
        row(0, "Make", F.col("source"), "0x010f"),
        row(1, "ExifSubIFD:LensModel", F.col("lang"), "0xa434"),
        row(2, "Software", (F.col("n_chars") % 7).cast("string"), "0x0131"),
        row(3, "Software", (F.col("n_chars") % 5).cast("string"), "0x0131"),
    )
    more = F.when(F.col("n_chars") > 2000, F.array(row(4, "ExifSubIFD:Make", F.lit("long"), "0x9999"))).otherwise(F.array().cast("array<struct<ordinal:bigint,name:string,value_str:string,tag_id:string>>"))
    return d.select(F.col("doc_id").alias("sha256"), F.explode(F.concat(rows, more)).alias("f")).select("sha256", "f.*")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents, by what their labels and lengths say."""
    d = table(spark, sf_dir, "documents")
    one = lambda cond, n, tier, name, value: F.when(cond, F.struct(F.lit(n).cast("long").alias("ordinal"), F.lit(tier).alias("tier"), F.lit(name).alias("name"), value.cast("string").alias("value")))
    key = F.col("doc_id")
    gps = F.concat(F.lit('{"latitude":'), (key % 90).cast("string"), F.lit(',"longitude":'), (key % 180).cast("string"), F.lit("}"))
    every = F.filter(
        F.array(
            one(key % 3 == 0, 0, 3, "trailing_data_detected", F.col("n_chars")),
            one(key % 4 == 0, 1, 5, "gps_coordinates_claimed", gps),
            one(key % 5 == 0, 2, 6, "indicator_timeline_inversion", F.lit("1")),
            one(key % 7 == 0, 3, 7, "lsb_entropy_screening", F.col("n_chars") % 2),
        ),
        lambda f: f.isNotNull(),
    )
    return d.select(key.alias("sha256"), F.explode(every).alias("f")).select("sha256", "f.*")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a verdict's signals for each document."""
    k = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        k.alias("sha256"),
        (k % 13 == 0).alias("trailing"),
        (k % 11 == 0).alias("inversion"),
        (k % 5 == 0).alias("lsb_anomaly"),
        (k % 17 == 0).alias("fft_grid"),
        (k % 29 == 0).alias("encrypted"),
        (k % 19 == 0).alias("ambiguous"),
        F.when(k % 2 == 0, F.array(F.lit("ai_generator"))).otherwise(F.array(F.lit("social_media"))).alias("collision_categories"),
        pick(6, "Apple iPhone 15", "Midjourney v6", "Adobe Photoshop", "MozJPEG", "WhatsApp", "Unknown").alias("device_model"),
        F.lit("").alias("category"),
        (k % 23 == 0).alias("c2pa"),
        (k % 3 == 0).alias("gps"),
        (k % 9 == 0).alias("gps_uninitialized"),
        pick(4, "HIGH", "MEDIUM", "LOW", "REJECTED").alias("gps_level"),
        (F.col("n_chars") % 2 == 0).alias("has_metadata"),
    )


def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("doc_id") * 5 % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sha256"), label.alias("verdict_label"))


def corpus(spark: SparkSession) -> DataFrame:
    """Entries made from the standard's tables at several qualities."""
    rows = []
    for q, category in ((30, "social_media"), (50, "codec_library"), (75, "codec_library"), (85, "editing_software"), (92, "camera_hardware"), (96, "ai_generator")):
        rows.append((f"std_q{q}", f"Standard tables at {q}", "standard", "direct", category, "4:2:0", scaled_table(q), scaled_table(q, True), ["SOI", "APP0", "DQT", "SOF0"], "optimized" if q > 80 else "standard", "SOF0", [], "indicative"))
    return spark.createDataFrame(rows, CORPUS_SCHEMA)


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints: tables near those of a quality that the embedding's id picks, disturbed by its values."""
    qualities = (30, 50, 75, 85, 92, 96)
    base = F.element_at(F.array(*[F.array(*[F.lit(v) for v in scaled_table(q)]) for q in qualities]), (F.col("vec_id") % 6 + 1).cast("int"))
    noise = F.transform("vals", lambda v: (v % 3) * (F.col("vec_id") % 4).cast("int"))
    lum = F.zip_with(base, noise, lambda b, n: b + n)
    return quant_tables(spark, sf_dir).select(
        F.col("vec_id").alias("print_id"), lum.alias("lum"), F.lit(None).cast("array<int>").alias("chrom"),
        F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("SOI"), F.lit("APP0"), F.lit("DQT"))).otherwise(F.array(F.lit("SOI"), F.lit("APP1"))).alias("segments"),
        F.when(F.col("vec_id") % 3 == 0, "4:4:4").otherwise("4:2:0").alias("subsampling"), (F.col("vec_id") % 5 == 0).alias("optimized"), F.lit("SOF0").alias("sof"),
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files around documents: a camera's name in EXIF, a table, the whole text and the id as scan data, the language after the end of every third."""
    d = table(spark, sf_dir, "documents")
    hexed = lambda c: F.hex(F.encode(c, "UTF-8"))
    make = hexed(F.concat(F.lit("Camera-"), "source"))
    size = (F.length(make) / 2 + 1).cast("int")
    word = F.lpad(F.hex(size), 2, "0")
    exif = F.concat(F.lit("457869660000" "49492A0008000000" "0100" "0F010200"), word, F.lit("000000" "1A000000" "00000000"), make, F.lit("00"))
    app1 = F.concat(F.lit("FFE1"), F.lpad(F.hex((F.length(exif) / 2 + 2).cast("int")), 4, "0"), exif)
    scan = F.concat(hexed(F.coalesce("text", F.lit(""))), hexed(F.col("doc_id").cast("string")))
    tail = F.when(F.col("doc_id") % 3 == 0, hexed(F.concat(F.lit("PK"), "lang"))).otherwise("")
    content = F.unhex(F.concat(F.lit("FFD8"), app1, F.lit("FFDB004300" + "10" * 64 + "FFDA0002"), scan, F.lit("FFD9"), tail))
    rows = d.select(F.concat(F.lit("/case/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), content.alias("content"))
    return files.identified(rows.select("path", F.length("content").cast("long").alias("length"), F.timestamp_seconds(F.lit(0)).alias("mtime"), "content"))


def _hexed(column) :
    return F.hex(F.encode(column, "UTF-8"))


def _little(value, size: int):
    """A number's ``size`` bytes in hex, the lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(size)])


def _files(rows: DataFrame, suffix: str) -> DataFrame:
    """Identified files out of (doc_id, hex)."""
    own = rows.select(F.concat(F.lit("/case/"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.unhex("hex").alias("content"))
    return files.identified(own.select("path", F.length("content").cast("long").alias("length"), F.timestamp_seconds(F.lit(0)).alias("mtime"), "content"))


def _chunk(kind: str, body) :
    """A PNG chunk in hex, with its checksum."""
    inner = F.concat(F.lit(kind.encode().hex().upper()), body)
    return F.concat(F.lpad(F.hex((F.length(body) / 2).cast("long")), 8, "0"), inner, F.lpad(F.hex(F.crc32(F.unhex(inner))), 8, "0"))


def pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files around documents: source and language as text chunks, the text and the id as image data, the language after the end of every third."""
    d = table(spark, sf_dir, "documents")
    text = lambda name, c: F.concat(F.lit(name.encode().hex().upper() + "00"), _hexed(F.col(c)))
    data = F.concat(_hexed(F.coalesce("text", F.lit(""))), _hexed(F.col("doc_id").cast("string")))
    tail = F.when(F.col("doc_id") % 3 == 0, _hexed(F.col("lang"))).otherwise("")
    parts = [F.lit("89504E470D0A1A0A"), _chunk("IHDR", F.lit("00000001000000010800000000")), _chunk("tEXt", text("Author", "source")), _chunk("tEXt", text("Comment", "lang")), _chunk("IDAT", data), _chunk("IEND", F.lit("")), tail]
    return _files(d.select("doc_id", F.concat(*parts).alias("hex")), ".png")


def webps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WebP files: the text and the id as a picture's chunk, source and language in an XMP packet."""
    d = table(spark, sf_dir, "documents")
    packet = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:CreatorTool="'),
        F.col("source"), F.lit('" xmp:Label="'), F.col("lang"), F.lit('"/></rdf:RDF></x:xmpmeta>'),
    )

    def chunk(name: str, body):
        n = (F.length(body) / 2).cast("long")
        return F.concat(F.lit(name.encode().hex().upper()), _little(n, 4), body, F.when(n % 2 == 1, "00").otherwise(""))

    data = F.concat(_hexed(F.coalesce("text", F.lit(""))), _hexed(F.col("doc_id").cast("string")))
    body = F.concat(F.lit("57454250"), chunk("VP8 ", data), chunk("XMP ", _hexed(packet)))
    return _files(d.select("doc_id", F.concat(F.lit("52494646"), _little(F.length(body) / 2, 4), body).alias("hex")), ".webp")


def gifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GIF files: a colour table, the source as comment, a frame that holds the id, the language after the trailer of every third."""
    d = table(spark, sf_dir, "documents")
    block = lambda c: F.concat(F.lpad(F.hex((F.length(c) / 2).cast("long")), 2, "0"), c, F.lit("00"))
    tail = F.when(F.col("doc_id") % 3 == 0, _hexed(F.col("lang"))).otherwise("")
    parts = [F.lit("474946383961" + "01000100" + "800000" + "00" * 6), F.lit("21FE"), block(_hexed(F.col("source"))), F.lit("2C" + "0000000001000100" + "00" + "02"), block(_hexed(F.col("doc_id").cast("string"))), F.lit("3B"), tail]
    return _files(d.select("doc_id", F.concat(*parts).alias("hex")), ".gif")


def bmps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BMP files whose pixels are the id, the language after the claimed end of every third."""
    d = table(spark, sf_dir, "documents")
    data = _hexed(F.col("doc_id").cast("string"))
    size = 54 + (F.length(data) / 2).cast("long")
    tail = F.when(F.col("doc_id") % 3 == 0, _hexed(F.col("lang"))).otherwise("")
    return _files(d.select("doc_id", F.concat(F.lit("424D"), _little(size, 4), F.lit("00000000" + "36000000" + "28000000" + "00" * 36), data, tail).alias("hex")), ".bmp")


def _directory(spark: SparkSession, sf_dir: str):
    """(doc_id, hex): a TIFF directory of a short, a long, three shorts and a rational out of each document."""
    d = table(spark, sf_dir, "documents")
    entry = lambda tag, kind, n, value: F.concat(F.lit(tag), F.lit(kind), F.lit(n), value)
    k = F.col("doc_id")
    entries = [
        entry("1201", "0300", "01000000", F.concat(_little(k % 8 + 1, 2), F.lit("0000"))),
        entry("0101", "0400", "01000000", _little(F.col("n_chars"), 4)),
        entry("0201", "0300", "03000000", F.lit("3E000000")),
        entry("1A01", "0500", "01000000", F.lit("44000000")),
    ]
    body = [F.lit("0400"), *entries, F.lit("00000000"), _little(k % 3, 2), _little(k % 5, 2), _little(k % 7, 2), _little(k, 4), _little(k % 9 + 1, 4)]
    return d.select("doc_id", F.concat(F.lit("49492A0008000000"), *body).alias("hex"))


def tiffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_directory(spark, sf_dir), ".tif")


def number_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF blocks of numbers, under the document's id."""
    rows = _directory(spark, sf_dir)
    return rows.select(F.col("doc_id").cast("string").alias("sha256"), F.lit(0).alias("ordinal"), F.lit("EXIF").alias("kind"), F.lit(0).cast("long").alias("offset"), F.unhex("hex").alias("raw_bytes"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of logs (conv_id, ordinal, ...) read from JSON lines, each hashed anew: a log for each conversation, an entry for each turn.

    In some logs an entry has a wrong index or link, was edited after it was hashed, or is no JSON.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], audit.GENESIS
        for n, (conv, t) in enumerate(pdf.sort_values("turn")[["conv_id", "t"]].itertuples(index=False)):
            kind = conv % 5
            entry = {"entry_index": n + 7 if kind == 1 and n == 1 else n, "previous_hash": "x" if kind == 4 and n == 1 else last, "text": t}
            entry["entry_hash"] = last = audit.entry_hash(entry)
            if kind == 2 and n == 2:
                entry["text"] = "edited"
            rows.append((conv, n, "no JSON" if kind == 3 and n == 1 else json.dumps(entry)))
        return pd.DataFrame(rows, columns=["conv_id", "n", "value"])

    made = c.groupBy("conv_id").applyInPandas(lines, "conv_id long, n long, value string").withColumn("ordinal", F.col("conv_id") * 100_000 + F.col("n"))
    return audit.hashed_entries(made).withColumn("conv_id", F.floor(F.col("ordinal") / 100_000))


def _be(value, size: int):
    """A number's ``size`` bytes in hex, the highest first."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def tagged_jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files with a colour profile, captions, a frame, code tables and a restart interval, all by the document's id."""
    d = table(spark, sf_dir, "documents")
    n = lambda c: (F.length(c) / 2).cast("long")
    entry = lambda key, c: F.concat(F.lit(f"1C02{key:02X}"), _be(n(c), 2), c)
    data = F.concat(entry(5, _hexed(F.col("source"))), entry(25, _hexed(F.col("lang"))))
    captions = F.concat(F.lit(b"Photoshop 3.0\0".hex() + b"8BIM".hex() + "04040000"), _be(n(data), 4), data)
    profile = F.concat(F.lit("00000080" + "00000000"), _be(F.col("doc_id") % 5, 1), F.lit("400000" + b"mntrRGB XYZ ".hex() + "00" * 12 + b"acsp".hex() + "00" * 8 + b"APPL".hex() + "00" * 76))
    segment = lambda marker, body: F.concat(F.lit(marker), _be(n(body) + 2, 2), body)
    parts = [
        F.lit("FFD8"), segment("FFE2", F.concat(F.lit(b"ICC_PROFILE\0".hex() + "0101"), profile)), segment("FFED", captions), F.lit("FFDB004300"), F.repeat(_be(F.col("doc_id") % 200 + 1, 1), 64),
        F.lit("FFC0001108"), _be(F.col("doc_id") % 999 + 1, 2), _be(F.col("doc_id") % 777 + 1, 2), F.lit("03012200021101031101"),
        F.lit("FFC4001F00" + "00010501010101010100000000000000" + "".join(f"{k:02X}" for k in range(12))), F.lit("FFDD0004"), _be(F.col("doc_id") % 100 + 1, 2), F.lit("FFDA0002"), _hexed(F.col("doc_id").cast("string")), F.lit("FFD9"),
    ]
    return _files(d.select("doc_id", F.upper(F.concat(*parts)).alias("hex")), ".jpg")


def place_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as lines of JSON in three shapes; some lack a name or a place."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    lat, lon = (k * 2 - 25).cast("string"), (k * 7 - 90).cast("string")
    flat = F.concat(F.lit('{"name":"'), name, F.lit('","lat":'), lat, F.lit(',"lon":'), lon, F.lit(',"cc":"xx","population":'), k.cast("string"), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), name, F.lit('","iso_a2":"yy","timezone":"Z/1"},"geometry":{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}}"))
    nested = F.concat(F.lit('{"names":{"primary":"'), name, F.lit('"},"latitude":'), lat, F.lit(',"longitude":'), lon, F.lit("}"))
    line = F.when(k % 5 == 4, F.lit('{"name":"nowhere"}')).when(k % 3 == 0, flat).when(k % 3 == 1, feature).otherwise(nested)
    return table(spark, sf_dir, "nation").select(line.alias("value"))

