"""Files as rows: listing, custody, and the tables of units, blocks, fields and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.operators import bytestats
from casegrain.sources import containers, metadata

# Fixed value: suffixes that a folder or a pattern lists.
LISTED = "jpg jpeg jpe jfif png tif tiff webp heic heif avif gif bmp dib psd svg pptx docx xlsx dng nef cr2 arw zip".split()
MOST_BYTES = 256 << 20

UNITS = "sha256 string, ordinal int, name string, offset long, length long, data_offset long, data_length long, description string, payload binary"
BLOCKS = "sha256 string, ordinal int, kind string, offset long, length long, raw_bytes binary, source_unit string"
FIELDS = "sha256 string, ordinal long, standard string, name string, tag_id string, value_str string, value_type string, value_long long, value_offset long"
DIAGNOSTICS = "sha256 string, ordinal int, level string, message string, offset long"
EVENTS = "sha256 string, ordinal int, event string, name string, offset long, length long, data_offset long, data_length long, description string, bytes binary"
PAYLOADS = ("DQT", "DHT", "DRI", "SOF0", "SOF1", "SOF2")


def evidence(spark: SparkSession, targets: list[str], recursive: bool = True) -> DataFrame:
    """(path, length, mtime, content, sha256, format, mime_type, extension_mismatch, error), each path once.

    A target that names a file is read whatever its suffix; others list known suffixes only. Targets inside of others are
    dropped before anything is read. A file of more than MOST_BYTES is not read: it has an error, and no content or hash.
    """
    paths, named = resolved(spark, targets, recursive)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    wanted = bytestats.suffix(F.col("path")).isin(LISTED)
    for start in range(0, len(named), 1000):
        wanted = wanted | F.col("path").isin(named[start : start + 1000])
    rows = reader.load(paths).where(wanted).withColumnRenamed("modificationTime", "mtime")
    read = rows.where(F.col("length") <= MOST_BYTES).select("path", "length", "mtime", "content", F.lit(None).cast("string").alias("error"))
    # Without its content in the select, a file is only listed.
    large = rows.where(F.col("length") > MOST_BYTES).select("path", "length", "mtime", F.lit(None).cast("binary").alias("content"), F.concat(F.lit(f"more than {MOST_BYTES} bytes: "), F.col("length").cast("string")).alias("error"))
    return identified(read.unionByName(large))


def resolved(spark: SparkSession, targets: list[str], recursive: bool = True) -> tuple[list[str], list[str]]:
    """Folders and files that ``targets`` (which may be patterns) name, each once and none inside of another; and the files named."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders, named = set(), set()
    for target in targets:
        where = jvm.org.apache.hadoop.fs.Path(target)
        for status in where.getFileSystem(conf).globStatus(where) or ():
            (folders if status.isDirectory() else named).add(status.getPath().toString())
    parents = lambda path: [path[:k] for k, c in enumerate(path) if c == "/"]
    if recursive:
        folders = {f for f in folders if not folders.intersection(parents(f))}
        alone = {f for f in named if not folders.intersection(parents(f))}
    else:
        alone = {f for f in named if f.rpartition("/")[0] not in folders}
    if not folders and not named:
        raise FileNotFoundError(f"nothing at {', '.join(targets)}")
    return sorted(folders | alone), sorted(named)


def identified(files: DataFrame) -> DataFrame:
    form = bytestats.sniffed(bytestats.head_of(F.col("content")))
    out = files.withColumns({"sha256": F.sha2("content", 256), "format": form})
    return out.withColumns({"mime_type": bytestats.mime_type(F.col("format")), "extension_mismatch": bytestats.mismatched(F.col("format"), F.col("path"))})


def events(files: DataFrame) -> DataFrame:
    """All events of the walks, in order; a file's content is in one task's memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, form, content in zip(pdf["sha256"], pdf["format"], pdf["content"], strict=True):
                data = bytes(content)
                for n, e in enumerate(containers.walk(form, data)):
                    if e[0] == "unit":
                        keep = data[e[4] : e[4] + min(e[5], containers.MOST_PAYLOAD)] if e[1] in PAYLOADS else None
                        rows.append((sha, n, *e, keep))
                    elif e[0] == "block":
                        rows.append((sha, n, "block", e[1], e[2], len(e[3]), e[2], len(e[3]), e[4], e[3]))
                    else:
                        rows.append((sha, n, "note", e[1], e[3], 0, 0, 0, e[2], None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return files.where("content is not null").select("sha256", "format", "content").mapInPandas(run, EVENTS)


def units(walked: DataFrame) -> DataFrame:
    return walked.where("event = 'unit'").select("sha256", "ordinal", "name", "offset", "length", "data_offset", "data_length", "description", F.col("bytes").alias("payload"))


def blocks(walked: DataFrame) -> DataFrame:
    return walked.where("event = 'block'").select("sha256", "ordinal", F.col("name").alias("kind"), "offset", "length", F.col("bytes").alias("raw_bytes"), F.col("description").alias("source_unit"))


def diagnostics(walked: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Notes of the walks, and of the parsers."""
    out = walked.where("event = 'note'").select("sha256", "ordinal", F.col("name").alias("level"), F.col("description").alias("message"), "offset")
    if parsed is None:
        return out
    return out.unionByName(parsed.where("standard = '!'").select("sha256", F.col("ordinal").cast("int").alias("ordinal"), F.lit("warning").alias("level"), F.col("name").alias("message"), F.col("value_offset").alias("offset")))


def parsed(block_rows: DataFrame) -> DataFrame:
    """The parsers' rows; those of standard ! are diagnostics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, ordinal, kind, offset, raw in zip(pdf["sha256"], pdf["ordinal"], pdf["kind"], pdf["offset"], pdf["raw_bytes"], strict=True):
                for n, r in enumerate(metadata.parse(kind, bytes(raw), int(offset))):
                    place = (int(ordinal) << 20) + n
                    if r[0] == "!":
                        rows.append((sha, place, "!", r[1], None, None, None, None, int(offset)))
                    else:
                        standard, name, value, value_type, tag, at = r
                        rows.append((sha, place, standard, name, tag, value, value_type, int(value) if re_int(value) else None, at))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIELDS.split(", ")]).astype({"value_long": "Int64"})

    return block_rows.select("sha256", "ordinal", "kind", "offset", "raw_bytes").mapInPandas(run, FIELDS)


def re_int(text: str) -> bool:
    own = text.removeprefix("-")
    return own.isdigit() and own.isascii() and len(own) < 19


def fields(parsed_rows: DataFrame) -> DataFrame:
    """Fields of all standards, with numbers as such: integers in ``value_longs``, rationals in ``value_ratios`` as pairs."""
    parts = F.split("value_str", ", ")
    longs = F.when(F.col("value_type").rlike(r"^(BYTE|S?SHORT|S?LONG)(\[\])?$"), F.transform(parts, lambda p: p.try_cast("long")))
    ratios = F.when(F.col("value_type").rlike(r"^S?RATIONAL(\[\])?$"), F.transform(parts, lambda p: F.transform(F.split(p, "/"), lambda x: x.try_cast("long"))))
    return parsed_rows.where("standard <> '!'").withColumns({"value_longs": longs, "value_ratios": ratios})


def store(files: DataFrame, folder: str) -> DataFrame:
    """Originals under their hash, each once; returns the custody table (sha256, path, length) as it was stored."""
    new = files.select("sha256", "path", "length", "content").dropDuplicates(["sha256"])
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)
    return files.sparkSession.read.parquet(folder).select("sha256", "path", "length")
