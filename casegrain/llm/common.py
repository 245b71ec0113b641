"""What the corpus operators share: scratch tables, word patterns, sampling by hash."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words parted by ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables, under the one that driver and executors share.

    ``spark.checkpoint.dir`` names that one. Where it is unset, a session on one machine (as in tests) gets
    ``/tmp/checkpoints``; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/casegrain-{sc.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name for scratch."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; for callers that have written or collected their results."""
    removed(spark, scratch_root(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, and of known size.

    A lost executor costs nothing that was written, and the planner broadcasts a reread table only if its
    size on disk is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forgotten(table: DataFrame) -> None:
    """Deletes a ``written`` table that nothing reads any more."""
    removed(table.sparkSession, table.scratch)


def broadcast_if_small(table: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A ``written`` table marked for broadcast if the planner, who knows its files, puts it at ``most_bytes`` or less."""
    return F.broadcast(table) if table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most_bytes else table


def id_text(col: str | Column) -> Column:
    return F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit(""))


def crc_of_id(col: str = "doc_id") -> Column:
    """CRC-32 of the id written as text (a null id counts as empty text)."""
    return F.crc32(F.encode(id_text(col), "UTF-8"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learning_rows(labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """(doc_id, y): at most ``per_class`` labelled ids of each class that ``learn`` admits, drawn by hash.

    Ids labelled twice count once, with the greater label; null ids and labels other than 0 and 1 are left out.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return written(drawn[0].union(drawn[1]), "learning_rows")
