"""Hash-chained logs, custody and manifests."""

from __future__ import annotations

import hashlib
import hmac
import json
import threading
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(entry: dict) -> str:
    """JSON with sorted keys, as entries are hashed."""
    return json.dumps(entry, sort_keys=True)


def entry_hash(entry: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in entry.items() if k != "entry_hash"}).encode()).hexdigest()


def hashed_entries(lines: DataFrame) -> DataFrame:
    """(ordinal, entry_index, previous_hash, entry_hash, content_hash) of JSON lines (ordinal, value); blank lines are left out.

    The content is hashed anew from canonical JSON, in batches; a line that is no JSON has nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ordinal, value in zip(pdf["ordinal"], pdf["value"], strict=True):
                try:
                    e = json.loads(value)
                    rows.append((ordinal, e.get("entry_index"), e.get("previous_hash"), e.get("entry_hash"), entry_hash(e)))
                except (ValueError, AttributeError):
                    rows.append((ordinal, None, None, None, None))
            yield pd.DataFrame(rows, columns=["ordinal", "entry_index", "previous_hash", "entry_hash", "content_hash"]).astype({"entry_index": "Int64"})

    own = lines.where(F.trim("value") != "").select("ordinal", "value")
    return own.mapInPandas(run, "ordinal long, entry_index long, previous_hash string, entry_hash string, content_hash string")


def chain_faults(entries: DataFrame, by: str | None = None) -> DataFrame:
    """Each entry that breaks its chain, and why: its index, then its link, then its content.

    ``by`` names the log where there are several; each log is one chain, which is walked in order.
    """
    log = Window.partitionBy(by or F.lit(0)).orderBy("ordinal")
    place = (F.row_number().over(log) - 1).cast("long")
    linked = F.coalesce(F.lag("entry_hash").over(log), F.lit(GENESIS))
    reason = (
        F.when(F.col("entry_hash").isNull(), "unreadable")
        .when(~F.col("entry_index").eqNullSafe(F.col("_place")), "index")
        .when(~F.col("previous_hash").eqNullSafe(F.col("_link")), "link")
        .when(F.col("content_hash") != F.col("entry_hash"), "content")
    )
    out = entries.withColumns({"_place": place, "_link": linked}).withColumn("reason", reason)
    return out.where("reason is not null").withColumn("position", F.col("_place")).drop("_place", "_link")


def chain_status(entries: DataFrame, by: str) -> DataFrame:
    """(by, n_entries, valid, broken_position, reason) of each log."""
    first = chain_faults(entries, by).groupBy(by).agg(F.min("position").alias("broken_position"), F.min_by("reason", "position").alias("reason"))
    counts = entries.groupBy(by).agg(F.count("*").alias("n_entries"))
    return counts.join(first, by, "left").withColumn("valid", F.col("broken_position").isNull())


class Writer:
    """Appends to one log; entries are chained under a lock (a log is serial by nature)."""

    def __init__(self, path: str):
        self.path, self.lock, self.last, self.n = path, threading.Lock(), GENESIS, 0
        try:
            with open(path, encoding="utf-8") as lines:
                for line in filter(str.strip, lines):
                    self.last, self.n = json.loads(line)["entry_hash"], self.n + 1
        except FileNotFoundError:
            pass

    def append(self, action: str, operator: str = "", outcome: str = "ok", **details) -> dict:
        with self.lock:
            entry = {"entry_index": self.n, "timestamp_utc": datetime.now(UTC).isoformat(), "operator": operator, "action": action, "outcome": outcome, "details": details, "previous_hash": self.last}
            entry["entry_hash"] = entry_hash(entry)
            with open(self.path, "a", encoding="utf-8") as out:
                out.write(json.dumps(entry) + "\n")
            self.last, self.n = entry["entry_hash"], self.n + 1
            return entry


def signed(text: str, key: bytes) -> str:
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def verified(text: str, key: bytes, signature: str) -> bool:
    return hmac.compare_digest(signed(text, key), signature)


def manifest(files: DataFrame) -> DataFrame:
    """(file_name, sha256, size, row_hash) of files (name, content)."""
    row = files.select(F.col("name").alias("file_name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))
    return row.withColumn("row_hash", F.sha2(F.concat_ws("|", "file_name", "sha256", F.col("size").cast("string")), 256))


def custody_faults(stored: DataFrame, originals: DataFrame) -> DataFrame:
    """Stored originals (sha256, path) whose content (path, content) hashes to something else, or that are gone."""
    now = originals.select("path", F.sha2("content", 256).alias("now"))
    return stored.join(now, "path", "left").where(~F.col("now").eqNullSafe(F.col("sha256")))


def chained(rows: DataFrame, by: str, order: Column, payload: Column) -> DataFrame:
    """``rows`` as logs: entry_index, previous_hash and entry_hash, each entry's hash covering its payload and the payload before it."""
    log = Window.partitionBy(by).orderBy(order)
    out = rows.withColumns({"_own": payload, "entry_index": (F.row_number().over(log) - 1).cast("long")})
    link = F.coalesce(F.sha2(F.lag("_own").over(log), 256), F.lit(GENESIS))
    out = out.withColumn("_link", link).withColumn("entry_hash", F.sha2(F.concat("_own", "_link"), 256))
    return out.withColumn("previous_hash", F.coalesce(F.lag("entry_hash").over(log), F.lit(GENESIS))).drop("_own", "_link")
