"""Fields, findings and records: lookups, filters, differences, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), -1)


def get_field(fields: DataFrame, name: str) -> DataFrame:
    """(sha256, value_str): the first field with the name, or with a name that ends in :name."""
    own = F.lower("name")
    hit = (own == name.lower()) | own.endswith(":" + name.lower())
    return fields.where(hit).groupBy("sha256").agg(F.min_by("value_str", "ordinal").alias("value_str"))


def field_map(fields: DataFrame, names: list[str]) -> DataFrame:
    """A column for each name: the last field with the full name, or else the first with the short name."""
    full = {n: F.max_by("value_str", F.when(F.col("name") == n, F.col("ordinal"))) for n in names}
    short = {n: F.min_by("value_str", F.when(short_name(F.col("name")) == n, F.col("ordinal"))) for n in names}
    has = {n: F.max(F.col("name") == n) for n in names}
    return fields.groupBy("sha256").agg(*[F.when(has[n], full[n]).otherwise(short[n]).alias(n) for n in names])


def select_fields(fields: DataFrame, names: list[str]) -> DataFrame:
    """Fields listed by full name or tag id."""
    low = [n.strip().lower() for n in names]
    return fields.where(F.lower("name").isin(low) | F.coalesce(F.lower("tag_id").isin(low), F.lit(False)))


def findings_by(findings: DataFrame, tier: int | None = None, name: str | None = None) -> DataFrame:
    out = findings if tier is None else findings.where(F.col("tier") == tier)
    return out if name is None else out.where(F.lower("name") == name.lower())


def record_filter(records: DataFrame, findings: DataFrame, text: str) -> DataFrame:
    """Records that a filter word admits; any other word admits all."""
    word = text.strip().lower()
    among = lambda cond: records.join(findings.where(cond).select("sha256").distinct(), "sha256", "left_semi")
    if word in ("has_gps", "gps"):
        return among(F.lower("name").isin("gps_coordinates_claimed", "gps_location_fix"))
    if word in ("has_payload", "payload", "carve"):
        return among(F.lower("name") == "trailing_data_detected")
    if word in ("authentic=false", "modified", "tampered"):
        return records.where("is_authentic = false")
    if word in ("authentic=true", "authentic"):
        return records.where("is_authentic = true")
    if word.startswith("tier=") and word[5:].isdigit():
        return among(F.col("tier") == int(word[5:]))
    return records


def metadata_diff(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, name, change, value_a, value_b): fields of a pair's two records, by name; of equal names the last counts."""
    last = fields.groupBy("sha256", "name").agg(F.max_by("value_str", "ordinal").alias("value"))
    side = lambda c: pairs.join(last, pairs[c] == last.sha256).select("pair_id", "name", F.col("value").alias(f"value_{c}"))
    both = side("a").withColumn("_a", F.lit(True)).join(side("b").withColumn("_b", F.lit(True)), ["pair_id", "name"], "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("value_a").eqNullSafe(F.col("value_b")), "identical").otherwise("modified")
    return both.select("pair_id", "name", change.alias("change"), "value_a", "value_b")


def diff_verdict(same_file: Column, same_data: Column, same_pixels: Column, altered: Column, ssim: Column, look: Column) -> Column:
    """How two records differ, the strongest evidence first; unknown evidence is null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    pixels = altered.isNotNull()
    return (
        F.when(yes(same_file), "EXACT_BITWISE_MATCH")
        .when(yes(same_data), "METADATA_ONLY_MODIFICATION")
        .when(yes(same_pixels), "CONTAINER_OR_RECOMPRESS_IDENTICAL_PIXELS")
        .when(pixels & (altered <= 25.0) & (ssim > 0.60), "LOCALIZED_TAMPERING_OR_EDIT")
        .when(pixels & (ssim > 0.85) & yes(look <= 10), "VISUALLY_SIMILAR_RECOMPRESSION")
        .when(pixels, "DISTINCT_OR_HEAVILY_ALTERED_IMAGES")
        .when(look <= 5, "PERCEPTUAL_NEAR_MATCH")
        .when(look.isNotNull(), "DISTINCT_IMAGES")
        .otherwise("INCONCLUSIVE_DIFFERENCE")
    )


def repaired_json(text: Column) -> Column:
    """The JSON object in a model's answer: without code fences, else from the first brace to the last, else {"raw_response": text}."""
    stripped = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```(?:json)?", ""), r"```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    sound = lambda t: F.try_parse_json(t).isNotNull() & (t != "")
    return F.when(sound(bare), bare).when(sound(inner), inner).otherwise(F.to_json(F.struct(bare.alias("raw_response"))))


def table_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two tables' bytes, and similarity 100 / (1 + d / 50)."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.struct(F.round(d, 3).alias("distance"), F.round(100.0 / (1.0 + d / 50.0), 1).alias("similarity"))


def _holds(label: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.upper(label).contains(w) for w in words])


_BUCKETS = {"authentic": ("AUTHENTIC",), "tampered": ("TAMPERED", "MODIFIED", "TRAILING"), "synthetic": ("SYNTHETIC", "AI"), "encrypted": ("ENCRYPTED", "SCRAMBLED")}


def triage(verdicts: DataFrame) -> DataFrame:
    """(bucket, n, percent): a label counts in each bucket whose words it holds; a trailing payload is also "AI"."""
    label = F.col("verdict_label")
    labels = verdicts.groupBy("verdict_label").agg(F.count("*").alias("c")).withColumn("_total", F.sum("c").over(Window.partitionBy()))  # a row per label
    hits = F.filter(F.array(*[F.when(_holds(label, *w), b) for b, w in _BUCKETS.items()]), lambda b: b.isNotNull())
    rows = labels.select("c", "_total", F.explode(F.when(F.coalesce(F.size(hits), F.lit(0)) <= 0, F.array(F.lit("inconclusive"))).otherwise(hits)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.sum("c").alias("n"), F.max("_total").alias("_total")).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("_total"), 1).alias("percent"))


def dossier(verdicts: DataFrame) -> DataFrame:
    """(badge, n): each record in the first bucket that fits."""
    label = F.coalesce("verdict_label", F.lit("UNVERIFIED_METADATA_STRIPPED"))
    badge = F.coalesce(*[F.when(_holds(label, *w), b) for b, w in _BUCKETS.items()], F.lit("unverified"))
    return verdicts.groupBy(badge.alias("badge")).agg(F.count("*").alias("n"))


def container_anomalies(units: DataFrame) -> DataFrame:
    """(sha256, anomaly, n): more than one frame header in a JPEG, or image header in a PNG."""
    kind = F.when((F.col("format") == "JPEG") & F.col("name").rlike("^SOF[0-9]+$"), "multiple_sof").when((F.col("format") == "PNG") & (F.col("name") == "IHDR"), "multiple_ihdr")
    return units.withColumn("anomaly", kind).where("anomaly is not null").groupBy("sha256", "anomaly").agg(F.count("*").alias("n")).where("n > 1")


def page(records: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of records by hash."""
    return records.orderBy("sha256").offset(offset).limit(limit)


def get(records: DataFrame, sha256: str) -> DataFrame:
    return records.where(F.col("sha256") == sha256)


def without(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """Records but those whose hashes are listed."""
    return records.join(hashes.select("sha256").distinct(), "sha256", "left_anti")


def saved(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with new ones in place of those that share their hashes."""
    return without(records, new).unionByName(new, allowMissingColumns=True)


def capped(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group by ordinal, as displays show them."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("ordinal"))).where(F.col("_n") <= most).drop("_n")


def override(seed: DataFrame, user: DataFrame, key: str) -> DataFrame:
    """The user's rows, and the seed's where the user has none."""
    return seed.join(user.select(key).distinct(), key, "left_anti").unionByName(user, allowMissingColumns=True)


def ordered_distinct(rows: DataFrame, key: str) -> DataFrame:
    """Each key once, with its least ordinal's row."""
    return rows.groupBy(key).agg(F.min(F.struct("ordinal", *[c for c in rows.columns if c not in (key, "ordinal")])).alias("_r")).select(key, "_r.*")


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
