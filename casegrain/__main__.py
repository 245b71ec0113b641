"""Commands: python -m casegrain COMMAND TARGET... [--out FOLDER] [...]

Results are tables: printed, or written as Parquet or JSON under --out.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain import governance, skills
from casegrain.functions import bits, cipher
from casegrain.operators import artefacts, audit, bytestats, clusters, encoders, exports, places, records, reports, timeline
from casegrain.plans import casework
from casegrain.sources import files, geodata, pictures

# Exit codes.
EXIT_OK, EXIT_ERROR, EXIT_USAGE, EXIT_FORMAT, EXIT_PARTIAL, EXIT_SCOPE, EXIT_CUSTODY = 0, 1, 2, 3, 4, 6, 7


def _known_places(spark: SparkSession, path: str) -> DataFrame:
    """Places from a SQLite database, a JSON file with a list of them, tables, or lines of JSON."""
    if path.endswith((".sqlite", ".db")):
        return geodata.sqlite_places(spark, path)
    if path.endswith(".json"):
        return geodata.geonames(spark, path)
    return spark.read.parquet(path) if path.endswith(".parquet") else places.parse_places(spark.read.text(path))


def _case(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    more = {}
    if args.corpus:
        more["corpus"] = encoders.read_corpus(spark, args.corpus)
    if args.places:
        more["places"] = _known_places(spark, args.places).withColumn("place_id", F.xxhash64("name", "lat", "lon"))
    own = files.evidence(spark, args.targets)
    if args.pixels:
        more["images"] = pictures.decoded(spark, args.targets).join(own.select("path", "sha256"), "path").select("sha256", "image")
    return casework.opened(own, **more)


def _tiers(args: argparse.Namespace) -> tuple[int, ...]:
    return tuple(int(t) for t in args.tiers.split(",")) if args.tiers else casework.TIERS


def analyze(spark, args) -> dict[str, DataFrame]:
    case = _case(spark, args)
    found = casework.findings(case, _tiers(args))
    rows = records.record_filter(casework.verdicts(case, found), found, args.filter or "")
    fields = records.select_fields(case["fields"], args.fields.split(",")) if args.fields else case["fields"]
    return {"verdicts": rows, "findings": found.join(rows.select("sha256"), "sha256", "left_semi"), "fields": fields, "diagnostics": case["diagnostics"]}


def probe(spark, args):
    return {"files": files.evidence(spark, args.targets).drop("content")}


def scan(spark, args):
    case = _case(spark, args)
    labels = casework.verdicts(case, casework.findings(case, _tiers(args)))
    return {"triage": records.triage(labels), "dossier": records.dossier(labels)}


def timeline_of(spark, args):
    events = timeline.kinematics(casework.events(_case(spark, args)))
    rows = events.withColumns({"message": F.concat(F.lit("Image "), F.col("file_name")), "anomalous": F.col("kinematic_anomaly")})
    return {"timeline": events, "summary": timeline.summary(events), "inversions": timeline.inversions(events.select("case_id", "ts", F.col("file_name").alias("name")), "name"), "plaso": exports.timeline_rows(rows)}


def locate(spark, args):
    case = _case(spark, args)
    points = casework.events(case).where("lat is not null")
    out = {"points": points, "steps": timeline.steps(points), "geojson": exports.geojson_features(points), "kml": exports.kml_placemarks(points.withColumn("name", F.col("file_name"))), "gpx": exports.gpx_waypoints(points.withColumn("name", F.col("file_name"))), "bounds": exports.bounding_box(points)}
    if args.ip:
        lat, lon = map(float, args.ip.split(","))
        out["network"] = places.ip_correlation(points.withColumn("point_id", F.col("ordinal")), lat, lon)
    return out


def cluster(spark, args):
    case = _case(spark, args)
    dqt = case["units"].where("name = 'DQT'").groupBy("sha256").agg(F.substring(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", F.hex("payload"))))), 256), 1, 8).alias("dqt"))
    items = casework.events(case).join(case["facts"].drop("lat", "lon"), "sha256", "left").join(dqt, "sha256", "left")
    if args.strategy == "geo":
        return {"clusters": clusters.by_place(items, args.radius)}
    if args.strategy == "visual":
        looks = items.join(case["pixels"].select("sha256", bits.hex_to_long(F.col("phash")).alias("hash")), "sha256", "left") if "pixels" in case else items.withColumn("hash", F.lit(None).cast("long"))
        return {"clusters": clusters.by_look(looks)}
    key = F.concat(F.lit("DQT_Profile_"), F.coalesce("dqt", F.lit("no_dqt"))) if args.strategy == "dqt" else clusters.camera_key(F.col("make"), F.col("model"), F.col("serial"), F.col("dqt"))
    groups = clusters.grouped(items, key, "DQT_" if args.strategy == "dqt" else "CAM_")
    return {"clusters": groups, "outliers": clusters.outliers(groups)}


def diff(spark, args):
    case = _case(spark, args)
    ids = case["files"].select("path", "sha256").orderBy("path").limit(2).collect()
    if not ids:
        raise ValueError("nothing to compare")
    pairs = spark.createDataFrame([("pair", ids[0]["sha256"], ids[-1]["sha256"])], "pair_id string, a string, b string")
    return {"metadata": records.metadata_diff(case["fields"], pairs), "verdict": casework.compared(case, pairs)}


def export(spark, args):
    case = _case(spark, args)
    found = casework.findings(case, _tiers(args))
    rows = case["files"].drop("content").join(casework.verdicts(case, found), "sha256").withColumns({"file_path": F.col("path"), "file_name": F.element_at(F.split("path", "/"), -1)})
    trailing = rows.join(found.where("name = 'trailing_data_detected'").select("sha256", F.lit(True).alias("trailing")).distinct(), "sha256", "left")
    return {"images": exports.images(rows), "metadata_fields": case["fields"], "findings": found, "gps_locations": exports.gps_locations(found), "stix": exports.stix_json(trailing, args.created), "reports": exports.reports(rows, found), "pages": reports.html_records(rows, found, case["fields"])}


def extract(spark, args):
    return {"artefacts": artefacts.extract(files.evidence(spark, args.targets))}


def clean(spark, args):
    return {"cleaned": artefacts.clean(files.evidence(spark, args.targets))}


def audit_log(spark, args):
    rows = spark.read.text(args.targets[0], wholetext=False).withColumn("ordinal", F.monotonically_increasing_id())
    return {"faults": audit.chain_faults(audit.hashed_entries(rows))}


def encrypt(spark, args):
    rows = files.evidence(spark, args.targets).select("path", "content")
    salt, iv = F.expr("substring(unhex(sha2(uuid(), 256)), 1, 16)"), F.expr("substring(unhex(sha2(uuid(), 256)), 1, 12)")
    rows = rows.withColumns({"salt": salt, "iv": iv}).persist()  # drawn once
    return {"sealed": rows.select("path", cipher.sealed(F.col("content"), cipher.key_column(args.password, F.col("salt")), F.col("salt"), F.col("iv")).alias("content"))}


def decrypt(spark, args):
    rows = spark.read.parquet(*args.targets)
    return {"opened": rows.select("path", cipher.opened(F.col("content"), args.password).alias("content"))}


def stego(spark, args):
    found = casework.pixels(pictures.decoded(spark, args.targets).select(F.col("path").alias("sha256"), "image"))
    return {"stego": found.select(F.col("sha256").alias("path"), "lsb_density", "lsb_anomaly", "covert", bytestats.covert_verdict(F.round("covert", 2)).alias("verdict"))}


def geo_ingest(spark, args):
    new = geodata.geonames(spark, args.targets) if args.targets[0].endswith(".json") else places.parse_places(spark.read.text(args.targets))
    new = new.withColumn("ordinal", F.monotonically_increasing_id())
    known = _known_places(spark, args.places) if args.places else new.drop("ordinal").limit(0)
    return {"places": places.in_order(places.ingested(known, new.select(*known.columns, "ordinal"), args.limit))}


def motion(spark, args):
    """Clips inside of pictures: where, what kind, and the clip itself."""
    found = artefacts.extract(files.evidence(spark, args.targets))
    return {"clips": found.where("kind like 'clip_%'")}


def scope(spark, args):
    """A new scope (with --case), or what a scope file says."""
    if args.case:
        end = (datetime.now(UTC) + timedelta(days=args.days)).isoformat()
        made = governance.Scope(args.case, args.purpose or "", args.legal_basis or "", args.party or "", ["Image Source Files"], [f"tier{t}" for t in casework.TIERS], args.days, end)
        text = governance.dump(made, args.secret)
    else:
        text = governance.dump(governance.load(Path(args.targets[0]).read_text(encoding="utf-8"), args.secret), args.secret)
    return {"scope": spark.createDataFrame([(text,)], "value string")}


def skill(spark, args):
    """The skills in folders, and what could not be loaded."""
    loaded, wrong = skills.discover([Path(t) for t in args.targets])
    rows = [(m.name, m.tier, m.version, m.description, ",".join(m.formats), None) for m in loaded] + [(w.partition(": ")[0], None, None, None, None, w.partition(": ")[2]) for w in wrong]
    return {"skills": spark.createDataFrame(rows, "name string, tier int, version string, description string, formats string, error string")}


def corpus(spark, args):
    return {"corpus": encoders.read_corpus(spark, args.targets[0])}


def doctor(spark, args):
    parts = [("spark", spark.version), ("analysers", ", ".join(sorted(casework.ANALYSERS)) or "built in only"), ("refused", ", ".join(governance.REFUSED))]
    return {"doctor": spark.createDataFrame(parts, "part string, state string")}


COMMANDS = {"analyze": analyze, "audit": audit_log, "clean": clean, "cluster": cluster, "corpus": corpus, "decrypt": decrypt, "diff": diff, "doctor": doctor, "encrypt": encrypt, "export": export, "extract": extract, "geo": geo_ingest, "locate": locate, "motion": motion, "probe": probe, "scan": scan, "scope": scope, "skill": skill, "stego": stego, "timeline": timeline_of}


def main(argv: list[str]) -> int:
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["analyze", *argv]
    parser = argparse.ArgumentParser("casegrain", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("targets", nargs="*", default=["."])
    for name, text in (("out", "folder for the tables"), ("tiers", "such as 1,3,5"), ("filter", "has_gps, payload, authentic, modified, tier=N"), ("fields", "names or tag ids"), ("corpus", "encoder corpus in JSON"), ("places", "places in NDJSON"), ("scope", "authorisation scope in JSON"), ("secret", "the scope's secret"), ("ip", "LAT,LON of an address"), ("password", "for encrypt and decrypt"), ("case", "id of a new scope"), ("purpose", "of a new scope"), ("legal-basis", "of a new scope"), ("party", "who authorises a new scope")):
        parser.add_argument(f"--{name}", help=text)
    parser.add_argument("--strategy", choices=("camera", "dqt", "geo", "visual"), default="camera")
    parser.add_argument("--radius", type=float, default=clusters.RADIUS_KM)
    parser.add_argument("--created", default="1970-01-01T00:00:00.000Z", help="the time that STIX objects carry")
    parser.add_argument("--days", type=int, default=30, help="how long a new scope lasts")
    parser.add_argument("--limit", type=int, help="new places at most")
    parser.add_argument("--pixels", action="store_true", help="decode pictures too")
    args = parser.parse_args(argv)
    try:
        scope = governance.load(open(args.scope, encoding="utf-8").read(), args.secret) if args.scope else governance.self_audit()
    except (OSError, governance.ScopeError) as e:
        print(e, file=sys.stderr)
        return EXIT_SCOPE
    if args.tiers:
        args.tiers = ",".join(t for t in args.tiers.split(",") if scope.permits(args.command, int(t)))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").appName("casegrain").getOrCreate()
    try:
        tables = COMMANDS[args.command](spark, args)
        for name, table in tables.items():
            if args.out:
                table.write.mode("overwrite").parquet(f"{args.out}/{name}")
            else:
                print(name)
                table.show(50, truncate=60)
    except governance.ScopeError as e:
        print(e, file=sys.stderr)
        return EXIT_SCOPE
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return EXIT_USAGE
    except ValueError as e:
        print(e, file=sys.stderr)
        return EXIT_FORMAT
    return _exit_code(args.command, tables)


def _exit_code(command: str, tables: dict[str, DataFrame]) -> int:
    """Broken chains are custody errors; files that could not be read or walked make a partial failure."""
    if command == "audit" and not tables["faults"].isEmpty():
        return EXIT_CUSTODY
    if command == "probe" and not tables["files"].where("error is not null").isEmpty():
        return EXIT_PARTIAL
    if command == "analyze" and not tables["diagnostics"].where("level = 'error'").isEmpty():
        return EXIT_PARTIAL
    return EXIT_OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
