"""Reports as text, HTML and map files: templates over ordered rows, each file's rows put together in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import geo
from casegrain.operators import exports

#: Rows that a report shows of fields and of findings' values.
MOST_FIELDS, MOST_FINDINGS = 15, 6


def _lines(rows: DataFrame, line: Column, name: str, most: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("sha256").orderBy("ordinal", "name"))
    own = rows.withColumn("_n", place)
    own = own if most is None else own.where(F.col("_n") <= most)
    return own.groupBy("sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))), lambda x: x["t"]), "\n").alias(name))


def text_reports(records: DataFrame, findings: DataFrame, fields: DataFrame) -> DataFrame:
    """(sha256, report): header, verdict, findings by tier, the first fields."""
    found = _lines(findings, F.concat(F.lit("  ["), F.col("tier").cast("string"), F.lit("] "), F.col("name"), F.lit(" ("), F.col("confidence"), F.lit("): "), F.coalesce("value", F.lit(""))), "found")
    known = _lines(fields, F.concat(F.lit("  "), F.col("name"), F.lit(" = "), F.coalesce("value_str", F.lit(""))), "known", MOST_FIELDS)
    rows = records.join(found, "sha256", "left").join(known, "sha256", "left")
    text = F.concat_ws("\n", F.concat(F.lit("File "), F.col("file_name")), F.concat(F.lit("SHA-256 "), F.col("sha256")), F.concat(F.lit("Verdict "), F.col("verdict_label"), F.lit(", risk "), F.col("risk_level"), F.lit(", score "), F.col("confidence_score").cast("string")), F.lit("Findings"), F.coalesce("found", F.lit("  none")), F.lit("Fields"), F.coalesce("known", F.lit("  none")))
    return rows.select("sha256", text.alias("report"))


def escaped(column: Column) -> Column:
    out = column
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def dossier_rows(records: DataFrame, findings: DataFrame) -> DataFrame:
    """(sha256, html): a table row for each record with the names of its first findings; all text escaped."""
    names = _lines(findings, F.col("name"), "names", MOST_FINDINGS)
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    rows = records.join(names, "sha256", "left")
    cells = [cell(F.col("file_name")), cell(F.col("verdict_label")), cell(F.col("risk_level")), cell(F.col("confidence_score").cast("string")), cell(F.replace(F.col("names"), F.lit("\n"), F.lit(", ")))]
    return rows.select("sha256", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def dossier(title: str, counts: dict[str, int], rows: list[str]) -> str:
    """A page around the rows of a case; no remote assets."""
    import html

    boxes = "".join(f"<li>{html.escape(k)}: {int(v)}</li>" for k, v in sorted(counts.items()))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{boxes}</ul><table><tr><th>File</th><th>Verdict</th><th>Risk</th><th>Score</th><th>Findings</th></tr>{''.join(rows)}</table></body></html>"


def html_records(records: DataFrame, findings: DataFrame, fields: DataFrame) -> DataFrame:
    """(sha256, html): a page for each record, with its verdict, findings by tier and all fields; all text escaped, no remote assets."""
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    row = lambda *columns: F.concat(F.lit("<tr>"), *map(cell, columns), F.lit("</tr>"))
    found = _lines(findings, row(F.col("tier").cast("string"), F.col("name"), F.col("confidence"), F.col("value"), F.col("caveat")), "found")
    known = _lines(fields, row(F.col("standard"), F.col("name"), F.col("value_str"), F.col("value_type"), F.col("tag_id")), "known")
    rows = records.join(found, "sha256", "left").join(known, "sha256", "left")
    head = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), escaped(F.col("file_name")), F.lit("</title></head><body><h1>"), escaped(F.col("file_name")), F.lit("</h1>"))
    facts = F.concat(F.lit("<table>"), row(F.lit("SHA-256"), F.col("sha256")), row(F.lit("Verdict"), F.col("verdict_label")), row(F.lit("Risk"), F.col("risk_level")), row(F.lit("Score"), F.col("confidence_score").cast("string")), F.lit("</table>"))
    part = lambda title, names, body: F.concat(F.lit(f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"), F.coalesce(F.col(body), F.lit("")), F.lit("</table>"))
    page = F.concat(head, facts, part("Findings", ("Tier", "Name", "Confidence", "Value", "Caveat"), "found"), part("Fields", ("Standard", "Name", "Value", "Type", "Tag"), "known"), F.lit("</body></html>"))
    return rows.select("sha256", page.alias("html"))


def geojson_documents(points: DataFrame) -> DataFrame:
    """(case_id, part, document): a feature collection with its bounding box for each part of a case."""
    features = exports.geojson_features(points).groupBy("case_id", "part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(1 << 62)).alias("n"), F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("geometry"), F.lit("}")).alias("g")))).alias("all"))
    boxed = features.join(exports.bounding_box(points.withColumn("part", exports.part()), "case_id", "part"), ["case_id", "part"])
    box = F.concat(F.lit("["), F.concat_ws(",", *[F.col(c).cast("string") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]), F.lit("]"))
    return boxed.select("case_id", "part", F.concat(F.lit('{"type":"FeatureCollection","bbox":'), box, F.lit(',"features":['), F.array_join(F.transform("all", lambda x: x["g"]), ","), F.lit("]}")).alias("document"))


def map_documents(points: DataFrame) -> DataFrame:
    """(case_id, part, document): a page with the points and their path drawn on a grid of degrees, as inline SVG."""
    own = points.where(geo.usable(F.col("lat"), F.col("lon")))
    x, y = F.round(F.col("lon") + 180, 5).cast("string"), F.round(90 - F.col("lat"), 5).cast("string")
    name = F.coalesce(F.col("name"), F.col("ordinal").cast("string")) if "name" in points.columns else F.col("ordinal").cast("string")
    dot = F.concat(F.lit("<circle r='0.6' cx='"), x, F.lit("' cy='"), y, F.lit("'><title>"), escaped(name), F.lit("</title></circle>"))
    every = own.groupBy("case_id", exports.part().alias("part")).agg(F.array_sort(F.collect_list(F.struct("ordinal", dot.alias("d"), F.concat(x, F.lit(","), y).alias("p")))).alias("all"))
    grid = "".join(f"<line x1='{k}' y1='0' x2='{k}' y2='180'/>" for k in range(0, 361, 30)) + "".join(f"<line x1='0' y1='{k}' x2='360' y2='{k}'/>" for k in range(0, 181, 30))
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Map</title></head><body><svg viewBox='0 0 360 180' width='100%'><g stroke='#ccc' stroke-width='0.2'>{grid}</g><polyline fill='none' stroke='#36c' stroke-width='0.2' points='"
    return every.select("case_id", "part", F.concat(F.lit(head), F.array_join(F.transform("all", lambda r: r["p"]), " "), F.lit("'/><g fill='#c33'>"), F.array_join(F.transform("all", lambda r: r["d"]), ""), F.lit("</g></svg></body></html>")).alias("document"))


def _document(rows: DataFrame, column: str, head: str, foot: str) -> DataFrame:
    every = rows.groupBy("case_id", exports.part().alias("part")).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col(column).alias("t")))).alias("all"))
    return every.select("case_id", "part", F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["t"]), ""), F.lit(foot)).alias("document"))


def kml_documents(points: DataFrame) -> DataFrame:
    return _document(exports.kml_placemarks(points), "placemark", '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>")


def gpx_documents(points: DataFrame) -> DataFrame:
    return _document(exports.gpx_waypoints(points), "waypoint", '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="casegrain" xmlns="http://www.topografix.com/GPX/1/1">', "</gpx>")


def kmz(document: str) -> bytes:
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("doc.kml", document)
    return raw.getvalue()
