"""The queries of the catalog in DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

from casegrain.operators import verdict
from casegrain.operators.bytestats import AVIF_BRANDS, HEIC_BRANDS, MIME, PAYLOADS, SUFFIXES
from casegrain.operators.encoders import base_table, scaled_table
from casegrain.functions.geo import COMPASS
from casegrain.plans.catalog import FENCES, LIMITS
from casegrain.plans.derive import HEADS, LABELS


def _hav(a: str, b: str, c: str, d: str, radius: float = 6371.0, clamp: bool = False) -> str:
    h = f"sin(radians({c}-{a})/2.0)*sin(radians({c}-{a})/2.0)+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2.0)*sin(radians({d}-{b})/2.0)"
    h = f"least(1.0,greatest(0.0,{h}))" if clamp else f"({h})"
    return f"({2.0 * radius}::DOUBLE*atan2(sqrt({h}),sqrt(1.0-{h})))"


def _usable(lat: str, lon: str) -> str:
    return f"coalesce({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 AND NOT (abs({lat})<0.0001 AND abs({lon})<0.0001), false)"


def _bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}-{b}))*cos(radians({c}))"
    x = f"cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-{b}))"
    return f"((degrees(atan2({y},{x}))+360.0)%360.0::DOUBLE)"


def _list(values, kind: str = "VARCHAR") -> str:
    quote = (lambda v: f"'{v}'") if kind == "VARCHAR" else str
    return "([" + ",".join(quote(v) for v in values) + f"]::{kind}[])"


def _cardinal(b: str) -> str:
    return f"{_list(COMPASS)}[(floor(({b}+11.25)/22.5)::BIGINT%16)+1]"


FIX = """fix AS (SELECT user_id AS case_id, event_id AS ordinal, ts, event_type, value,
 CASE WHEN event_id%11=0 THEN NULL WHEN event_id%97=0 THEN 0.0::DOUBLE ELSE ((user_id*37+event_id*13)%1700)/10::DOUBLE-85 END AS lat,
 CASE WHEN event_id%11=0 THEN NULL WHEN event_id%97=0 THEN 0.0::DOUBLE ELSE ((user_id*53+event_id*29)%3580)/10::DOUBLE-179 END AS lon FROM events)"""
PLACES = "pl AS (SELECT n_nationkey::BIGINT AS place_id, n_name AS name, upper(substr(n_name,1,2)) AS country_code, (n_nationkey*6-72)::DOUBLE AS plat, ((n_nationkey*41)%340-170)::DOUBLE AS plon FROM nation)"
FACILITIES = "fa AS (SELECT s_suppkey AS place_id, CASE WHEN s_suppkey%2=0 THEN 'airport' ELSE 'port' END AS kind, ((s_suppkey*7)%1600)/10::DOUBLE-80 AS plat, ((s_suppkey*31)%3500)/10::DOUBLE-175 AS plon FROM supplier)"
QUANT = "qt AS (SELECT vec_id, label, list_transform(embedding, lambda v: (1+floor(abs(v::DOUBLE)*1000)%255)::INT) AS vals FROM embeddings)"
SIGNS = "hs AS (SELECT vec_id AS id, label::BIGINT AS case_id, list_sum(list_transform(range(0,32), lambda k: CASE WHEN embedding[k+1]>embedding[k+2] THEN (1::BIGINT)<<k ELSE 0 END))::BIGINT AS hash FROM embeddings)"
BLOBS = f"bl AS (SELECT doc_id AS id, 'doc'||doc_id||{_list(('.jpg', '.png', '', '.gif', '.jpg'))}[doc_id%5+1] AS path, {_list(HEADS)}[doc_id%8+1]||hex(encode(text)) AS hex FROM documents)"
FIELDS = """fl AS (SELECT doc_id AS sha256, 0::BIGINT AS ordinal, 'Make' AS name, source AS value_str, '0x010f' AS tag_id FROM documents
 UNION ALL SELECT doc_id, 1, 'ExifSubIFD:LensModel', lang, '0xa434' FROM documents
 UNION ALL SELECT doc_id, 2, 'Software', (n_chars%7)::VARCHAR, '0x0131' FROM documents
 UNION ALL SELECT doc_id, 3, 'Software', (n_chars%5)::VARCHAR, '0x0131' FROM documents
 UNION ALL SELECT doc_id, 4, 'ExifSubIFD:Make', 'long', '0x9999' FROM documents WHERE n_chars>2000)"""
FINDINGS = """fi AS (SELECT doc_id AS sha256, 0 AS ordinal, 3 AS tier, 'trailing_data_detected' AS name, n_chars::VARCHAR AS value FROM documents WHERE doc_id%3=0
 UNION ALL SELECT doc_id, 1, 5, 'gps_coordinates_claimed', '{"latitude":'||(doc_id%90)||',"longitude":'||(doc_id%180)||'}' FROM documents WHERE doc_id%4=0
 UNION ALL SELECT doc_id, 2, 6, 'indicator_timeline_inversion', '1' FROM documents WHERE doc_id%5=0
 UNION ALL SELECT doc_id, 3, 7, 'lsb_entropy_screening', (n_chars%2)::VARCHAR FROM documents WHERE doc_id%7=0)"""
VERDICT_LABELS = f"vl AS (SELECT doc_id AS sha256, {_list(LABELS)}[doc_id*5%7+1] AS verdict_label FROM documents)"

SOLAR = """sun0 AS (SELECT ordinal AS point_id, lat, lon, ts, hour(ts)*60.0::DOUBLE+minute(ts)+second(ts)/60.0::DOUBLE AS m FROM fix WHERE lat IS NOT NULL),
sun1 AS (SELECT *, 2.0*pi()/365.0*(dayofyear(ts)-1+(m/60.0-12.0)/24.0) AS g FROM sun0),
sun2 AS (SELECT *, 229.18*(0.000075+0.001868*cos(g)-0.032077*sin(g)-0.014615*cos(2*g)-0.040849*sin(2*g)) AS eq, 0.006918-0.399912*cos(g)+0.070257*sin(g)-0.006758*cos(2*g)+0.000907*sin(2*g) AS dec FROM sun1),
sun3 AS (SELECT *, (m+eq+4.0*lon)/4.0-180.0 AS ha FROM sun2),
sun4 AS (SELECT *, acos(greatest(-1.0,least(1.0,sin(radians(lat))*sin(dec)+cos(radians(lat))*cos(dec)*cos(radians(ha))))) AS z FROM sun3),
sun5 AS (SELECT *, 180.0-degrees(acos(greatest(-1.0,least(1.0,(sin(radians(lat))*cos(z)-sin(dec))/(cos(radians(lat))*sin(z)))))) AS side FROM sun4),
sun AS (SELECT point_id, round(90.0-degrees(z),2) AS elevation, round(CASE WHEN sin(z)=0 THEN 0 WHEN ha>0 THEN 360.0-side ELSE side END,2) AS azimuth FROM sun5)"""

CHAIN = f"""log AS (SELECT conv_id, turn, row_number() OVER w-1 AS entry_index, sha256(coalesce(text,'')||coalesce(sha256(lag(coalesce(text,'')) OVER w), repeat('0',64))) AS entry_hash FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
chain AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY conv_id ORDER BY turn), repeat('0',64)) AS previous_hash FROM log)"""

BYTES = f"{BLOBS}, hb AS (SELECT id, b, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(hex,'..')) AS b FROM bl) GROUP BY id, b)"
ENTROPY = f"{BYTES}, en AS (SELECT bl.id, coalesce(sum(n),0)::BIGINT AS n_bytes, CASE WHEN coalesce(sum(n),0)>0 THEN log2(sum(n))-sum(n*log2(n))/sum(n) ELSE 0 END AS entropy FROM bl LEFT JOIN hb USING (id) GROUP BY bl.id)"


_HX = "hex(encode({}))"
PICTURES = f"""pc AS (SELECT doc_id, {_HX.format("'Camera-'||source")} AS mk, {_HX.format("coalesce(text,'')")}||{_HX.format("doc_id::VARCHAR")} AS scan, CASE WHEN doc_id%3=0 THEN {_HX.format("'PK'||lang")} ELSE '' END AS tail FROM documents),
px AS (SELECT *, '457869660000'||'49492A0008000000'||'0100'||'0F010200'||lpad(to_hex(length(mk)//2+1),2,'0')||'000000'||'1A000000'||'00000000'||mk||'00' AS ex FROM pc),
pf AS (SELECT *, length(ex)//2+4 AS al, length(scan)//2 AS sl, length(tail)//2 AS tl, 'FFD8'||'FFE1'||lpad(to_hex(length(ex)//2+2),4,'0')||ex||'FFDB004300'||repeat('10',64)||'FFDA0002'||scan||'FFD9'||tail AS hx FROM px),
fi AS (SELECT *, sha256(unhex(hx)) AS sha256 FROM pf)"""


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column},'{w}')" for w in words) + ")"


def _signals() -> str:
    pick = lambda n, *v: f"{_list(v)}[doc_id%{n}+1]"
    kind = f"""CASE WHEN doc_id%19=0 THEN CASE WHEN doc_id%2=0 THEN 'ambiguous_generator' ELSE 'ambiguous' END
      WHEN {_any("model", verdict.GENERATORS)} THEN 'generator' WHEN {_any("model", verdict.EDITORS)} THEN 'editor' WHEN {_any("model", verdict.CODECS)} THEN 'codec'
      WHEN {_any("model", verdict.CAMERAS)} THEN 'camera' WHEN {_any("model", verdict.SOCIAL)} THEN 'social' ELSE 'other' END"""
    return f"""s0 AS (SELECT *, {pick(6, "Apple iPhone 15", "Midjourney v6", "Adobe Photoshop", "MozJPEG", "WhatsApp", "Unknown")} AS model, {pick(4, "HIGH", "MEDIUM", "LOW", "REJECTED")} AS lvl FROM documents),
s1 AS (SELECT doc_id, {kind} AS k, doc_id%13=0 AS trl, doc_id%11=0 AS inv, doc_id%5=0 AS lsb, doc_id%17=0 AS grid, doc_id%29=0 AS enc, doc_id%23=0 AS c2pa, doc_id%3=0 AND doc_id%9<>0 AND lvl NOT IN ('LOW','REJECTED') AS located, n_chars%2=0 AS meta FROM s0),
s2 AS (SELECT *, 0.5::DOUBLE-CASE WHEN trl THEN 0.35::DOUBLE ELSE 0 END-CASE WHEN inv THEN 0.2::DOUBLE ELSE 0 END-CASE WHEN lsb THEN 0.15::DOUBLE ELSE 0 END AS a FROM s1),
s3 AS (SELECT *, CASE WHEN grid THEN least(a,0.2::DOUBLE) ELSE a END AS b FROM s2),
s4 AS (SELECT *, CASE k WHEN 'ambiguous_generator' THEN least(b,0.3::DOUBLE) WHEN 'generator' THEN 0.1 WHEN 'editor' THEN 0.4 WHEN 'codec' THEN 0.5 WHEN 'social' THEN 0.5 WHEN 'camera' THEN b+0.25::DOUBLE ELSE b END::DOUBLE AS c FROM s3),
s5 AS (SELECT *, greatest(0,least(1,c+CASE WHEN c2pa THEN 0.2::DOUBLE ELSE 0 END+CASE WHEN located THEN 0.1::DOUBLE ELSE 0 END)) AS e,
 CASE WHEN enc THEN 'ENCRYPTED_OR_SCRAMBLED_CARRIER' WHEN trl THEN 'TAMPERED_TRAILING_PAYLOAD' WHEN grid OR k IN ('generator','ambiguous_generator') THEN 'AI_SYNTHETIC_GENERATION'
  WHEN k='camera' AND NOT inv AND meta THEN 'AUTHENTIC_CAMERA_CAPTURE' WHEN NOT meta AND k<>'camera' THEN 'UNVERIFIED_METADATA_STRIPPED' WHEN inv THEN 'MODIFIED_METADATA_INCONSISTENT' ELSE 'INCONCLUSIVE_SIGNALS' END AS label FROM s4),
vd AS (SELECT doc_id AS sha256, k AS encoder_kind, label AS verdict_label,
 CASE WHEN label='AUTHENTIC_CAMERA_CAPTURE' THEN true WHEN label IN ('TAMPERED_TRAILING_PAYLOAD','AI_SYNTHETIC_GENERATION','MODIFIED_METADATA_INCONSISTENT') THEN false END AS is_authentic,
 round(CASE WHEN label='AUTHENTIC_CAMERA_CAPTURE' THEN greatest(e,0.9) ELSE e END,2)::DOUBLE AS confidence_score,
 CASE label WHEN 'TAMPERED_TRAILING_PAYLOAD' THEN 'CRITICAL' WHEN 'ENCRYPTED_OR_SCRAMBLED_CARRIER' THEN 'HIGH' WHEN 'AI_SYNTHETIC_GENERATION' THEN 'HIGH' WHEN 'UNVERIFIED_METADATA_STRIPPED' THEN 'MEDIUM' WHEN 'MODIFIED_METADATA_INCONSISTENT' THEN 'MEDIUM' WHEN 'AUTHENTIC_CAMERA_CAPTURE' THEN 'LOW'
  ELSE CASE WHEN k='editor' OR inv THEN 'MEDIUM' ELSE 'LOW' END END AS risk_level, trl FROM s5)"""


def _prints() -> str:
    qualities = (30, 50, 75, 85, 92, 96)
    bases = "[" + ",".join(_list(scaled_table(q), "INT") for q in qualities) + "]"
    return f"""{QUANT}, pr AS (SELECT vec_id AS print_id, list_transform(range(1,65), lambda i: {bases}[vec_id%6+1][i]+(vals[i]%3)*(vec_id%4)::INT) AS lum,
 vec_id%2=0 AS app0, CASE WHEN vec_id%3=0 THEN '4:4:4' ELSE '4:2:0' END AS sub, vec_id%5=0 AS opt FROM qt)"""


def _scored() -> str:
    entries = ((30, "social_media"), (50, "codec_library"), (75, "codec_library"), (85, "editing_software"), (92, "camera_hardware"), (96, "ai_generator"))
    rows = " UNION ALL ".join(f"SELECT 'std_q{q}' AS entry_id, '{c}' AS category, {_list(scaled_table(q), 'INT')} AS t, {'true' if q > 80 else 'false'} AS eopt" for q, c in entries)
    sim = "CASE WHEN lum=t THEN 1.0 ELSE exp(-1.5*list_sum(list_transform(range(1,65), lambda i: abs(ln(greatest(1,lum[i])::DOUBLE)-ln(greatest(1,t[i])::DOUBLE))))/64.0) END"
    return f"""{_prints()}, ent AS ({rows}), sc AS (SELECT print_id, entry_id, category,
 0.45*({sim})+0.15*0.5+0.15*CASE WHEN app0 THEN 1.0 ELSE 0.5 END+0.1*CASE WHEN sub='4:2:0' THEN 1.0 ELSE 0.0 END+0.1*CASE WHEN opt=eopt THEN 1.0 ELSE 0.0 END+0.05*1.0 AS score FROM pr CROSS JOIN ent)"""


def _nearest(only: str = "true") -> str:
    km = _hav("lat", "lon", "plat", "plon", 6371.0088, True)
    return f"""WITH {FIX}, {PLACES}, p AS (SELECT ordinal AS point_id, lat, lon FROM fix WHERE lat IS NOT NULL),
pairs AS (SELECT point_id, place_id, {km} AS km, greatest(abs(plat-lat),abs(plon-lon)) AS apart FROM p CROSS JOIN pl WHERE {only}),
best AS (SELECT point_id, w, min(km) AS km, arg_min(place_id, (km, place_id)) AS place_id FROM pairs, (VALUES (1.0),(3.0),(10.0),(45.0)) AS v(w) WHERE apart<=w GROUP BY point_id, w),
pick AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN km<=150 THEN w ELSE 1000-w END) AS k FROM best)
SELECT point_id, place_id, round(km,3) AS distance_km, km>150 AS approximate FROM pick WHERE k=1"""


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _crc(column: str) -> str:
    """CRC-32 of bytes in hex, in hex."""
    folded = f"list_reduce([4294967295::BIGINT]||list_transform(regexp_extract_all({column},'..'), lambda x: ('0x'||x)::BIGINT), lambda c, x: xor(c>>8, ({_crc_table()}::BIGINT[])[(xor(c,x)&255)+1]))"
    return f"lpad(to_hex(xor({folded},4294967295)),8,'0')"


def _little(value: str, size: int) -> str:
    return "||".join(f"lpad(to_hex((({value})>>{8 * k})&255),2,'0')" for k in range(size))


def _text(text: str) -> str:
    return f"'{text.encode().hex().upper()}'"


_TAIL = "CASE WHEN doc_id%3=0 THEN hex(encode(lang)) ELSE '' END"
_DATA = "hex(encode(coalesce(text,'')))||hex(encode(doc_id::VARCHAR))"
PNGS = f"""p0 AS (SELECT doc_id, source, lang, {_text("IHDR")}||'00000001000000010800000000' AS c1, {_text("tEXtAuthor")}||'00'||hex(encode(source)) AS c2, {_text("tEXtComment")}||'00'||hex(encode(lang)) AS c3, {_text("IDAT")}||{_DATA} AS c4, {_text("IEND")} AS c5, {_TAIL} AS tail FROM documents),
p1 AS (SELECT *, {", ".join(f"lpad(to_hex(length(c{k})//2-4),8,'0')||c{k}||{_crc(f'c{k}')} AS k{k}" for k in range(1, 6))} FROM p0),
pn AS (SELECT *, sha256(unhex('89504E470D0A1A0A'||k1||k2||k3||k4||k5||tail)) AS sha256, {", ".join(f"(length(k{k})//2)::BIGINT AS n{k}" for k in range(1, 6))}, (length(tail)//2)::BIGINT AS nt FROM p1)"""
_XMP = """'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:CreatorTool="'||source||'" xmp:Label="'||lang||'"/></rdf:RDF></x:xmpmeta>'"""
WEBPS = f"""w0 AS (SELECT doc_id, source, lang, {_DATA} AS a, hex(encode({_XMP})) AS b FROM documents),
w1 AS (SELECT *, length(a)//2 AS na, length(b)//2 AS nb FROM w0),
w2 AS (SELECT *, '57454250'||{_text("VP8 ")}||{_little("na", 4)}||a||CASE WHEN na%2=1 THEN '00' ELSE '' END||{_text("XMP ")}||{_little("nb", 4)}||b||CASE WHEN nb%2=1 THEN '00' ELSE '' END AS body FROM w1),
wb AS (SELECT *, sha256(unhex('52494646'||{_little("length(body)//2", 4)}||body)) AS sha256 FROM w2)"""
GIFS = f"""g0 AS (SELECT doc_id, hex(encode(source)) AS s, hex(encode(doc_id::VARCHAR)) AS i, {_TAIL} AS tail FROM documents),
gf AS (SELECT *, sha256(unhex('47494638396101000100800000000000000000'||'21FE'||lpad(to_hex(length(s)//2),2,'0')||s||'00'||'2C00000000010001000002'||lpad(to_hex(length(i)//2),2,'0')||i||'00'||'3B'||tail)) AS sha256, (length(s)//2)::BIGINT AS ns, (length(i)//2)::BIGINT AS ni, (length(tail)//2)::BIGINT AS nt FROM g0)"""
BMPS = f"""b0 AS (SELECT doc_id, hex(encode(doc_id::VARCHAR)) AS i, {_TAIL} AS tail FROM documents),
bm AS (SELECT *, sha256(unhex('424D'||{_little("54+length(i)//2", 4)}||'000000003600000028000000'||repeat('00',36)||i||tail)) AS sha256, (length(i)//2)::BIGINT AS ni, (length(tail)//2)::BIGINT AS nt FROM b0)"""
TIFFS = f"""ti AS (SELECT doc_id, n_chars, sha256(unhex('49492A00080000000400'||'1201030001000000'||{_little("doc_id%8+1", 2)}||'0000'||'0101040001000000'||{_little("n_chars", 4)}||'02010300030000003E000000'||'1A0105000100000044000000'||'00000000'||{_little("doc_id%3", 2)}||{_little("doc_id%5", 2)}||{_little("doc_id%7", 2)}||{_little("doc_id", 4)}||{_little("doc_id%9+1", 4)})) AS sha256 FROM documents)"""


_IPTC = "'1C0205'||lpad(to_hex(length(s)//2),4,'0')||s||'1C0219'||lpad(to_hex(length(l)//2),4,'0')||l"
TAGGED = f"""t0 AS (SELECT doc_id, source, lang, hex(encode(source)) AS s, hex(encode(lang)) AS l, hex(encode(doc_id::VARCHAR)) AS i FROM documents),
t1 AS (SELECT *, {_IPTC} AS data FROM t0),
t2 AS (SELECT *, '{b"Photoshop 3.0".hex().upper()}00{b"8BIM".hex().upper()}04040000'||lpad(to_hex(length(data)//2),8,'0')||data AS cap FROM t1),
tj AS (SELECT *, (length(cap)//2)::BIGINT AS nc, (length(i)//2)::BIGINT AS ni, 0 AS nt, sha256(unhex('FFD8FFE20090{b"ICC_PROFILE".hex().upper()}0001010000008000000000'||lpad(to_hex(doc_id%5),2,'0')||'400000{b"mntrRGB XYZ ".hex().upper()}'||repeat('00',12)||'{b"acsp".hex().upper()}'||repeat('00',8)||'{b"APPL".hex().upper()}'||repeat('00',76)
 ||'FFED'||lpad(to_hex(length(cap)//2+2),4,'0')||cap||'FFDB004300'||repeat(lpad(to_hex(doc_id%200+1),2,'0'),64)||'FFC0001108'||lpad(to_hex(doc_id%999+1),4,'0')||lpad(to_hex(doc_id%777+1),4,'0')||'03012200021101031101FFC4001F0000010501010101010100000000000000000102030405060708090A0BFFDD0004'||lpad(to_hex(doc_id%100+1),4,'0')||'FFDA0002'||i||'FFD9')) AS sha256 FROM t2)"""


def _dms(v: str, plus: str, minus: str) -> str:
    m = f"floor((abs({v})-floor(abs({v})))*60)"
    return f"printf('%d°%d''%.1f\"',floor(abs({v}))::BIGINT,{m}::BIGINT,(abs({v})-floor(abs({v}))-{m}/60.0::DOUBLE)*3600.0::DOUBLE)||CASE WHEN {v}>=0 THEN '{plus}' ELSE '{minus}' END"


def _units(source: str, *rows: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT sha256, '{name}' AS name, ({at})::BIGINT AS offset, ({n})::BIGINT AS length FROM {source}" + (" WHERE nt>0" if name == "TRAILING_DATA" else "") for name, at, n in rows)


def _led(rows: str, near: str, prefix: str, column: str) -> str:
    """Clusters around leaders: in each round the first item of a case that is left leads, and takes what is near."""
    return f"""led AS (SELECT 0 AS n, case_id, ordinal, {column}, NULL::BIGINT AS leader FROM {rows}
 UNION ALL SELECT n+1, case_id, ordinal, {column}, CASE WHEN {near} THEN lead END FROM (SELECT *, min(ordinal) OVER w AS lead, {", ".join(f"first_value({c}) OVER (PARTITION BY case_id ORDER BY ordinal) AS l{c}" for c in column.split(", "))} FROM led WHERE leader IS NULL WINDOW w AS (PARTITION BY case_id)))
SELECT case_id, ordinal, '{prefix}'||n AS cluster_id, leader FROM led WHERE leader IS NOT NULL"""


def _facilities() -> str:
    km = _hav("lat", "lon", "plat", "plon", 6371.0088, True)
    most = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items())
    return f"""WITH {FIX}, {FACILITIES}, near AS (SELECT ordinal AS point_id, kind, place_id, {km} AS km FROM fix CROSS JOIN fa WHERE lat IS NOT NULL)
SELECT point_id, kind, arg_min(place_id,(km,place_id)) AS place_id, round(min(km),3) AS distance_km FROM near WHERE km<=CASE kind {most} END GROUP BY point_id, kind"""


def _fences() -> str:
    edges = []
    for fence, rings in FENCES:
        for r, ring in enumerate(rings):
            edges += [f"({fence},{r},{a[0]}::DOUBLE,{a[1]}::DOUBLE,{b[0]}::DOUBLE,{b[1]}::DOUBLE)" for a, b in zip(ring, ring[-1:] + ring[:-1], strict=True)]
    return f"""WITH {FIX}, ed(f,r,ax,ay,zx,zy) AS (VALUES {",".join(edges)}), p AS (SELECT ordinal AS point_id, lat, lon FROM fix WHERE lat IS NOT NULL),
odd AS (SELECT point_id, f, r, count(*) FILTER (WHERE (ay>lat)<>(zy>lat) AND lon<(zx-ax)*(lat-ay)/(zy-ay)+ax)%2=1 AS inside FROM p CROSS JOIN ed GROUP BY point_id, f, r),
hit AS (SELECT point_id, f FROM odd GROUP BY point_id, f HAVING bool_or(inside AND r=0) AND NOT bool_or(inside AND r>0)),
one AS (SELECT point_id, min(f) AS fence_id FROM hit GROUP BY point_id)
SELECT p.point_id, fence_id, fence_id IS NOT NULL AS inside FROM p LEFT JOIN one USING (point_id)"""


def _cone() -> str:
    left = "((h-hfov/2.0+360.0)%360.0::DOUBLE)"
    return f"""WITH {FIX}, a AS (SELECT ordinal AS point_id, lat, lon, (ordinal%360)::DOUBLE AS h, CASE WHEN ordinal%3=0 AND ordinal%80>0 THEN (ordinal%80)::DOUBLE WHEN ordinal%3=1 AND ordinal%20>0 THEN CASE WHEN (ordinal%20)/2.0::DOUBLE<10 THEN (ordinal%20)/2.0::DOUBLE*5.6 ELSE (ordinal%20)/2.0::DOUBLE END ELSE 50.0 END AS f0 FROM fix WHERE lat IS NOT NULL),
b AS (SELECT *, greatest(1.0,f0)::DOUBLE AS f FROM a),
c AS (SELECT *, degrees(2.0*atan(36.0/(2.0*f))) AS hfov, degrees(2.0*atan(24.0/(2.0*f))) AS vfov, degrees(2.0*atan(sqrt(1872.0::DOUBLE)/(2.0*f))) AS dfov FROM b),
d AS (SELECT c.*, i AS place, ({left}+(i-1)/16.0::DOUBLE*hfov)%360.0::DOUBLE AS br FROM c, range(0,19) AS t(i)),
e AS (SELECT *, asin(sin(radians(lat))*cos(300.0/6371008.8)+cos(radians(lat))*sin(300.0/6371008.8)*cos(radians(br))) AS la FROM d)
SELECT point_id, place::INT AS place, round(hfov,4) AS hfov, round(vfov,4) AS vfov, round(dfov,4) AS dfov,
 round(CASE WHEN place IN (0,18) THEN lat ELSE degrees(la) END,5)+0.0::DOUBLE AS lat,
 round(CASE WHEN place IN (0,18) THEN lon ELSE degrees(radians(lon)+atan2(sin(radians(br))*sin(300.0/6371008.8)*cos(radians(lat)), cos(300.0/6371008.8)-sin(radians(lat))*sin(la))) END,5)+0.0::DOUBLE AS lon FROM e"""


def _confidence() -> str:
    return f"""WITH {FIX}, a AS (SELECT ordinal AS k, {_usable("lat", "lon")} AS ok, CASE WHEN ordinal%4<>0 THEN ordinal%14 END AS dop, (ordinal%90-30)::DOUBLE AS up FROM fix),
b AS (SELECT *, CASE WHEN k%7=0 THEN 'Night' WHEN up>6 THEN 'Daylight' WHEN up>0 THEN 'Golden Hour' WHEN up>=-6 THEN 'Civil Twilight' ELSE 'Night' END AS phase FROM a),
c AS (SELECT k, ok, 0.5::DOUBLE+CASE WHEN k%2=0 THEN 0.2::DOUBLE ELSE 0 END+CASE WHEN dop IS NULL THEN 0 WHEN dop<2 THEN 0.15::DOUBLE WHEN dop<5 THEN 0.1::DOUBLE WHEN dop<10 THEN 0 ELSE -0.1::DOUBLE END+CASE WHEN k%5=0 THEN 0 WHEN (up>0)=(phase IN ('Daylight','Golden Hour')) THEN 0.1::DOUBLE ELSE -0.15::DOUBLE END AS s FROM b),
e AS (SELECT k, ok, CASE WHEN ok THEN greatest(0,least(1,s)) ELSE 0 END AS s FROM c)
SELECT k AS point_id, round(s,2)::DOUBLE AS score, CASE WHEN NOT ok THEN 'REJECTED' WHEN s>=0.8 THEN 'HIGH' WHEN s>=0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM e"""


def _sniff(column: str = "hex") -> str:
    text = lambda t: t.encode().hex().upper()
    brands = lambda names: "(" + ",".join(f"'{text(n)}'" for n in names) + ")"
    s = lambda h: f"starts_with({column},'{h}')"
    c = lambda t: f"contains({column},'{text(t)}')"
    return f"""CASE WHEN {s("FFD8FF")} THEN 'JPEG' WHEN {s("89504E470D0A1A0A")} THEN 'PNG' WHEN {s("49492A00")} OR {s("4D4D002A")} THEN 'TIFF' WHEN {s("52494646")} AND substr({column},17,8)='57454250' THEN 'WEBP'
 WHEN substr({column},9,8)='66747970' AND substr({column},17,8) IN {brands(HEIC_BRANDS)} THEN 'HEIC' WHEN substr({column},9,8)='66747970' AND substr({column},17,8) IN {brands(AVIF_BRANDS)} THEN 'AVIF'
 WHEN {s("474946383761")} OR {s("474946383961")} THEN 'GIF' WHEN {s("424D")} THEN 'BMP' WHEN {s("38425053")} THEN 'PSD'
 WHEN {s("504B0304")} THEN CASE WHEN {c("ppt/")} THEN 'PPTX' WHEN {c("word/")} THEN 'DOCX' WHEN {c("xl/")} THEN 'XLSX' ELSE 'ZIP' END WHEN {c("<svg")} THEN 'SVG' ELSE 'UNKNOWN' END"""


def _case(column: str, pairs, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + f" ELSE {other} END"


def _bucket(words: tuple[str, ...]) -> str:
    return _any("verdict_label", words)


AUTH, TAMP, SYNT, ENCR = ("AUTHENTIC",), ("TAMPERED", "MODIFIED", "TRAILING"), ("SYNTHETIC", "AI"), ("ENCRYPTED", "SCRAMBLED")
_DELTA = "(epoch_us(ts)-epoch_us(pts))/1000000.0::DOUBLE"
_BOTH = f"{_usable('plat', 'plon')} AND {_usable('lat', 'lon')} AND abs({_DELTA})>=1"
_KM = f"CASE WHEN {_BOTH} THEN {_hav('plat', 'plon', 'lat', 'lon')} END"
_KIN = f"""{FIX}, k0 AS (SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fix WINDOW w AS (PARTITION BY case_id ORDER BY ts, ordinal)),
kin AS (SELECT *, {_DELTA} AS delta, {_KM} AS km, {_KM}/abs({_DELTA})*3600.0 AS kmh FROM k0)"""

_IDS = "ids AS (SELECT doc_id AS sha256, CASE WHEN doc_id%3=0 THEN NULL ELSE doc_id%3=1 END AS is_authentic FROM documents)"
_STEP = _bearing("lat", "lon", "tlat", "tlon")
_IP = ("48.83::DOUBLE", "2.35::DOUBLE", "lat", "lon")

ORACLES: dict[str, str] = {
    "timeline_kinematics": f"WITH {_KIN} SELECT case_id, ordinal, ts, delta AS delta_seconds, round(km,3) AS distance_km, round(kmh,1) AS speed_kmh, coalesce(kmh>1000,false) AS kinematic_anomaly FROM kin",
    "timeline_summary": f"WITH {FIX} SELECT case_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts))-epoch_us(min(ts)))/1000000.0::DOUBLE AS duration_seconds FROM fix GROUP BY case_id",
    "sequence_inversion": f"WITH {FIX}, a AS (SELECT case_id, printf('IMG_%08d', ordinal) AS name, CASE WHEN ordinal%10=3 THEN ts-INTERVAL 200 DAY ELSE ts END AS ts FROM fix), b AS (SELECT *, lag(name) OVER w AS previous_name, lag(ts) OVER w AS pts FROM a WINDOW w AS (PARTITION BY case_id ORDER BY name)) SELECT case_id, name, previous_name, {_DELTA} AS delta_seconds FROM b WHERE ts<pts",
    "clock_drift": f"WITH {FIX}, a AS (SELECT ordinal, round((floor(value*10)::BIGINT*1000000)/1000000.0::DOUBLE,2) AS d FROM fix) SELECT ordinal, d AS drift_seconds, abs(d)>300 AS drift_anomaly FROM a",
    "trajectory_steps": f"""WITH {FIX}, a AS (SELECT *, lead(ordinal) OVER w AS to_ordinal, lead(ts) OVER w AS tts, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon FROM fix WHERE {_usable("lat", "lon")} WINDOW w AS (PARTITION BY case_id ORDER BY ordinal)),
 b AS (SELECT *, {_hav("lat", "lon", "tlat", "tlon")} AS km, {_STEP} AS br, abs((epoch_us(tts)-epoch_us(ts))/1000000.0::DOUBLE) AS s FROM a WHERE to_ordinal IS NOT NULL)
 SELECT case_id, ordinal, to_ordinal, round(km,3) AS distance_km, round(br,2) AS bearing, {_cardinal("br")} AS cardinal, s AS seconds, round(CASE WHEN s>0 THEN km/s*3600.0 END,1) AS speed_kmh, coalesce(CASE WHEN s>0 THEN km/s*3600.0 END>1000,false) AS anomaly FROM b""",
    "timestamp_choice": "SELECT event_id AS ordinal, CASE WHEN event_id%3=0 OR event_id%2=0 THEN date_trunc('second',ts) ELSE date_trunc('day',ts) END::TIMESTAMP AS ts, CASE WHEN event_id%3=0 THEN 'DateTimeOriginal' WHEN event_id%2=0 THEN 'ModifyDate' ELSE 'FileSystemMtime' END AS source FROM events",
    "offset_shift": "SELECT event_id AS ordinal, (date_trunc('second',ts)-CASE event_id%3 WHEN 0 THEN INTERVAL 120 MINUTE WHEN 1 THEN INTERVAL (-570) MINUTE ELSE INTERVAL 0 MINUTE END)::TIMESTAMP AS utc FROM events",
    "mtime_crosscheck": "WITH a AS (SELECT event_id AS ordinal, floor(value*100)::BIGINT AS gap FROM events) SELECT ordinal, gap>0 AND NOT (gap<86400 AND (gap%900<120 OR gap%900>780)) AS precedes FROM a",
    "coordinate_status": f"WITH {FIX}, a AS (SELECT ordinal AS point_id, CASE WHEN ordinal%13=0 THEN lat*2 ELSE lat END AS lat, lon FROM fix) SELECT point_id, CASE WHEN NOT coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180,false) THEN 'OUT_OF_BOUNDS' WHEN abs(lat)<0.0001 AND abs(lon)<0.0001 THEN 'NULL_ISLAND' ELSE 'VALID' END AS status FROM a",
    "solar_position": f"WITH {FIX}, {SOLAR} SELECT point_id, round(elevation,1)+0.0::DOUBLE AS elevation, round(azimuth,1)+0.0::DOUBLE AS azimuth FROM sun",
    "day_phase": f"WITH {FIX}, {SOLAR}, a AS (SELECT floor(round(elevation,1)) AS up FROM sun) SELECT up::BIGINT AS elevation, CASE WHEN up>6 THEN 'Daylight' WHEN up>0 THEN 'Golden Hour' WHEN up>=-6 THEN 'Civil Twilight' ELSE 'Night' END AS phase, count(*) AS n FROM a GROUP BY 1,2",
    "shadow_geometry": "WITH a AS (SELECT event_id AS point_id, event_id%170/2.0::DOUBLE-10.0 AS el, (event_id%360)::DOUBLE AS az FROM events), b AS (SELECT *, 1.0/tan(radians(el)) AS f FROM a WHERE el>0.5) SELECT point_id, round((az+180.0)%360.0,2)::DOUBLE AS bearing, round(f,3) AS multiplier, round(f*1.8::DOUBLE,2) AS length_1_8m, round(f*5.0::DOUBLE,2) AS length_5_0m, round(f*10.0::DOUBLE,2) AS length_10_0m FROM b",
    "viewing_cone": _cone(),
    "location_confidence": _confidence(),
    "gnss_integrity": "WITH a AS (SELECT event_id AS point_id, 0.5::DOUBLE+CASE WHEN event_id%2=0 THEN 0.15::DOUBLE ELSE 0 END+CASE WHEN event_id%3=0 THEN 0.15::DOUBLE ELSE 0 END+CASE WHEN event_id%5=0 THEN 0.1::DOUBLE ELSE 0 END+CASE WHEN event_id%12 BETWEEN 0.5 AND 8 THEN 0.1::DOUBLE ELSE 0 END AS s FROM events) SELECT point_id, round(s,2) AS score, s>=0.75::DOUBLE AS probable FROM a",
    "nearest_place": _nearest(),
    "facility_context": _facilities(),
    "geofence_membership": _fences(),
    "ip_correlation": f"""WITH {FIX}, a AS (SELECT ordinal AS point_id, round({_hav(*_IP)},3) AS km, {_bearing(*_IP)} AS br FROM fix WHERE {_usable("lat", "lon")})
 SELECT point_id, km AS distance_km, round(br,2) AS bearing, {_cardinal("br")} AS cardinal, CASE WHEN km<=60 THEN 'CORROBORATED_METRO' WHEN km<=300 THEN 'REGIONAL_PROXIMITY' WHEN km<=1200 THEN 'NATIONAL_PROXIMITY' ELSE 'DISCREPANCY_ANOMALY' END AS verdict, km>1200 AS suspicious FROM a""",
    "places_merge": f"WITH {PLACES} SELECT place_id, name, country_code, plat AS lat, plon AS lon FROM pl WHERE place_id%2=0 UNION ALL SELECT place_id, lower(name), country_code, plat, plon FROM pl WHERE place_id%2=1 UNION ALL SELECT place_id, name, country_code, plat+1, plon FROM pl",
    "jpeg_segments": f"WITH {TAGGED} {_units('tj', ('SOI', '0', '2'), ('APP2', '2', '146'), ('APP13', '148', 'nc+4'), ('DQT', '152+nc', '69'), ('SOF0', '221+nc', '19'), ('DHT', '240+nc', '33'), ('DRI', '273+nc', '6'), ('SOS', '279+nc', '4'), ('EOI', '283+nc+ni', '2'))}",
    "caption_and_profile_fields": f"""WITH {TAGGED}, v AS (SELECT sha256, unnest([('IPTC','iptc:ObjectName',source),('IPTC','iptc:Keywords',lang),('ICC','ProfileSize','128'),('ICC','Version',(doc_id%5)||'.4'),('ICC','DeviceClass','mntr'),('ICC','ColorSpace','RGB'),('ICC','ConnectionSpace','XYZ'),('ICC','DeviceManufacturer','APPL'),('ICC','DeviceModel','')]) AS x FROM tj) SELECT sha256, x[1] AS standard, x[2] AS name, x[3] AS value_str FROM v""",
    "quantisation_of_files": f"WITH {TAGGED} SELECT sha256 AS print_id, array_to_string(list_transform(range(64), lambda k: doc_id%200+1),',') AS lum, '4:2:0' AS subsampling, 'SOF0' AS sof, (doc_id%100+1)::INT AS restart, sha256(unhex('00010501010101010100000000000000000102030405060708090A0B')) AS code_hash, false AS optimized FROM tj",
    "tier2_fingerprints": f"WITH {PICTURES} SELECT sha256, 2 AS tier, 'encoder_composite_fingerprint' AS name, 'observed' AS confidence, sha256('FMT:JPEG|DQT:'||sha256(array_to_string(list_transform(range(64), lambda k: 16),','))||'|DHT:|SUB:None|SEG:SOI,APP1,DQT,SOS,EOI'||CASE WHEN tl>0 THEN ',TRAILING_DATA' ELSE '' END||'|DRI:0') AS value FROM fi",
    "tier3_findings": f"WITH {PICTURES} SELECT sha256, 'trailing_data_detected' AS name, 77+al+sl AS offset, tl AS length FROM fi WHERE tl>0",
    "distance_units": f"WITH {FIX}, a AS (SELECT ordinal AS point_id, ordinal*0.25::DOUBLE AS km FROM fix) SELECT point_id, round(km,3) AS distance_km, round(km*0.621371::DOUBLE,3) AS distance_miles, round(km*0.539957::DOUBLE,3) AS distance_nautical_miles, round(km*1000.0::DOUBLE,1) AS distance_meters FROM a",
    "sexagesimal": f"WITH {FIX}, a AS (SELECT ordinal AS k, (ordinal%90)::DOUBLE+(ordinal%60)::DOUBLE/60.0::DOUBLE+((ordinal%600)/10.0::DOUBLE)/3600.0::DOUBLE AS v FROM fix) SELECT k AS point_id, round(CASE WHEN k%4 IN (1,3) THEN -v ELSE v END,9) AS degrees, round(CASE WHEN k%7=0 THEN k::DOUBLE ELSE k/(k%7)::DOUBLE END,9) AS ratio FROM a",
    "coordinate_texts": f"""WITH {FIX}, a AS (SELECT ordinal AS point_id, ordinal%170-85+0.25::DOUBLE AS lat, ordinal%340-170-0.5::DOUBLE AS lon FROM fix WHERE lat IS NOT NULL)
 SELECT point_id, {_dms('lat', 'N', 'S')}||', '||{_dms('lon', 'E', 'W')} AS dms, printf('%.6f, %.6f',lat,lon) AS pair, printf('https://www.google.com/maps?q=%.6f,%.6f',lat,lon) AS google_maps, 'https://geohack.toolforge.org/geohack.php?params='||printf('%.4f_%s_%.4f_%s',abs(lat),CASE WHEN lat>=0 THEN 'N' ELSE 'S' END,abs(lon),CASE WHEN lon>=0 THEN 'E' ELSE 'W' END) AS geohack FROM a""",
    "cartesian_points": f"WITH {FIX} SELECT ordinal AS point_id, round(cos(radians(lat))*cos(radians(lon)),6)+0.0 AS x, round(cos(radians(lat))*sin(radians(lon)),6)+0.0 AS y, round(sin(radians(lat)),6)+0.0 AS z FROM fix WHERE lat IS NOT NULL",
    "satellite_times": "SELECT event_id AS point_id, CASE WHEN event_id%6<>0 THEN date_trunc('second',ts) END AS ts FROM events",
    "timestamp_texts": "WITH a AS (SELECT event_id AS k, date_trunc('second',ts) AS s, date_trunc('day',ts)::TIMESTAMP AS d FROM events) SELECT k AS point_id, CASE WHEN k%5<3 THEN s WHEN k%5=3 THEN d END AS locator, CASE WHEN k%5<2 THEN s END AS timeline, CASE WHEN k%5<2 THEN s END AS crosscheck, CASE WHEN k%5<2 THEN s WHEN k%5=3 THEN d END AS indicated FROM a",
    "capture_times": "WITH a AS (SELECT event_id AS k, date_trunc('second',ts) AS s FROM events) SELECT k AS point_id, CASE WHEN k%3=0 THEN s-INTERVAL 2 HOUR WHEN k%2=0 THEN s-INTERVAL 330 MINUTE ELSE s END AS utc, k%2=1 OR k%3=0 AS fits FROM a",
    "span_texts": "WITH a AS (SELECT event_id AS k, CASE event_id%3 WHEN 0 THEN (event_id%60)*0.5::DOUBLE WHEN 1 THEN 60+6*(event_id%500) ELSE 3600+360*(event_id%1000) END::DOUBLE AS s FROM events) SELECT k AS point_id, CASE WHEN s<60 THEN printf('%.1fs',s) WHEN s<3600 THEN printf('%.1fm',s/60.0::DOUBLE) ELSE printf('%.1fh',s/3600.0::DOUBLE) END AS text FROM a",
    "severity_order": "SELECT doc_id, (doc_id%5+1)::INT AS severity FROM documents",
    "first_fields": f"WITH {FIELDS}, a AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY ordinal) AS n FROM fl) SELECT sha256, ordinal, name FROM a WHERE n<=2",
    "record_store": "SELECT doc_id AS sha256, CASE WHEN doc_id%4=0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id%5<>0",
    "place_lines": "SELECT n_name AS name, NULL::VARCHAR AS country, CASE n_nationkey%3 WHEN 0 THEN 'XX' WHEN 1 THEN 'YY' END AS country_code, NULL::VARCHAR AS admin1, (n_nationkey*2-25)::DOUBLE AS lat, (n_nationkey*7-90)::DOUBLE AS lon, CASE WHEN n_nationkey%3=1 THEN 'Z/1' END AS timezone, CASE WHEN n_nationkey%3=0 THEN n_nationkey END::BIGINT AS population FROM nation WHERE n_nationkey%5<>4",
    "address_answers": "SELECT n_nationkey AS key, '10.0.0.'||n_nationkey AS ip, 'ZZ' AS country_code, n_name AS city, (n_nationkey*8-80)::DOUBLE AS lat, (n_nationkey*10)::DOUBLE AS lon, 'AS1' AS autonomous_system FROM nation WHERE n_nationkey%4<>0 AND n_nationkey*8-80<=90 AND n_nationkey*10<=180",
    "geojson_fences": _fences(),
    "dossier_lines": f"""WITH {_signals()}, {FINDINGS}, n AS (SELECT sha256, string_agg(name, ', ' ORDER BY ordinal, name) AS names FROM fi GROUP BY sha256)
 SELECT sha256, '<tr><td>&lt;'||sha256||'&gt; &amp; co</td><td>'||verdict_label||'</td><td>'||risk_level||'</td><td>'||confidence_score||'</td><td>'||coalesce(names,'')||'</td></tr>' AS html FROM vd LEFT JOIN n USING (sha256)""",
    "text_reports": f"""WITH {_signals()}, {FINDINGS}, {FIELDS}, f AS (SELECT sha256, string_agg('  ['||tier||'] '||name||' (derived): '||value, chr(10) ORDER BY ordinal, name) AS t FROM fi GROUP BY sha256), k AS (SELECT sha256, string_agg('  '||name||' = '||value_str, chr(10) ORDER BY ordinal, name) AS t FROM fl GROUP BY sha256)
 SELECT sha256, 'File '||sha256||chr(10)||'SHA-256 '||sha256||chr(10)||'Verdict '||verdict_label||', risk '||risk_level||', score '||confidence_score||chr(10)||'Findings'||chr(10)||coalesce(f.t,'  none')||chr(10)||'Fields'||chr(10)||k.t AS report FROM vd LEFT JOIN f USING (sha256) JOIN k USING (sha256)""",
    "cluster_visual": f"WITH RECURSIVE {SIGNS}, it AS (SELECT case_id, id AS ordinal, hash FROM hs), {_led('it', 'bit_count(xor(hash,lhash))<=5', 'VIS_', 'hash')}",
    "cluster_geo": f"WITH RECURSIVE {FIX}, it AS (SELECT case_id, ordinal, lat, lon FROM fix WHERE {_usable('lat', 'lon')}), {_led('it', _hav('llat', 'llon', 'lat', 'lon') + '<=2000', 'GEO_', 'lat, lon')} UNION ALL SELECT case_id, ordinal, 'GEO_NONE', NULL FROM fix WHERE NOT {_usable('lat', 'lon')}",
    "near_dup_links": f"WITH {SIGNS}, a AS (SELECT id, hash&986895 AS h FROM hs), c AS (SELECT h, count(*) AS n FROM a GROUP BY h), m AS (SELECT x.h, sum(CASE WHEN x.h=y.h THEN y.n-1 ELSE y.n END)::BIGINT AS links FROM c x JOIN c y ON bit_count(xor(x.h,y.h))<=5 GROUP BY x.h) SELECT id, n-1 AS same, links FROM a JOIN c USING (h) JOIN m USING (h)",
    "exif_numbers": """SELECT doc_id::VARCHAR AS sha256, 'Orientation' AS name, 'SHORT' AS value_type, doc_id%8+1 AS first_long, 1 AS n_longs, NULL::BIGINT AS num, NULL::BIGINT AS den FROM documents
 UNION ALL SELECT doc_id::VARCHAR, 'Tag_0x0101', 'LONG', n_chars, 1, NULL, NULL FROM documents UNION ALL SELECT doc_id::VARCHAR, 'Tag_0x0102', 'SHORT[]', doc_id%3, 3, NULL, NULL FROM documents UNION ALL SELECT doc_id::VARCHAR, 'XResolution', 'RATIONAL', NULL, 0, doc_id, doc_id%9+1 FROM documents""",
    "png_units": f"WITH {PNGS} {_units('pn', ('PNG_HEADER', '0', '8'), ('IHDR', '8', 'n1'), ('tEXt', '8+n1', 'n2'), ('tEXt', '8+n1+n2', 'n3'), ('IDAT', '8+n1+n2+n3', 'n4'), ('IEND', '8+n1+n2+n3+n4', 'n5'), ('TRAILING_DATA', '8+n1+n2+n3+n4+n5', 'nt'))}",
    "png_text_fields": f"WITH {PNGS} SELECT sha256, 'PNG' AS standard, 'png:Author' AS name, source AS value_str FROM pn UNION ALL SELECT sha256, 'PNG', 'png:Comment', lang FROM pn",
    "clean_png": f"WITH {PNGS}, c AS (SELECT sha256, '89504E470D0A1A0A'||k1||k4||k5 AS h FROM pn) SELECT sha256, sha256(unhex(h)) AS cleaned_sha256, (length(h)//2)::BIGINT AS length FROM c",
    "walk_faults": f"WITH {PNGS} SELECT sha256, 'warning' AS level, 'no IEND' AS message, 8+n1+n2+n3+n4 AS offset FROM pn",
    "webp_units": f"WITH {WEBPS} {_units('wb', ('RIFF_HEADER', '0', '12'), ('RIFF_VP8', '12', 'na+8'), ('RIFF_XMP', '20+na+na%2', 'nb+8'))}",
    "xmp_fields": f"WITH {WEBPS} SELECT sha256, 'xmp:CreatorTool' AS name, source AS value_str FROM wb UNION ALL SELECT sha256, 'xmp:Label', lang FROM wb",
    "gif_units": f"WITH {GIFS} {_units('gf', ('HEADER', '0', '6'), ('LSD', '6', '7'), ('GCT', '13', '6'), ('COMMENT', '19', 'ns+4'), ('FRAME_1', '23+ns', 'ni+13'), ('TRAILER', '36+ns+ni', '1'), ('TRAILING_DATA', '37+ns+ni', 'nt'))}",
    "bmp_units": f"WITH {BMPS} {_units('bm', ('BMP_HEADER', '0', '14'), ('DIB_HEADER', '14', '40'), ('PIXEL_ARRAY', '54', 'ni'), ('TRAILING_DATA', '54+ni', 'nt'))}",
    "tiff_units": f"WITH {TIFFS} {_units('ti', ('TIFF_HEADER', '0', '8'), ('IFD0', '8', '54'))}",
    "pair_compare": f"""WITH {PICTURES}, c AS (SELECT doc_id, length(hx)//2 AS n, 2+69+4+sl+2 AS m FROM fi), a AS (SELECT 'next'||x.doc_id AS pair_id, (y.n-x.n)::BIGINT AS size_delta, false AS d FROM c x JOIN c y ON y.doc_id=x.doc_id+1 UNION ALL SELECT 'clean'||doc_id, (m-n)::BIGINT, true FROM c)
 SELECT pair_id, size_delta, false AS sha256_match, d AS data_match, 0.0::DOUBLE AS dqt_distance, 100.0::DOUBLE AS dqt_similarity, CASE WHEN d THEN 'METADATA_ONLY_MODIFICATION' ELSE 'INCONCLUSIVE_DIFFERENCE' END AS verdict FROM a""",
    "relational_fields": f"WITH {FIELDS} SELECT sha256 AS image_sha256, tag_id, name AS tag_name, CASE WHEN sha256%3=0 THEN value_str ELSE 'old' END AS field_value FROM fl WHERE NOT (sha256%3=0 AND name='Software')",
    "relational_findings": f"WITH {FINDINGS} SELECT sha256 AS image_sha256, tier, name, 'derived' AS confidence, 'x' AS extractor, value AS value_json FROM fi",
    "relational_joined": f"WITH {_signals()}, {FIELDS}, {FINDINGS} SELECT sha256, verdict_label, (SELECT count(*) FROM fl WHERE fl.sha256=vd.sha256) AS n_fields, (SELECT count(*) FROM fi WHERE fi.sha256=vd.sha256) AS n_findings, (SELECT max(tier) FROM fi WHERE fi.sha256=vd.sha256) AS top_tier, CASE WHEN sha256%4=0 THEN (sha256%90)::DOUBLE END AS latitude, CASE WHEN sha256%4=0 THEN (sha256%180)::DOUBLE END AS longitude FROM vd",
    "json_repair": "SELECT doc_id, CASE WHEN doc_id%4<3 THEN n_chars END AS score, CASE WHEN doc_id%4=3 THEN 'no object here' END AS raw FROM documents",
    "place_zones": f"WITH near AS ({_nearest()}), {FIX}, h AS (SELECT ordinal AS point_id, round_even(lon/15.0,0)::INT AS h FROM fix WHERE lat IS NOT NULL) SELECT h.point_id, CASE WHEN near.place_id%3<>0 THEN 'Zone/'||n_name ELSE 'Etc/GMT'||CASE WHEN h>=0 THEN '+' ELSE '-' END||abs(h) END AS zone FROM h LEFT JOIN near USING (point_id) LEFT JOIN nation ON n_nationkey=near.place_id",
    "places_ingest": f"WITH {PLACES}, a AS (SELECT place_id, name, country_code, plat+2 AS lat, plon AS lon, 100-place_id AS o FROM pl UNION ALL SELECT place_id, name, country_code, plat, plon, place_id+200 FROM pl WHERE place_id%2=1) SELECT place_id, name, country_code, plat AS lat, plon AS lon FROM pl WHERE place_id%2=0 UNION ALL (SELECT place_id, name, country_code, lat, lon FROM a ORDER BY o LIMIT 10)",
    "geocode_choice": f"WITH a AS ({_nearest('place_id%2=0')}), b AS ({_nearest('place_id%2=1')}), u AS (SELECT *, 'index' AS origin, 0 AS n FROM a UNION ALL SELECT *, 'list', 1 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_km, n) AS k FROM u) SELECT point_id, place_id, distance_km, approximate, origin, round(distance_km*0.621371::DOUBLE,3) AS distance_miles FROM r WHERE k=1",
    "audit_content_verify": """WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS n, sha256(coalesce(text,'')) AS t FROM conversations),
 r AS (SELECT conv_id, n, sha256('{"entry_index": 0, "previous_hash": "'||repeat('0',64)||'", "text": "'||t||'"}') AS h FROM c WHERE n=0 UNION ALL SELECT c.conv_id, c.n, sha256('{"entry_index": '||c.n||', "previous_hash": "'||h||'", "text": "'||t||'"}') FROM r JOIN c ON c.conv_id=r.conv_id AND c.n=r.n+1),
 s AS (SELECT conv_id, count(*) AS n_entries, arg_max(h,n) AS last FROM r GROUP BY conv_id),
 f AS (SELECT *, CASE WHEN conv_id%5=1 AND n_entries>1 THEN 'index' WHEN conv_id%5=2 AND n_entries>2 THEN 'content' WHEN conv_id%5=3 AND n_entries>1 THEN 'unreadable' WHEN conv_id%5=4 AND n_entries>1 THEN 'link' END AS reason FROM s)
 SELECT conv_id, n_entries, CASE WHEN reason='content' THEN 2 WHEN reason IS NOT NULL THEN 1 END::BIGINT AS broken_position, reason, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN last END AS head FROM f""",
    "cluster_camera": """WITH a AS (SELECT doc_id, CASE WHEN doc_id%10<>0 THEN trim(source||' '||lang) ELSE 'Unknown / Stripped Camera' END||CASE WHEN doc_id%4=0 THEN ' | SN:'||(doc_id%3) ELSE '' END AS l FROM documents),
 b AS (SELECT l, count(*) AS n, min(doc_id) AS f FROM a GROUP BY l) SELECT 'CAM_'||row_number() OVER (ORDER BY f) AS cluster_id, l AS cluster_label, n AS item_count, f AS first_ordinal FROM b""",
    "cluster_dqt": f"WITH {QUANT}, a AS (SELECT 'DQT_Profile_'||substr(sha256((vals[1]%16)::VARCHAR),1,8) AS l, vec_id FROM qt), b AS (SELECT l, count(*) AS n, min(vec_id) AS f FROM a GROUP BY l) SELECT 'DQT_'||row_number() OVER (ORDER BY f) AS cluster_id, l AS cluster_label, n AS item_count, f AS first_ordinal FROM b",
    "cluster_outliers": "WITH b AS (SELECT lang||'|'||(n_chars%101) AS l, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1) SELECT l AS cluster_label, n AS item_count, f AS first_ordinal FROM b WHERE n=1 AND (SELECT max(n)>=3 AND count(*)>1 FROM b)",
    "near_dup_pairs": f"WITH {SIGNS} SELECT x.id AS a, y.id AS b, bit_count(xor(x.hash,y.hash))::INT AS distance FROM hs x JOIN hs y ON x.id<y.id WHERE bit_count(xor(x.hash,y.hash))<=5",
    "table_quality": f"""WITH {_prints()}, r AS (SELECT print_id, list_avg(list_transform(range(2,34), lambda i: lum[i]/{_list(base_table(), "INT")}[i]::DOUBLE)) AS m FROM pr) SELECT print_id, greatest(1,least(100,round(CASE WHEN m>1 THEN 50.0/m ELSE 100.0-50.0*m END)::INT)) AS quality FROM r""",
    "composite_fingerprint": f"WITH {QUANT} SELECT vec_id, sha256('FMT:JPEG|DQT:'||sha256(array_to_string(vals[1:32],','))||','||sha256(array_to_string(vals[33:64],','))||'|DHT:|SUB:'||CASE WHEN vec_id%2=0 THEN '4:2:0' ELSE 'None' END||'|SEG:SOI,DQT|DRI:'||CASE WHEN vec_id%3=0 THEN vec_id ELSE 0 END) AS composite_hash FROM qt",
    "candidate_ranking": f"WITH {_scored()} SELECT print_id, entry_id, round(score,6)::DOUBLE AS score FROM sc",
    "encoder_attribution": f"""WITH {_scored()}, b AS (SELECT *, max(score) OVER (PARTITION BY print_id) AS best FROM sc)
 SELECT print_id, CASE WHEN max(best)<0.75 THEN 'INSUFFICIENT' WHEN count(*) FILTER (WHERE score>=best-0.02 AND score>=0.75)>1 THEN 'AMBIGUOUS' ELSE 'INDICATIVE' END AS outcome, arg_min(entry_id,(-score,entry_id)) AS entry_id, arg_min(category,(-score,entry_id)) AS category, round(max(best),3)::DOUBLE AS score,
 count(*) FILTER (WHERE score>=best-0.02 AND score>=0.75) AS n_candidates, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE score>=best-0.02 AND score>=0.75)),','),'') AS categories FROM b GROUP BY print_id""",
    "metadata_diff": f"""WITH {FIELDS}, l AS (SELECT sha256, name, arg_max(value_str,ordinal) AS v FROM fl GROUP BY 1,2), p AS (SELECT x.doc_id AS a, x.doc_id+1 AS b FROM documents x WHERE x.doc_id+1 IN (SELECT doc_id FROM documents)),
 l1 AS (SELECT a AS pair_id, name, v FROM p JOIN l ON sha256=a), l2 AS (SELECT a AS pair_id, name, v FROM p JOIN l ON sha256=b)
 SELECT coalesce(l1.pair_id,l2.pair_id) AS pair_id, coalesce(l1.name,l2.name) AS name, CASE WHEN l1.name IS NULL THEN 'added' WHEN l2.name IS NULL THEN 'removed' WHEN l1.v IS NOT DISTINCT FROM l2.v THEN 'identical' ELSE 'modified' END AS change, l1.v AS value_a, l2.v AS value_b FROM l1 FULL JOIN l2 ON l1.pair_id=l2.pair_id AND l1.name=l2.name""",
    "diff_verdict": """WITH a AS (SELECT doc_id, doc_id%31=0 AS f, doc_id%2<>0 AND doc_id%7=0 AS dt, doc_id%3<>0 AND doc_id%5=0 AS px, doc_id%3<>0 AS known, doc_id%100 AS alt, (doc_id%10)/10::DOUBLE AS ss, CASE WHEN doc_id%4<>0 THEN doc_id%20 END AS lk FROM documents)
 SELECT doc_id, CASE WHEN f THEN 'EXACT_BITWISE_MATCH' WHEN dt THEN 'METADATA_ONLY_MODIFICATION' WHEN px THEN 'CONTAINER_OR_RECOMPRESS_IDENTICAL_PIXELS' WHEN known AND alt<=25 AND ss>0.6::DOUBLE THEN 'LOCALIZED_TAMPERING_OR_EDIT' WHEN known AND ss>0.85::DOUBLE AND lk<=10 THEN 'VISUALLY_SIMILAR_RECOMPRESSION' WHEN known THEN 'DISTINCT_OR_HEAVILY_ALTERED_IMAGES' WHEN lk<=5 THEN 'PERCEPTUAL_NEAR_MATCH' WHEN lk IS NOT NULL THEN 'DISTINCT_IMAGES' ELSE 'INCONCLUSIVE_DIFFERENCE' END AS verdict FROM a""",
    "table_distance": f"WITH {QUANT}, a AS (SELECT x.vec_id, sqrt(list_sum(list_transform(range(1,65), lambda i: ((x.vals[i]-y.vals[i])*(x.vals[i]-y.vals[i]))::DOUBLE))) AS d FROM qt x JOIN qt y ON y.vec_id=x.vec_id+1) SELECT vec_id, round(d,3) AS distance, round(100.0/(1.0+d/50.0),1) AS similarity FROM a",
    "field_lookup": f"WITH {FIELDS} SELECT sha256, arg_min(value_str,ordinal) AS value_str FROM fl WHERE lower(name)='make' OR ends_with(lower(name),':make') GROUP BY sha256",
    "field_map": "SELECT doc_id AS sha256, source AS Make, (n_chars%5)::VARCHAR AS Software, lang AS LensModel FROM documents",
    "select_fields": f"WITH {FIELDS} SELECT sha256, ordinal, name, value_str FROM fl WHERE lower(name)='make' OR tag_id='0x0131'",
    "findings_by_tier": f"WITH {FINDINGS} SELECT sha256, name, value FROM fi WHERE tier=5",
    "record_filter_gps": f"WITH {_IDS} SELECT * FROM ids WHERE sha256%4=0",
    "record_filter_payload": f"WITH {_IDS} SELECT * FROM ids WHERE sha256%3=0",
    "record_filter_tier": f"WITH {_IDS} SELECT * FROM ids WHERE sha256%5=0",
    "record_filter_authentic": f"WITH {_IDS} SELECT * FROM ids WHERE is_authentic",
    "record_filter_modified": f"WITH {_IDS} SELECT * FROM ids WHERE NOT is_authentic",
    "record_filter_unknown": f"WITH {_IDS} SELECT * FROM ids",
    "triage_counts": f"""WITH {VERDICT_LABELS}, a AS (SELECT 'authentic' AS bucket FROM vl WHERE {_bucket(AUTH)} UNION ALL SELECT 'tampered' FROM vl WHERE {_bucket(TAMP)} UNION ALL SELECT 'synthetic' FROM vl WHERE {_bucket(SYNT)} UNION ALL SELECT 'encrypted' FROM vl WHERE {_bucket(ENCR)} UNION ALL SELECT 'inconclusive' FROM vl WHERE NOT {_bucket(AUTH + TAMP + SYNT + ENCR)})
 SELECT bucket, count(*) AS n, round(100.0::DOUBLE*count(*)/(SELECT count(*) FROM vl),1) AS percent FROM a GROUP BY bucket""",
    "dossier_kpis": f"WITH {VERDICT_LABELS} SELECT CASE WHEN {_bucket(AUTH)} THEN 'authentic' WHEN {_bucket(TAMP)} THEN 'tampered' WHEN {_bucket(SYNT)} THEN 'synthetic' WHEN {_bucket(ENCR)} THEN 'encrypted' ELSE 'unverified' END AS badge, count(*) AS n FROM vl GROUP BY 1",
    "verdict_fold": f"WITH {_signals()} SELECT sha256, encoder_kind, verdict_label, is_authentic, confidence_score, risk_level FROM vd",
    "container_anomalies": "WITH a AS (SELECT l_orderkey AS sha256, CASE WHEN l_orderkey%2=0 AND l_linenumber%3<>0 THEN 'multiple_sof' WHEN l_orderkey%2<>0 AND l_linenumber%3=0 THEN 'multiple_ihdr' END AS anomaly FROM lineitem) SELECT sha256, anomaly, count(*) AS n FROM a WHERE anomaly IS NOT NULL GROUP BY 1,2 HAVING count(*)>1",
    "record_page": f"WITH {BLOBS} SELECT DISTINCT sha256(hex) AS sha256 FROM bl ORDER BY 1 LIMIT 25 OFFSET 10",
    "corpus_override": "SELECT p_partkey AS entry_id, p_brand AS category FROM part WHERE p_partkey%2=0 AND p_partkey%3<>0 UNION ALL SELECT p_partkey, 'user' FROM part WHERE p_partkey%3=0",
    "wordlist_candidates": """WITH w AS (SELECT 0 AS p, item_id::BIGINT AS k, string_split(regexp_replace(lower(text),'[^a-z]+',' ','g'),' ') AS ws FROM benchmark UNION ALL SELECT 1, doc_id::BIGINT, string_split(regexp_replace(lower(text),'[^a-z]+',' ','g'),' ') FROM documents),
 x AS (SELECT p, k, unnest(ws) AS candidate, unnest(range(0,len(ws)))::INT AS i FROM w) SELECT candidate, arg_min(p,(p,k,i)) AS priority, arg_min(k,(p,k,i)) AS source_id, arg_min(i,(p,k,i)) AS place FROM x WHERE candidate<>'' GROUP BY candidate""",
    "audit_chain": f"WITH {CHAIN} SELECT conv_id, turn, entry_index, previous_hash, entry_hash FROM chain",
    "audit_chain_verify": f"""WITH {CHAIN}, e AS (SELECT conv_id, turn, CASE WHEN conv_id%5=1 AND turn=2 THEN 9 ELSE entry_index END AS ix, entry_index AS place, CASE WHEN conv_id%5=2 AND turn=1 THEN 'x' ELSE previous_hash END AS ph, previous_hash AS link, conv_id%5=3 AND turn=1 AS edited FROM chain),
 f AS (SELECT *, CASE WHEN ix<>place THEN 'index' WHEN ph<>link THEN 'link' WHEN edited THEN 'content' END AS reason FROM e)
 SELECT conv_id, count(*) AS n_entries, min(place) FILTER (WHERE reason IS NOT NULL) AS broken_position, arg_min(reason,place) FILTER (WHERE reason IS NOT NULL) AS reason, count(reason)=0 AS valid FROM f GROUP BY conv_id""",
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "hash_manifest": f"WITH {BLOBS}, a AS (SELECT path AS file_name, sha256(unhex(hex)) AS h, (length(hex)/2)::BIGINT AS size FROM bl) SELECT file_name, h AS sha256, size, sha256(file_name||'|'||h||'|'||size) AS row_hash FROM a",
    "hamming_distance": f"WITH {SIGNS} SELECT x.id, bit_count(xor(x.hash,y.hash))::INT AS distance FROM hs x JOIN hs y ON y.id=x.id+1",
    "format_sniff": f"WITH {BLOBS}, a AS (SELECT id, {_sniff()} AS f FROM bl) SELECT id, f AS format, {_case('f', [(k, repr(v)) for k, v in MIME.items()], repr('application/octet-stream'))} AS mime_type FROM a",
    "extension_mismatch": f"WITH {BLOBS}, a AS (SELECT id, {_sniff()} AS f, regexp_extract(path,'\\.([A-Za-z0-9]+)$',1) AS s FROM bl) SELECT id, s<>'' AND NOT {_case('f', [(k, 's IN (' + ','.join(repr(x) for x in v) + ')') for k, v in SUFFIXES.items()], 'true')} AS mismatch FROM a",
    "byte_entropy": f"WITH {ENTROPY} SELECT id, n_bytes, round(entropy,6) AS entropy FROM en",
    "payload_sniff": f"""WITH {ENTROPY} SELECT id, CASE {" ".join(f"WHEN starts_with(hex,'{m}') THEN '{n}'" for m, n in PAYLOADS)} WHEN regexp_full_match(hex,'(0[9AD]|[2-6][0-9A-F]|7[0-9A-E])+') THEN 'ASCII_TEXT' WHEN round(entropy,6)>7.5 THEN 'ENCRYPTED_OR_COMPRESSED' WHEN round(entropy,6)<2 THEN 'PADDING' ELSE 'BINARY_DATA' END AS kind, substr(hex,1,64) AS preview FROM bl JOIN en USING (id)""",
    "chi_square_pov": f"WITH {BYTES}, a AS (SELECT id, ('0x'||b)::INT//2 AS p, sum(n) AS t, sum(CASE WHEN ('0x'||b)::INT%2=0 THEN n ELSE 0 END) AS e FROM hb GROUP BY 1,2), c AS (SELECT id, sum((e-t/2.0::DOUBLE)*(e-t/2.0::DOUBLE)/(t/2.0::DOUBLE)) AS x, count(*) AS dof FROM a WHERE t/2.0>5 GROUP BY id) SELECT id, round(x,4) AS chi_square, dof, dof>30 AND x<0.4::DOUBLE*dof AS uniform FROM c",
    "bitplane_density": f"WITH {BYTES}, a AS (SELECT id, plane::INT AS plane, sum(n*((('0x'||b)::INT>>plane::INT)&1))::DOUBLE/sum(n) AS p FROM hb, range(0,8) AS t(plane) GROUP BY 1,2) SELECT id, plane, round(p,6) AS density, round(CASE WHEN p<=0 OR p>=1 THEN 0 ELSE -p*log2(p)-(1-p)*log2(1-p) END,5) AS entropy FROM a",
    "covert_risk": "WITH a AS (SELECT doc_id, round(least(1,0.1::DOUBLE+CASE WHEN doc_id%4>=2 THEN 0.35::DOUBLE WHEN doc_id%4=1 THEN 0.15::DOUBLE ELSE 0 END+CASE WHEN doc_id%3>0 THEN 0.4::DOUBLE ELSE 0 END+0.2::DOUBLE*(doc_id%2)),2)::DOUBLE AS s FROM documents) SELECT doc_id, s AS score, CASE WHEN s>=0.7::DOUBLE THEN 'SUSPECTED_COVERT_STEGANOGRAPHY' WHEN s>=0.4::DOUBLE THEN 'POSSIBLE_LSB_MANIPULATION' ELSE 'CLEAN_NATURAL_ENTROPY' END AS verdict FROM a",
    "identified_files": f"WITH {PICTURES} SELECT '/case/'||doc_id||'.jpg' AS path, (length(hx)//2)::BIGINT AS length, sha256, 'JPEG' AS format, 'image/jpeg' AS mime_type, false AS extension_mismatch FROM fi",
    "walk_units": f"""WITH {PICTURES} SELECT sha256, 'SOI' AS name, 0::BIGINT AS offset, 2::BIGINT AS length FROM fi UNION ALL SELECT sha256, 'APP1', 2, al FROM fi UNION ALL SELECT sha256, 'DQT', 2+al, 69 FROM fi UNION ALL SELECT sha256, 'SOS', 71+al, 4 FROM fi
 UNION ALL SELECT sha256, 'EOI', 75+al+sl, 2 FROM fi UNION ALL SELECT sha256, 'TRAILING_DATA', 77+al+sl, tl FROM fi WHERE tl>0""",
    "exif_fields": f"WITH {PICTURES} SELECT sha256, 'EXIF' AS standard, 'Make' AS name, 'Camera-'||source AS value_str, 'ASCII' AS value_type, '0x010f' AS tag_id FROM fi JOIN documents USING (doc_id)",
    "clean_metadata": f"WITH {PICTURES}, c AS (SELECT sha256, 'FFD8FFDB004300'||repeat('10',64)||'FFDA0002'||scan||'FFD9' AS h FROM fi) SELECT sha256, sha256(unhex(h)) AS cleaned_sha256, (length(h)//2)::BIGINT AS length FROM c",
    "extract_artefacts": f"WITH {PICTURES} SELECT sha256, 'block_exif' AS kind, 12::BIGINT AS offset, (length(ex)//2-6)::BIGINT AS length, sha256(unhex(substr(ex,13))) AS content_sha256 FROM fi UNION ALL SELECT sha256, 'trailing', 77+al+sl, tl, sha256(unhex(tail)) FROM fi WHERE tl>0",
    "data_stream_hashes": f"WITH {PICTURES} SELECT sha256, sha256(unhex(scan)) AS value FROM fi",
    "file_verdicts": f"""WITH {PICTURES} SELECT sha256, 'none' AS encoder_kind, CASE WHEN tl>0 THEN 'TAMPERED_TRAILING_PAYLOAD' ELSE 'INCONCLUSIVE_SIGNALS' END AS verdict_label, CASE WHEN tl>0 THEN false END AS is_authentic, CASE WHEN tl>0 THEN 0.15 ELSE 0.5 END::DOUBLE AS confidence_score, CASE WHEN tl>0 THEN 'CRITICAL' ELSE 'LOW' END AS risk_level FROM fi""",
    "relational_images": f"WITH {_signals()} SELECT sha256, 'f'||sha256 AS file_name, '/case' AS file_path, 'image/jpeg' AS mime_type, verdict_label, confidence_score, CASE WHEN sha256%3=0 THEN risk_level ELSE 'OLD' END AS risk_level, is_authentic::INT AS is_authentic FROM vd",
    "relational_gps": "SELECT doc_id AS sha256, (doc_id%90)::DOUBLE AS latitude, (doc_id%180)::DOUBLE AS longitude FROM documents WHERE doc_id%4=0",
    "stix_objects": f"""WITH {_signals()}, a AS (SELECT sha256(sha256::VARCHAR) AS sha256, unnest(CASE WHEN risk_level IN ('HIGH','CRITICAL') OR trl THEN ['file','indicator','relationship'] ELSE ['file'] END) AS type FROM vd), b AS (SELECT *, sha256(type||':'||sha256) AS h FROM a)
 SELECT sha256, type, type||'--'||substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-8'||substr(h,18,3)||'-'||substr(h,21,12) AS id FROM b""",
    "timeline_export": f"WITH {_KIN} SELECT strftime(ts,'%Y-%m-%dT%H:%M:%S')||'+00:00' AS datetime, 'DateTimeOriginal' AS timestamp_desc, 'IMAGE' AS source, 'Image metadata' AS source_long, event_type AS message, 'timeline' AS parser, ordinal::VARCHAR AS display_name, CASE WHEN coalesce(kmh>1000,false) THEN 'anomaly' ELSE 'evidence_capture' END AS tag FROM kin",
    "bounding_box": f"WITH {FIX} SELECT case_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM fix WHERE {_usable('lat', 'lon')} GROUP BY case_id",
    "geojson_features": f"WITH {FIX} SELECT case_id, count(*) AS n_points, CASE WHEN count(*)>1 THEN 1 ELSE 0 END::BIGINT AS n_lines FROM fix WHERE {_usable('lat', 'lon')} GROUP BY case_id",
}
