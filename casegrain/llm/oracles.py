"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_DRAW = "('0x'||substr(sha256('mix:'||coalesce(doc_id::VARCHAR,'')),1,13))::BIGINT/4503599627370496.0::DOUBLE"

OP1 = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text,'[^\\x20\\x09-\\x0D]+')),0)::BIGINT AS size, {_DRAW} AS u FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0,2.0,1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE*source_size AS most, 3.0::DOUBLE*source_size/w AS ratio FROM p),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER ()-coalesce(sum(most) OVER b,0))/(sum(w) OVER ()-coalesce(sum(w) OVER b,0)) AS here, row_number() OVER o AS n FROM r
 WINDOW o AS (ORDER BY ratio, source NULLS LAST), b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, w*(SELECT arg_min(here,n) FILTER (WHERE here<=ratio) FROM l)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size>0 THEN target/source_size ELSE 0.0 END AS rate FROM t),
c AS (SELECT d.*, q.source_size, q.target, (floor(q.rate)+CASE WHEN u<q.rate-floor(q.rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size, source_size, target, copies, copies*size AS taken FROM c"""

_WORDS = "regexp_extract_all(translate({},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format("text")},[]) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, m, array_to_string(w[k:k+m-1],' ') AS g FROM (SELECT item, w, least(10,len(w)) AS m, unnest(range(1,greatest(1,len(w)-9)+1)) AS k FROM b WHERE len(w)>0)),
spot AS (SELECT r, m, k, array_to_string(w[k:k+m-1],' ') AS g FROM (SELECT r, w, m, unnest(range(1,len(w)-m+2)) AS k FROM d, (SELECT DISTINCT m FROM win))),
hit AS (SELECT r, k, win.m AS m, item FROM spot JOIN win ON spot.g=win.g AND spot.m=win.m),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k,k+m)) AS p FROM hit) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(len(items),0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items,','),'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""

OP3 = """WITH p AS (SELECT page_id, coalesce(html,'') AS h FROM pages), q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes>=100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id<>first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id<>first THEN first END AS refers_to FROM f"""

#: Texts are cut after ends of sentences and line breaks, by a mark that then parts them, and long pieces after some words; white space is ASCII's.
OP10 = r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text,'([.!?]+)([ \t-\r])','\1'||chr(1)||'\2','g'),'\n',chr(10)||chr(1),'g'),chr(1)) AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(p) AS piece, unnest(range(0,len(p))) AS i FROM d),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off, regexp_extract_all(piece,'[ \t-\r]*[^ \t-\r]+') AS ws FROM e),
w AS (SELECT doc_id, i, off, len(ws) AS many, unnest(ws) AS own, unnest(range(0,len(ws))) AS k FROM o WHERE len(ws)>0),
x AS (SELECT *, lower(regexp_replace(own,'^[ \t-\r]+','')) AS word, (off+sum(length(own)) OVER (PARTITION BY doc_id, i ORDER BY k))::BIGINT AS z FROM w),
y AS (SELECT *, z-length(regexp_replace(own,'^[ \t-\r]+','')) AS a, coalesce(sum(CASE WHEN many>24 AND substr(sha256(word),1,1) IN ('0','1') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS part FROM x),
n AS (SELECT doc_id, i, part, min(a) AS a, max(z) AS z, count(*) AS words, string_agg(word,' ' ORDER BY k) AS norm FROM y GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS place FROM n),
f AS (SELECT *, first_value(doc_id) OVER h AS kept, first_value(place) OVER h AS kplace FROM u WINDOW h AS (PARTITION BY norm ORDER BY doc_id, place)),
r AS (SELECT *, place-row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM f WHERE (kept,kplace)<>(doc_id,place)),
k AS (SELECT doc_id, run, kept, min(a) AS a, max(z) AS z, sum(words) AS words, count(*) AS units FROM r GROUP BY doc_id, run, kept)
SELECT doc_id, min(a)::INT AS start, max(z)::INT AS end, sum(words)::BIGINT AS n_words, sum(units)::BIGINT AS n_units, arg_max(kept,(words,-kept)) AS kept_doc_id, array_to_string(list_sort(list(DISTINCT kept)),',') AS kept_doc_ids
FROM k GROUP BY doc_id, run HAVING sum(words)>=20"""


def _places(kind: str, pattern: str, among: str = "d") -> str:
    """Matches of a pattern with their places, by the lengths of what is between them."""
    return f"""m_{kind} AS (SELECT r, unnest(regexp_extract_all(t,'{pattern}')) AS v, unnest((string_split_regex(t,'{pattern}'))[1:len(regexp_extract_all(t,'{pattern}'))]) AS g, unnest(range(1,len(regexp_extract_all(t,'{pattern}'))+1)) AS i FROM {among}),
p_{kind} AS (SELECT r, v, (sum(length(g)) OVER w+sum(length(v)) OVER w-length(v))::BIGINT AS a, (sum(length(g)) OVER w+sum(length(v)) OVER w)::BIGINT AS z FROM m_{kind} WINDOW w AS (PARTITION BY r ORDER BY i))"""


def _nearby(name: str, kind: str, whole: str) -> str:
    """Matches that are one as a whole, with what stands between them and their neighbours, 40 characters at most on each side."""
    return f"""{name}0 AS (SELECT *, coalesce(lag(z) OVER w,0) AS pz, lead(a) OVER w AS na FROM p_{kind} WHERE regexp_full_match(v,'{whole}') WINDOW w AS (PARTITION BY r ORDER BY a)),
{name} AS (SELECT q.*, lower(substr(t,greatest(pz,a-40)+1,a-greatest(pz,a-40))||' '||substr(t,z+1,least(40,coalesce(na,length(t))-z))) AS near FROM {name}0 AS q JOIN d USING (r))"""


_FIGURES = "regexp_replace(v,'[^0-9]','','g')"
_LUHN = f"list_sum(list_transform(range(1,length({_FIGURES})+1), lambda k: CASE WHEN (length({_FIGURES})-k)%2=1 THEN CASE WHEN 2*substr({_FIGURES},k,1)::INT>9 THEN 2*substr({_FIGURES},k,1)::INT-9 ELSE 2*substr({_FIGURES},k,1)::INT END ELSE substr({_FIGURES},k,1)::INT END))%10=0"
_IBAN = "replace(v,' ','')"
_MOD97 = f"list_reduce(list_transform(string_split(substr({_IBAN},5)||substr({_IBAN},1,4),''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c)-55 END), lambda x, c: (x*CASE WHEN c>9 THEN 100 ELSE 10 END+c)%97)=1"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_SHORT = "3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3(?:0[0-5]|[68][0-9])[0-9][ -]?[0-9]{6}[ -]?[0-9]{4}"

_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_NAMED = "(?i:token|secret|passwd|password|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\\x22\\x27]?[ ]{0,2}[:=][ ]{0,2}[\\x22\\x27]?"
_KINDS = ("email", "ip", "card", "phone", "short_card", "iban", "ssn", "secret")

#: Short cards and social security numbers are chains of characters that are one as a whole.
OP8 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS t FROM documents),
{_places("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
{_places("ip", "[0-9]+(?:[.][0-9]+){3}")},
{_places("card", "[0-9](?:[ -]?[0-9])+")},
{_places("phone", "[+][0-9][ ().0-9-]+[0-9]")},
{_places("iban", "\\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\\b")},
d_ssn AS (SELECT r, t FROM d WHERE regexp_matches(t,'{_SSN}')),
{_places("ssn", "[0-9A-Za-z-]+", "d_ssn")},
{_places("secret", _NAMED + "[A-Za-z0-9_/+=.~-]{16,}")},
{_nearby("short", "card", _SHORT)},
{_nearby("social", "ssn", _SSN)},
hidden AS (SELECT r, z, regexp_replace(v,'^{_NAMED}','') AS v FROM p_secret),
f AS (SELECT r, 1 AS o, 'email' AS kind, a, z FROM p_email
 UNION ALL SELECT r, 2, 'ip', a, z FROM p_ip WHERE regexp_full_match(v,'{_PART}(?:[.]{_PART}){{3}}')
 UNION ALL SELECT r, 3, 'card', a, z FROM p_card WHERE length({_FIGURES}) BETWEEN 16 AND 19 AND {_LUHN}
 UNION ALL SELECT r, 4, 'phone', a, z FROM p_phone WHERE length({_FIGURES}) BETWEEN 8 AND 15
 UNION ALL SELECT r, 5, 'short_card', a, z FROM short WHERE {_LUHN} AND NOT regexp_matches(near,'order|tracking|isbn|serial')
 UNION ALL SELECT r, 6, 'iban', a, z FROM p_iban WHERE length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}
 UNION ALL SELECT r, 7, 'ssn', a, z FROM social WHERE NOT regexp_matches(v,'^(?:000|666|9[0-9]{{2}})|-00-|-0000$') AND NOT regexp_matches(near,'part|serial|order|isbn')
 UNION ALL SELECT r, 8, 'secret', z-length(v), z FROM hidden WHERE regexp_matches(v,'[0-9]') AND regexp_matches(v,'[A-Za-z]') AND len(list_distinct(string_split(v,'')))>=8),
g AS (SELECT r, count(*) AS n_spans, string_agg(kind||':'||a||':'||z, ',' ORDER BY o, a) AS spans, string_agg(kind||':'||a||':'||z, ',' ORDER BY o, a) FILTER (WHERE o<=4) AS base, {",".join(f"count(*) FILTER (WHERE kind='{k}') AS n_{k}" for k in _KINDS)} FROM f GROUP BY r)
SELECT doc_id, {",".join(f"coalesce(n_{k},0)::BIGINT AS n_{k}" for k in (*_KINDS, "spans"))}, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN g USING (r)"""

def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: CRC-32 folds a text's bytes; the line is ordered by 60 bits of the hashes of text and id.
OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t, strlen(coalesce(text,''))::BIGINT+16 AS size, ('0x'||substr(sha256(coalesce(text,'')),1,15))::BIGINT AS h, ('0x'||substr(sha256(coalesce(doc_id::VARCHAR,'')),1,15))::BIGINT AS i FROM documents),
o AS (SELECT *, (sum(size) OVER line-size)::BIGINT AS b, row_number() OVER line AS n, (sum(size) OVER (PARTITION BY h))::BIGINT AS gs, (sum(size) OVER ())::BIGINT AS total FROM d WINDOW line AS (ORDER BY h, i, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN gs*40*50<=total THEN min(b) OVER (PARTITION BY h)+gs//2 ELSE b+size//2 END AS mid FROM o),
s AS (SELECT *, least(40*mid//total,39)::INT AS shard FROM m)
SELECT doc_id, size, xor(list_reduce([4294967295::BIGINT]||list_transform(regexp_extract_all(hex(encode(t)),'..'), lambda x: ('0x'||x)::BIGINT), lambda c, x: xor(c>>8, ({_crc_table()}::BIGINT[])[(xor(c,x)&255)+1])), 4294967295) AS text_crc32,
 'bytes' AS law, shard, (n-min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s"""

# XXH64, seed 42, of strings: 64-bit sums and products are taken modulo 2^64 out of 128 bits.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED, _WORD = 42, 2**64


def _u(x: int | str) -> str:
    return f"{x}::UBIGINT" if isinstance(x, int) else x


def _mul(a: int | str, b: int | str) -> str:
    return f"(({_u(a)}::UHUGEINT*{_u(b)}::UHUGEINT)%{_WORD}::UHUGEINT)::UBIGINT"


def _add(a: int | str, b: int | str) -> str:
    return f"(({_u(a)}::UHUGEINT+{_u(b)}::UHUGEINT)%{_WORD}::UHUGEINT)::UBIGINT"


def _rot(a: str, r: int) -> str:
    return f"((((({a})::UHUGEINT*{2**r}::UHUGEINT)%{_WORD}::UHUGEINT)::UBIGINT|(({a})>>{64 - r}::UBIGINT)))"


def _lane(h: str, n: int) -> str:
    return "('0x'||" + "||".join(f"substr({h},{2 * k - 1},2)" for k in range(n, 0, -1)) + ")::UBIGINT"


def _mixed_down(source: str, out: str, columns: str, h: str) -> str:
    """The last steps of the hash: ``out`` has ``columns`` and h."""
    shift = lambda x, n: f"xor({x},({x})>>{n}::UBIGINT)"
    return f"""{out}1 AS (SELECT {columns}, {_mul(shift(h, 33), _P2)} AS h FROM {source}), {out}2 AS (SELECT {columns}, {_mul(shift("h", 29), _P3)} AS h FROM {out}1), {out} AS (SELECT {columns}, {shift("h", 32)} AS h FROM {out}2)"""


def _hashed(strings: str, out: str) -> str:
    """``out`` has each string s of ``strings`` and its hash h."""
    first = [(_SEED + _P1 + _P2) % _WORD, (_SEED + _P2) % _WORD, _SEED, (_SEED - _P1) % _WORD]
    lanes = ", ".join(f"list_reduce([{v}::UBIGINT]||list_transform(range({j},st,4), lambda i: m[i+1]), lambda v, k: {_mul(_rot(_add('v', 'k'), 31), _P1)}) AS v{j}" for j, v in enumerate(first))
    return f"""x0 AS (SELECT s, hex(encode(s)) AS x, strlen(s)::BIGINT AS n FROM (SELECT DISTINCT s FROM {strings})),
x1 AS (SELECT *, list_transform(range(0,n//8), lambda i: {_lane("substr(x,16*i+1,16)", 8)}) AS lanes, 4*(n//32) AS st FROM x0),
x2 AS (SELECT *, list_transform(lanes, lambda l: {_mul("l", _P2)}) AS m FROM x1),
x3 AS (SELECT *, {lanes} FROM x2),
x4 AS (SELECT *, {_add(_add(_rot("v0", 1), _rot("v1", 7)), _add(_rot("v2", 12), _rot("v3", 18)))} AS mix, {", ".join(f"{_mul(_rot(_mul(f'v{j}', _P2), 31), _P1)} AS q{j}" for j in range(4))} FROM x3),
x5 AS (SELECT *, CASE WHEN n<32 THEN {(_SEED + _P5) % _WORD}::UBIGINT ELSE list_reduce([mix,q0,q1,q2,q3], lambda c, k: {_add(_mul("xor(c,k)", _P1), _P4)}) END AS h0, list_transform(m[st+1:], lambda k: {_mul(_rot("k", 31), _P1)}) AS ks FROM x4),
x6 AS (SELECT *, list_reduce([{_add("h0", "n")}]||ks, lambda c, k: {_add(_mul(_rot("xor(c,k)", 27), _P1), _P4)}) AS h1, substr(x,16*(n//8)+1) AS rest FROM x5),
x7 AS (SELECT *, CASE WHEN n%8>=4 THEN {_mul(_lane("rest", 4), _P1)} END AS k4, CASE WHEN n%8>=4 THEN substr(rest,9) ELSE rest END AS last FROM x6),
x8 AS (SELECT *, CASE WHEN k4 IS NOT NULL THEN {_add(_mul(_rot("xor(h1,k4)", 23), _P2), _P3)} ELSE h1 END AS h2 FROM x7),
x9 AS (SELECT *, list_reduce([h2]||list_transform(regexp_extract_all(last,'..'), lambda b: {_mul("('0x'||b)::UBIGINT", _P5)}), lambda c, k: {_mul(_rot("xor(c,k)", 11), _P1)}) AS h3 FROM x8),
{_mixed_down("x9", out, "s", "h3")}"""


_LOWER = "regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x20\\x09-\\x0D]+')"

#: Fingerprints by sums of hash bits; classes by what different fingerprints of 3 bits or fewer reach.
OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_LOWER},[]) AS w FROM documents),
g AS (SELECT r, unnest(list_transform(range(1,greatest(2,len(w)-1)), lambda k: array_to_string(w[k:k+2],' '))) AS s FROM d WHERE len(w)>0),
{_hashed("g", "xh")},
c AS (SELECT r, count(*) AS n, {", ".join(f"sum((h>>{b}::UBIGINT)&1::UBIGINT) AS b{b}" for b in range(64))} FROM g JOIN xh USING (s) GROUP BY r),
f AS (SELECT doc_id, coalesce({"+".join(f"CASE WHEN 2*b{b}>n THEN {2**b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))},0::UHUGEINT)::UBIGINT AS fp FROM d LEFT JOIN c USING (r)),
p AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM p a JOIN p b ON bit_count(xor(a.fp,b.fp)::HUGEINT)<=3),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b=l.a),
m AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN p ON p.fp=reach.b GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)),16,'0') AS fingerprint, component_id FROM f JOIN m USING (fp)"""


def _of_long(value: str, seed: str) -> str:
    """The hash of a long before its last steps."""
    return _add(_mul(_rot(f"xor({_add(seed, (_P5 + 8) % _WORD)},{_mul(_rot(_mul(value, _P2), 31), _P1)})", 27), _P1), _P4)


#: N-grams fall into 131,072 buckets, which are enough for three million different ones; a pair's hash is that of its second word's, seeded by its first word's.
OP6 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text,'') AS t, coalesce(regexp_extract_all(text,'[^\\x20\\x09-\\x0D]+'),[]) AS w, doc_id IN (SELECT doc_id FROM labels WHERE quality=1 AND doc_id IS NOT NULL) AS good FROM documents),
w1 AS (SELECT r, good, unnest(w) AS s, unnest(range(1,len(w)+1)) AS k FROM d),
{_hashed("w1", "wh")},
w2 AS (SELECT r, good, k, h FROM w1 JOIN wh USING (s)),
g0 AS (SELECT DISTINCT a.h AS a, b.h AS b FROM w2 a JOIN w2 b ON a.r=b.r AND b.k=a.k+1),
g1 AS (SELECT a, b, {_of_long("a", f"{_SEED}::UBIGINT")} AS y FROM g0), {_mixed_down("g1", "g2", "a, b", "y")},
g3 AS (SELECT a, b, {_of_long("b", "h")} AS y FROM g2), {_mixed_down("g3", "g4", "a, b", "y")},
n AS (SELECT r, good, (h&131071::UBIGINT)::INT AS bucket FROM w2 UNION ALL SELECT x.r, x.good, (g4.h&131071::UBIGINT)::INT FROM w2 x JOIN w2 y ON x.r=y.r AND y.k=x.k+1 JOIN g4 ON g4.a=x.h AND g4.b=y.h),
c AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE good) AS target FROM n GROUP BY bucket),
q AS (SELECT sum(target)/sum(raw)::DOUBLE AS seen FROM c),
e AS (SELECT bucket, CASE WHEN seen>0 THEN ln((target+20.0::DOUBLE*seen)/(raw+20.0::DOUBLE)/seen) ELSE 0.0 END AS ratio FROM c, q),
z AS (SELECT r, sum(ratio)/count(*) AS score FROM n JOIN e USING (bucket) GROUP BY r),
v AS (SELECT r, k, array_to_string(w[k:k+4],' ') AS s FROM (SELECT r, w, unnest(range(1,len(w)-3)) AS k FROM d WHERE len(w)>4)),
a AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS m FROM v) WHERE m>1),
o AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(k,k+5)) AS p FROM a) GROUP BY r),
b AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t,'[\\x20\\x09-\\x0D]','','g'))::BIGINT AS word_chars, (length(t)-length(regexp_replace(t,'[#*$%&|<>]','','g')))::BIGINT AS n_symbols,
 (len(ln_)-len(list_distinct(ln_)))::BIGINT AS n_dup_lines FROM (SELECT *, list_filter(string_split(t,chr(10)), lambda x: regexp_matches(x,'[^\\x20\\x09-\\x0D]')) AS ln_ FROM d)),
u AS (SELECT b.*, coalesce(n_repeat_words,0)::BIGINT AS n_repeat_words, n_words<10 OR 100*coalesce(n_repeat_words,0)>20*n_words AS base_failed, coalesce(score,0.0) AS sc FROM b LEFT JOIN o USING (r) LEFT JOIN z USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND sc>=-0.15 AS kept, round(sc,10) AS score FROM u"""

ORACLES = {"op6_quality_rules": OP6, "op9_simhash": OP9, "op7_shard": OP7, "op8_pii": OP8, "op10_substring_dedup": OP10, "op1_mix_sources": OP1, "op2_decontaminate": OP2, "op3_warc": OP3}
