"""DuckDB oracle for the full scan and the decode-dependent queries.

DuckDB cannot decode invalid UTF-8 with replacement characters, so the rule
Python and Spark use (each maximal ill-formed subpart becomes one U+FFFD) is
written out over the byte list: a byte starts a unit unless a preceding lead
byte's unit (valid sequence, or maximal valid prefix) covers it.
"""

from __future__ import annotations

from tripwire.plans import oracles as O

CONT = "({x} BETWEEN 128 AND 191)"


def _b(j: str, d: int) -> str:
    return f"bs[{j} + {d}]" if d else f"bs[{j}]"


def _cont(j: str, d: int) -> str:
    return f"coalesce({CONT.format(x=_b(j, d))}, false)"


def _between(j: str, d: int, lo: int, hi: int) -> str:
    return f"coalesce({_b(j, d)} BETWEEN {lo} AND {hi}, false)"


def valid_len(j: str) -> str:
    b0 = _b(j, 0)
    return f"""(CASE WHEN {b0} < 128 THEN 1
 WHEN {b0} BETWEEN 194 AND 223 THEN CASE WHEN {_cont(j, 1)} THEN 2 ELSE 0 END
 WHEN {b0} = 224 THEN CASE WHEN {_between(j, 1, 160, 191)} AND {_cont(j, 2)} THEN 3 ELSE 0 END
 WHEN {b0} BETWEEN 225 AND 236 OR {b0} BETWEEN 238 AND 239 THEN CASE WHEN {_cont(j, 1)} AND {_cont(j, 2)} THEN 3 ELSE 0 END
 WHEN {b0} = 237 THEN CASE WHEN {_between(j, 1, 128, 159)} AND {_cont(j, 2)} THEN 3 ELSE 0 END
 WHEN {b0} = 240 THEN CASE WHEN {_between(j, 1, 144, 191)} AND {_cont(j, 2)} AND {_cont(j, 3)} THEN 4 ELSE 0 END
 WHEN {b0} BETWEEN 241 AND 243 THEN CASE WHEN {_cont(j, 1)} AND {_cont(j, 2)} AND {_cont(j, 3)} THEN 4 ELSE 0 END
 WHEN {b0} = 244 THEN CASE WHEN {_between(j, 1, 128, 143)} AND {_cont(j, 2)} AND {_cont(j, 3)} THEN 4 ELSE 0 END
 ELSE 0 END)"""


def second_ok(j: str) -> str:
    b0 = _b(j, 0)
    return f"""(CASE WHEN {b0} BETWEEN 194 AND 223 THEN {_cont(j, 1)}
 WHEN {b0} = 224 THEN {_between(j, 1, 160, 191)}
 WHEN {b0} = 237 THEN {_between(j, 1, 128, 159)}
 WHEN {b0} BETWEEN 225 AND 239 THEN {_cont(j, 1)}
 WHEN {b0} = 240 THEN {_between(j, 1, 144, 191)}
 WHEN {b0} = 244 THEN {_between(j, 1, 128, 143)}
 WHEN {b0} BETWEEN 241 AND 243 THEN {_cont(j, 1)} ELSE false END)"""


def unit_len(j: str) -> str:
    """Bytes consumed by the unit starting at j: the valid length, else the maximal valid prefix."""
    b0 = _b(j, 0)
    return f"""(CASE WHEN {valid_len(j)} > 0 THEN {valid_len(j)}
 WHEN {b0} BETWEEN 194 AND 244 AND {second_ok(j)} THEN
   CASE WHEN {b0} <= 239 THEN 2 WHEN {_cont(j, 2)} THEN 3 ELSE 2 END
 ELSE 1 END)"""


def code_point(j: str) -> str:
    b = lambda d: _b(j, d)
    return f"""(CASE vl[{j}] WHEN 1 THEN {b(0)}
 WHEN 2 THEN ({b(0)} & 31) * 64 + ({b(1)} & 63)
 WHEN 3 THEN ({b(0)} & 15) * 4096 + ({b(1)} & 63) * 64 + ({b(2)} & 63)
 ELSE ({b(0)} & 7) * 262144 + ({b(1)} & 63) * 4096 + ({b(2)} & 63) * 64 + ({b(3)} & 63) END)"""


def utf8_ctes(prefix: str, src: str, bin_col: str) -> tuple[str, str]:
    """CTEs adding ``txt`` (replacement-decoded ``bin_col``) to the rows of ``src``.
    Returns (sql, name of the last CTE)."""
    n1, n2, n3 = f"{prefix}_bytes", f"{prefix}_units", f"{prefix}_txt"
    absorbed = ("(CASE WHEN j > 1 AND NOT " + _cont("j", -1) + " THEN ul[j - 1] > 1"
                " WHEN j > 2 AND NOT " + _cont("j", -2) + " THEN ul[j - 2] > 2"
                " WHEN j > 3 AND NOT " + _cont("j", -3) + " THEN ul[j - 3] > 3 ELSE false END)")
    absorbed = absorbed.replace("bs[j + -1]", "bs[j - 1]").replace("bs[j + -2]", "bs[j - 2]").replace(
        "bs[j + -3]", "bs[j - 3]")
    sql = f"""{n1} AS (SELECT *, list_transform(range(coalesce(octet_length({bin_col}), 0)),
   lambda i: ('0x' || substr(hex({bin_col}), 2 * i + 1, 2))::INTEGER) AS bs FROM {src}),
{n2} AS (SELECT *, list_transform(range(1, len(bs) + 1), lambda j: {valid_len('j')}) AS vl,
   list_transform(range(1, len(bs) + 1), lambda j: {unit_len('j')}) AS ul FROM {n1}),
{n3} AS (SELECT * EXCLUDE (bs, vl, ul), CASE WHEN {bin_col} IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, len(bs) + 1),
   lambda j: CASE WHEN {_cont('j', 0)} AND {absorbed} THEN ''
     WHEN vl[j] > 0 THEN chr(CAST({code_point('j')} AS INTEGER)) ELSE chr(65533) END), '') END AS txt FROM {n2})"""
    return sql, n3


def printable_ok(txt: str, min_len: int) -> str:
    # RE2's \\pC lacks unassigned code points (Cn); a character in no category at all is one
    cls = "[\\pC\\pZ]|[^\\pL\\pM\\pN\\pP\\pS\\pZ\\pC]"
    nonprint = f"(length({txt}) - length(regexp_replace({txt}, '{cls}', '', 'g')) - (length({txt}) - length(replace({txt}, ' ', ''))))"
    return f"(length({txt}) >= {min_len} AND (length({txt}) - {nonprint}) / greatest(length({txt}), 1) > 0.75)"


def b64_bin(blob: str) -> str:
    core = f"translate(rtrim({blob}, '='), '-_', '+/')"
    m = f"length({core})"
    k = f"(length({blob}) - {m})"
    valid = f"(({m} % 4 = 0 AND {k} = 0) OR {m} % 4 = 2 OR ({m} % 4 = 3 AND {k} <= 1))"
    return f"CASE WHEN {valid} THEN try(from_base64({core} || repeat('=', (4 - {m} % 4) % 4))) END"


def snippet_ellipsis(x: str, n: int) -> str:
    return f"(left({x}, {n}) || CASE WHEN length({x}) > {n} THEN '…' ELSE '' END)"


# candidates per message (idx = first-seen order)
B64_CANDS = """b64c AS (
 SELECT msg_id, i - 1 AS idx, ds[i] AS blob FROM (
  SELECT msg_id, list_filter(cs, lambda x, i: list_position(cs, x) = i) AS ds FROM (
   SELECT msg_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9+/_=-]+'),
     lambda r: regexp_extract(r, '(?:^|=)([A-Za-z0-9+/_-]{16,}={0,2})$', 1)), lambda x: x <> '') AS cs FROM SRC)),
  range(1, len(ds) + 1) AS g(i))"""

HEX0X = O.LEFT_B + "0x([0-9a-fA-F]+)(" + O.WORD + "*)"
HEXB = O.LEFT_B + "([0-9a-fA-F]+)(" + O.WORD + "*)"
HEX_CANDS = f"""hexr AS (SELECT msg_id,
  list_transform(regexp_extract_all(text, {O.q(HEX0X)}, 0), lambda m: regexp_extract(m, {O.q(HEX0X)}, 1) || '|' || regexp_extract(m, {O.q(HEX0X)}, 2)) AS m0,
  list_transform(regexp_extract_all(text, {O.q(HEXB)}, 0), lambda m: regexp_extract(m, {O.q(HEXB)}, 1) || '|' || regexp_extract(m, {O.q(HEXB)}, 2)) AS mb
 FROM SRC),
hexf AS (SELECT msg_id,
  list_filter(list_transform(list_filter(m0, lambda m: ends_with(m, '|')), lambda m: rtrim(m, '|')), lambda h: length(h) >= 8 AND length(h) NOT IN (40, 64)) AS c0,
  list_filter(list_transform(list_filter(mb, lambda m: ends_with(m, '|')), lambda m: rtrim(m, '|')), lambda h: length(h) >= 16) AS br FROM hexr),
hexu AS (SELECT msg_id, list_filter(c0, lambda x, i: list_position(c0, x) = i) AS c0,
  list_filter(br, lambda x, i: list_position(br, x) = i) AS br FROM hexf),
hexv AS (SELECT msg_id, c0, list_filter(br, lambda h: NOT list_contains(c0, h) AND length(h) % 2 = 0 AND length(h) NOT IN (40, 64)) AS cb FROM hexu),
hexc AS (SELECT msg_id, '0x' AS kind, i - 1 AS idx, c0[i] AS hex FROM hexv, range(1, len(c0) + 1) AS g(i)
 UNION ALL SELECT msg_id, 'bare' AS kind, i - 1 AS idx, cb[i] AS hex FROM hexv, range(1, len(cb) + 1) AS g(i))"""


def decode_ctes(src: str) -> str:
    """Candidates of ``src`` (msg_id, text) with their printable decodings:
    b64d(msg_id, idx, blob, txt, ok), hexd(msg_id, kind, idx, hex, txt, ok)."""
    u1, last1 = utf8_ctes("b64u", "b64b", "bin")
    u2, last2 = utf8_ctes("hexu8", "hexb", "bin")
    return f"""{B64_CANDS.replace('SRC', src)},
b64b AS (SELECT msg_id, idx, blob, {b64_bin('blob')} AS bin FROM b64c),
{u1},
b64d AS (SELECT msg_id, idx, blob, txt, coalesce({printable_ok('txt', 4)}, false) AS ok FROM {last1}),
{HEX_CANDS.replace('SRC', src)},
hexb AS (SELECT msg_id, kind, idx, hex, CASE WHEN length(hex) % 2 = 0 THEN try(unhex(hex)) END AS bin FROM hexc),
{u2},
hexd AS (SELECT msg_id, kind, idx, hex, txt, coalesce({printable_ok('txt', 3)}, false) AS ok FROM {last2})"""


def scan_ctes(src: str, keywords: tuple[str, str, str, str] | None = None) -> str:
    """CTEs over ``src`` (msg_id, text, user_initiated_transfer) ending in
    ``verdicts`` (msg_id, risk_score, verdict, requires_confirmation, decoded_payload,
    n_findings, codes) and ``findings`` (msg_id, ord, severity, code, detail, decoded)."""
    kw_flags, kw_top, kw_labels, kw_any = keywords or (O.KW_FLAGS, O.KW_TOP, O.KW_LABELS, O.KW_ANY)
    kw_flags = kw_flags.replace("lower(text)", "lower(x)")
    inv = O.INVISIBLE
    return f"""base AS (SELECT msg_id, text, user_initiated_transfer FROM {src}),
lm AS (SELECT * FROM base WHERE length(text) >= 8),
{decode_ctes('lm')},
f_inv AS (SELECT msg_id, 0 AS grp, 0 AS sub, 'CRITICAL' AS severity, 'INVISIBLE_UNICODE' AS code,
  CAST(n AS VARCHAR) || ' invisible/zero-width unicode character(s) detected (' || printf('%.1f', (n / greatest(len,1)) * 100.0)
  || '% of input). Commonly used to smuggle hidden instructions.' AS detail, '' AS decoded
 FROM (SELECT msg_id, length(text) AS len, length(text) - length(regexp_replace(text, '{inv}', '', 'g')) AS n FROM lm) WHERE n > 0),
f_zal AS (SELECT msg_id, 1 AS grp, 0 AS sub, 'HIGH' AS severity, 'ZALGO_COMBINING' AS code,
  CAST(n AS VARCHAR) || ' combining/diacritic characters detected (' || printf('%.1f', (n / greatest(len,1)) * 100.0)
  || '% of input). Zalgo text can hide malicious instructions.' AS detail, '' AS decoded
 FROM (SELECT msg_id, length(text) AS len, length(text) - length(regexp_replace(text, '\\pM', '', 'g')) AS n FROM lm)
 WHERE n / greatest(len,1) >= 0.05),
f_b64 AS (SELECT msg_id, 2 AS grp, idx AS sub, 'HIGH' AS severity, 'BASE64_PAYLOAD' AS code,
  'Base64-encoded content detected. Decoded: "' || {snippet_ellipsis('txt', 120)} || '"' AS detail, txt AS decoded FROM b64d WHERE ok),
f_hex AS (SELECT msg_id, CASE kind WHEN '0x' THEN 3 ELSE 4 END AS grp, idx AS sub,
  CASE kind WHEN '0x' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE kind WHEN '0x' THEN 'HEX_PAYLOAD' ELSE 'HEX_BLOB' END AS code,
  CASE kind WHEN '0x' THEN 'Hex-encoded payload detected (0x-prefix). Decoded: "' ELSE 'Bare hex blob detected. Decoded: "' END
  || left(txt, 120) || '"' AS detail, txt AS decoded FROM hexd WHERE ok),
mt AS (SELECT msg_id, len(toks) AS nt, list_filter(toks, lambda x: regexp_full_match(x, '[.\\-]+')) AS mt
 FROM (SELECT msg_id, string_split_regex(regexp_replace(text, '^{O.WS}+|{O.WS}+$', '', 'g'), '{O.WS}+') AS toks FROM lm)),
f_mor AS (SELECT msg_id, 5 AS grp, 0 AS sub, 'HIGH' AS severity, 'MORSE_ENCODING' AS code,
  'Morse code detected (' || CAST(len(mt) AS VARCHAR) || ' tokens, ' || printf('%.0f', (len(mt) / nt) * 100.0) || '% of input). Decoded: "'
  || dec || '"' AS detail, dec AS decoded
 FROM (SELECT *, array_to_string(list_transform(mt, lambda t: {O.MORSE_CASE}), '') AS dec FROM mt) WHERE nt >= 4 AND len(mt) / nt >= 0.6),
{O.ROT_PROFILE.replace('{src}', 'lm')}, {O.ROT_BEST},
f_cae AS (SELECT msg_id, 6 AS grp, 0 AS sub, CASE WHEN r = 13 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN r = 13 THEN 'ROT13_OBFUSCATION' ELSE 'CAESAR_CIPHER' END AS code,
  CASE WHEN r = 13 THEN 'ROT13' ELSE 'ROT' || CAST(r AS VARCHAR) || ' (Caesar cipher)' END
  || ' obfuscation detected. Decoded: "' || left(dec, 120) || '"' AS detail, dec AS decoded FROM fire),
{O.BLOBS.replace('{src}', 'lm')},
f_ent AS (SELECT msg_id, 7 AS grp, 0 AS sub, 'MEDIUM' AS severity, 'HIGH_ENTROPY_BLOB' AS code,
  'High-entropy blob detected (entropy=' || printf('%.2f', ent) || ' bits/symbol ≥ 4.5). May represent encrypted or compressed data.' AS detail,
  '' AS decoded
 FROM (SELECT msg_id, list_filter(list_transform(blobs, lambda b: {O.ENTROPY.replace('BLOB', 'b')}), lambda x: x >= 4.5)[1] AS ent FROM bl)
 WHERE ent IS NOT NULL),
f_kw AS (SELECT msg_id, 8 AS grp, 0 AS sub, {kw_top} AS severity, 'INJECTION_KEYWORD' AS code,
  'Prompt-injection pattern(s) detected: ' || {kw_labels} || '.' AS detail, '' AS decoded
 FROM (SELECT msg_id, {kw_flags} FROM (SELECT msg_id, text AS x FROM lm)) WHERE {kw_any}),
pay AS (SELECT l.msg_id, l.text, p.decoded AS payload FROM lm l JOIN (
   SELECT msg_id, arg_min(decoded, grp * 1000000 + sub) AS decoded FROM (
     SELECT * FROM f_b64 UNION ALL SELECT * FROM f_hex UNION ALL SELECT * FROM f_mor UNION ALL SELECT * FROM f_cae)
   GROUP BY msg_id) p USING (msg_id)),
f_kw2 AS (SELECT msg_id, 9 AS grp, 0 AS sub, {kw_top} AS severity, 'INJECTION_KEYWORD' AS code,
  'Prompt-injection pattern(s) detected: ' || {kw_labels} || '.' AS detail, '' AS decoded
 FROM (SELECT msg_id, {kw_flags} FROM (SELECT msg_id, payload AS x FROM pay WHERE payload <> '' AND payload <> text)) WHERE {kw_any}),
f_itn AS (SELECT msg_id, 10 AS grp, 0 AS sub, CASE WHEN sig <> '' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'UNVERIFIED_INTENT' AS code,
  CASE WHEN sig <> '' THEN 'High-risk financial command detected with no active transfer session (' || sig
    || '). Likely injection targeting wallet actions.'
   ELSE 'Financial keyword detected with no active user-initiated transfer session. May indicate an injection attempting to trigger an unauthorised transaction.' END AS detail,
  '' AS decoded
 FROM (SELECT msg_id, concat_ws(', ', CASE WHEN regexp_matches(text, {O.q(O.AMT)}) THEN 'explicit amount' END,
    CASE WHEN regexp_matches(text, {O.q(O.URG)}) THEN 'urgency language' END,
    CASE WHEN regexp_matches(text, {O.q(O.ADDR)}) THEN 'recipient address' END) AS sig
   FROM lm WHERE regexp_matches(text, {O.q(O.FIN)}) AND NOT coalesce(user_initiated_transfer, false))),
f_short AS (SELECT msg_id, 0 AS grp, 0 AS sub, 'INFO' AS severity, CASE WHEN text IS NULL THEN 'SCAN_ERROR' ELSE 'TOO_SHORT' END AS code,
  CASE WHEN text IS NULL THEN 'Partial scan — an internal error occurred: text is NULL' ELSE 'Input too short for full analysis.' END AS detail,
  '' AS decoded FROM base WHERE text IS NULL OR length(text) < 8),
allf AS (SELECT * FROM f_inv UNION ALL SELECT * FROM f_zal UNION ALL SELECT * FROM f_b64 UNION ALL SELECT * FROM f_hex
  UNION ALL SELECT * FROM f_mor UNION ALL SELECT * FROM f_cae UNION ALL SELECT * FROM f_ent UNION ALL SELECT * FROM f_kw
  UNION ALL SELECT * FROM f_kw2 UNION ALL SELECT * FROM f_itn UNION ALL SELECT * FROM f_short),
findings AS (SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY grp, sub) - 1 AS BIGINT) AS ord,
  severity, code, detail, decoded,
  CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END AS sev_rank,
  CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 12 WHEN 'LOW' THEN 5 ELSE 0 END AS weight
 FROM allf),
agg AS (SELECT msg_id, least(100, sum(weight)) AS score, count(*) AS n, string_agg(code, ',' ORDER BY ord) AS codes,
  arg_min(CASE WHEN code IN ('BASE64_PAYLOAD','HEX_PAYLOAD','HEX_BLOB','MORSE_ENCODING','ROT13_OBFUSCATION','CAESAR_CIPHER') THEN decoded END,
          CASE WHEN code IN ('BASE64_PAYLOAD','HEX_PAYLOAD','HEX_BLOB','MORSE_ENCODING','ROT13_OBFUSCATION','CAESAR_CIPHER') THEN ord END) AS payload
 FROM findings GROUP BY msg_id),
verdicts AS (SELECT b.msg_id, CAST(coalesce(score, 0) AS BIGINT) AS risk_score,
  CASE WHEN coalesce(score, 0) >= 60 THEN 'MALICIOUS' WHEN coalesce(score, 0) >= 25 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict,
  coalesce(score, 0) >= 60 AS requires_confirmation, coalesce(payload, '') AS decoded_payload, CAST(coalesce(n, 0) AS BIGINT) AS n_findings,
  coalesce(codes, '') AS codes
 FROM base b LEFT JOIN agg USING (msg_id))"""
