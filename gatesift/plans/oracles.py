"""The registered queries in ANSI-style SQL for an independent engine.

Rules are spelled out with that engine's own functions. Its regular expressions have
no look-around, so boundaries are consumed instead, which is the same for a test.
"""

from __future__ import annotations

from gatesift import rules
from gatesift.plans import inputs as I

SPACE = r"[\s\p{Z}\x1C-\x1F\x{85}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def cases(by_value: dict[str, str]) -> str:
    return " ".join(f"WHEN {q(k)} THEN {v}" for k, v in by_value.items())


# ------------------------------------------------------------------ inputs

PROBES = ("probes(probe_id, payload) AS (VALUES "
          + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(I.PROBES)) + ")")
CORPUS = (
    f"{PROBES}, corpus AS (SELECT d.doc_id, d.lang, "
    "CASE WHEN p.payload IS NULL THEN d.text ELSE d.text || ' ' || p.payload END AS text "
    f"FROM documents d LEFT JOIN probes p ON d.doc_id % {I.PROBE_STRIDE} = p.probe_id)"
)
LEVEL_LIST = text_list(I.LEVEL_CYCLE)


def level_of(index: str) -> str:
    return f"{LEVEL_LIST}[CAST(({index}) % 3 AS BIGINT) + 1]"


PAYLOADS = CORPUS + """, encoded AS (
  SELECT doc_id, text, to_base64(encode(text)) AS e FROM corpus),
payloads AS (SELECT doc_id, text, CASE doc_id % 9
  WHEN 1 THEN substr(e, 1, 10) || chr(10) || substr(e, 11)
  WHEN 2 THEN substr(e, 1, length(e) - 1)
  WHEN 3 THEN e || 'é'
  WHEN 4 THEN '!!!!'
  WHEN 5 THEN to_base64(encode('%PDF-1.4' || chr(10) || text))
  WHEN 6 THEN to_base64(encode(repeat(chr(1) || chr(2), 600) || text))
  WHEN 7 THEN '!?' || e
  ELSE e END AS file FROM encoded),
decoded AS (SELECT *,
  CASE doc_id % 9 WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' WHEN 4 THEN 'other'
       WHEN 5 THEN 'pdf' WHEN 6 THEN 'other' ELSE 'text' END AS kind,
  CASE doc_id % 9 WHEN 5 THEN '%PDF-1.4' || chr(10) || text ELSE text END AS content
  FROM payloads)"""

MIXED = CORPUS + """, mixed AS (SELECT doc_id AS request_id,
  CASE WHEN doc_id % 5 IN (0, 1) THEN text WHEN doc_id % 5 = 2 THEN ''
       WHEN doc_id % 5 = 4 AND doc_id % 2 = 0 THEN ' ' || chr(160) || chr(9) END AS text,
  CASE WHEN doc_id % 5 IN (1, 2) THEN to_base64(encode(text)) END AS file, text AS original,
  ['high', 'medium', 'low', 'HIGH', NULL, '', 'extreme'][doc_id % 7 + 1] AS security_level
  FROM corpus)"""

_SHARED = f"event_type IN ({', '.join(map(q, I.SHARED_TEXT_EVENTS))})"
REQUEST_LOG = f"""log AS (SELECT event_id AS request_id, epoch_us(ts) AS us,
  CASE WHEN event_type = 'purchase' THEN 'file' ELSE 'text' END AS analysis_type,
  {level_of('user_id')} AS security_level,
  CASE WHEN {_SHARED} THEN {q(I.REQUEST_TEXTS[0])}
    ELSE {text_list(I.REQUEST_TEXTS)}[user_id % {len(I.REQUEST_TEXTS)} + 1] END AS base,
  base || CASE WHEN {_SHARED} THEN '' ELSE ' (' || user_id || ')' END AS plain,
  value AS latency_ms FROM events),
keyed AS (SELECT *, 'validation:' || analysis_type || ':' || security_level || ':' ||
    sha256(CASE analysis_type WHEN 'file' THEN to_base64(encode(plain)) ELSE plain END)
    AS cache_key,
  CASE analysis_type WHEN 'text' THEN {rules.TEXT_TTL_SECONDS}
    ELSE {rules.FILE_TTL_SECONDS} END * 1000000::BIGINT AS ttl FROM log)"""

DOC_REQUESTS = PROBES + f""", requests AS (SELECT doc_id AS request_id,
  {I.START_US} + doc_id * 1000000 AS us, 'text' AS analysis_type,
  {level_of('n_chars')} AS security_level,
  CASE WHEN payload IS NULL THEN text ELSE text || ' ' || payload END AS content
  FROM documents LEFT JOIN probes ON n_chars % {I.PROBE_STRIDE} = probe_id),
keyed AS (SELECT *, 'validation:text:' || security_level || ':' || sha256(content)
  AS cache_key FROM requests)"""

# --------------------------------------------------------------- detectors


def contains_any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in patterns) + ")"


def family_list(family: rules.Family, text: str, lowered: str) -> str:
    target = text if family.raw else lowered
    if family.every:
        return (f"list_transform(list_filter({text_list(family.patterns)}, "
                f"lambda p: contains({target}, p)), lambda p: {q(family.message)} || p)")
    return (f"(CASE WHEN {contains_any(target, family.patterns)} "
            f"THEN [{q(family.message)}] ELSE [] END)")


def injection_list(profile: str, text: str = "text", lowered: str = "lower(text)") -> str:
    lists = [family_list(f, text, lowered) for f in rules.families(profile).values()]
    return "(" + " || ".join(lists) + ")"


def escape(text: str) -> str:
    return "".join("\\" + c if c in "\\.()[]{}|*+?^$-" else c for c in text)


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def keyword_pattern(keyword: str) -> str:
    before = f"(?:^|{NOT_WORD})" if is_word(keyword[0]) else WORD
    after = f"(?:{NOT_WORD}|$)" if is_word(keyword[-1]) else WORD
    return before + escape(keyword) + after


PLAIN_WORDS = [k for k in rules.KEYWORDS if is_word(k[-1])]
CALL_WORDS = [k for k in rules.KEYWORDS if not is_word(k[-1])]


def has_keyword(lowered: str = "lower(text)") -> str:
    plain = f"(?:^|{NOT_WORD})(?:{'|'.join(escape(k) for k in PLAIN_WORDS)})(?:{NOT_WORD}|$)"
    call = f"(?:^|{NOT_WORD})(?:{'|'.join(escape(k) for k in CALL_WORDS)}){WORD}"
    return (f"(regexp_matches({lowered}, {q(plain)}) "
            f"OR regexp_matches({lowered}, {q(call)}))")


def vertical_tab(pattern: str) -> str:
    # the engine's \s lacks the vertical tab
    return pattern.replace(r"[\s\-\.]", r"[\s\v\-\.]")


EMAIL = f"regexp_matches(text, {q(rules.EMAIL_REGEX)})"
PHONE = f"regexp_matches(text, {q(vertical_tab(rules.PHONE_REGEX))})"
SSN = f"regexp_matches(text, {q(rules.SSN_REGEX)})"
PII = (f"((CASE WHEN {EMAIL} OR {PHONE} OR {SSN} THEN [{q(rules.PII_ISSUE)}] ELSE [] END)"
       f" || (CASE WHEN {EMAIL} THEN [{q(rules.EMAIL_ISSUE)}] ELSE [] END)"
       f" || (CASE WHEN {PHONE} THEN [{q(rules.PHONE_ISSUE)}] ELSE [] END)"
       f" || (CASE WHEN {SSN} THEN [{q(rules.SSN_ISSUE)}] ELSE [] END))")
KEYWORD_LIST = f"(CASE WHEN {has_keyword()} THEN [{q(rules.KEYWORD_ISSUE)}] ELSE [] END)"
TEXT_ISSUES = f"({injection_list('text')} || {KEYWORD_LIST})"


def comma(issues: str) -> str:
    return f"array_to_string({issues}, ', ')"


def shown(issues: str) -> str:
    return comma(f"list_transform({issues}, lambda i: CASE WHEN i = {q(rules.KEYWORD_ISSUE)} "
                 f"THEN {q(rules.KEYWORD_ISSUE_SHOWN)} ELSE i END)")


# ----------------------------------------------------------------- scoring

def verdict(source: str, ids: str, level: str = "level", conf: str = "conf",
            rounded: bool = False) -> str:
    """Verdicts of ``source(ids, issues, conf, level)``."""
    llm = f"CASE {level} WHEN 'high' THEN {conf} ELSE 1.0::DOUBLE END"
    weighted = (f"CASE {level} WHEN 'high' THEN 1.0::DOUBLE * 0.4::DOUBLE + ({llm}) * 0.6::DOUBLE "
                f"WHEN 'medium' THEN 1.0::DOUBLE * 0.7::DOUBLE + ({llm}) * 0.3::DOUBLE "
                "ELSE 1.0::DOUBLE END")
    threshold = (f"CASE {level} WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE "
                 "ELSE 0.5::DOUBLE END")
    return f"""SELECT {ids},
  CASE WHEN len(issues) = 0 AND {weighted} >= {threshold} THEN 'safe' ELSE 'unsafe' END AS status,
  CASE WHEN len(issues) > 0 THEN {comma('issues')}
       WHEN {weighted} >= {threshold} THEN 'safe' ELSE 'unspecified_issue' END AS reason,
  {llm} AS llm_score,
  CASE WHEN len(issues) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS rule_score,
  CASE WHEN len(issues) > 0 THEN 0.0::DOUBLE ELSE {weighted} END AS overall_score,
  {shown('issues')} AS issues FROM {source}"""


def text_verdicts(source: str, ids: str, level: str) -> str:
    """Verdicts of non-blank texts ``source(ids, text)``."""
    return (f"found AS MATERIALIZED (SELECT {ids}, {level} AS level, {TEXT_ISSUES} AS issues FROM {source}), "
            "scored AS (SELECT *, CASE WHEN len(issues) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
            "AS conf FROM found), "
            f"verdicts AS ({verdict('scored', ids + ', level')})")


TEXT_COLUMNS = "status, reason, llm_score, rule_score, overall_score, issues"


def _file_found(source: str, text: str = "text", profile_ids: str = "doc_id") -> str:
    """File-profile findings of ``source`` whose column ``text`` is analysed."""
    return (f"found AS MATERIALIZED (SELECT {profile_ids}, text, {PII} AS pii, {injection_list('file')} AS inj "
            f"FROM {source}), "
            "scored AS (SELECT *, pii || inj AS issues, 1.0::DOUBLE "
            "- CASE WHEN len(inj) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END "
            "- CASE WHEN len(pii) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS conf FROM found)")


SQL: dict[str, str] = {}

for _level in rules.LEVELS:
    SQL[f"validate_text_{_level}"] = (
        f"WITH {CORPUS}, {text_verdicts('corpus', 'doc_id', q(_level))} "
        f"SELECT doc_id, {TEXT_COLUMNS} FROM verdicts")
SQL["validate_pages"] = (
    "WITH src AS (SELECT page_id, html AS text FROM pages), "
    f"{text_verdicts('src', 'page_id', q('high'))} SELECT page_id, {TEXT_COLUMNS} FROM verdicts")
SQL["validate_conversations"] = (
    f"WITH {text_verdicts('conversations', 'conv_id, turn', q('medium'))} "
    f"SELECT conv_id, turn, {TEXT_COLUMNS} FROM verdicts")
SQL["validate_benchmark"] = (
    f"WITH {text_verdicts('benchmark', 'item_id', q('low'))} "
    f"SELECT item_id, {TEXT_COLUMNS} FROM verdicts")
SQL["unsafe_documents_by_language"] = (
    f"WITH {CORPUS}, {text_verdicts('corpus', 'doc_id, lang', q('high'))} "
    "SELECT lang, status, count(*) AS n_docs FROM verdicts GROUP BY lang, status")
SQL["verdict_summary_text"] = (
    f"WITH {CORPUS}, f AS MATERIALIZED (SELECT {TEXT_ISSUES} AS issues FROM corpus) "
    f"SELECT {q(rules.TEXT_SUMMARY)} AS analysis_summary, len(issues) = 0 AS is_safe, "
    "count(*) AS n_docs FROM f GROUP BY 2")

for _name, _key in {"sql": "sql", "xss": "xss", "command": "cmd", "nosql": "nosql",
                    "ldap": "ldap", "path": "path", "xml": "xml", "template": "template",
                    "code": "code_exec", "suspicious": "suspicious"}.items():
    SQL[f"detect_{_key}"] = (
        f"WITH {CORPUS} SELECT doc_id, "
        f"{comma(family_list(rules.families('text')[_name], 'text', 'lower(text)'))} AS issues "
        "FROM corpus")
SQL["detect_nosql_file"] = (
    f"WITH {CORPUS} SELECT doc_id, "
    f"{comma(family_list(rules.families('file')['nosql'], 'text', 'lower(text)'))} AS issues "
    "FROM corpus")
SQL["detect_keyword"] = (
    f"WITH {CORPUS} SELECT doc_id, {has_keyword()} AS has_keyword FROM corpus")
SQL["detect_email"] = f"WITH {CORPUS} SELECT doc_id, {EMAIL} AS hit FROM corpus"
SQL["detect_phone"] = f"WITH {CORPUS} SELECT doc_id, {PHONE} AS hit FROM corpus"
SQL["detect_ssn"] = f"WITH {CORPUS} SELECT doc_id, {SSN} AS hit FROM corpus"
SQL["detect_pii"] = f"WITH {CORPUS} SELECT doc_id, {comma(PII)} AS issues FROM corpus"
SQL["injection_issues"] = (
    f"WITH {CORPUS} SELECT doc_id, {comma(injection_list('text'))} AS issues FROM corpus")


def rules_values(profile: str) -> str:
    rows = ", ".join(f"({q(f.name)}, {i}, {q(p)}, {str(f.raw).lower()})"
                     for f in rules.families(profile).values() for i, p in enumerate(f.patterns))
    return f"rule(family, position, pattern, raw) AS (VALUES {rows})"


SQL["rule_matches_long"] = (
    f"WITH {CORPUS}, {rules_values('text')} SELECT doc_id, family, position, pattern "
    "FROM (SELECT doc_id, text, lower(text) AS lo FROM corpus) JOIN rule "
    "ON contains(CASE WHEN raw THEN text ELSE lo END, pattern)")
SQL["rule_table_matches"] = SQL["rule_matches_long"]
SQL["rule_matches_pages"] = (
    f"WITH {rules_values('file')} SELECT family, pattern, count(*) AS n_pages "
    "FROM (SELECT page_id, html, lower(html) AS lo FROM pages) JOIN rule "
    "ON contains(CASE WHEN raw THEN html ELSE lo END, pattern) GROUP BY family, pattern")
_EACH_KEYWORD = ", ".join(
    f"CASE WHEN contains(lo, {q(k)}) AND regexp_matches(lo, {q(keyword_pattern(k))}) "
    f"THEN {q(k)} END" for k in rules.KEYWORDS)
SQL["keyword_matches"] = (
    f"WITH {CORPUS}, k AS (SELECT doc_id, unnest([{_EACH_KEYWORD}]) AS keyword "
    "FROM (SELECT doc_id, lower(text) AS lo FROM corpus)) "
    "SELECT doc_id, keyword FROM k WHERE keyword IS NOT NULL")
SQL["keyword_table_matches"] = SQL["keyword_matches"]

# ---------------------------------------------------------------- profiles
SQL["analyze_text_profile"] = (
    f"WITH {CORPUS}, f AS MATERIALIZED (SELECT doc_id, {TEXT_ISSUES} AS i FROM corpus) SELECT doc_id, "
    "len(i) = 0 AS is_safe, CASE WHEN len(i) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    f"AS confidence_score, {comma('i')} AS issues, {q(rules.TEXT_SUMMARY)} AS analysis_summary "
    "FROM f")


def _file_profile(threshold: float, max_bytes: int) -> str:
    over = f"octet_length(encode(text)) > {max_bytes}"
    return (f"WITH {CORPUS}, {_file_found('corpus')} SELECT doc_id, "
            f"NOT ({over}) AND conf >= {threshold}::DOUBLE AS is_safe, "
            f"CASE WHEN {over} THEN 0.0::DOUBLE ELSE conf END AS confidence_score, "
            f"CASE WHEN {over} THEN {q(rules.OVERSIZE_ISSUE)} ELSE {comma('issues')} END AS issues, "
            f"CASE WHEN {over} THEN {q(rules.OVERSIZE_SUMMARY)} "
            f"WHEN conf >= {threshold}::DOUBLE THEN {q(rules.FILE_TEXT_SAFE_SUMMARY)} "
            f"ELSE {q(rules.FILE_TEXT_UNSAFE_SUMMARY)} END AS analysis_summary FROM scored")


SQL["analyze_file_profile"] = _file_profile(0.8, rules.MAX_BYTES)
SQL["analyze_file_profile_half"] = _file_profile(0.5, 20_000)
SQL["file_safety_score"] = (
    f"WITH {CORPUS}, {_file_found('corpus')} SELECT doc_id, conf AS score FROM scored")
SQL["is_content_safe_text"] = (
    f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE len({TEXT_ISSUES}) = 0")
# safe takes the analyser's own threshold of 0.8
SQL["is_content_safe_file"] = (
    f"WITH {CORPUS}, {_file_found('corpus')} SELECT doc_id FROM scored "
    "WHERE conf >= 0.8::DOUBLE AND conf >= 0.5::DOUBLE")
SQL["paged_document_verdict"] = (
    "WITH docs AS (SELECT conv_id, count(*) AS n_pages, string_agg(text, '' ORDER BY turn) AS text, "
    "bool_or(conv_id % 4 = 0) AS emb FROM conversations GROUP BY conv_id), "
    f"{_file_found('docs', profile_ids='conv_id, n_pages, emb')}, "
    f"pdf AS MATERIALIZED (SELECT *, conf >= 0.8::DOUBLE AS passed, "
    f"CASE WHEN conf >= 0.8::DOUBLE AND emb THEN issues || [{q(rules.EMBEDDED_ISSUE)}] "
    "ELSE issues END AS all_issues, "
    "CASE WHEN conf >= 0.8::DOUBLE AND emb THEN conf * 0.8::DOUBLE ELSE conf END AS final FROM scored) "
    "SELECT conv_id, n_pages, final >= 0.8::DOUBLE AS is_safe, final AS confidence_score, "
    f"{comma('all_issues')} AS issues, CASE WHEN passed THEN {q(rules.PDF_SAFE_SUMMARY)} "
    f"ELSE {q(rules.PDF_UNSAFE_SUMMARY)} END AS analysis_summary, "
    "CASE WHEN len(all_issues) = 0 THEN 'safe' ELSE 'unsafe' END AS status, "
    "CASE WHEN len(all_issues) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS overall_score FROM pdf")

# ------------------------------------------------------------------- files
_FILES = (f"{PAYLOADS}, src AS (SELECT doc_id, kind, content AS text FROM decoded), "
          + _file_found("src", profile_ids="doc_id, kind"))


def guarded(value: str, invalid: str, other: str) -> str:
    return f"CASE kind WHEN 'invalid' THEN {invalid} WHEN 'other' THEN {other} ELSE {value} END"


_FILE_STATUS = guarded("CASE WHEN len(issues) = 0 THEN 'safe' ELSE 'unsafe' END",
                       "'unsafe'", "'error'")
_FILE_REASON = guarded(f"CASE WHEN len(issues) = 0 THEN 'safe' ELSE {comma('issues')} END",
                       "'invalid_base64'", "'unsupported_file_type'")
_ONE_IF_CLEAN = "CASE WHEN len(issues) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_FILE_SELECT = f"""SELECT doc_id, {_FILE_STATUS} AS status, {_FILE_REASON} AS reason,
  {guarded('conf', 'NULL', 'NULL')} AS llm_score,
  {guarded(_ONE_IF_CLEAN, 'NULL', 'NULL')} AS rule_score,
  {guarded(_ONE_IF_CLEAN, '0.0::DOUBLE', '0.0::DOUBLE')} AS overall_score,
  {guarded(comma('issues'), 'NULL', 'NULL')} AS issues FROM scored"""
SQL["base64_roundtrip_verdict"] = f"WITH {_FILES} {_FILE_SELECT}"
SQL["unread_pdf_verdict"] = (
    f"WITH {_FILES}, v AS (SELECT "
    f"CASE WHEN kind = 'pdf' THEN 'unsafe' ELSE {_FILE_STATUS} END AS status, "
    f"CASE WHEN kind = 'pdf' THEN {q(rules.BAD_PDF_ISSUE)} ELSE {_FILE_REASON} END AS reason "
    "FROM scored) SELECT status, reason, count(*) AS n_files FROM v GROUP BY status, reason")
_PDF_PENALISED = "kind = 'pdf' AND doc_id % 2 = 0 AND conf >= 0.8::DOUBLE"
SQL["extracted_pdf_verdict"] = (
    f"WITH {PAYLOADS}, src AS (SELECT doc_id, kind, text FROM decoded), "
    + _file_found("src", profile_ids="doc_id, kind")
    + f""", pen AS (SELECT doc_id, kind, conf, CASE WHEN {_PDF_PENALISED}
  THEN issues || [{q(rules.EMBEDDED_ISSUE)}] ELSE issues END AS issues FROM scored)
SELECT doc_id, {_FILE_STATUS} AS status, {_FILE_REASON} AS reason,
  {guarded(_ONE_IF_CLEAN, '0.0::DOUBLE', '0.0::DOUBLE')} AS overall_score,
  CASE kind WHEN 'pdf' THEN CASE WHEN conf >= 0.8::DOUBLE THEN {q(rules.PDF_SAFE_SUMMARY)}
         ELSE {q(rules.PDF_UNSAFE_SUMMARY)} END
       WHEN 'text' THEN CASE WHEN conf >= 0.8::DOUBLE THEN {q(rules.FILE_TEXT_SAFE_SUMMARY)}
         ELSE {q(rules.FILE_TEXT_UNSAFE_SUMMARY)} END END AS analysis_summary FROM pen""")
_BUNDLES = f"""bundles AS (SELECT doc_id // {I.BUNDLE} AS bundle,
    string_agg(CASE WHEN doc_id % {I.BUNDLE} = 0 AND doc_id // {I.BUNDLE} % 3 = 0 THEN '%PDF-1.4 ' || text
      ELSE text END || chr(10), '' ORDER BY doc_id) AS text FROM corpus GROUP BY 1)"""


def _file_row(text: str, unavailable: str, missing: str) -> str:
    return (f"CASE WHEN bundle % 10 = 9 THEN {unavailable} WHEN bundle < 0 THEN {missing} ELSE {text} END")


SQL["file_source_analysis"] = (
    f"WITH {CORPUS}, {_BUNDLES}, {_file_found('bundles', profile_ids='bundle')}, "
    "every AS (SELECT bundle, conf, issues FROM scored "
    "UNION ALL SELECT -1 - bundle, 0.0::DOUBLE, NULL FROM scored WHERE bundle % 7 = 2) SELECT bundle, "
    f"{_file_row('conf >= 0.8::DOUBLE', 'false', 'false')} AS is_safe, "
    f"{_file_row('conf', '0.0::DOUBLE', '0.0::DOUBLE')} AS confidence_score, "
    f"{_file_row(comma('issues'), q(rules.FILE_UNAVAILABLE_ISSUE), q(rules.FILE_ERROR_ISSUE))} AS issues, "
    + _file_row(f"CASE WHEN conf >= 0.8::DOUBLE THEN {q(rules.FILE_TEXT_SAFE_SUMMARY)} "
                f"ELSE {q(rules.FILE_TEXT_UNSAFE_SUMMARY)} END", q(rules.FILE_UNAVAILABLE_SUMMARY),
                f"{q(rules.FILE_MISSING_ERROR)} || bundle") + " AS analysis_summary FROM every")
SQL["file_type_census"] = (
    f"WITH {PAYLOADS} SELECT kind, count(*) AS n_files FROM decoded GROUP BY kind")
_BYTES = ("CASE WHEN doc_id % 9 = 4 THEN 0 WHEN doc_id % 9 = 6 "
          "THEN 1200 + octet_length(encode(text)) ELSE octet_length(encode(text)) END")
_TOO_LARGE = f"kind <> 'invalid' AND {_BYTES} > 5000"
SQL["size_guard"] = (
    f"WITH {_FILES} SELECT doc_id, CASE WHEN {_TOO_LARGE} THEN 'unsafe' ELSE {_FILE_STATUS} END "
    f"AS status, CASE WHEN {_TOO_LARGE} THEN 'file_too_large' ELSE {_FILE_REASON} END AS reason, "
    f"CASE WHEN {_TOO_LARGE} THEN 0.0::DOUBLE ELSE "
    f"{guarded(_ONE_IF_CLEAN, '0.0::DOUBLE', '0.0::DOUBLE')} END AS overall_score FROM scored")
SQL["display_error"] = (
    f"WITH {PAYLOADS} SELECT doc_id, CASE WHEN kind = 'other' "
    f"THEN {q(rules.DISPLAY_ERRORS['unsupported_file_type'])} END AS message FROM decoded")

# ---------------------------------------------------------------- requests
_T, _F = "coalesce(text <> '', false)", "coalesce(file <> '', false)"
_KNOWN = "IN ('high', 'medium', 'low')"


def _routed(level: str, error: str) -> str:
    return (f"{MIXED}, checked AS (SELECT *, {level} AS lv FROM mixed), "
            f"routed AS (SELECT *, {error} AS request_error FROM checked)")


_ROUTED_SELECT = f"""SELECT request_id, lv AS security_level, request_error,
  CASE WHEN request_error IS NULL THEN CASE WHEN {_T} THEN 'text' ELSE 'file' END END
    AS analysis_type,
  CASE WHEN request_error IS NULL THEN sha256(CASE WHEN {_T} THEN text ELSE file END) END
    AS content_hash FROM routed"""
_SERVICE = _routed("CASE WHEN coalesce(security_level, '') = '' THEN 'high' ELSE security_level END", (
    f"CASE WHEN NOT lv {_KNOWN} THEN {q(rules.BAD_LEVEL_ERROR)} "
    f"WHEN {_T} AND {_F} THEN {q(rules.AMBIGUOUS_ERROR)} "
    f"WHEN NOT {_T} AND NOT {_F} THEN {q(rules.MISSING_ERROR)} END"))
SQL["route_requests"] = f"WITH {_SERVICE} {_ROUTED_SELECT}"
# a broken line has no fields; one with a field of another kind keeps the others
_LINE = f"""CASE request_id % {I.BROKEN_STRIDE}
  WHEN 0 THEN '{{"request_id":' || request_id || ',"text":"'
  WHEN 1 THEN '{{"request_id":"no ' || request_id || '","text":"x"}}' END"""
SQL["read_json_requests"] = (
    f"WITH {_SERVICE}, r AS ({_ROUTED_SELECT}), l AS (SELECT *, {_LINE} AS line FROM r) "
    "SELECT CASE WHEN line IS NULL THEN request_id END AS request_id, "
    "CASE WHEN line IS NULL THEN security_level END AS security_level, "
    f"CASE WHEN line IS NULL THEN request_error ELSE {q(rules.MALFORMED_ERROR)} END AS request_error, "
    "CASE WHEN line IS NULL THEN analysis_type END AS analysis_type, "
    "CASE WHEN line IS NULL THEN content_hash ELSE sha256(line) END AS content_hash FROM l")
SQL["stream_json_requests"] = SQL["read_json_requests"]
SQL["gateway_requests"] = "WITH " + _routed("coalesce(security_level, 'high')", (
    f"CASE WHEN NOT {_T} AND NOT {_F} THEN {q(rules.MISSING_ERROR)} "
    f"WHEN NOT lv {_KNOWN} THEN {q(rules.GATEWAY_LEVEL_ERROR)} END")) + " " + _ROUTED_SELECT
SQL["resolve_level"] = f"""WITH {MIXED}, chosen AS (SELECT request_id,
  CASE WHEN coalesce(security_level, '') = '' THEN 'medium' ELSE security_level END AS c FROM mixed)
SELECT request_id, c AS strict_level,
  CASE WHEN lower(c) {_KNOWN} THEN lower(c) ELSE 'high' END AS lenient_level FROM chosen"""


def _mixed_verdicts(level: str) -> str:
    """Routed requests with their issues; files of mixed requests are whole documents."""
    return (f"{_SERVICE}, typed AS (SELECT request_id, request_error, lv, {level} AS level, "
            f"CASE WHEN request_error IS NULL THEN CASE WHEN {_T} THEN 'text' ELSE 'file' END END "
            f"AS analysis_type, CASE WHEN {_T} THEN text ELSE original END AS text FROM routed), "
            "guard AS MATERIALIZED (SELECT *, analysis_type = 'text' AND NOT "
            f"regexp_matches(text, '[^\\s\\p{{Z}}]') AS blank, "
            f"{PII} AS pii, {injection_list('file')} AS finj, {TEXT_ISSUES} AS tiss FROM typed), "
            "found AS MATERIALIZED (SELECT *, CASE analysis_type WHEN 'text' THEN tiss ELSE pii || finj END "
            "AS issues, CASE WHEN analysis_type = 'text' THEN CASE WHEN len(tiss) = 0 "
            "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE "
            "- CASE WHEN len(finj) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END "
            "- CASE WHEN len(pii) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS conf FROM guard), "
            "raw AS (" + verdict("found", "request_id, request_error, lv, analysis_type, blank")
            + """), v AS (SELECT request_id, request_error, lv AS security_level, analysis_type,
  CASE WHEN request_error IS NOT NULL THEN NULL WHEN blank THEN 'unsafe' ELSE status END AS status,
  CASE WHEN request_error IS NOT NULL THEN NULL WHEN blank THEN 'empty_input' ELSE reason END
    AS reason,
  CASE WHEN request_error IS NULL AND NOT blank THEN llm_score END AS llm_score,
  CASE WHEN request_error IS NULL AND NOT blank THEN rule_score END AS rule_score,
  CASE WHEN request_error IS NOT NULL THEN NULL WHEN blank THEN 0.0 ELSE overall_score END
    AS overall_score,
  CASE WHEN request_error IS NULL AND NOT blank THEN issues END AS issues FROM raw)""")


SQL["validate_requests"] = (
    f"WITH {_mixed_verdicts('lv')} SELECT request_id, request_error, analysis_type, "
    f"security_level, {TEXT_COLUMNS} FROM v")
SQL["verdict_sink"] = (
    f"WITH {_mixed_verdicts('lv')} SELECT request_id, CAST(request_id % 2 AS VARCHAR) AS batch, "
    "status, reason, overall_score FROM v WHERE status = 'unsafe'")
SQL["validate_requests_fixed_level"] = (
    f"WITH {_mixed_verdicts(q('high'))} SELECT security_level, status, llm_score, "
    "count(*) AS n_requests FROM v GROUP BY security_level, status, llm_score")

# ----------------------------------------------------------- model verdicts
LABELLED = (f"{CORPUS}, labelled AS (SELECT c.*, l.toxic, l.quality FROM corpus c "
            "LEFT JOIN labels l ON c.doc_id = l.doc_id)")
SQL["model_verdict_join"] = (
    f"WITH {LABELLED}, found AS MATERIALIZED (SELECT doc_id, {level_of('doc_id')} AS level, {TEXT_ISSUES} || "
    f"(CASE WHEN toxic = 1 THEN [{q(rules.MODEL_ISSUE)}] ELSE [] END) AS issues FROM labelled), "
    "scored AS (SELECT *, CASE WHEN len(issues) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conf "
    "FROM found) " + verdict("scored", "doc_id"))
SQL["model_scorer"] = (
    f"WITH {CORPUS}, found AS MATERIALIZED (SELECT doc_id, 'high' AS level, "
    "round(1 - length(regexp_replace(text, '[^aeiou]', '', 'g'))::DOUBLE / length(text), 1) "
    f"AS score, {TEXT_ISSUES} AS issues FROM corpus), scored AS (SELECT *, "
    "CASE WHEN len(issues) > 0 THEN 0.0::DOUBLE ELSE score END AS conf FROM found), v AS ("
    + verdict("scored", "doc_id") + ") SELECT doc_id, status, reason, "
    "round(overall_score, 6) AS overall_score FROM v")
SQL["weighted_overall"] = (
    f"WITH {LABELLED}, found AS MATERIALIZED (SELECT doc_id, {level_of('doc_id')} AS level, quality, "
    f"{TEXT_ISSUES} AS issues FROM labelled), scored AS (SELECT *, CASE WHEN len(issues) > 0 "
    "THEN 0.0::DOUBLE WHEN quality = 0 THEN 0.75::DOUBLE WHEN quality = 1 THEN 0.95::DOUBLE "
    "ELSE 1.0::DOUBLE END AS conf FROM found), v AS (" + verdict("scored", "doc_id") + ") "
    "SELECT doc_id, status, reason, round(llm_score, 6) AS llm_score, "
    "round(overall_score, 6) AS overall_score FROM v")


def _engine(pattern: str) -> str:
    return pattern.replace(r"\w", WORD).replace(r"\s", SPACE)


_RISK = [(rules.RISK_CHARACTERS_REGEX, rules.RISK_CHARACTERS_ISSUE),
         (rules.RISK_SQL_REGEX, rules.RISK_SQL_ISSUE),
         (rules.RISK_XSS_REGEX, rules.RISK_XSS_ISSUE)]
_RISK_ISSUES = " || ".join(f"(CASE WHEN regexp_matches(text, {q(_engine(p))}) THEN [{q(i)}] "
                           "ELSE [] END)" for p, i in _RISK)
SQL["risk_score_legacy"] = f"""WITH {LABELLED}, f AS MATERIALIZED (SELECT doc_id, {level_of('doc_id')} AS level,
  coalesce(toxic, 0)::DOUBLE AS tox, {_RISK_ISSUES} AS issues FROM labelled),
p AS (SELECT *, len(issues) * 0.3::DOUBLE AS rule,
  CASE level WHEN 'low' THEN 0.0::DOUBLE ELSE tox END AS llm FROM f),
s AS (SELECT *, CASE level WHEN 'high' THEN rule * 0.4::DOUBLE + llm * 0.6::DOUBLE
  WHEN 'medium' THEN rule * 0.6::DOUBLE + llm * 0.4::DOUBLE ELSE rule END AS o FROM p)
SELECT doc_id, CASE WHEN o < 0.7::DOUBLE THEN 'safe' ELSE 'unsafe' END AS status,
  CASE WHEN o < 0.7::DOUBLE THEN 'safe' WHEN len(issues) > 0 THEN {comma('issues')}
       ELSE {q(rules.RISK_OTHER_REASON)} END AS reason,
  round(least(1.0::DOUBLE, rule), 6) AS rule_score, round(llm, 6) AS llm_score,
  round(least(1.0::DOUBLE, o), 6) AS overall_score FROM s"""

# ------------------------------------------------------------------- cache
AS_OF_US = I.START_US + 2_200 * 1_000_000
DOC_VERDICTS = (
    f"{DOC_REQUESTS}, src AS (SELECT request_id, us, cache_key, security_level, content AS text "
    f"FROM keyed), found AS MATERIALIZED (SELECT request_id, us, cache_key, security_level, "
    f"security_level AS level, {TEXT_ISSUES} AS issues FROM src), "
    "scored AS (SELECT *, CASE WHEN len(issues) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conf "
    "FROM found), verdicts AS ("
    + verdict("scored", "request_id, us, cache_key, security_level") + ")")
CACHE = (f"{DOC_VERDICTS}, cache AS (SELECT cache_key, security_level, status, reason, issues, "
         f"overall_score, us // 1000000 AS cached_at, us + {rules.TEXT_TTL_SECONDS} * 1000000 "
         "AS expires_us FROM verdicts), "
         "latest AS (SELECT cache_key, any_value(security_level) AS security_level, "
         "any_value(status) AS status, any_value(reason) AS reason, any_value(issues) AS issues, "
         "any_value(overall_score) AS overall_score, max(cached_at) AS cached_at, "
         "max(expires_us) AS expires_us FROM cache GROUP BY cache_key), "
         f"live AS (SELECT * FROM latest WHERE expires_us > {AS_OF_US})")

LABELLED_CACHE = CACHE.replace("FROM verdicts), latest", "FROM verdicts WHERE request_id IN "
                               "(SELECT doc_id FROM labels)), latest")

SQL["cache_keys"] = f"WITH {DOC_REQUESTS} SELECT request_id, cache_key FROM keyed"
SQL["cache_entries"] = (f"WITH {CACHE} SELECT cache_key, security_level, status, reason, cached_at, "
                        "expires_us FROM cache")
SQL["latest_entry"] = f"WITH {CACHE} SELECT cache_key, cached_at, status FROM latest"
SQL["upsert_entries"] = (
    f"WITH {CACHE}, u AS (SELECT cache_key, cached_at, expires_us FROM cache UNION ALL "
    "SELECT cache_key, cached_at + 600, expires_us + 600000000 FROM cache "
    "WHERE security_level = 'high') SELECT cache_key, max(cached_at) AS cached_at, "
    "max(expires_us) AS expires_us FROM u GROUP BY cache_key")
SQL["live_entries"] = f"WITH {CACHE} SELECT cache_key FROM live"
SQL["clear_by_glob"] = (f"WITH {CACHE} SELECT cache_key FROM latest "
                        "WHERE NOT cache_key GLOB 'validation:text:high:[0-7]*'")
SQL["entry_json_roundtrip"] = (
    f"WITH {CACHE} SELECT cache_key, 'text' AS analysis_type, security_level, cached_at, reason, "
    "overall_score, issues FROM latest")
SQL["cache_lookup"] = (
    f"WITH {LABELLED_CACHE} SELECT k.request_id, l.cache_key IS NOT NULL AS cache_hit, l.status, l.reason, "
    "l.cached_at FROM keyed k LEFT JOIN live l USING (cache_key)")
SQL["uncached_requests"] = (
    f"WITH {LABELLED_CACHE} SELECT request_id, cache_key FROM keyed "
    "WHERE cache_key NOT IN (SELECT cache_key FROM live)")
SQL["cached_requests"] = (
    f"WITH {LABELLED_CACHE} SELECT request_id, cache_key FROM keyed "
    "WHERE cache_key IN (SELECT cache_key FROM live)")
SQL["validate_with_cache"] = (
    f"WITH {LABELLED_CACHE} SELECT v.request_id, v.security_level, l.cache_key IS NOT NULL AS cache_hit, "
    "v.status, v.reason, v.overall_score, l.cached_at, "
    "CASE WHEN l.cache_key IS NOT NULL THEN 'text' END AS analysis_type "
    "FROM verdicts v LEFT JOIN live l USING (cache_key)")
SQL["validate_without_cache"] = (
    f"WITH {DOC_VERDICTS} SELECT request_id, security_level, false AS cache_hit, status, reason, "
    "overall_score, NULL::BIGINT AS cached_at, NULL::VARCHAR AS analysis_type FROM verdicts")
SQL["analyse_once"] = (
    f"WITH {DOC_VERDICTS} SELECT request_id, cache_key, {TEXT_COLUMNS} FROM verdicts")

# ----------------------------------------------------------------- the log
# Each request's successor as a write is the first request of its key that comes when
# the lifetime is over; the writes are what the first request of each key leads to.
REPLAY = f"""{REQUEST_LOG}, succ AS (SELECT cache_key, us, min(us) OVER (
    PARTITION BY cache_key ORDER BY us RANGE BETWEEN ttl FOLLOWING AND UNBOUNDED FOLLOWING)
    AS nxt FROM keyed),
writes(cache_key, us) AS (
  SELECT cache_key, min(us) FROM keyed GROUP BY cache_key
  UNION ALL
  SELECT s.cache_key, s.nxt FROM writes w JOIN succ s ON w.cache_key = s.cache_key AND w.us = s.us
  WHERE s.nxt IS NOT NULL),
replayed AS (SELECT k.*, w.us IS NULL AS cache_hit, max(w.us) OVER (
    PARTITION BY k.cache_key ORDER BY k.us) AS written_us
  FROM keyed k LEFT JOIN writes w ON k.cache_key = w.cache_key AND k.us = w.us)"""
_PLAIN_STATUS = {
    text: ("safe", "safe") for text in I.REQUEST_TEXTS[:2]} | {
    I.REQUEST_TEXTS[2]: ("unsafe", "unsafe"),
    I.REQUEST_TEXTS[3]: ("unsafe", "safe"),
    I.REQUEST_TEXTS[4]: ("safe", "unsafe"),
}
_STATUS = ("CASE analysis_type WHEN 'text' THEN CASE base "
           + cases({t: q(s[0]) for t, s in _PLAIN_STATUS.items()}) + " END ELSE CASE base "
           + cases({t: q(s[1]) for t, s in _PLAIN_STATUS.items()}) + " END END")
LOG_VERDICTS = f"{REPLAY}, logged AS (SELECT *, {_STATUS} AS status FROM replayed)"
_COUNTERS = """counters AS (
  SELECT 'cache_hits' AS counter, count(*) AS value FROM logged WHERE cache_hit
  UNION ALL SELECT 'cache_misses', count(*) FROM logged WHERE NOT cache_hit
  UNION ALL SELECT 'validations_' || analysis_type, count(*) FROM logged WHERE NOT cache_hit
    GROUP BY analysis_type
  UNION ALL SELECT 'validations_' || analysis_type || '_' || status, count(*) FROM logged
    WHERE NOT cache_hit GROUP BY analysis_type, status)"""
_ROLLUP = """SELECT count(*) FILTER (cache_hit) AS total_hits,
  count(*) FILTER (NOT cache_hit) AS total_misses,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (cache_hit)::DOUBLE / count(*) * 100
    ELSE 0.0::DOUBLE END, 6) AS hit_rate,
  count(*) FILTER (NOT cache_hit AND analysis_type = 'text') AS text_validations,
  count(*) FILTER (NOT cache_hit AND analysis_type = 'file') AS file_validations,
  count(*) FILTER (NOT cache_hit AND status = 'safe') AS safe_results,
  count(*) FILTER (NOT cache_hit AND status = 'unsafe') AS unsafe_results FROM logged"""

SQL["ttl_replay"] = (f"WITH RECURSIVE {REPLAY} SELECT request_id, cache_key, cache_hit, written_us, "
                     "written_us + ttl AS expires_us FROM replayed")
SQL["replay_stats"] = (
    f"WITH RECURSIVE {REPLAY} SELECT analysis_type, count(*) FILTER (cache_hit) AS n_hits, "
    "count(*) FILTER (NOT cache_hit) AS n_misses FROM replayed GROUP BY analysis_type")
SQL["event_counters"] = f"WITH RECURSIVE {LOG_VERDICTS}, {_COUNTERS} SELECT * FROM counters"
SQL["hit_rate"] = f"WITH RECURSIVE {LOG_VERDICTS} {_ROLLUP}"
SQL["stats_snapshot"] = SQL["hit_rate"]
SQL["empty_log_stats"] = (
    "SELECT 0::BIGINT AS total_hits, 0::BIGINT AS total_misses, 0.0::DOUBLE AS hit_rate, "
    "0::BIGINT AS text_validations, 0::BIGINT AS file_validations, 0::BIGINT AS safe_results, "
    "count(*) AS unsafe_results FROM events WHERE value < 0")
# what is left of the counters without file requests and unsafe verdicts
SQL["missing_counter_stats"] = (
    f"WITH RECURSIVE {LOG_VERDICTS} SELECT count(*) FILTER (cache_hit) AS total_hits, "
    "count(*) FILTER (NOT cache_hit) AS total_misses, "
    "round(count(*) FILTER (cache_hit) / greatest(count(*), 1) * 100::DOUBLE, 6) AS hit_rate, "
    "count(*) FILTER (NOT cache_hit) AS text_validations, 0::BIGINT AS file_validations, "
    "count(*) FILTER (NOT cache_hit) AS safe_results, 0::BIGINT AS unsafe_results "
    "FROM logged WHERE analysis_type = 'text' AND status = 'safe'")
_DOC_KEYS = ("(WITH " + CACHE + " SELECT count(*) FROM latest)")
SQL["key_census"] = (
    f"WITH RECURSIVE {LOG_VERDICTS}, {_COUNTERS} "
    f"SELECT 'validation' AS kind, {_DOC_KEYS} AS n_keys "
    "UNION ALL SELECT 'counter', count(*) FROM counters")
SQL["cache_info"] = (
    f"WITH RECURSIVE {LOG_VERDICTS}, {_COUNTERS}, rollup AS ({_ROLLUP}) "
    f"SELECT {_DOC_KEYS} + (SELECT count(*) FROM counters) AS total_keys, "
    f"{_DOC_KEYS} AS validation_cache_keys, (SELECT count(*) FROM counters) AS counter_keys, "
    "total_hits, safe_results FROM rollup")
SQL["first_sighting"] = (
    f"WITH {REQUEST_LOG} SELECT request_id, cache_key, row_number() OVER "
    "(PARTITION BY cache_key ORDER BY us, request_id) > 1 AS is_duplicate FROM keyed")
SQL["first_sighting_documents"] = (
    f"WITH {DOC_REQUESTS}, r AS (SELECT row_number() OVER (PARTITION BY cache_key "
    "ORDER BY us, request_id) > 1 AS is_duplicate FROM keyed) "
    "SELECT is_duplicate, count(*) AS n_requests FROM r GROUP BY is_duplicate")


def _sessions(where: str = "true") -> str:
    gap = rules.COUNTER_TTL_SECONDS * 1_000_000
    return (f"WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events WHERE {where}), "
            "m AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us > lag(us) OVER w + "
            f"{gap} THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id, event_type "
            "ORDER BY us)), "
            "s AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY us) AS no FROM m), "
            "lives AS (SELECT user_id, event_type, no, min(us) AS start_us, max(us) AS last_us, "
            "count(*) AS counter_value FROM s GROUP BY user_id, event_type, no)")


SQL["counter_sessions"] = (
    f"{_sessions()} SELECT user_id, event_type, start_us, last_us, counter_value FROM lives")
_AT = I.START_US + 15 * 86_400 * 1_000_000
SQL["counter_values"] = (
    f"{_sessions(f'epoch_us(ts) <= {_AT}')} SELECT user_id, event_type, "
    f"CAST(coalesce(sum(counter_value) FILTER (last_us + {rules.COUNTER_TTL_SECONDS * 1_000_000} "
    f">= {_AT}), 0) AS BIGINT) AS counter_value FROM lives GROUP BY user_id, event_type")
SQL["latency_summary"] = (
    "SELECT count(*) AS n_requests, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, "
    "max(value) AS max_ms FROM events")
SQL["hit_miss_latency"] = (
    f"WITH RECURSIVE {REPLAY}, a AS (SELECT avg(latency_ms) FILTER (cache_hit) AS h, "
    "avg(latency_ms) FILTER (NOT cache_hit) AS m FROM replayed) "
    "SELECT round(h, 6) AS avg_hit_ms, round(m, 6) AS avg_miss_ms, "
    "round((m - h) / m * 100, 6) AS improvement_pct FROM a")
_SHOWN_LIST = ("list_transform(issues, lambda i: CASE WHEN i = "
               f"{q(rules.KEYWORD_ISSUE)} THEN {q(rules.KEYWORD_ISSUE_SHOWN)} ELSE i END)")
SQL["issue_frequency"] = (
    f"WITH {CORPUS}, f AS MATERIALIZED (SELECT {TEXT_ISSUES} AS issues FROM corpus), "
    f"u AS (SELECT unnest({_SHOWN_LIST}) AS issue FROM f) "
    "SELECT issue, count(*) AS n FROM u GROUP BY issue")
SQL["issue_by_lang"] = (
    f"WITH {CORPUS}, f AS MATERIALIZED (SELECT lang, {TEXT_ISSUES} AS issues FROM corpus), "
    f"u AS (SELECT lang, unnest({_SHOWN_LIST}) AS issue FROM f) "
    "SELECT lang, issue, count(*) AS n FROM u GROUP BY lang, issue")

# --------------------------------------------------------------- streaming
SQL["stream_validate"] = SQL["validate_text_high"]
SQL["stream_validate_files"] = SQL["base64_roundtrip_verdict"]
SQL["stream_ttl_replay"] = SQL["ttl_replay"]
SQL["stream_replay_unordered"] = SQL["ttl_replay"]
SQL["stream_counters"] = SQL["counter_sessions"]
SQL["stream_counter_values"] = (
    f"{_sessions()}, now AS (SELECT max(us) AS us FROM e) SELECT user_id, event_type, "
    f"CAST(coalesce(sum(counter_value) FILTER (last_us + {rules.COUNTER_TTL_SECONDS * 1_000_000} "
    ">= now.us), 0) AS BIGINT) AS counter_value FROM lives, now GROUP BY user_id, event_type")
SQL["stream_dedup"] = f"WITH {DOC_REQUESTS} SELECT DISTINCT cache_key FROM keyed"
SQL["stream_upsert"] = (
    f"WITH {DOC_VERDICTS} SELECT cache_key, max(us // 1000000) AS cached_at, "
    "any_value(status) AS status FROM verdicts GROUP BY cache_key")
