"""Views for rules, QR evidence, replies, image signals and risk."""

from ..functions import bands as B
from ..functions import checksum as C
from ..functions import qr as Q
from ..functions.bands import EDITING_TOOLS
from ..operators import layout as L
from ..operators import risk as R
from . import VIEWS
from .text_views import LINE_ENDS, first, if_valid, q, strip, title, token_match, valid_name, words

AS_OF = "DATE '2025-01-01'"

# --- checksums ---------------------------------------------------------------------------
_PRODUCT = "[" + ",".join(map(str, C.PRODUCT)) + "]"
_POWERS = "[" + ",".join(str(x) for row in C.POWERS for x in row) + "]"
_INVERSE = "[" + ",".join(map(str, C.INVERSE)) + "]"


def verhoeff_fold(x: str) -> str:
    permuted = (f"list_transform(range(0, length({x})), lambda i: "
                f"{_POWERS}[(i % 8) * 10 + CAST(substr(reverse({x}), i + 1, 1) AS INTEGER) + 1])")
    return f"list_reduce({permuted}, lambda c, p: {_PRODUCT}[c * 10 + p + 1], 0)"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '\\D', '', 'g')"


def verhoeff_parts(x: str) -> dict:
    passes = f"{verhoeff_fold(x)} = 0"
    short, start = f"length({x}) <> 12", f"substr({x}, 1, 1) IN ('0', '1')"
    return {
        "valid": f"CASE WHEN {short} OR {start} THEN false ELSE {passes} END",
        "reason": f"CASE WHEN {short} THEN 'Aadhaar must be 12 digits, got ' || length({x}) "
                  f"WHEN {start} THEN 'Aadhaar cannot start with ''' || substr({x}, 1, 1) || ''' (UIDAI rule)' "
                  f"WHEN {passes} THEN {q(C.VALID_REASON)} ELSE {q(C.INVALID_REASON)} END",
        "penalty": f"CAST(CASE WHEN {short} OR {start} THEN 25 WHEN {passes} THEN 0 ELSE 30 END AS INTEGER)",
    }


def luhn(x: str) -> str:
    part = (f"list_transform(range(0, length({x})), lambda i: CASE WHEN i % 2 = 0 "
            f"THEN CAST(substr(reverse({x}), i + 1, 1) AS INTEGER) "
            f"ELSE [0,2,4,6,8,1,3,5,7,9][CAST(substr(reverse({x}), i + 1, 1) AS INTEGER) + 1] END)")
    return f"coalesce(list_sum({part}), 0) % 10 = 0"


def parse_date(x: str) -> str:
    s = strip(x)
    return (f"coalesce(CASE WHEN regexp_matches({s}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_strptime({s}, '%d/%m/%Y') END, "
            f"CASE WHEN regexp_matches({s}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') THEN try_strptime({s}, '%d-%m-%Y') END, "
            f"CASE WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN try_strptime({s}, '%Y-%m-%d') END)::DATE")


# --- rules -------------------------------------------------------------------------------

def checks_view(source: str) -> str:
    v = verhoeff_parts("num")
    rows = []

    def rule(types, when, name, passed, message, severity):
        rows.append(
            f"SELECT doc_id, {len(rows)} AS o, {q(name)} AS field_name, coalesce({passed}, false) AS passed, "
            f"{message} AS message, {severity} AS severity FROM f WHERE document_type IN ({types}) AND ({when})")

    ID, TAX, PASS = "'aadhaar'", "'pan'", "'passport'"
    CERT, CV = "'graduation_certificate', 'marksheet'", "'resume'"
    H, M, LO = "'high'", "'medium'", "'low'"
    rule(ID, "num IS NOT NULL", "aadhaar_number_format", "length(num) = 12",
         "'Aadhaar must be 12 digits (got ' || length(num) || ')'", H)
    rule(ID, "num IS NOT NULL", "aadhaar_first_digit", "length(num) >= 1 AND substr(num, 1, 1) NOT IN ('0', '1')",
         "'First digit of Aadhaar cannot be 0 or 1'", H)
    rule(ID, "length(num) = 12", "aadhaar_verhoeff_checksum", v["valid"], v["reason"], H)
    rule(ID, "num IS NULL", "aadhaar_number_present", "false", "'Aadhaar number not found'", H)
    rule(ID, "d IS NOT NULL", "dob_not_future", "d < t",
         "CASE WHEN d >= t THEN 'DOB ' || d || ' is in the future' ELSE 'DOB OK' END", H)
    rule(ID, "d IS NOT NULL", "dob_realistic_age", "age > 0 AND age < 120",
         "'Age computed as ' || age || ' years — ' || CASE WHEN age >= 120 THEN 'suspicious' ELSE 'OK' END", M)
    rule(ID, "d IS NULL", "dob_present", "false", "'DOB not found'", M)
    rule(ID, "true", "name_present", "name IS NOT NULL",
         "CASE WHEN name IS NOT NULL THEN 'Name field extracted' ELSE 'Name not detected' END", M)
    rule(ID, "true", "gender_valid", "lower(coalesce(gender, '')) IN ('male', 'female', 'transgender', '')",
         "CASE WHEN gender IS NULL THEN 'Gender not found' ELSE 'Gender value ''' || lower(gender) || ''' is valid' END", LO)
    rule(ID, "pincode IS NOT NULL", "pincode_valid", "regexp_matches(pincode, '^[1-9]\\d{5}$')",
         "CASE WHEN regexp_matches(pincode, '^[1-9]\\d{5}$') THEN 'Pincode ' || pincode || ' valid' "
         "ELSE 'Invalid pincode: ' || pincode END", LO)
    rule(TAX, "pan_number IS NOT NULL", "pan_format", "regexp_matches(pan_number, '^[A-Z]{5}\\d{4}[A-Z]$')",
         "'PAN format ' || CASE WHEN regexp_matches(pan_number, '^[A-Z]{5}\\d{4}[A-Z]$') THEN 'valid' ELSE 'INVALID' END "
         "|| ': ' || pan_number", H)
    entity = "contains('ABCFGHLJPTK', substr(pan_number, 4, 1))"
    rule(TAX, "pan_number IS NOT NULL", "pan_entity_code", entity,
         f"CASE WHEN {entity} THEN 'PAN 4th char ''' || substr(pan_number, 4, 1) || ''' entity code valid' "
         "ELSE 'Invalid PAN entity code' END", M)
    rule(TAX, "pan_number IS NULL", "pan_number_present", "false", "'PAN number not found'", H)
    rule(TAX, "d IS NOT NULL", "pan_dob_valid", "d < t",
         "CASE WHEN d < t THEN 'DOB is valid' ELSE 'DOB is in the future' END", H)
    rule(TAX, "true", "pan_name_present", "name IS NOT NULL",
         "CASE WHEN name IS NOT NULL THEN 'Name present' ELSE 'Name missing' END", M)
    good = "regexp_matches(passport_number, '^[A-Z]\\d{7}$')"
    rule(PASS, "passport_number IS NOT NULL", "passport_number_format", good,
         f"'Passport number ' || CASE WHEN {good} THEN 'valid' ELSE 'INVALID' END || ': ' || passport_number", H)
    rule(PASS, "passport_number IS NULL", "passport_number_present", "false", "'Passport number missing'", H)
    rule(PASS, "d IS NOT NULL", "passport_dob_past", "d < t",
         "CASE WHEN d < t THEN 'DOB is valid' ELSE 'DOB in future' END", H)
    rule(PASS, "e IS NOT NULL", "passport_not_expired", "e >= t",
         "CASE WHEN e < t THEN 'Passport is expired' ELSE 'Passport valid until ' || e END",
         "CASE WHEN e < t THEN 'high' ELSE 'low' END")
    rule(PASS, "d IS NOT NULL AND e IS NOT NULL", "expiry_after_dob", "e > d",
         "CASE WHEN e > d THEN 'Expiry is after DOB' ELSE 'Expiry date before DOB — impossible' END", H)
    rule(PASS, "true", "mrz_present", "length(mrz_line1) >= 40",
         "CASE WHEN mrz_line1 IS NOT NULL THEN 'MRZ line detected' ELSE 'MRZ line not found' END", M)
    yr = "CAST(year AS INTEGER) BETWEEN 1950 AND year(t)"
    rule(CERT, "year IS NOT NULL", "certificate_year_valid", yr,
         f"'Certificate year ' || year || ' is ' || CASE WHEN {yr} THEN 'valid' ELSE 'suspicious' END", M)
    rule(CERT, "year IS NULL", "certificate_year_present", "false", "'Year not found in certificate'", LO)
    rule(CERT, "pct IS NOT NULL", "percentage_range", "pct BETWEEN 0 AND 100",
         "CASE WHEN pct BETWEEN 0 AND 100 THEN 'Percentage ' || pct || '% in valid range' "
         "ELSE 'Impossible percentage: ' || pct || '%' END", "CASE WHEN pct > 100 THEN 'high' ELSE 'low' END")
    rule(CERT, "true", "institution_present", "institution IS NOT NULL",
         "CASE WHEN institution IS NOT NULL THEN 'Institution name found' ELSE 'Institution name missing' END", M)
    mail = "regexp_matches(email, '(?i)^[\\w.+-]+@[\\w-]+\\.[a-z]{2,}$')"
    rule(CV, "email IS NOT NULL", "email_format", mail,
         f"'Email ' || CASE WHEN {mail} THEN 'valid' ELSE 'invalid' END || ': ' || email", LO)
    rule(CV, "email IS NULL", "email_present", "false", "'No email found in resume'", LO)
    n = f"length({digits('phone')})"
    rule(CV, "phone <> ''", "phone_length", f"{n} BETWEEN 7 AND 15",
         f"'Phone digit count ' || {n} || ': ' || CASE WHEN {n} BETWEEN 7 AND 15 THEN 'OK' ELSE 'suspicious' END", LO)
    rule(CV, "true", "resume_has_skills", "len(skills) > 0",
         "CASE WHEN len(skills) > 0 THEN 'Skills section found' ELSE 'No skills listed' END", LO)
    rule("'unknown'", "true", "doc_type_supported", "false", "'No validation rules for ' || document_type", LO)
    return f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS seq,
  field_name, passed, message, severity
FROM (WITH f AS (SELECT *, {digits('aadhaar_number')} AS num, {parse_date('dob')} AS d,
    {parse_date('expiry_date')} AS e, {AS_OF} AS t,
    CAST(floor(date_diff('day', {parse_date('dob')}, {AS_OF}) / 365) AS BIGINT) AS age,
    CAST(nullif(regexp_extract(percentage, '\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS pct
    FROM {source}) {' UNION ALL '.join(rows)}) r"""


def report_view(source: str) -> str:
    return f"""
SELECT doc_id, passed, failed, critical_failures,
  round_even(passed / (passed + failed), 4) AS validation_score,
  passed || '/' || (passed + failed) || ' checks passed (' || critical_failures || ' critical failure(s))' AS summary
FROM (SELECT doc_id, CAST(count(*) FILTER (passed) AS INTEGER) AS passed,
  CAST(count(*) FILTER (NOT passed) AS INTEGER) AS failed,
  CAST(count(*) FILTER (NOT passed AND severity = 'high') AS INTEGER) AS critical_failures
  FROM {source} GROUP BY doc_id) c"""


VIEWS["checks"] = checks_view("fields")
VIEWS["report"] = report_view("checks")

# --- QR ------------------------------------------------------------------------------------


def _att(n: str) -> str:
    return f"nullif(regexp_extract(src, '\\s{n}=\"([^\"]*)\"', 1), '')"


VIEWS["qr_kinds"] = f"""
SELECT doc_id, payload, inflated,
  CASE WHEN payload IS NULL OR payload = '' THEN 'not_found'
    WHEN length(inflated) > 20 AND contains(inflated, '<') AND contains(inflated, '>') THEN 'inflated_xml'
    WHEN length(inflated) > 20 THEN 'inflated_parts'
    WHEN starts_with(trim(payload), '<') AND contains(payload, '>') THEN 'xml'
    WHEN regexp_matches(substr(payload, 1, 50), '\\d') THEN 'text'
    ELSE 'unknown' END AS kind
FROM qr"""
_addr = "nullif(concat_ws(', ', " + ", ".join(_att(a) for a in Q.ADDRESS_ATTRIBUTES) + "), '')"
VIEWS["qr_xml"] = f"""
SELECT doc_id, good, CASE WHEN good AND {_att('signature')} IS NOT NULL THEN 'xml_signed' ELSE 'xml_plain' END AS qr_type,
  CASE WHEN good THEN coalesce({_att('name')}, {_att('nm')}) END AS name,
  CASE WHEN good THEN coalesce({_att('dob')}, {_att('yob')}) END AS dob,
  CASE WHEN good THEN {_att('dob')} IS NULL AND {_att('yob')} IS NOT NULL END AS year_only,
  CASE WHEN good THEN coalesce({_att('gender')}, {_att('gentype')}) END AS gender,
  CASE WHEN good THEN nullif({digits(_att('uid'))}, '') END AS uid,
  CASE WHEN good THEN {_addr} END AS address,
  CASE WHEN good AND regexp_matches({_att('pc')}, '^\\d{{6}}$') THEN {_att('pc')} END AS pincode,
  CASE WHEN good THEN coalesce({_att('m')}, {_att('mobile_hash')}) END AS mobile_hash,
  good AND regexp_matches(src, '<pht>[^<]') AS has_photo
FROM (SELECT *, regexp_matches(src, '(/>|</\\w+>)$') AS good
  FROM (SELECT *, CASE kind WHEN 'xml' THEN payload ELSE inflated END AS src FROM qr_kinds
        WHERE kind IN ('xml', 'inflated_xml')) a) b"""
_parts = "list_filter(list_transform(string_split_regex(inflated, '[\\x00-\\x1f]+'), lambda p: trim(p)), lambda p: length(p) >= 3)"
VIEWS["qr_parts"] = f"""
SELECT doc_id,
  list_filter(ps, lambda p: regexp_matches(p, {q(Q.PART_DATE)}))[-1] AS dob,
  {digits(f"list_filter(ps, lambda p: length({digits('p')}) = 12)[-1]")} AS uid,
  list_filter(ps, lambda p: regexp_matches(p, {q(Q.PART_NAME)}))[-1] AS name,
  list_filter(ps, lambda p: regexp_matches(p, {q(Q.PART_PINCODE)}))[-1] AS pincode
FROM (SELECT doc_id, {_parts} AS ps FROM qr_kinds WHERE kind = 'inflated_parts') a"""
VIEWS["qr_decoded"] = f"""
SELECT doc_id, qr_type, name, dob, gender,
  CASE WHEN length(uid) = 12 THEN uid END AS uid_full,
  CASE WHEN length(uid) IN (4, 12) THEN right(uid, 4) END AS uid_last4,
  address, pincode, mobile_hash, has_photo,
  CASE WHEN NOT good THEN 'XML parse error' END AS parse_error,
  concat_ws(',', CASE WHEN name IS NOT NULL THEN 'name' END,
    CASE WHEN dob IS NOT NULL AND NOT year_only THEN 'dob' END, CASE WHEN year_only THEN 'dob_year' END,
    CASE WHEN gender IS NOT NULL THEN 'gender' END, CASE WHEN uid IS NOT NULL THEN 'uid' END,
    CASE WHEN address IS NOT NULL THEN 'address' END, CASE WHEN pincode IS NOT NULL THEN 'pincode' END,
    CASE WHEN has_photo THEN 'photo' END, CASE WHEN mobile_hash IS NOT NULL THEN 'mobile_hash' END) AS fields_found
FROM qr_xml
UNION ALL
SELECT doc_id, 'secure_v2', name, dob, NULL, uid, right(uid, 4), NULL, pincode, NULL, false, NULL,
  concat_ws(',', CASE WHEN dob IS NOT NULL THEN 'dob' END, CASE WHEN uid IS NOT NULL THEN 'uid' END,
    CASE WHEN name IS NOT NULL THEN 'name' END, CASE WHEN pincode IS NOT NULL THEN 'pincode' END)
FROM qr_parts
UNION ALL
SELECT doc_id, 'text_plain', NULL, dob, NULL, uid, right(uid, 4), NULL, NULL, NULL, false, NULL,
  concat_ws(',', CASE WHEN uid IS NOT NULL THEN 'uid' END, CASE WHEN dob IS NOT NULL THEN 'dob' END)
FROM (SELECT doc_id, {first('payload', Q.TEXT_UID)} AS uid, {first('payload', Q.TEXT_DATE)} AS dob
  FROM qr_kinds WHERE kind = 'text') t
UNION ALL
SELECT doc_id, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false,
  CASE WHEN kind = 'unknown' THEN 'Unknown QR format — ' || strlen(payload) || ' bytes' END, ''
FROM qr_kinds WHERE kind IN ('unknown', 'not_found')"""


def compare_view(source: str) -> str:
    """Reading table (doc_id, name, dob, aadhaar_number, gender) against qr_decoded."""
    return f"""
SELECT doc_id, status, CAST(CASE status WHEN 'no_qr' THEN 5 WHEN 'decode_error' THEN 8 WHEN 'suspicious' THEN 5
    WHEN 'verified' THEN -5 WHEN 'partial_match' THEN 10 ELSE 30 END AS INTEGER) AS penalty,
  coalesce(qr_type, 'not_found') AS qr_type, matches, mismatches, name_ok, q_name, q_dob, fields_found,
  CASE WHEN status = 'no_qr' THEN 'No QR code found — cannot perform QR cross-validation'
    WHEN status = 'decode_error' THEN 'QR decode error: ' || parse_error
    WHEN fields_found = '' THEN 'QR found but no Aadhaar fields extracted — suspicious structure'
    WHEN status = 'suspicious' THEN 'QR decoded but no comparable fields found in OCR'
    WHEN status = 'verified' THEN 'QR VERIFIED — ' || hits || '/' || hits || ' fields match (type: ' || qr_type || ')'
    WHEN status = 'mismatch' THEN 'QR MISMATCH — ' || misses || ' field(s) differ: ' || mismatches
    ELSE 'QR PARTIAL — ' || hits || ' match, ' || misses || ' mismatch: ' || mismatches END AS summary
FROM (SELECT *, CASE WHEN qr_type IS NULL OR qr_type = 'not_found' THEN 'no_qr'
    WHEN parse_error IS NOT NULL AND fields_found = '' THEN 'decode_error'
    WHEN fields_found = '' OR hits + misses = 0 THEN 'suspicious'
    WHEN misses = 0 THEN 'verified' WHEN misses >= 2 THEN 'mismatch' ELSE 'partial_match' END AS status
  FROM (SELECT *,
    coalesce(name_ok, false)::INT + coalesce(dob_ok, false)::INT + coalesce(uid_ok, last_ok, false)::INT
      + coalesce(gender_ok, false)::INT AS hits,
    coalesce(NOT name_ok, false)::INT + coalesce(NOT dob_ok, false)::INT + coalesce(NOT uid_ok, NOT last_ok, false)::INT AS misses,
    concat_ws(',', CASE WHEN name_ok THEN 'name' END, CASE WHEN dob_ok THEN 'dob' END,
      CASE WHEN uid_ok THEN 'aadhaar_number' END, CASE WHEN last_ok THEN 'aadhaar_last4' END,
      CASE WHEN gender_ok THEN 'gender' END) AS matches,
    concat_ws('; ', CASE WHEN NOT name_ok THEN 'name: QR=''' || q_name || ''' vs OCR=''' || name || '''' END,
      CASE WHEN NOT dob_ok THEN 'dob: QR=''' || q_dob || ''' vs OCR=''' || dob || '''' END,
      CASE WHEN NOT uid_ok THEN 'aadhaar_number: last4 QR=''' || uid_last4 || ''' vs OCR=''' || right(uid, 4) || '''' END,
      CASE WHEN NOT last_ok THEN 'aadhaar last4: QR=''' || uid_last4 || ''' vs OCR=''' || right(uid, 4) || '''' END) AS mismatches
    FROM (SELECT o.doc_id, o.name, o.dob, o.uid, d.qr_type, d.parse_error, d.fields_found, d.uid_last4,
      d.name AS q_name, d.dob AS q_dob,
      CASE WHEN d.name IS NOT NULL AND o.name IS NOT NULL THEN {token_match('d.name', 'o.name', 0.55)} END AS name_ok,
      CASE WHEN d.dob IS NOT NULL AND o.dob IS NOT NULL THEN {digits('d.dob')} = {digits('o.dob')}
        OR (regexp_matches(substr(d.dob, 1, 4), '^\\d{{4}}$') AND substr(d.dob, 1, 4) = substr(o.dob, 1, 4)) END AS dob_ok,
      CASE WHEN d.uid_full IS NOT NULL AND o.uid IS NOT NULL THEN d.uid_full = o.uid END AS uid_ok,
      CASE WHEN d.uid_full IS NULL AND d.uid_last4 IS NOT NULL AND length(o.uid) >= 4 THEN d.uid_last4 = right(o.uid, 4) END AS last_ok,
      CASE WHEN d.gender IS NOT NULL AND o.gender IS NOT NULL THEN upper(substr(d.gender, 1, 1)) = upper(substr(o.gender, 1, 1)) END AS gender_ok
      FROM (SELECT doc_id, name, dob, gender, nullif({digits('aadhaar_number')}, '') AS uid FROM {source}) o
      LEFT JOIN qr_decoded d ON o.doc_id = d.doc_id) a) b) c"""


def quick_view(source: str) -> str:
    common = f"len(list_intersect({words('lower(qn)')}, {words('lower(name)')})) > 0"
    key = lambda x: f"regexp_replace({x}, '[/\\-\\s]', '', 'g')"
    return f"""
SELECT doc_id, CASE WHEN qn IS NULL AND qd IS NULL THEN 'not_found'
    WHEN coalesce({key('qd')} = {key('dob')}, true) THEN 'verified' ELSE 'mismatch' END AS qr_quick,
  CASE WHEN qn IS NOT NULL AND NOT coalesce({valid_name('name', 6, 0.75)}
    AND ({token_match('qn', 'name', 0.6)} OR {common}), false) THEN qn ELSE name END AS quick_name
FROM (SELECT o.doc_id, o.name, o.dob, CASE WHEN k.kind = 'xml' THEN d.name END AS qn,
    CASE WHEN k.kind = 'xml' THEN d.dob END AS qd
  FROM {source} o LEFT JOIN qr_decoded d ON o.doc_id = d.doc_id LEFT JOIN qr_kinds k ON o.doc_id = k.doc_id) a"""


VIEWS["readings_match"] = compare_view("readings")
VIEWS["readings_quick"] = quick_view("readings")
VIEWS["card_fields"] = "SELECT * FROM fields WHERE document_type = 'aadhaar'"
VIEWS["card_match"] = compare_view("card_fields")
VIEWS["card_quick"] = quick_view("card_fields")

# --- replies -------------------------------------------------------------------------------
VIEWS["reply_texts"] = f"""
SELECT doc_id, CASE WHEN part_1 IS NOT NULL THEN trim(part_1 || ' ' || part_2)
  ELSE {strip("coalesce(nullif(content, ''), nullif(reasoning, ''), nullif(reasoning_content, ''))")} END AS t
FROM replies"""
VIEWS["reply_json"] = """
SELECT doc_id, t, CASE WHEN t IS NULL THEN 'empty' WHEN j = '' THEN 'no JSON' WHEN NOT json_valid(j) THEN 'bad JSON' END AS reply_error,
  CASE WHEN json_valid(j) THEN j::JSON END AS j
FROM (SELECT doc_id, t, CASE WHEN t = '' THEN '{}' ELSE regexp_replace(regexp_extract(
    regexp_replace(regexp_replace(t, '(?i)```json', '', 'g'), '```', '', 'g'), '(?s)\\{.*\\}'), ',(\\s*[}\\]])', '\\1', 'g') END AS j
  FROM reply_texts) a"""
VIEWS["reply_used"] = """
SELECT doc_id, reason, reason IS NULL AS available,
  coalesce(CASE WHEN reason IS NULL THEN conf END, 0.0) AS vlm_confidence,
  coalesce(CASE WHEN reason IS NULL THEN j->>'$.document_type_confirmed' END, 'unknown') AS document_type_confirmed,
  coalesce(CASE WHEN reason IS NULL THEN j->>'$.overall_assessment' END, 'unknown') AS overall_assessment,
  coalesce(CASE WHEN reason IS NULL THEN j->>'$.layout_authenticity' END, 'unknown') AS layout_authenticity,
  coalesce(CASE WHEN reason IS NULL THEN j->>'$.font_consistency' END, 'unknown') AS font_consistency,
  coalesce(CASE WHEN reason IS NULL THEN (j->>'$.visible_tampering') = 'true' END, false) AS visible_tampering,
  coalesce(CASE WHEN reason IS NULL THEN (j->>'$.seal_signature_present') = 'true' END, false) AS seal_signature_present,
  CASE WHEN reason IS NULL THEN coalesce(j->>'$.reasoning', '') ELSE 'VLM analysis skipped: ' || reason END AS reasoning,
  CAST(coalesce(CASE WHEN reason IS NULL THEN delta END, 0) AS INTEGER) AS delta,
  CASE WHEN reason IS NULL THEN array_to_string(list_transform(CAST(j->'$.fraud_signals' AS JSON[]),
    lambda s: (s->>'$.signal') || '/' || (s->>'$.severity')), ';') ELSE '' END AS signals,
  CASE WHEN reason IS NULL THEN array_to_string(list_transform(list_filter(CAST(j->'$.fraud_signals' AS JSON[]),
    lambda s: (s->>'$.severity') = 'high'), lambda s: s->>'$.signal'), '; ') ELSE '' END AS high_signals,
  CASE WHEN reason IS NULL THEN coalesce(array_to_string(CAST(j->'$.logical_inconsistencies' AS VARCHAR[]), '; '), '') ELSE '' END AS inconsistencies
FROM (SELECT *, coalesce(reply_error, CASE WHEN delta NOT BETWEEN -20 AND 40 THEN 'risk adjustment out of range' END,
    CASE WHEN conf NOT BETWEEN 0 AND 1 THEN 'confidence out of range' END) AS reason
  FROM (SELECT *, CAST(j->>'$.suggested_risk_adjustment' AS INTEGER) AS delta, CAST(j->>'$.vlm_confidence' AS DOUBLE) AS conf
    FROM reply_json) a) b"""

# --- image signals --------------------------------------------------------------------------
VIEWS["signal_bands"] = f"""
SELECT doc_id,
  CASE WHEN ela_score >= {B.ELA_TAMPERED} THEN 'tampered' WHEN ela_score >= {B.ELA_SUSPICIOUS} OR ela_score IS NULL THEN 'suspicious' ELSE 'clean' END AS ela,
  coalesce(round_even(ela_score, 2), 50.0) AS ela_score,
  CASE WHEN blur_score < 80 THEN 'blurry' WHEN blur_score < 200 OR blur_score IS NULL THEN 'slightly_blurry' ELSE 'sharp' END AS blur,
  coalesce(round_even(blur_score, 2), 0.0) AS blur_score,
  CASE WHEN lower(suffix) = '.pdf' THEN 'missing' WHEN exif_state = 'absent' THEN 'missing'
    WHEN exif_state IS NULL OR exif_state <> 'present' THEN 'suspicious'
    WHEN {' OR '.join(f"contains(lower(software), {q(t)})" for t in EDITING_TOOLS)} THEN 'suspicious'
    WHEN datetime <> '' AND datetime_original <> '' AND datetime <> datetime_original THEN 'suspicious' ELSE 'normal' END AS metadata,
  CASE WHEN coalesce(dct_mid_ratio > 0.35, false)::INT + coalesce(noise_uniformity > 0.92, false)::INT
    + coalesce(edge_density < 0.02 OR edge_density > 0.40, false)::INT >= 2 THEN 'suspected' ELSE 'not_detected' END AS ai_artifacts
FROM imaged"""
# Every document with its measured values, or NULLs where none were measured.
VIEWS["imaged"] = "SELECT c.doc_id, s.* EXCLUDE (doc_id) FROM corpus c LEFT JOIN signals s ON c.doc_id = s.doc_id"

_kw = " ".join(
    "WHEN '" + t + "' THEN " + " + ".join(f"contains(lower(text), '{k}')::INT" for k in s[0]) for t, s in L.SPECS.items())


def _spec(i: int) -> str:
    return ("(CASE document_type " + " ".join(f"WHEN '{t}' THEN {s[i]}" for t, s in L.SPECS.items())
            + f" ELSE {L.DEFAULT_SPEC[i]} END)")


def _spec_text(i: int) -> str:
    return ("(CASE document_type " + " ".join(f"WHEN '{t}' THEN '{s[i]}'" for t, s in L.SPECS.items())
            + f" ELSE '{L.DEFAULT_SPEC[i]}' END)")


VIEWS["layouts"] = f"""
SELECT doc_id, violations, CASE WHEN document_type = 'unknown' THEN 'unknown'
  WHEN violations <> '' THEN 'invalid' ELSE 'valid' END AS layout_validation
FROM (SELECT doc_id, document_type, concat_ws('; ',
    CASE WHEN hits < 2 THEN 'keyword_hits=' || hits || ' (expected ≥2)' END,
    CASE WHEN lines < {_spec(1)} THEN 'text_lines=' || lines || ' (expected ≥' || {_spec(1)} || ')' END,
    CASE WHEN ar NOT BETWEEN {_spec(2)} AND {_spec(3)} THEN 'aspect_ratio=' || printf('%.2f', ar) ||
      ' (expected ' || {_spec_text(2)} || '–' || {_spec_text(3)} || ')' END) AS violations
  FROM (SELECT c.doc_id, c.document_type,
    CASE c.document_type {_kw} ELSE 0 END AS hits,
    len(list_filter(string_split_regex(c.text, {q(LINE_ENDS)}), lambda ln: {strip('ln')} <> '')) AS lines,
    CASE WHEN s.height > 0 THEN s.width / s.height WHEN s.width IS NOT NULL AND s.height IS NOT NULL THEN 1.0 END AS ar
    FROM classified c JOIN imaged s ON c.doc_id = s.doc_id) a) b"""

_missing = ("list_filter([" + ", ".join(q(s) for s in L.CARD_SIGNALS) + "], lambda s: NOT contains(lo, s))")
_R = repr(L.CARD_RATIO)
VIEWS["card_layouts"] = f"""
SELECT doc_id, CASE WHEN issues = '' THEN 'valid' WHEN points <= 8 THEN 'suspicious' ELSE 'invalid' END AS status,
  CAST(least(points, 20) AS INTEGER) AS penalty, issues,
  CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, '; ')) END AS n, points
FROM (SELECT doc_id,
  (CASE WHEN off > {L.CARD_TOLERANCE} THEN 5 ELSE 0 END) + (CASE len(missing) WHEN 4 THEN 8 WHEN 3 THEN 3 ELSE 0 END)
  + (CASE WHEN unreadable THEN 4 ELSE 0 END) + (CASE WHEN hindi THEN 0 ELSE 2 END)
  + (CASE WHEN brightness < 40 THEN 3 WHEN saturation > 180 THEN 5 ELSE 0 END)
  + (CASE WHEN coalesce(qr_region_found, false) THEN 0 ELSE 2 END) + (CASE WHEN photo_found = false THEN 3 ELSE 0 END) AS points,
  concat_ws('; ',
    CASE WHEN off > {L.CARD_TOLERANCE} THEN 'Aspect ratio ' || printf('%.2f', ar) || ' deviates from standard 1.59 by ' || printf('%.1f', off * 100) || '%' END,
    CASE len(missing) WHEN 4 THEN 'Missing critical Aadhaar text signals: [''' || array_to_string(missing, ''', ''') || ''']'
      WHEN 3 THEN 'Some Aadhaar text signals absent: [''' || array_to_string(missing, ''', ''') || ''']' END,
    CASE WHEN unreadable THEN 'Aadhaar number not found or incorrectly formatted' END,
    CASE WHEN NOT hindi THEN 'Devanagari (Hindi) script not detected' END,
    CASE WHEN brightness < 40 THEN 'Image very dark (brightness=' || printf('%.0f', brightness) || ') — possible heavily degraded scan'
      WHEN saturation > 180 THEN 'Unusually high saturation (' || printf('%.0f', saturation) || ') — possible AI-generated/printed fake' END,
    CASE WHEN NOT coalesce(qr_region_found, false) THEN 'QR code region not detected visually' END,
    CASE WHEN photo_found = false THEN 'Biometric photo region not detected' END) AS issues
  FROM (SELECT *, {_missing} AS missing, abs(ar - {_R}) / {_R} AS off, regexp_matches(lo, '[ऀ-ॿ]') AS hindi,
      aadhaar_number IS NULL AND NOT regexp_matches(lo, '\\b\\d{{4}}\\s+\\d{{4}}\\s+\\d{{4}}\\b') AND NOT regexp_matches(lo, '\\d{{12}}') AS unreadable
    FROM (SELECT f.doc_id, f.aadhaar_number, lower(f.raw_text) AS lo, s.brightness, s.saturation, s.qr_region_found, s.photo_found,
      CASE WHEN s.width > 0 AND s.height > 0 THEN s.width / s.height END AS ar
      FROM card_fields f JOIN imaged s ON f.doc_id = s.doc_id) a) b) c"""

# --- statistics -----------------------------------------------------------------------------
VIEWS["profile"] = """
SELECT s.doc_id, n, CASE WHEN n >= 5 THEN mean END AS mean, CASE WHEN n >= 5 THEN sd END AS sd,
  CASE WHEN n >= 5 THEN sd / (mean + 1e-6) END AS cv,
  CAST(CASE WHEN n >= 5 THEN (SELECT count(*) FROM text_blocks b WHERE b.doc_id = s.doc_id AND b.hf_ratio > mean + 2 * sd) ELSE 0 END AS BIGINT) AS outliers,
  n >= 5 AS enough
FROM (SELECT doc_id, count(hf_ratio) AS n, avg(hf_ratio) AS mean, stddev_pop(hf_ratio) AS sd FROM text_blocks GROUP BY doc_id) s"""
VIEWS["text_blocks"] = "SELECT * FROM blocks WHERE text_density >= 0.05"
VIEWS["blockiness"] = """
SELECT doc_id, count(blockiness) AS tiles, CASE WHEN count(blockiness) < 4 THEN false
  ELSE stddev_pop(blockiness) / (avg(blockiness) + 1e-6) > 1.2 END AS compression_inconsistency
FROM tiles GROUP BY doc_id"""
VIEWS["edge_cv"] = "SELECT doc_id, stddev_pop(sharpness) / (avg(sharpness) + 1e-6) AS cv_edge FROM tiles GROUP BY doc_id"
VIEWS["fonts"] = """
SELECT *, CASE WHEN NOT enough THEN 'Insufficient text blocks for analysis'
  WHEN status = 'inconsistent' THEN 'Font inconsistency DETECTED — variance_ratio=' || printf('%.3f', variance_ratio) || ', suspicious_blocks=' || outliers || '/' || total_text_blocks
    || ', hf_anomaly=' || CASE WHEN high_frequency_anomaly THEN 'True' ELSE 'False' END || ', compression_inconsistency=' || CASE WHEN compression_inconsistency THEN 'True' ELSE 'False' END
  WHEN status = 'suspicious' THEN 'Font rendering suspicious — variance_ratio=' || printf('%.3f', variance_ratio) || ', suspicious_blocks=' || outliers || '/' || total_text_blocks
  ELSE 'Font rendering consistent — variance_ratio=' || printf('%.3f', variance_ratio) END AS detail
FROM (SELECT doc_id, outliers, enough, CAST(CASE WHEN enough THEN n ELSE 0 END AS BIGINT) AS total_text_blocks,
  enough AND coalesce(cv_edge > 0.8, false) AS high_frequency_anomaly, enough AND coalesce(uneven, false) AS compression_inconsistency,
  CASE WHEN NOT enough THEN 'consistent' WHEN ratio + bonus >= 0.45 THEN 'inconsistent' WHEN ratio + bonus >= 0.25 THEN 'suspicious' ELSE 'consistent' END AS status,
  CASE WHEN enough THEN ratio ELSE 0.0 END AS variance_ratio,
  CAST(CASE WHEN NOT enough THEN 0 WHEN ratio + bonus >= 0.45 THEN 20 WHEN ratio + bonus >= 0.25 THEN 10 ELSE 0 END AS INTEGER) AS penalty
FROM (SELECT p.doc_id, p.outliers, p.enough, p.n, e.cv_edge, b.compression_inconsistency AS uneven, round_even(least(1.0, p.cv * 0.6 + coalesce(e.cv_edge, 0) * 0.4), 4) AS ratio,
  (CASE WHEN e.cv_edge > 0.8 THEN 0.15 ELSE 0.0 END)::DOUBLE + (CASE WHEN b.compression_inconsistency THEN 0.10 ELSE 0.0 END)::DOUBLE AS bonus
  FROM profile p LEFT JOIN edge_cv e ON p.doc_id = e.doc_id LEFT JOIN blockiness b ON p.doc_id = b.doc_id) a) g"""
VIEWS["distances"] = """
SELECT a.doc_id, a.kp_id, b.kp_id AS other, CAST(list_sum(list_transform(range(1, 5), lambda w: bit_count(xor(a.bits[w], b.bits[w])))) AS INTEGER) AS d,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS apart,
  row_number() OVER (PARTITION BY a.doc_id, a.kp_id ORDER BY list_sum(list_transform(range(1, 5), lambda w: bit_count(xor(a.bits[w], b.bits[w])))), b.kp_id) AS rn
FROM descriptors a JOIN descriptors b ON a.doc_id = b.doc_id AND a.kp_id <> b.kp_id"""
VIEWS["copy_pairs"] = """
SELECT n.doc_id, n.kp_id, n.other AS nearest_kp, n.d AS d1, m.d AS d2
FROM distances n JOIN distances m ON n.doc_id = m.doc_id AND n.kp_id = m.kp_id AND n.rn = 1 AND m.rn = 2
WHERE n.d <= 40 AND m.d > 0 AND n.d / m.d <= 0.75 AND n.apart > 50"""
VIEWS["copy_verdicts"] = """
SELECT d.doc_id, count(p.kp_id) AS pairs, CASE WHEN count(p.kp_id) >= 10 THEN 'detected' ELSE 'not_detected' END AS duplicate_regions
FROM (SELECT DISTINCT doc_id FROM descriptors) d LEFT JOIN copy_pairs p ON d.doc_id = p.doc_id GROUP BY d.doc_id"""

# --- verdicts --------------------------------------------------------------------------------
VIEWS["cards"] = f"""
SELECT *, 'Aadhaar verification: ' || checks_passed || '/' || (checks_passed + checks_failed) || ' checks passed | penalty=' || total_penalty
  || ' | risk=' || risk_level || ' | verhoeff=' || CASE WHEN verhoeff_valid THEN 'True' ELSE 'False' END
  || ' | qr=' || qr_status || ' | font=' || font_status || ' | layout=' || layout_status AS summary
FROM (SELECT *, CASE WHEN total_penalty <= 5 THEN 'low' WHEN total_penalty <= 20 THEN 'medium'
    WHEN total_penalty <= 40 THEN 'high' ELSE 'critical' END AS risk_level,
  verhoeff_valid::INT + (qr_status = 'verified')::INT + (font_status = 'consistent')::INT + (layout_status = 'valid')::INT AS checks_passed,
  (NOT verhoeff_valid)::INT + (qr_status = 'mismatch')::INT + (font_status = 'inconsistent')::INT + (layout_status = 'invalid')::INT AS checks_failed
  FROM (SELECT f.doc_id, coalesce({verhoeff_parts('f.aadhaar_number')['valid']}, false) AS verhoeff_valid,
    CASE WHEN f.aadhaar_number IS NULL THEN 'Aadhaar number not found in OCR' ELSE {verhoeff_parts('f.aadhaar_number')['reason']} END AS verhoeff_reason,
    CAST(CASE WHEN f.aadhaar_number IS NULL THEN 15 ELSE {verhoeff_parts('f.aadhaar_number')['penalty']} END AS INTEGER) AS verhoeff_penalty,
    m.status AS qr_status, coalesce(o.status, 'consistent') AS font_status, l.status AS layout_status,
    CAST(greatest(-5, least(100, CASE WHEN f.aadhaar_number IS NULL THEN 15 ELSE {verhoeff_parts('f.aadhaar_number')['penalty']} END
      + m.penalty + coalesce(o.penalty, 0) + l.penalty)) AS INTEGER) AS total_penalty
    FROM card_fields f JOIN card_match m ON f.doc_id = m.doc_id JOIN card_layouts l ON f.doc_id = l.doc_id
    LEFT JOIN fonts o ON f.doc_id = o.doc_id) a) b"""
VIEWS["completed_fields"] = """
SELECT f.* REPLACE (
  CASE WHEN f.document_type = 'aadhaar' THEN coalesce(k.quick_name,
    CASE WHEN m.name_ok THEN m.q_name END, f.name, CASE WHEN m.status IN ('verified', 'partial_match') THEN m.q_name END) ELSE f.name END AS name,
  CASE WHEN f.document_type = 'aadhaar' THEN coalesce(f.dob, CASE WHEN m.status IN ('verified', 'partial_match') THEN m.q_dob END) ELSE f.dob END AS dob)
FROM fields f LEFT JOIN card_match m ON f.doc_id = m.doc_id LEFT JOIN card_quick k ON f.doc_id = k.doc_id"""
VIEWS["final_checks"] = checks_view("completed_fields")
VIEWS["final_report"] = report_view("final_checks")


def points(signal: str, column: str) -> str:
    return ("(CASE " + column + " " + " ".join(f"WHEN '{v}' THEN {p}" for v, p in R.POINTS[signal].items()) + " ELSE 0 END)")


VIEWS["fraud"] = """
SELECT c.doc_id, c.document_type, c.type_confidence, b.ela, b.ela_score, b.blur, b.blur_score, b.metadata, b.ai_artifacts,
  coalesce(v.duplicate_regions, 'not_detected') AS duplicate_regions, l.layout_validation,
  CASE WHEN c.document_type <> 'aadhaar' THEN 'not_found' WHEN m.status IN ('verified', 'mismatch') THEN m.status ELSE k.qr_quick END AS qr_validation
FROM classified c JOIN signal_bands b ON c.doc_id = b.doc_id JOIN layouts l ON c.doc_id = l.doc_id
LEFT JOIN copy_verdicts v ON c.doc_id = v.doc_id
LEFT JOIN card_match m ON c.doc_id = m.doc_id LEFT JOIN card_quick k ON c.doc_id = k.doc_id"""
VIEWS["base_scores"] = f"""
SELECT *, CAST(greatest(0, least(100, {' + '.join(points(s, s) for s in R.POINTS if s != 'qr_validation')}
  + CASE WHEN document_type = 'aadhaar' THEN {points('qr_validation', 'qr_validation')} ELSE 0 END
  + CAST(trunc(ela_score * 0.1) AS INTEGER))) AS INTEGER) AS base_score
FROM fraud"""
VIEWS["verdicts"] = """
SELECT *, CASE WHEN risk_score < 30 THEN 'Likely Genuine' WHEN risk_score < 60 THEN 'Suspicious' ELSE 'Likely Fake / Tampered' END AS status
FROM (SELECT s.*, coalesce(a.available, false) AS reply_available, coalesce(a.reason, CASE WHEN a.doc_id IS NULL THEN 'no reply' END) AS quarantine_reason,
  c.total_penalty AS card_penalty, r.critical_failures, r.validation_score, r.summary AS validation_summary,
  CAST(least(100, greatest(0, least(100, CASE WHEN a.available THEN greatest(0, least(100, s.base_score + a.delta
    + CASE WHEN a.visible_tampering THEN 15 ELSE 0 END)) ELSE s.base_score END + coalesce(c.total_penalty, 0)))
    + r.critical_failures * 8) AS INTEGER) AS risk_score
  FROM base_scores s LEFT JOIN reply_used a ON s.doc_id = a.doc_id LEFT JOIN cards c ON s.doc_id = c.doc_id
  JOIN final_report r ON s.doc_id = r.doc_id) x"""
VIEWS["summaries"] = f"""
SELECT v.doc_id, concat_ws(chr(10),
  'Document Type: ' || {title("replace(v.document_type, '_', ' ')")},
  'Verification Status: ' || v.status,
  'Risk Score: ' || v.risk_score || '/100',
  'OCR Confidence: ' || printf('%.0f', d.confidence * 100) || '%',
  'VLM Assessment: ' || {title("coalesce(a.overall_assessment, 'unknown')")} || ' — ' || coalesce(a.reasoning, 'VLM analysis skipped: no reply'),
  'Layout Authenticity: ' || {title("replace(coalesce(a.layout_authenticity, 'unknown'), '_', ' ')")},
  'Font Consistency: ' || {title("replace(coalesce(a.font_consistency, 'unknown'), '_', ' ')")},
  'Visible Tampering Detected: ' || CASE WHEN a.visible_tampering THEN 'Yes ⚠️' ELSE 'No ✓' END,
  'Seal/Signature Present: ' || CASE WHEN a.seal_signature_present THEN 'Yes ✓' ELSE 'Not detected' END,
  'Validation: ' || v.validation_summary,
  CASE WHEN a.high_signals <> '' THEN 'High-Severity Fraud Signals: ' || a.high_signals END,
  CASE WHEN f.msgs IS NOT NULL THEN 'Critical Field Issues: ' || f.msgs END,
  CASE WHEN a.inconsistencies <> '' THEN 'Logical Inconsistencies: ' || a.inconsistencies END) AS human_summary
FROM verdicts v JOIN docs_rounded d ON v.doc_id = d.doc_id LEFT JOIN reply_used a ON v.doc_id = a.doc_id
LEFT JOIN (SELECT doc_id, string_agg(message, '; ' ORDER BY seq) AS msgs FROM final_checks
  WHERE NOT passed AND severity = 'high' GROUP BY doc_id) f ON v.doc_id = f.doc_id"""
VIEWS["docs_rounded"] = "SELECT doc_id, CAST(printf('%.4f', confidence) AS DOUBLE) AS confidence, page_count FROM docs"
