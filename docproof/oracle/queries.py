"""The SQL of each query, by the query's name."""

from . import render
from . import evidence_views as ev
from . import page_views  # noqa: F401  (registers its views)
from . import text_views as tv
from ..operators.report import CARD_STAGE, STAGES
from ..operators.risk import LEVELS, SIGNALS
from ..schemas import DOC_TYPES

_SQL: dict[str, str] = {}

_SQL["clean_text"] = "SELECT doc_id, text FROM cleaned"
_SQL["normalise_ws"] = (f"SELECT doc_id, {tv.normalise('text')} AS collapsed, "
                        f"lower({tv.normalise('text')}) AS dedup_key FROM corpus")
_SQL["classify_weighted"] = (
    "SELECT c.doc_id, c.document_type, c.type_confidence, c.is_ambiguous, "
    "CAST(CASE WHEN c.document_type = 'unknown' THEN 7 ELSE 6 END AS INTEGER) AS score_keys, "
    + ", ".join(f"max(CASE WHEN t.type_ord = {i} THEN t.share END) AS score_{t}, "
                f"max(CASE WHEN t.type_ord = {i} THEN t.signals END) AS hits_{t}"
                for i, t in enumerate(DOC_TYPES))
    + " FROM classified c JOIN type_scores t ON c.doc_id = t.doc_id GROUP BY ALL")
_SQL["classify_scores"] = (
    "SELECT doc_id, type_ord, document_type, raw_score, share, signals, "
    "CAST(CASE WHEN signals = '' THEN 0 ELSE len(string_split(signals, ' ; ')) END AS INTEGER) AS hits FROM type_scores")
_SQL["classify_keywords"] = """
SELECT doc_id, CASE WHEN m = 0 THEN 'unknown' """ + " ".join(
    f"WHEN s{i} = m THEN '{t}'" for i, t in enumerate(DOC_TYPES)) + """ END AS keyword_type,
CAST(m AS INTEGER) AS keyword_hits
FROM (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS m FROM keyword_hits) k"""
_SQL["argmax_type"] = "SELECT doc_id, document_type, share FROM best_type"
for _name, _types, _cols in (
    ("parse_id_card", "'aadhaar'", "aadhaar_number, dob, gender, pincode, address, name"),
    ("parse_tax_card", "'pan'", "pan_number, dob, name, father_name"),
    ("parse_passport", "'passport'",
     "passport_number, dob, expiry_date, nationality, mrz_line1, mrz_line2, surname"),
    ("parse_resume", "'resume'", "email, phone, array_to_string(skills, '; ') AS skills, name"),
    ("parse_certificate", "'graduation_certificate', 'marksheet'",
     "year, percentage, roll_number, student_name, institution"),
    ("extract_address", "'aadhaar'", "address"),
):
    _SQL[_name] = f"SELECT doc_id, {_cols} FROM fields WHERE document_type IN ({_types})"


_SQL["extract_name"] = "SELECT doc_id, plain_name AS name FROM names"
_SQL["valid_name"] = (f"SELECT doc_id, ord, {tv.valid_name('text')} AS valid, "
                      f"{tv.valid_name('text', 6, 0.75)} AS plausible FROM page_lines")
_SQL["rank_names"] = f"""
SELECT doc_id, name, candidates FROM (SELECT doc_id, text AS name, count(*) OVER (PARTITION BY doc_id) AS candidates,
  row_number() OVER (PARTITION BY doc_id ORDER BY len({tv.words('text')}) DESC, length(text) DESC, ord) AS rn
  FROM page_lines WHERE {tv.valid_name('text')}) r WHERE rn = 1"""
_SQL["parse_fields"] = "SELECT * EXCLUDE (skills), array_to_string(skills, '; ') AS skills FROM fields"

_SQL["parse_date"] = f"SELECT doc_id, CAST({ev.parse_date('written')} AS VARCHAR) AS parsed FROM dates"
_SQL["normalise_date_digits"] = ("SELECT doc_id, regexp_replace(written, '[^0-9]', '', 'g') AS date_key, "
                                 "regexp_replace(written, '[/\\-\\s]', '', 'g') AS loose_key FROM dates")
_v = ev.verhoeff_parts("c")
_SQL["verhoeff_check"] = (f"SELECT doc_id, {_v['valid']} AS valid, c AS clean_number, {_v['reason']} AS reason, "
                          f"{_v['penalty']} AS penalty FROM (SELECT doc_id, {ev.digits('number')} AS c FROM numbers) n")
_SQL["verhoeff_append"] = (
    f"SELECT doc_id, number, {ev.verhoeff_parts('number')['valid']} AS valid FROM (SELECT doc_id, stem || "
    f"{ev._INVERSE}[{ev.verhoeff_fold('s0')} + 1] AS number FROM (SELECT *, stem || '0' AS s0 FROM numbers) a) b")
_SQL["luhn_check"] = f"SELECT doc_id, {ev.luhn('c')} AS luhn_ok FROM (SELECT doc_id, {ev.digits('number')} AS c FROM numbers) n"
_SQL["mask_id"] = "SELECT doc_id, '****' || right(number, 4) AS masked FROM numbers"
_SQL["token_match"] = (f"SELECT doc_id, {tv.token_match('a', 'b', 0.55)} AS deep, "
                       f"{tv.token_match('a', 'b', 0.6)} AS quick FROM name_pairs")
_sim = tv.trigram_similarity("a.text", "b.text")
_SQL["trigram_similarity"] = (
    f"SELECT doc_id, ord, round_even(s, 6) AS similarity, s >= 0.75 AS near_duplicate FROM (SELECT a.doc_id, a.ord, {_sim} AS s "
    "FROM page_lines a JOIN primary_lines b ON a.doc_id = b.doc_id AND a.ord = b.ord) t")

_SQL["parse_model_json"] = """
SELECT doc_id, reply_error, CAST(j->>'$.vlm_confidence' AS DOUBLE) AS vlm_confidence, j->>'$.overall_assessment' AS overall_assessment,
  CAST(j->>'$.visible_tampering' AS BOOLEAN) AS visible_tampering, CAST(j->>'$.suggested_risk_adjustment' AS INTEGER) AS delta,
  j->>'$.reasoning' AS reasoning, CASE WHEN reply_error IS NULL THEN array_to_string(list_sort(list_filter(json_keys(j), lambda k: k NOT IN (
    'document_type_confirmed', 'vlm_confidence', 'field_validation', 'logical_inconsistencies', 'fraud_signals', 'font_consistency', 'layout_authenticity',
    'seal_signature_present', 'visible_tampering', 'overall_assessment', 'reasoning', 'suggested_risk_adjustment'))), ',') END AS extra_keys FROM reply_json"""
_reply = ("reason AS quarantine_reason, available, vlm_confidence, overall_assessment, layout_authenticity, font_consistency, "
          "visible_tampering, seal_signature_present, reasoning, delta, signals, inconsistencies")
_SQL["coalesce_model_reply"] = f"SELECT doc_id, {_reply} FROM reply_used"
_SQL["attach_model_reply"] = """
SELECT c.doc_id, CASE WHEN r.doc_id IS NULL THEN 'no reply' ELSE reason END AS quarantine_reason, coalesce(available, false) AS available,
  coalesce(vlm_confidence, 0.0) AS vlm_confidence, coalesce(overall_assessment, 'unknown') AS overall_assessment,
  coalesce(layout_authenticity, 'unknown') AS layout_authenticity, coalesce(font_consistency, 'unknown') AS font_consistency,
  coalesce(visible_tampering, false) AS visible_tampering, coalesce(seal_signature_present, false) AS seal_signature_present,
  coalesce(reasoning, 'VLM analysis skipped: no reply') AS reasoning, coalesce(delta, 0) AS delta, coalesce(signals, '') AS signals,
  coalesce(inconsistencies, '') AS inconsistencies FROM corpus c LEFT JOIN reply_used r ON c.doc_id = r.doc_id"""

_SQL["qr_payload_type"] = """
SELECT doc_id, CASE WHEN payload IS NULL OR payload = '' THEN 'not_found'
  WHEN starts_with(trim(payload), '<') AND contains(payload, '>') THEN 'xml'
  WHEN regexp_matches(substr(payload, 1, 50), '\\d') THEN 'text' ELSE 'unknown' END AS kind FROM qr"""
_SQL["decode_qr"] = "SELECT * FROM qr_decoded"
_SQL["parse_qr_xml"] = "SELECT * FROM qr_decoded WHERE qr_type IN ('xml_signed', 'xml_plain')"
_SQL["parse_qr_text"] = "SELECT * FROM qr_decoded WHERE qr_type = 'text_plain'"
_SQL["parse_qr_parts"] = "SELECT * FROM qr_decoded WHERE qr_type = 'secure_v2'"
_SQL["reconcile_qr_ocr"] = "SELECT doc_id, status, penalty, qr_type, matches, mismatches, summary FROM readings_match"
_SQL["correct_from_qr"] = """
SELECT r.doc_id, coalesce(CASE WHEN m.name_ok THEN m.q_name END, r.name, CASE WHEN ok THEN m.q_name END) AS corrected_name,
  coalesce(r.dob, CASE WHEN ok THEN m.q_dob END) AS corrected_dob,
  CASE WHEN r.name IS NULL AND ok THEN m.q_name END AS filled_name, CASE WHEN r.dob IS NULL AND ok THEN m.q_dob END AS filled_dob
FROM readings r JOIN (SELECT *, status IN ('verified', 'partial_match') AS ok FROM readings_match) m ON r.doc_id = m.doc_id"""
_SQL["qr_quick_verdict"] = "SELECT doc_id, qr_quick, quick_name FROM readings_quick"

_bands = "SELECT doc_id, {} FROM " + "(" + ev.VIEWS["signal_bands"].replace("FROM imaged", "FROM signals") + ") b"
_SQL["metadata_verdict"] = _bands.format("metadata")
_SQL["ela_band"] = _bands.format("ela, ela_score")
_SQL["blur_band"] = _bands.format("blur, blur_score")
_SQL["synthetic_vote"] = _bands.format("ai_artifacts")
_SQL["layout_verdict"] = "SELECT doc_id, layout_validation, violations FROM layouts"
_SQL["card_layout_score"] = """
SELECT doc_id, status, penalty, issues, 'Layout ' || status || ': ' || n || ' issue(s), penalty=' || points || '. ' ||
  CASE WHEN issues = '' THEN 'All checks passed.' ELSE issues END AS detail FROM card_layouts"""

_SQL["text_block_filter"] = "SELECT * FROM text_blocks"
_SQL["dispersion_profile"] = ("SELECT doc_id, n, round_even(mean, 9) AS mean, round_even(sd, 9) AS sd, "
                              "round_even(cv, 9) AS cv, outliers, enough FROM profile")
_FONT = "status, variance_ratio, penalty, outliers AS suspicious_blocks, total_text_blocks, high_frequency_anomaly, compression_inconsistency, detail"
_SQL["font_verdict"] = f"SELECT doc_id, {_FONT} FROM fonts"
_SQL["blockiness_flag"] = "SELECT * FROM blockiness"
_SQL["noise_uniformity"] = """
SELECT i.doc_id, i.cells, CASE WHEN o.sd >= 1e-3 THEN round_even(i.c / (o.sd + 1e-9), 9) END AS uniformity
FROM (SELECT doc_id, avg(s) AS c, count(*) AS cells FROM (SELECT doc_id, cell, stddev_pop(residual) AS s FROM tiles GROUP BY doc_id, cell) a GROUP BY doc_id) i
JOIN (SELECT doc_id, stddev_pop(residual) AS sd FROM tiles GROUP BY doc_id) o ON i.doc_id = o.doc_id"""
_SQL["top_blocks"] = """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hf_ratio DESC, y, x, block_id) AS INTEGER) AS rank FROM blocks) b WHERE rank <= 5"""
_SQL["copy_move_pairs"] = "SELECT * FROM copy_pairs"
_SQL["copy_move_verdict"] = ("SELECT doc_id, pairs, CASE WHEN pairs >= 1 THEN 'detected' ELSE 'not_detected' END "
                             "AS duplicate_regions FROM copy_verdicts")

_SQL["scan_boxes"] = ("SELECT doc_id, page_no, CAST(line * 10000 + word AS INTEGER) AS ord, 'second' AS engine, text, confidence, "
                      "x0, y0, x1, y1 FROM tokens")
_SQL["scan_files"] = """
SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines,
  '.txt' AS suffix, false AS any_pdf, 'text/plain' AS mime, 'UnsupportedFileTypeError' AS verdict, CAST(0 AS BIGINT) AS empty FROM documents GROUP BY lang
UNION ALL SELECT 'none', 0, 0, '.txt', false, 'application/x-empty', 'UnsupportedFileTypeError', 1"""
_SQL["pages_to_document"] = "SELECT doc_id, text, round_even(confidence, 9) AS confidence, page_count FROM docs"
_SQL["assign_lines"] = "SELECT doc_id, page_no, line, word, line_no FROM token_lines"
_SQL["merge_tokens"] = "SELECT * FROM merged_lines"
_SQL["fuse_ocr"] = "SELECT doc_id, page_no, ord, text, confidence, engine FROM fused"
_SQL["secondary_only_lines"] = """
SELECT doc_id, page_no, ord, text, confidence, engine FROM fused WHERE confidence >= 0.3 AND text <> ''
UNION ALL
SELECT doc_id, page_no, ord, text, confidence, 'secondary_only' FROM secondary_kept WHERE confidence >= 0.3"""
_SQL["label_regions"] = """
SELECT doc_id, region, page_no, ord, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, region ORDER BY ord DESC) AS rn
  FROM (SELECT *, CASE WHEN contains(lower(text), 'roll') THEN 'roll_number' WHEN contains(lower(text), 'name') THEN 'student_name'
    WHEN contains(lower(text), 'year') THEN 'year' END AS region FROM page_lines) a WHERE region IS NOT NULL) b WHERE rn = 1"""

_SQL["validate_fields"] = "SELECT * FROM checks"
_SQL["validation_report"] = "SELECT * FROM report"
_long = " UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS signal, {s} AS value, CAST("
    + ("CASE WHEN document_type = 'aadhaar' THEN " + ev.points(s, s) + " ELSE 0 END" if s == "qr_validation" else ev.points(s, s))
    + " AS INTEGER) AS points FROM fraud" for s in SIGNALS)
_SQL["penalty_lookup"] = _long
_level = "CASE value " + " ".join(f"WHEN '{v}' THEN '{l}'" for v, l in LEVELS.items()) + " ELSE 'none' END"
_SQL["signal_levels"] = f"SELECT doc_id, signal, value, {_level} AS level FROM ({_long}) l"
_SQL["stream_level_counts"] = f"""
SELECT strftime(TIMESTAMP '2025-01-01' + to_hours((doc_id * 97) % 86400 // 3600), '%Y-%m-%d %H:%M') AS start, signal, level, count(*) AS n
FROM (SELECT doc_id, signal, {_level} AS level FROM ({_long}) l) x GROUP BY ALL"""
_SQL["base_risk"] = "SELECT doc_id, base_score FROM base_scores"
_SQL["card_verification"] = ("SELECT doc_id, verhoeff_valid, verhoeff_reason, total_penalty, risk_level, "
                             "checks_passed, checks_failed, summary FROM cards")
_SQL["final_risk"] = "SELECT doc_id, base_score, risk_score FROM verdicts"
_SQL["status_band"] = "SELECT document_type, status, count(*) AS n FROM verdicts GROUP BY document_type, status"
_ord = "CASE f.document_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(DOC_TYPES)) + " END"
_key = "array_to_string(list_sort(list_distinct(string_split(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), ' '))), ' ')"
_SQL["cross_document_check"] = f"""
WITH RECURSIVE s AS (SELECT u.subject_id, f.doc_id, f.document_type, coalesce(f.name, f.surname, f.student_name) AS name, f.dob, {_ord} AS o
  FROM fields f JOIN subjects u ON f.doc_id = u.doc_id
  WHERE f.document_type <> 'unknown' AND coalesce(f.name, f.surname, f.student_name, f.dob) IS NOT NULL),
n AS (SELECT * FROM s WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY o, doc_id) = 1),
d AS (SELECT * FROM s WHERE dob IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY o, doc_id) = 1),
k AS (SELECT subject_id, count(DISTINCT {_key}) AS subject_names, count(DISTINCT {ev.digits('dob')}) AS subject_dates FROM s GROUP BY subject_id),
m AS (SELECT DISTINCT subject_id, {_key} AS name_key FROM s WHERE name IS NOT NULL),
x AS (SELECT a.subject_id, a.name_key, count(*) FILTER (a.name_key <> b.name_key AND NOT {tv.token_match('a.name_key', 'b.name_key', 0.6)}) AS name_conflicts
  FROM m a JOIN m b ON a.subject_id = b.subject_id GROUP BY ALL),
xs AS (SELECT subject_id, CAST(sum(name_conflicts) // 2 AS BIGINT) AS subject_conflicts FROM x GROUP BY subject_id)
SELECT s.subject_id, s.doc_id, s.document_type, n.doc_id AS name_anchor, d.doc_id AS dob_anchor,
  CASE WHEN s.name IS NOT NULL AND n.doc_id <> s.doc_id THEN {tv.token_match('n.name', 's.name', 0.6)} END AS name_agrees,
  CASE WHEN s.dob IS NOT NULL AND d.doc_id <> s.doc_id THEN {ev.digits('d.dob')} = {ev.digits('s.dob')} END AS dob_agrees,
  k.subject_names, k.subject_dates, x.name_conflicts, coalesce(xs.subject_conflicts, 0) AS subject_conflicts
FROM s JOIN k ON s.subject_id = k.subject_id LEFT JOIN xs ON s.subject_id = xs.subject_id
LEFT JOIN x ON s.subject_id = x.subject_id AND x.name_key = {_key.replace('name', 's.name')} LEFT JOIN n ON s.subject_id = n.subject_id LEFT JOIN d ON s.subject_id = d.subject_id"""

_before = ",".join(STAGES[:STAGES.index(CARD_STAGE)])
_after = ",".join(STAGES[STAGES.index(CARD_STAGE) + 1:])
_SQL["audit_stages"] = (
    f"SELECT doc_id, CASE WHEN document_type = 'aadhaar' THEN '{_before},{CARD_STAGE},{_after}' ELSE '{_before},{_after}' END AS stages, "
    f"CAST(CASE WHEN document_type = 'aadhaar' THEN {len(STAGES)} ELSE {len(STAGES) - 1} END AS INTEGER) AS stage_count FROM classified")
_STAGES = (f"CASE WHEN c.document_type = 'aadhaar' THEN '{_before},{CARD_STAGE},{_after}' ELSE '{_before},{_after}' END AS stages")
_LISTS = "array_to_string(f.skills, '; ') AS skills, CAST(NULL AS VARCHAR) AS education, CAST(NULL AS VARCHAR) AS experience"
_FIELDS = ", ".join(f"f.{n}" for n in (
    "name", "dob", "gender", "aadhaar_number", "address", "pincode", "father_name", "pan_number", "surname", "nationality",
    "passport_number", "expiry_date", "mrz_line1", "mrz_line2", "email", "phone", "student_name", "institution", "year",
    "roll_number", "percentage", "raw_text")) + ", CAST(NULL AS VARCHAR) AS given_names, CAST(NULL AS VARCHAR) AS degree, " + _LISTS
_SCORES = ", ".join(f"t.score_{t}, t.hits_{t}" for t in DOC_TYPES)
_TYPE_SCORES = "SELECT doc_id, " + ", ".join(
    f"max(CASE WHEN type_ord = {i} THEN share END) AS score_{t}, max(CASE WHEN type_ord = {i} THEN signals END) AS hits_{t}"
    for i, t in enumerate(DOC_TYPES)) + " FROM type_scores GROUP BY doc_id"
_SQL["extract_documents"] = f"""
SELECT c.doc_id, c.document_type, c.type_confidence, c.is_ambiguous, d.confidence, d.page_count, {_FIELDS}, {_SCORES}
FROM classified c JOIN fields f ON c.doc_id = f.doc_id JOIN docs_rounded d ON c.doc_id = d.doc_id
JOIN ({_TYPE_SCORES}) t ON c.doc_id = t.doc_id"""
_card = lambda table, name, columns: ", ".join(f"{table}.{c} AS {name}_{c}" for c in columns)
_font = "CASE WHEN c.document_type = 'aadhaar' THEN coalesce(o.{0}, {1}) END AS font_{2}"
_sorted = lambda x, by: f"array_to_string(list_sort(string_split({x}, '{by}')), '{by}')"
_WHOLE = f"""
SELECT v.doc_id, v.document_type, v.ela, v.metadata, v.blur, v.duplicate_regions, v.layout_validation, v.qr_validation, v.ai_artifacts, v.ela_score, v.blur_score,
  v.risk_score, v.status, d.confidence, d.page_count, v.type_confidence, c.is_ambiguous, {_SCORES}, {_FIELDS}, v.reply_available,
  coalesce(z.document_type_confirmed, 'unknown') AS reply_document_type_confirmed, '' AS reply_field_validation,
  {_card('r', 'reply', ('vlm_confidence', 'overall_assessment', 'layout_authenticity', 'font_consistency', 'visible_tampering', 'seal_signature_present', 'reasoning'))},
  r.delta AS reply_suggested_risk_adjustment, r.signals AS reply_signals, r.inconsistencies AS reply_inconsistencies, k.checks,
  p.passed AS validation_passed, p.failed AS validation_failed, v.critical_failures, v.validation_score, v.validation_summary,
  a.verhoeff_valid, a.verhoeff_reason, a.verhoeff_penalty, a.total_penalty AS total_aadhaar_penalty, a.risk_level AS aadhaar_risk_level,
  a.checks_passed, a.checks_failed, a.summary AS card_summary,
  m.qr_type, CASE WHEN m.doc_id IS NOT NULL THEN coalesce(replace(m.fields_found, ',', '; '), '') END AS qr_fields_found, m.status AS qr_cross_validation_status,
  {_sorted('m.matches', ',')} AS qr_matches, m.mismatches AS qr_mismatches, m.penalty AS qr_penalty, m.summary AS qr_summary,
  {', '.join(_font.format(*x) for x in (('status', "'consistent'", 'status'), ('variance_ratio', '0.0', 'variance_ratio'), ('penalty', '0', 'penalty'),
    ('outliers', '0', 'suspicious_blocks'), ('high_frequency_anomaly', 'false', 'high_frequency_anomaly'),
    ('compression_inconsistency', 'false', 'compression_inconsistency'), ('detail', "'Insufficient text blocks for analysis'", 'detail')))},
  l.status AS layout_status, l.issues AS layout_issues, l.penalty AS layout_penalty,
  'Layout ' || l.status || ': ' || l.n || ' issue(s), penalty=' || l.points || '. ' || CASE WHEN l.issues = '' THEN 'All checks passed.' ELSE l.issues END AS layout_detail,
  CASE WHEN f.name IS NULL AND m.status IN ('verified', 'partial_match') THEN m.q_name END AS filled_name,
  CASE WHEN f.dob IS NULL AND m.status IN ('verified', 'partial_match') THEN m.q_dob END AS filled_dob, {_STAGES}, v.base_score, v.quarantine_reason
FROM verdicts v JOIN classified c ON v.doc_id = c.doc_id JOIN fields f ON v.doc_id = f.doc_id JOIN docs_rounded d ON v.doc_id = d.doc_id
JOIN ({_TYPE_SCORES}) t ON v.doc_id = t.doc_id
JOIN ({_SQL['attach_model_reply']}) r ON v.doc_id = r.doc_id LEFT JOIN reply_used z ON v.doc_id = z.doc_id JOIN final_report p ON v.doc_id = p.doc_id
LEFT JOIN (SELECT doc_id, string_agg(field_name || '|' || CAST(passed AS VARCHAR) || '|' || severity || '|' || message, ' ; ' ORDER BY seq) AS checks
  FROM final_checks GROUP BY doc_id) k ON v.doc_id = k.doc_id
LEFT JOIN cards a ON v.doc_id = a.doc_id LEFT JOIN fonts o ON v.doc_id = o.doc_id LEFT JOIN card_match m ON v.doc_id = m.doc_id
LEFT JOIN card_layouts l ON v.doc_id = l.doc_id"""
_SQL["verify_documents"] = _WHOLE
_SQL["analyze_documents"] = f"SELECT w.*, s.human_summary FROM ({_WHOLE}) w JOIN summaries s ON w.doc_id = s.doc_id"
_SQL["human_summary"] = "SELECT doc_id, human_summary FROM summaries"
_SQL["verdict_json"] = f"SELECT * EXCLUDE (base_score, quarantine_reason) FROM ({_WHOLE}) w"
_SQL["risk_by_type"] = """
SELECT document_type, count(*) AS documents, round_even(avg(risk_score), 4) AS mean_risk,
  count(*) FILTER (status = 'Likely Genuine') AS genuine, count(*) FILTER (status = 'Suspicious') AS suspicious,
  count(*) FILTER (status = 'Likely Fake / Tampered') AS fake FROM verdicts GROUP BY document_type"""

_SQL["sink_extracted"] = _SQL["stream_extract"] = _SQL["extract_documents"]
_SQL["sink_verdicts"] = _SQL["stream_verify"] = _SQL["stream_verify_awaiting"] = _SQL["verify_bucketed"] = _WHOLE
_SQL["sink_json"] = f"""
SELECT w.document_type, w.status, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS risk, round_even(sum(confidence), 6) AS confidence,
  CAST(coalesce(sum(k.n), 0) AS BIGINT) AS checks, count(*) FILTER (w.document_type = 'aadhaar') AS cards
FROM ({_WHOLE}) w LEFT JOIN (SELECT doc_id, count(*) AS n FROM final_checks GROUP BY doc_id) k ON w.doc_id = k.doc_id GROUP BY w.document_type, w.status"""
_mime = """CASE doc % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/tiff'
  WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/gif' ELSE 'text/plain' END"""
_SQL["validate_files"] = f"""
SELECT digest, path, suffix, suffix = '.pdf' AS is_pdf, length, mime, verdict,
  CASE verdict WHEN 'FileTooLargeError' THEN 'File ' || chr(39) || substr(path, 4) || chr(39) || ' is ' || printf('%.1f', length / 1048576) || ' MB — limit is 0.00390625 MB.'
    WHEN 'UnsupportedFileTypeError' THEN 'MIME type ' || chr(39) || mime || chr(39) || ' is not supported. Allowed: application/pdf, image/jpeg, image/png, image/tiff, image/webp' END AS message
FROM (SELECT *, CASE WHEN length > 4096 THEN 'FileTooLargeError' WHEN mime IN ('image/gif', 'text/plain') THEN 'UnsupportedFileTypeError' ELSE 'accepted' END AS verdict
  FROM (SELECT sha256(content) AS digest, path, length, {_mime} AS mime,
    CASE WHEN regexp_matches(path, '\\.[^./]+$') THEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) ELSE '.bin' END AS suffix
    FROM (SELECT *, CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) AS doc FROM files) a) b) c"""

ORACLE = {name: render(sql) for name, sql in _SQL.items()}
