"""Views for documents, classification and field extraction."""

from ..functions import parse as P
from ..functions.text import WHITESPACE
from ..operators.classify import KEYWORDS, MIN_CONFIDENCE, WEIGHTED
from ..schemas import DOC_TYPES
from . import VIEWS

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE)})"


def clean(x: str) -> str:
    x = f"replace({x}, chr(10) || chr(10), chr(10))"
    x = f"replace(replace(replace({x}, '0l', '01'), 'O', '0'), '|', '1')"
    return strip(f"regexp_replace({x}, ' {{2,}}', ' ', 'g')")


def normalise(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            "lambda p: upper(p[1:1]) || lower(p[2:])), '')")


def first(x: str, pattern: str, flags: str = "", group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(flags + pattern)}, {group}), '')"


def valid_name(x: str, max_words: int = 5, min_alpha: float = 0.8) -> str:
    return (f"coalesce(length({x}) >= 4 AND len({words(x)}) BETWEEN 2 AND {max_words} "
            f"AND len(list_filter({words(x)}, lambda w: length(w) < 2 OR "
            f"length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) / length(w) < {min_alpha})) = 0 "
            f"AND NOT regexp_matches({x}, '\\d'), false)")


def if_valid(x: str) -> str:
    return f"CASE WHEN {valid_name(x)} THEN {x} END"


def token_match(a: str, b: str, t: float) -> str:
    ta, tb = f"list_distinct({words(f'lower({a})')})", f"list_distinct({words(f'lower({b})')})"
    inter = f"len(list_intersect({ta}, {tb}))"
    union = f"len(list_distinct(list_concat({ta}, {tb})))"
    small = f"least(len({ta}), len({tb}))"
    return (f"coalesce(CASE WHEN {small} = 0 THEN false ELSE {inter} / {union} >= {t} "
            f"OR {inter} = {small} END, false)")


def trigrams(x: str) -> str:
    return (f"(CASE WHEN length({x}) < 3 THEN [{x}] ELSE "
            f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END)")


def trigram_similarity(a: str, b: str) -> str:
    ta, tb = trigrams(a), trigrams(b)
    return (f"CASE WHEN {a} <> '' AND {b} <> '' THEN len(list_intersect({ta}, {tb})) / "
            f"len(list_distinct(list_concat({ta}, {tb}))) ELSE 0.0 END")


VIEWS["page_means"] = """
SELECT doc_id, page_no, list_reduce(list(confidence ORDER BY ord), lambda a, b: a + b) / count(*) AS c
FROM page_lines GROUP BY doc_id, page_no"""
VIEWS["docs"] = """
SELECT t.doc_id, t.text, m.confidence, m.page_count
FROM (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no, ord) AS text FROM page_lines GROUP BY doc_id) t
JOIN (SELECT doc_id, list_reduce(list(c ORDER BY page_no), lambda a, b: a + b) / count(*) AS confidence,
  count(*) AS page_count FROM page_means GROUP BY doc_id) m
ON t.doc_id = m.doc_id"""
VIEWS["cleaned"] = f"SELECT doc_id, {clean('text')} AS text FROM corpus"


def _score(table: dict) -> str:
    columns = []
    for i, t in enumerate(DOC_TYPES):
        entries = [(e[0], e[1]) if isinstance(e, tuple) else (e, 1.0) for e in table[t]]
        parts = [f"CASE WHEN regexp_matches(lo, {q(p)}) THEN {w} ELSE 0 END" for p, w in entries]
        hits = [f"CASE WHEN regexp_matches(lo, {q(p)}) THEN {q(p)} END" for p, _ in entries]
        columns.append(f"CAST({' + '.join(parts)} AS DOUBLE) AS s{i}")
        columns.append(f"concat_ws(' ; ', {', '.join(hits)}) AS h{i}")
    return f"SELECT doc_id, {', '.join(columns)} FROM (SELECT doc_id, lower(text) AS lo FROM cleaned) c"


VIEWS["weighted_hits"] = _score(WEIGHTED)
VIEWS["keyword_hits"] = _score(KEYWORDS)
VIEWS["type_scores"] = "\nUNION ALL\n".join(
    f"SELECT doc_id, {i} AS type_ord, {q(t)} AS document_type, s{i} AS raw_score, h{i} AS signals, "
    f"CASE WHEN s0+s1+s2+s3+s4+s5 = 0 THEN 0.0 ELSE round_even(s{i} / (s0+s1+s2+s3+s4+s5), 4) END AS share "
    "FROM weighted_hits" for i, t in enumerate(DOC_TYPES))
VIEWS["best_type"] = """
SELECT doc_id, document_type, share FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, type_ord) AS rn FROM type_scores) t
WHERE rn = 1"""
VIEWS["classified"] = f"""
SELECT c.doc_id, c.text, CASE WHEN b.share > 0 THEN b.document_type ELSE 'unknown' END AS document_type,
  b.share AS type_confidence, b.share < {MIN_CONFIDENCE} AS is_ambiguous
FROM cleaned c JOIN best_type b ON c.doc_id = b.doc_id"""

# --- names and addresses ------------------------------------------------------------------
VIEWS["names"] = f"""
SELECT doc_id, text, document_type,
  coalesce({if_valid('n1')}, {if_valid('n2')}) AS plain_name,
  coalesce({if_valid('c1')}, {if_valid('c2')}) AS card_name
FROM (SELECT *,
  {strip(first('text', P.NAME_AFTER_LABEL))} AS n1,
  {strip(first('text', P.NAME_BEFORE_DATE))} AS n2,
  {strip(first('text', "(?:^|\n)(" + P.NAME_WORDS + r")\s*\n.*?(?:" + P.BIRTH_MARK + ")", '(?sm)'))} AS c1,
  {strip(first('text', "(" + P.NAME_WORDS + r")\s*\n.*?(?:" + P.NUMBER_MARK + ")", '(?sm)'))} AS c2
  FROM classified) c"""

_LOCALITY = r"(?i)\b(" + "|".join(P.LOCALITY_WORDS) + r")\b"


def _address_like(x: str) -> str:
    s = strip(x)
    return (f"(length({s}) >= 4 AND ((regexp_matches({s}, '\\d') AND regexp_matches({s}, '[A-Za-z]')) "
            f"OR regexp_matches({s}, {q(_LOCALITY)})))")


VIEWS["address_lines"] = f"""
SELECT doc_id, text, string_split_regex(text, {q(LINE_ENDS)}) AS lines,
  list_transform(string_split_regex(regexp_extract(text, {q('(?is)' + P.ADDRESS_LABEL + '(.*)$')}, 1), {q(LINE_ENDS)}),
    lambda ln: {normalise('ln')}) AS after,
  {first('text', P.PINCODE)} AS pin
FROM classified WHERE document_type = 'aadhaar'"""
VIEWS["address_stops"] = f"""
SELECT *, coalesce((SELECT min(i) FROM (SELECT unnest(range(1, len(after) + 1)) AS i) t
    WHERE regexp_matches(after[i], {q('(?i)' + P.ADDRESS_STOP)})
       OR (after[i] = '' AND i > 1 AND after[i - 1] = '')), len(after) + 1) AS stop,
  (SELECT min(i) FROM (SELECT unnest(range(1, len(lines) + 1)) AS i) t WHERE contains(lines[i], pin)) AS pin_at
FROM address_lines"""
VIEWS["addresses"] = f"""
SELECT doc_id, coalesce(
  nullif(array_to_string(list_filter(after[1:stop - 1], lambda ln: ln <> '')[1:6], ', '), ''),
  CASE WHEN len(block) >= 2 THEN array_to_string(block, ', ') END,
  CASE WHEN len(scan) >= 2 THEN array_to_string(scan[1:6], ', ') END) AS address
FROM (SELECT *,
  list_filter(list_transform(lines[greatest(pin_at - 4, 1):pin_at + 2], lambda ln: {normalise('ln')}),
    lambda ln: {_address_like('ln')} OR contains(ln, pin)) AS block,
  list_transform(list_filter(lines, lambda ln: {_address_like('ln')}), lambda ln: {normalise('ln')}) AS scan
  FROM address_stops) a"""

# --- fields of all types, one column each ---------------------------------------------------
_dates = f"regexp_extract_all(n.text, {q(P.DATE)}, 1)"
_mrz = f"regexp_extract_all(n.text, {q(P.MRZ)}, 1)"
_lines = "string_split(n.text, chr(10))"
_school = (f"list_filter({_lines}, lambda ln: regexp_matches(ln, "
           f"{q('(?i)[A-Z].*(?:' + P.INSTITUTION_WORDS + ')')}))[1]")


def _of(types: str, value: str) -> str:
    return f"CASE WHEN document_type IN ({types}) THEN {value} END"


_ID, _TAX, _PASS, _CV, _CERT = "'aadhaar'", "'pan'", "'passport'", "'resume'", "'graduation_certificate', 'marksheet'"
VIEWS["fields"] = f"""
SELECT n.doc_id, n.text AS raw_text, document_type,
  {_of(_ID, f"regexp_replace({first('n.text', P.ID_NUMBER)}, '[\\s-]', '', 'g')")} AS aadhaar_number,
  {_of(f'{_ID}, {_TAX}, {_PASS}', first('n.text', P.DATE))} AS dob,
  {_of(_ID, title(first('n.text', P.GENDER, '(?i)')))} AS gender,
  {_of(_ID, first('n.text', P.PINCODE))} AS pincode,
  address,
  CASE document_type WHEN 'aadhaar' THEN coalesce(card_name, plain_name)
    WHEN 'pan' THEN plain_name WHEN 'resume' THEN plain_name END AS name,
  {_of(_TAX, first('n.text', P.TAX_NUMBER))} AS pan_number,
  {_of(_TAX, title(strip(first('n.text', P.FATHER, '(?i)'))))} AS father_name,
  {_of(_PASS, 'plain_name')} AS surname,
  {_of(_PASS, first('n.text', P.PASSPORT_NUMBER))} AS passport_number,
  {_of(_PASS, f"CASE WHEN len({_dates}) >= 2 THEN {_dates}[-1] END")} AS expiry_date,
  {_of(_PASS, title(first('n.text', P.NATIONALITY, '(?i)')))} AS nationality,
  {_of(_PASS, f"{_mrz}[1]")} AS mrz_line1,
  {_of(_PASS, f"{_mrz}[2]")} AS mrz_line2,
  {_of(_CV, first('n.text', P.EMAIL, '(?i)'))} AS email,
  {_of(_CV, f"CASE WHEN regexp_matches(n.text, {q(P.PHONE)}) THEN {strip(f'regexp_extract(n.text, {q(P.PHONE)}, 1)')} END")} AS phone,
  {_of(_CV, f"list_filter(list_transform(string_split_regex(regexp_extract(n.text, {q('(?i)' + P.SKILLS)}, 1), {q(P.SKILL_SEPARATORS)}), lambda s: {strip('s')}), lambda s: s <> '')")} AS skills,
  {_of(_CERT, 'plain_name')} AS student_name,
  {_of(_CERT, strip(first(_school, '([A-Za-z].*)$')))} AS institution,
  {_of(_CERT, first('n.text', P.YEAR))} AS year,
  {_of(_CERT, strip(first('n.text', P.ROLL, '(?i)')))} AS roll_number,
  {_of(_CERT, first('n.text', P.PERCENTAGE))} AS percentage
FROM names n LEFT JOIN addresses a ON n.doc_id = a.doc_id"""
