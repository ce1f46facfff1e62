"""Input tables derived from the test tables, written in SQL that Spark and DuckDB both read.

The engine's inputs are OCR text, boxes, image scores, QR payloads and model replies. Each
recipe below renders one of them from a test table row by row, so it grows with that table.
``{customer}`` and the like stand for the source tables. See FIXTURES.md.
"""

from pyspark.sql import DataFrame, SparkSession

#: Identity values per customer. Impossible, mixed-separator and future dates occur.
PEOPLE = """
SELECT k, CAST(k % 7 AS INT) AS kind,
  split_part('Asha,Ravi,Meera,Kiran,Omkar,Devi,Nisha,Arjun', ',', CAST(1 + k % 8 AS INT)) || ' ' ||
  split_part('Sharma,Patel,Iyer,Khan,Das,Rao,Menon', ',', CAST(1 + (k * 3) % 7 AS INT)) ||
  CASE WHEN k % 4 = 0 THEN ' Kumar' ELSE '' END AS nm,
  CAST(200000000000 + ((k % 1000003) * 829356451) % 700000000000 AS string) AS uid,
  lpad(CAST(1 + k % 31 AS string), 2, '0') || CASE WHEN k % 11 = 0 THEN '-' ELSE '/' END ||
  lpad(CAST(1 + k % 12 AS string), 2, '0') || CASE WHEN k % 13 = 0 THEN '-' ELSE '/' END ||
  CAST(1940 + (k * 17) % 90 AS string) AS dob,
  '01/01/' || CAST(2019 + k % 12 AS string) AS expiry,
  CAST(100000 + (k * 7907) % 900000 AS string) AS pin,
  split_part('Male,Female,Transgender', ',', CAST(1 + k % 3 AS INT)) AS gender,
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + k % 26 AS INT), 1) AS l1,
  substr('PCHFATBLJGKXQ', CAST(1 + k % 13 AS INT), 1) AS l4,
  lpad(CAST((k * 37) % 10000 AS string), 4, '0') AS d4,
  lpad(CAST(((k % 1000003) * 7919) % 10000000 AS string), 7, '0') AS d7,
  CAST(1950 + (k * 7) % 90 AS string) AS yr,
  chr(10) AS nl
FROM (SELECT c_custkey AS k FROM {customer}) c
"""

#: OCR text per person, one layout per kind.
SCANS = """
SELECT k AS doc_id, kind, nm, uid, dob, expiry, pin, gender,
  CASE kind
  WHEN 0 THEN
    CASE WHEN k % 2 = 0 THEN 'भारत सरकार' || nl ELSE '' END ||
    CASE WHEN k % 25 = 0 THEN 'aadhaar card' ELSE 'Government of India' || nl || 'Unique Identification Authority' END || nl ||
    nm || nl || 'DOB: ' || dob || nl || gender || nl ||
    CASE WHEN k % 9 = 1 THEN ''
         WHEN k % 5 = 1 THEN substr(uid, 1, 4) || '-' || substr(uid, 5, 4) || '-' || substr(uid, 9, 4) || nl
         ELSE substr(uid, 1, 4) || ' ' || substr(uid, 5, 4) || ' ' || substr(uid, 9, 4) || nl END ||
    CASE WHEN k % 3 = 0 THEN 'Address: ' || d4 || ', Gandhi Road' || nl || 'Pune ' || pin || nl
         WHEN k % 3 = 1 THEN d4 || ', Gandhi  Road' || nl || 'Pune ' || pin || nl
         ELSE 'Flat 12, Shanti Nagar' || nl || 'near Main Market' || nl END ||
    'uidai  aadhaar'
  WHEN 1 THEN 'INCOME TAX DEPARTMENT' || nl || 'Permanent Account Number' || nl ||
    CASE WHEN k % 10 = 3 THEN '' ELSE 'A' || l1 || 'C' || l4 || 'E' || d4 || 'Z' || nl END ||
    CASE WHEN k % 3 = 1 THEN nm || nl ELSE 'Name: ' || nm || nl || 'Father''s Name: RAVI KUMAR' || nl END || dob
  WHEN 2 THEN 'PASSPORT' || nl || 'Republic of India' || nl || 'Nationality: INDIAN' || nl || l1 || d7 || nl ||
    'Place of Birth PUNE' || nl || 'Name: ' || nm || nl || dob || nl || 'Date of Expiry ' || expiry ||
    CASE WHEN k % 5 = 2 THEN '' ELSE nl || rpad('P<IND' || upper(replace(nm, ' ', '<')), 44, '<') || nl ||
      rpad(l1 || d7 || '<IND', 44, '<') END
  WHEN 3 THEN 'Curriculum Vitae' || nl || 'Name: ' || nm || nl ||
    CASE WHEN k % 6 = 1 THEN '' ELSE lower(replace(nm, ' ', '.')) || '@mail.example' || nl END ||
    '+91 98' || d4 || d4 || nl || 'Work Experience' || nl ||
    CASE WHEN k % 5 = 0 THEN '' ELSE 'Skills: sql, spark' || nl || 'python' || nl END || 'Education: BSc'
  WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 'University of Pune' ELSE 'The University of Pune' END || nl ||
    'Bachelor of Science' || nl || 'awarded the degree to' || nl ||
    'Name: ' || nm || nl || 'Convocation ' || yr || nl || 'Registrar'
  WHEN 5 THEN 'Mark Sheet' || nl || 'Semester IV' || nl || 'Name: ' || nm || nl || 'Roll No: R-' || d4 || nl ||
    'Total Marks 500' || nl || 'Percentage: ' || CAST(k % 120 AS string) || '.5 %' || nl || 'City College of Arts'
  ELSE 'lorem ipsum ' || d4 END AS text
FROM {people} p
"""

#: Everything to be verified: the rendered scans, and the prose documents as noise.
CORPUS = """
SELECT doc_id, text FROM {scans} s
UNION ALL
SELECT 1000000000000 + doc_id AS doc_id, text FROM {documents} d
"""

#: Image scores and tags per document.
SIGNALS = """
SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 10 END AS ela_score,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST((o_orderkey * 53) % 4000 AS DOUBLE) / 10 END AS blur_score,
  CAST((o_orderkey * 29) % 100 AS DOUBLE) / 100 AS dct_mid_ratio,
  CAST((o_orderkey * 31) % 200 AS DOUBLE) / 100 AS noise_uniformity,
  CAST((o_orderkey * 41) % 60 AS DOUBLE) / 100 AS edge_density,
  CAST(800 + (o_orderkey * 13) % 1200 AS INT) AS width,
  CAST(600 + (o_orderkey * 7) % 900 AS INT) AS height,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST((o_orderkey * 19) % 256 AS DOUBLE) END AS brightness,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST((o_orderkey * 23) % 256 AS DOUBLE) END AS saturation,
  (o_orderkey % 3 <> 0) AS qr_region_found,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_orderkey % 4 <> 0) END AS photo_found,
  split_part('.jpg,.pdf,.png,.tiff,.jpeg', ',', CAST(1 + o_orderkey % 5 AS INT)) AS suffix,
  split_part('present,absent,present,corrupt,present,present,error', ',', CAST(1 + o_orderkey % 7 AS INT)) AS exif_state,
  split_part('Adobe Photoshop,GIMP 2.10,Scanner X,,,HP Scan', ',', CAST(1 + o_orderkey % 6 AS INT)) AS software,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '2024:01:0' || CAST(1 + o_orderkey % 9 AS string) END AS datetime,
  CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE '2024:01:0' || CAST(1 + (o_orderkey * o_orderkey) % 9 AS string) END AS datetime_original
FROM {orders} o
"""

#: QR contents: XML (signed, plain, broken, altered), text, unknown, empty, none; and
#: ``inflated``, the text of the compressed kind after decompression outside.
QR = """
SELECT k AS doc_id,
  CASE
    WHEN k % 9 = 0 THEN NULL
    WHEN k % 41 = 5 THEN ''
    WHEN k % 37 = 5 THEN 'no numbers in here'
    WHEN k % 10 = 3 THEN 'UID ' || uid || CASE WHEN k % 4 = 1 THEN '' ELSE ' born ' || dob END
    WHEN k % 10 = 7 THEN '02b1c3d4'
    WHEN k % 31 = 4 THEN '<PrintLetterBioData uid="' || uid || '" name="' || nm
    ELSE '<PrintLetterBioData uid="' ||
      CASE WHEN k % 8 = 0 THEN substr(uid, 1, 11) || CAST((CAST(substr(uid, 12, 1) AS INT) + 1) % 10 AS string)
           WHEN k % 8 = 3 THEN substr(uid, 9, 4) ELSE uid END || '"' ||
      CASE WHEN k % 12 = 2 THEN '' WHEN k % 5 = 0 THEN ' name="Vikram Bose"' ELSE ' name="' || nm || '"' END ||
      ' gender="' || substr(gender, 1, 1) || '"' ||
      CASE WHEN k % 6 = 4 THEN ' yob="' || substr(dob, 7, 4) || '"'
           WHEN k % 7 = 0 AND k % 3 = 0 THEN ' dob="01/01/1900"'
           ELSE ' dob="' || replace(dob, '/', '-') || '"' END ||
      ' co="S/O Ravi" house="' || d4 || '" street="" dist="Pune" state="Maharashtra"' ||
      ' pc="' || CASE WHEN k % 13 = 2 THEN '12' ELSE pin END || '"' ||
      CASE WHEN k % 4 = 1 THEN ' signature="ab12"' ELSE '' END ||
      CASE WHEN k % 6 = 0 THEN ' m="9f8e"' ELSE '' END ||
      CASE WHEN k % 3 = 0 THEN '><pht>aGVsbG8</pht></PrintLetterBioData>' ELSE '/>' END
  END AS payload,
  CASE WHEN k % 10 = 7 AND k % 9 <> 0 AND k % 41 <> 5 AND k % 37 <> 5 THEN
    CASE WHEN k % 4 = 1 THEN '<Kyc name="' || nm || '" dob="' || dob || '" uid="' || substr(uid, 9, 4) || '" signature="x"/>'
    ELSE 'V2' || chr(1) || nm || chr(2) || dob || chr(3) || chr(3) || CASE WHEN k % 5 = 2 THEN pin || chr(4) ELSE '' END ||
      'Pune' || chr(5) || uid || chr(6) || 'ok' END
  END AS inflated
FROM {people} p
"""

#: Metric blocks of an image, about 600 a document.
BLOCKS = """
SELECT l_suppkey AS doc_id, l_linenumber AS x, CAST(l_orderkey % 50 AS INT) AS y,
  l_orderkey AS block_id, l_discount AS hf_ratio, l_tax AS text_density
FROM {lineitem} l
"""

#: Tile scores: edge sharpness and blockiness per tile, and residuals per grid cell.
TILES = """
SELECT l_suppkey AS doc_id, CAST(l_partkey % 64 AS INT) AS cell,
  l_quantity AS sharpness,
  CASE WHEN l_suppkey % 5 = 0 AND l_orderkey % 11 <> 0 THEN 0.0 ELSE l_quantity END AS blockiness,
  l_quantity AS residual
FROM {lineitem} l
"""

#: Model replies: fenced JSON with a trailing comma; some broken, out of range, or absent.
REPLIES = """
SELECT doc_id,
  CASE WHEN v = 0 THEN NULL ELSE msg END AS content,
  CASE WHEN v = 1 OR msg IS NULL THEN NULL WHEN v = 0 THEN msg ELSE 'spare' END AS reasoning,
  CASE WHEN v = 0 AND msg IS NOT NULL THEN 'unused' ELSE NULL END AS reasoning_content,
  CASE WHEN v = 2 THEN msg ELSE NULL END AS part_1,
  CASE WHEN v = 2 AND msg IS NOT NULL THEN ' ' ELSE NULL END AS part_2
FROM (
SELECT k AS doc_id, k % 5 AS v,
  CASE WHEN k % 6 = 0 THEN NULL WHEN k % 19 = 0 THEN 'no object here'
  WHEN k % 23 = 0 THEN '{{"suggested_risk_adjustment": '
  WHEN k % 29 = 0 THEN '{{"suggested_risk_adjustment": oops}}'
  ELSE
  '```json' || chr(10) || '{{"vlm_confidence": ' || CASE WHEN k % 43 = 0 THEN '1.5' ELSE '0.' || CAST(10 + k % 90 AS string) END ||
  CASE WHEN k % 14 = 3 THEN '' ELSE ', "overall_assessment": "' || split_part('genuine,suspicious,fake', ',', CAST(1 + k % 3 AS INT)) || '"' END ||
  ', "layout_authenticity": "likely_authentic", "visible_tampering": ' || CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END ||
  ', "seal_signature_present": ' || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END ||
  ', "fraud_signals": [{{"signal": "edge halo", "severity": "' || split_part('low,medium,high', ',', CAST(1 + k % 3 AS INT)) ||
  '"}}, {{"signal": "font mix", "severity": "high"}},]' ||
  CASE WHEN k % 2 = 0 THEN ', "logical_inconsistencies": ["issue before birth",]' ELSE '' END ||
  ', "reasoning": "checked ' || CAST(k AS string) || '"' ||
  ', "suggested_risk_adjustment": ' || CAST(CASE WHEN k % 17 = 0 THEN 90 ELSE k % 61 - 20 END AS string) || ',}}' || chr(10) || '```' END AS msg
FROM (SELECT c_custkey AS k FROM {customer}) c
) r
"""

#: Which subject a document belongs to: neighbouring scans share one.
SUBJECTS = """
SELECT k AS doc_id, CAST(FLOOR(k / 7) AS BIGINT) AS subject_id FROM {people} p
"""

#: OCR readings to hold against the QR: some names garbled or absent, some dates lost.
READINGS = """
SELECT k AS doc_id,
  CASE WHEN k % 16 = 3 THEN NULL WHEN k % 16 = 5 THEN 'x1' WHEN k % 16 = 7 THEN split_part(nm, ' ', 1) || ' Ghosh'
       ELSE nm END AS name,
  CASE WHEN k % 15 = 4 THEN NULL ELSE dob END AS dob,
  CASE WHEN k % 14 = 5 THEN NULL ELSE uid END AS aadhaar_number,
  CASE WHEN k % 17 = 6 THEN 'Male' WHEN k % 17 = 7 THEN NULL ELSE gender END AS gender
FROM {people} p
"""

#: Pairs of names: equal, reordered, shortened, different, blank.
NAME_PAIRS = """
SELECT k AS doc_id, nm AS a,
  CASE CAST(k % 6 AS INT) WHEN 0 THEN upper(nm) WHEN 1 THEN split_part(nm, ' ', 2) || '  ' || split_part(nm, ' ', 1)
    WHEN 2 THEN split_part(nm, ' ', 1) WHEN 3 THEN split_part(nm, ' ', 1) || ' Bose' WHEN 4 THEN ''
    ELSE 'Vikram ' || split_part(nm, ' ', 2) || ' Kumar' END AS b
FROM {people} p
"""

#: Numbers as printed: whole, grouped, short, wrong start.
NUMBERS = """
SELECT k AS doc_id,
  CASE CAST(k % 7 AS INT) WHEN 1 THEN substr(uid, 1, 11) WHEN 2 THEN '0' || substr(uid, 2, 11)
    WHEN 3 THEN substr(uid, 1, 4) || ' ' || substr(uid, 5, 4) || '-' || substr(uid, 9, 4)
    WHEN 4 THEN '' ELSE uid END AS number,
  substr(uid, 1, 11) AS stem
FROM {people} p
"""

#: Dates in the accepted layouts and in others.
DATES = """
SELECT k AS doc_id,
  CASE CAST(k % 5 AS INT) WHEN 1 THEN substr(dob, 7, 4) || '-' || substr(dob, 4, 2) || '-' || substr(dob, 1, 2)
    WHEN 2 THEN ' ' || replace(dob, '/', '-') || ' ' WHEN 3 THEN substr(dob, 1, 8) ELSE dob END AS written
FROM {people} p
"""

#: Uploaded files as rows: each document's text behind the leading bytes of some format.
FILES = (
    """
SELECT 'in/' || CAST(doc_id AS string) || split_part('.pdf,.JPG,.png,.tiff,.webp,.gif,', ',', CAST(1 + doc_id % 7 AS INT)) AS path,
  CAST(octet_length(content) AS BIGINT) AS length, content
FROM (SELECT doc_id, concat(unhex(split_part('255044462D312E37,FFD8FFE000104A46,89504E470D0A1A0A,49492A0008000000,524946460000000057454250,474946383961,',
    ',', CAST(1 + doc_id % 7 AS INT))), encode(text, 'UTF-8')) AS content FROM {documents} d) f
""",
    """
SELECT 'in/' || CAST(doc_id AS string) || split_part('.pdf,.JPG,.png,.tiff,.webp,.gif,', ',', CAST(1 + doc_id % 7 AS INT)) AS path,
  CAST(octet_length(content) AS BIGINT) AS length, content
FROM (SELECT doc_id, unhex(split_part('255044462D312E37,FFD8FFE000104A46,89504E470D0A1A0A,49492A0008000000,524946460000000057454250,474946383961,',
    ',', CAST(1 + doc_id % 7 AS INT))) || encode(text) AS content FROM {documents} d) f
""",
)

#: Engines where the row generator differs: (Spark text, DuckDB text).
PAGE_LINES = (
    """
SELECT doc_id, CAST(1 + FLOOR(pos / 40) AS INT) AS page_no, CAST(pos AS INT) AS ord, line AS text,
  CAST(((doc_id % 1009) * 11 + pos * 37) % 61 + 35 AS DOUBLE) / 100 AS confidence
FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM {corpus}) c
""",
    """
SELECT doc_id, CAST(1 + FLOOR(pos / 40) AS INT) AS page_no, CAST(pos AS INT) AS ord, line AS text,
  CAST(((doc_id % 1009) * 11 + pos * 37) % 61 + 35 AS DOUBLE) / 100 AS confidence
FROM (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {corpus}) a) c
""",
)

#: Word boxes of the second engine: one per word, on lightly sloping lines.
TOKENS = (
    """
SELECT doc_id, page_no, ord AS line, CAST(w AS INT) AS word, text,
  CAST(((doc_id % 1009) * 7 + ord * 13 + w * 5) % 80 + 15 AS DOUBLE) / 100 AS confidence,
  CAST(50 * w AS INT) AS x0, CAST(14 * (ord % 40) + (w * 5) % 3 + (ord % 3) * 2 AS INT) AS y0,
  CAST(50 * w + 8 * length(text) AS INT) AS x1, CAST(14 * (ord % 40) + 12 AS INT) AS y1
FROM (SELECT doc_id, page_no, ord, posexplode(split(text, ' ')) AS (w, text) FROM {page_lines}) c
WHERE text <> ''
""",
    """
SELECT doc_id, page_no, ord AS line, CAST(w AS INT) AS word, text,
  CAST(((doc_id % 1009) * 7 + ord * 13 + w * 5) % 80 + 15 AS DOUBLE) / 100 AS confidence,
  CAST(50 * w AS INT) AS x0, CAST(14 * (ord % 40) + (w * 5) % 3 + (ord % 3) * 2 AS INT) AS y0,
  CAST(50 * w + 8 * length(text) AS INT) AS x1, CAST(14 * (ord % 40) + 12 AS INT) AS y1
FROM (SELECT doc_id, page_no, ord, unnest(range(len(ws))) AS w, unnest(ws) AS text
      FROM (SELECT doc_id, page_no, ord, string_split(text, ' ') AS ws FROM {page_lines}) a) c
WHERE text <> ''
""",
)

#: Lines of the first engine over the same pages: every third with a letter wrong, every seventh unread.
PRIMARY = """
SELECT doc_id, page_no, ord,
  CASE WHEN (ord + doc_id) % 7 = 3 THEN '' WHEN ord % 3 = 1 THEN replace(replace(text, 'a', 'o'), 'Roll', 'roll') ELSE text END AS text, confidence
FROM {page_lines} s
"""

#: Key-point descriptors from vectors: four words of 64 bits, each with a bit per dimension above one of four limits.
DESCRIPTORS = (
    """
SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS kp_id,
  CAST((vec_id * 37) % 1000 AS INT) AS x, CAST((vec_id * 91) % 700 AS INT) AS y,
  transform(array(0.0D, 0.3125D, -0.3125D, 0.375D), t -> aggregate(sequence(0, 63), CAST(0 AS BIGINT),
            (b, i) -> b | IF(embedding[i] > t, shiftleft(CAST(1 AS BIGINT), i), CAST(0 AS BIGINT)))) AS bits
FROM {embeddings} e
""",
    """
SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS kp_id,
  CAST((vec_id * 37) % 1000 AS INT) AS x, CAST((vec_id * 91) % 700 AS INT) AS y,
  list_transform([0.0, 0.3125, -0.3125, 0.375], lambda t: CAST(list_sum(list_transform(range(64), lambda i:
    CASE WHEN embedding[i + 1] <= CAST(t AS DOUBLE) THEN 0 WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(i AS INT) END)) AS BIGINT)) AS bits
FROM {embeddings} e
""",
)

#: name -> (recipe, tables it reads)
RECIPES = {
    "people": (PEOPLE, ["customer"]),
    "scans": (SCANS, ["people"]),
    "corpus": (CORPUS, ["scans", "documents"]),
    "signals": (SIGNALS, ["orders"]),
    "qr": (QR, ["people"]),
    "blocks": (BLOCKS, ["lineitem"]),
    "tiles": (TILES, ["lineitem"]),
    "replies": (REPLIES, ["customer"]),
    "subjects": (SUBJECTS, ["people"]),
    "files": (FILES, ["documents"]),
    "readings": (READINGS, ["people"]),
    "name_pairs": (NAME_PAIRS, ["people"]),
    "numbers": (NUMBERS, ["people"]),
    "dates": (DATES, ["people"]),
    "page_lines": (PAGE_LINES, ["corpus"]),
    "tokens": (TOKENS, ["page_lines"]),
    "primary_lines": (PRIMARY, ["page_lines"]),
    "descriptors": (DESCRIPTORS, ["embeddings"]),
}


#: Tables whose rows cost much to render or to parse later, from a source that may lie in one row group and so in one task.
COSTLY = {"qr": "c_custkey", "replies": "c_custkey", "page_lines": "c_custkey"}


def fixture(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None, by_document: bool = False) -> DataFrame:
    """The named input table as a lazy DataFrame over the test data; the source rows that have the key ``spread`` are dealt over all tasks by it.

    With ``by_document`` the corpus is dealt by doc_id while a document is one cell, its smallest form; lines and words cut from it stay where it is.
    """
    if name not in RECIPES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # The number is given, as the keys alone are so small that they would be joined into one task again.
        return table.select(spread).repartition(parts(spark), spread) if spread in table.columns else table
    recipe, sources = RECIPES[name]
    text = recipe[0] if isinstance(recipe, tuple) else recipe
    df = spark.sql(text, **{s: fixture(spark, sf_dir, s, COSTLY.get(name, spread), by_document) for s in sources})
    return df.repartition(document_parts(spark), "doc_id") if by_document and name == "corpus" else df


def parts(spark: SparkSession) -> int:
    """Into how many parts tables are dealt."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_parts(spark: SparkSession) -> int:
    """Into how many parts documents are dealt: few bytes of text are many words, which a task sorts in memory."""
    return 4 * parts(spark)


def duckdb_ctes() -> dict[str, tuple[str, list[str]]]:
    """The same recipes as named DuckDB subqueries: name -> (SQL, names it reads)."""
    out = {}
    for name, (recipe, sources) in RECIPES.items():
        text = recipe[1] if isinstance(recipe, tuple) else recipe
        out[name] = (text.format(**{s: s for s in sources}), [s for s in sources if s in RECIPES])
    return out
