import random

import pytest
from pyspark.sql import functions as F

from docproof.functions import qr as Q, reply as RP
from docproof.operators import qr as QR, report, risk
from docproof.operators.crosscheck import cross_document_check
from docproof.sources import files

PAIR = "doc_id int, payload string, inflated string"


def decode(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAIR)
    return [r.qr for r in Q.decode_qr(df).orderBy("doc_id").collect()]


def test_xml_payload(spark):
    full, year, broken, bare, last4 = decode(
        spark,
        ('<K name="Asha &amp; Co" dob="01-02-1990" gender="F" uid="2345 6789 0123" co="C/O X" house="" dist="Pune" pc="411001" signature="s" m="h"><pht>x</pht></K>', None),
        ("z", '\ufeff <K nm="Asha" yob="1990" gentype="M" pc="41"/>'),
        ('<K name="Asha"', None), ("<K name='Asha'><a>", None), ('<K uid="XXXX0123"/>', None))
    assert (full.qr_type, full.name, full.uid_full, full.uid_last4, full.address, full.has_photo) == (
        "xml_signed", "Asha & Co", "234567890123", "0123", "C/O X, Pune", True)
    assert full.fields_found == ["name", "dob", "gender", "uid", "address", "pincode", "photo", "mobile_hash"]
    assert (year.qr_type, year.name, year.dob, year.gender, year.fields_found) == ("xml_plain", "Asha", "1990", "M", ["name", "dob_year", "gender"])
    assert broken.qr_type == "unknown" and bare.parse_error == "XML parse error" and bare.fields_found == []
    assert (last4.uid_full, last4.uid_last4, last4.fields_found) == (None, "0123", ["uid"])


def test_other_payloads(spark):
    none, empty, text, odd, parts, short, inner = decode(
        spark, (None, None), ("", None), ("no 1234567890123 uid 234567890123 on 1990-02-01", None), ("abc", None),
        ("z", "V2\x01Asha Rao\x0212/02/1990\x0301-01-2001x\x04Pune\x05411001\x06UID 2345 67890123"), ("zz 1", "short\x01"),
        ("z", 'junk <K name="Asha" uid="0123"/>'))
    assert none.qr_type == empty.qr_type == "not_found"
    assert (text.qr_type, text.uid_full, text.dob) == ("text_plain", "234567890123", "1990-02-01")
    assert odd.parse_error == "Unknown QR format — 3 bytes"
    assert (parts.qr_type, parts.name, parts.dob, parts.pincode, parts.uid_full) == (
        "secure_v2", "Pune", "01-01-2001x", "411001", "234567890123")
    assert short.qr_type == "text_plain" and inner.parse_error == "XML parse error"


def reconcile(spark, ocr, payload):
    o = spark.createDataFrame([(1, *ocr)], "doc_id int, name string, dob string, aadhaar_number string, gender string")
    q = Q.decode_qr(spark.createDataFrame([(1, payload, None)], PAIR))
    r = QR.correct_from_qr(QR.reconcile_qr_ocr(o, q)).first()
    return r.match, r


@pytest.mark.parametrize("ocr,payload,status,penalty", [
    (("Asha Rao", "01/02/1990", None, None), None, "no_qr", 5),
    (("Asha Rao", None, None, None), "abc", "decode_error", 8),
    (("Asha Rao", None, None, None), "1 2", "suspicious", 5),
    ((None, None, None, None), '<K name="Asha"/>', "suspicious", 5),
    (("Asha Rao", "01/02/1990", None, None), '<K name="Asha" dob="01-02-1990"/>', "verified", -5),
    (("Asha Rao", "02/02/1990", None, None), '<K name="Asha" dob="01-02-1990"/>', "partial_match", 10),
    (("Asha Rao", "02/02/1990", None, None), '<K name="Bo Das" dob="01-02-1990"/>', "mismatch", 30),
    (("Asha Rao", None, None, "Male"), '<K name="Asha" gender="F"/>', "verified", -5),
    ((None, None, None, "Male"), '<K gender="F"/>', "suspicious", 5),
    ((None, "01/02/1990", None, None), '<K yob="1990"/>', "partial_match", 10),  # a year never equals dd/m
    ((None, "1990-02-01", None, None), '<K yob="1990"/>', "verified", -5),
    ((None, None, "234567890123", None), '<K uid="0123"/>', "verified", -5),
    ((None, None, "234567890123", None), '<K uid="234567890124"/>', "partial_match", 10),
])
def test_reconcile(spark, ocr, payload, status, penalty):
    match, _ = reconcile(spark, ocr, payload)
    assert (match.status, match.penalty) == (status, penalty)


def test_corrections_keep_the_readings(spark):
    _, r = reconcile(spark, (None, None, "234567890123", None), '<K name="Asha Rao" dob="01-02-1990" uid="0123"/>')
    assert (r.name, r.corrected_name, r.corrected_dob) == (None, "Asha Rao", "01-02-1990")
    assert r.corrections == {"name": "Asha Rao", "dob": "01-02-1990"}
    match, r = reconcile(spark, ("Asha", None, None, None), '<K name="Asha Rao"/>')
    assert r.corrected_name == "Asha Rao" and r.corrections == {} and match.matches == ["name"]


@pytest.mark.parametrize("name,dob,payload,verdict,kept", [
    ("Asha Rao", "01/02/1990", None, "not_found", "Asha Rao"),
    ("Asha Rao", "01/02/1990", "uid 234567890123", "not_found", "Asha Rao"),
    ("Bo Das", "01/02/1990", '<K name="Asha Rao" dob="01-02-1990"/>', "verified", "Asha Rao"),
    ("Asha Das", "01/02/1990", '<K name="Asha Rao"/>', "verified", "Asha Das"),
    ("x", None, '<K name="Asha Rao" dob="01-02-1990"/>', "verified", "Asha Rao"),
    ("Asha Rao", "02/02/1990", '<K dob="01-02-1990"/>', "mismatch", "Asha Rao"),
])
def test_quick_verdict(spark, name, dob, payload, verdict, kept):
    o = spark.createDataFrame([(1, name, dob)], "doc_id int, name string, dob string")
    q = Q.decode_qr(spark.createDataFrame([(1, payload, None)], PAIR))
    r = QR.qr_quick_verdict(o, q).first()
    assert (r.qr_quick, r.quick_name) == (verdict, kept)


def replies(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "doc_id int, content string, reasoning string, reasoning_content string, parts array<string>")
    return RP.coalesce_model_reply(df).orderBy("doc_id").collect()


def test_replies(spark):
    ok, fenced, none, bad, wide, sure, parts, blank, second = replies(
        spark,
        ('{"visible_tampering": true, "suggested_risk_adjustment": 7, "fraud_signals": [{"signal": "a"}, {"severity": "high"}]}', None, None, None),
        ('x ```JSON\n{"reasoning": "r", "logical_inconsistencies": ["q",], }\n``` y', None, None, None),
        ("no object", None, None, None), ('{"a": }', None, None, None),
        ('{"suggested_risk_adjustment": 41}', None, None, None), ('{"vlm_confidence": 1.01}', None, None, None),
        (None, None, None, ['{"reasoning":', '"joined"}']), ("  ", "{}", None, None), ("", None, '{"reasoning": "third"}', None))
    assert ok.reply.visible_tampering and ok.reply.suggested_risk_adjustment == 7 and ok.reply.vlm_available
    assert [tuple(s) for s in ok.reply.fraud_signals] == [("a", "medium"), ("", "high")]
    assert fenced.reply.reasoning == "r" and fenced.reply.logical_inconsistencies == ["q"]
    assert [r.quarantine_reason for r in (none, bad, wide, sure)] == [
        "no JSON", "bad JSON", "risk adjustment out of range", "confidence out of range"]
    assert not wide.reply.vlm_available and wide.reply.suggested_risk_adjustment == 0
    assert parts.reply.reasoning == "joined" and second.reply.reasoning == "third"
    assert blank.reply.vlm_available and blank.reply.overall_assessment == "unknown"


def test_document_without_reply_is_neutral(spark):
    docs = spark.createDataFrame([(1,)], "doc_id int")
    raw = spark.createDataFrame([], "doc_id int, content string, reasoning string, reasoning_content string")
    r = RP.attach_model_reply(docs, raw).first()
    assert r.quarantine_reason == "no reply" and not r.reply.vlm_available and r.reply.fraud_signals == []


VERDICTS = dict(ela="tampered", metadata="missing", blur="blurry", duplicate_regions="detected", layout_validation="invalid",
                qr_validation="mismatch", ai_artifacts="suspected")


def test_points_by_lookup_and_by_column_agree(spark):
    rows = [(1, "aadhaar", 99.9, *VERDICTS.values()), (2, "pan", 9.99, *VERDICTS.values()),
            (3, "aadhaar", 0.0, "clean", "normal", "sharp", "not_detected", "valid", "verified", "not_detected"),
            (4, "pan", 30.0, "odd", "normal", None, "not_detected", "unknown", "mismatch", "not_detected")]
    df = spark.createDataFrame(rows, "doc_id int, document_type string, ela_score double, " + ", ".join(f"{k} string" for k in VERDICTS))
    by_column = {r.doc_id: r.base_score for r in risk.base_score(df).collect()}
    by_join = {r.doc_id: r.base_score for r in risk.base_risk(risk.signals_long(df)).collect()}
    assert by_column == by_join == {1: 100, 2: 100, 3: 0, 4: 8}


def test_signal_levels(spark):
    df = spark.createDataFrame([(1, "pan", 9.0, *VERDICTS.values())], "doc_id int, document_type string, ela_score double, " + ", ".join(f"{k} string" for k in VERDICTS))
    got = {r.signal: r.level for r in risk.signal_levels(df.withColumn("ela", F.lit("odd"))).collect()}
    assert got["ela"] == "none" and got["metadata"] == "amber" and got["blur"] == "red" and len(got) == 7


@pytest.mark.parametrize("base,delta,tamper,available,card,critical,score", [
    (10, 5, False, True, None, 0, 15), (10, -20, False, True, None, 0, 0), (95, 40, True, True, None, 0, 100),
    (10, 5, True, True, None, 0, 30), (50, 40, True, False, None, 0, 50), (0, 0, False, True, -5, 0, 0),
    (0, 0, False, True, -5, 1, 8), (90, 0, False, True, 30, 0, 100), (0, -20, False, True, 30, 2, 46), (99, 0, False, True, None, 3, 100),
])
def test_clamp_order(spark, base, delta, tamper, available, card, critical, score):
    df = spark.range(1).select(
        F.lit(base).alias("base_score"),
        F.struct(F.lit(delta).alias("suggested_risk_adjustment"), F.lit(tamper).alias("visible_tampering"), F.lit(available).alias("vlm_available")).alias("reply"),
        F.struct(F.lit(card).cast("int").alias("total_penalty")).alias("card"), F.struct(F.lit(critical).alias("critical_failures")).alias("report"))
    assert risk.final_risk(df).first().risk_score == score


@pytest.mark.parametrize("number,qr,font,layout,total,level,passed,failed", [
    ("234567890124", ("verified", -5), ("consistent", 0), ("valid", 0), -5, "low", 4, 0),
    ("234567890123", ("partial_match", 10), ("suspicious", 10), ("suspicious", 8), 58, "critical", 0, 1),
    (None, ("no_qr", 5), ("consistent", 0), ("valid", 0), 20, "medium", 2, 1),
    ("123", ("mismatch", 30), ("inconsistent", 20), ("invalid", 20), 95, "critical", 0, 4),
    (None, ("verified", -5), ("inconsistent", 20), ("suspicious", 8), 38, "high", 1, 2),
])
def test_card_verification(spark, number, qr, font, layout, total, level, passed, failed):
    pair = lambda p: F.struct(F.lit(p[0]).alias("status"), F.lit(p[1]).alias("penalty"))
    df = spark.range(1).select(F.lit(number).cast("string").alias("aadhaar_number"), pair(qr).alias("match"), pair(font).alias("font"), pair(layout).alias("card_layout"))
    c = risk.card_verification(df).first().card
    assert (c.total_penalty, c.risk_level, c.checks_passed, c.checks_failed) == (total, level, passed, failed)


def test_audit_stages(spark):
    df = spark.createDataFrame([("aadhaar",), ("pan",)], "t string").select(report.audit_stages(F.col("t")).alias("s"))
    card, other = [r.s for r in df.collect()]
    assert len(card) == 12 and len(other) == 11 and set(card) - set(other) == {"aadhaar_deep_verification"}


def test_cross_check_has_an_anchor_per_field(spark):
    rows = [(i, 1, "pan" if i else "aadhaar", "Asha Rao" if i % 2 == 0 else "Bo Das", "01/01/1990" if i % 3 else None) for i in range(50)]
    rows += [(60, 3, "aadhaar", "Asha Rao", None), (61, 3, "pan", None, "01/01/1990"), (62, 3, "passport", None, "02/01/1990"), (63, 3, "unknown", "Z", None)]
    df = spark.createDataFrame(rows + [(99, 2, "pan", "X Y", None)], "doc_id int, subject_id int, document_type string, name string, dob string")
    got = {r.doc_id: r for r in cross_document_check(df).collect()}
    assert len(got) == 54 and {got[i].name_anchor for i in range(50)} == {0} and {got[i].dob_anchor for i in range(50)} == {1}
    assert all(got[i].name_agrees == (i % 2 == 0) for i in range(1, 50)) and got[0].name_agrees is None
    assert all(got[i].dob_agrees == (True if i % 3 and i != 1 else None) for i in range(50))
    assert (got[5].subject_names, got[5].subject_dates) == (2, 1)
    # The first document states no date; two others disagree.
    assert (got[61].dob_agrees, got[62].dob_agrees, got[62].subject_dates) == (None, False, 2)
    assert (got[99].name_agrees, got[99].dob_agrees, got[99].dob_anchor, got[99].subject_dates) == (None, None, None, 0)


def test_unknown_keys_of_a_reply_are_kept(spark):
    texts = ['{"vlm_confidence": 0.5, "model": {"name": "m", "v": [1, 2]}, "note": null}', "{}", "no object", None]
    got = RP.parse_model_json(spark.createDataFrame([(t,) for t in texts], "reply_text string")).select(
        "reply_json.vlm_confidence", F.transform_values("reply_extra", lambda k, v: F.to_json(v)).alias("extra"), "reply_error").collect()
    assert got[0].vlm_confidence == 0.5 and set(got[0].extra) == {"model", "note"} and '"v":[1,2]' in got[0].extra["model"]
    assert (got[1].extra, got[1].reply_error) == ({}, None)
    assert [(r.extra, r.reply_error) for r in got[2:]] == [(None, "no JSON"), (None, "empty")]


def plainly_agree(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return bool(x and y) and (len(x & y) / len(x | y) >= 0.6 or x <= y or y <= x)


def test_all_pairs_of_names_are_judged(spark):
    """Two names that agree with the anchor but not with each other; a subject with nine tenths of the rows; blank names."""
    given, middle, family = "Ravi Asha Bo Devi Omar".split(), "Kumar Lal Nath Rani".split(), "Sharma Das Rao Ghosh Iyer Sen".split()
    rng = random.Random(14)
    rows = [(1, 1, "Ravi Kumar Sharma"), (2, 1, "Ravi Sharma"), (3, 1, "kumar  SHARMA"), (4, 2, "Asha Rao"), (5, 2, "Rao Asha"), (6, 3, None), (7, 4, ""), (8, 4, "X Y")]
    for i in range(10, 400):
        parts = [rng.choice(given), *rng.sample(middle, rng.randrange(3)), rng.choice(family)]
        rng.shuffle(parts)
        rows.append((i, 9, " ".join(parts + ["Jr"] * rng.randrange(2))))
    df = spark.createDataFrame([(i, s, "pan", n, "01/01/1990") for i, s, n in rows], "doc_id int, subject_id int, document_type string, name string, dob string")
    got = {r.doc_id: r for r in cross_document_check(df).collect()}
    assert len(got) == len(rows)
    assert [got[i].name_agrees for i in (1, 2, 3)] == [None, True, True]
    assert [got[i].name_conflicts for i in (1, 2, 3)] == [0, 1, 1] and got[1].subject_conflicts == 1
    assert (got[4].name_conflicts, got[4].subject_names, got[6].name_conflicts, got[6].subject_conflicts) == (0, 1, None, 0)
    assert (got[7].name_conflicts, got[8].name_conflicts) == (1, 1)
    different = {frozenset(n.lower().split()): n for _, s, n in rows if s == 9}
    conflicts = {k: sum(not plainly_agree(n, m) for j, m in different.items() if j != k) for k, n in different.items()}
    assert all(got[i].name_conflicts == conflicts[frozenset(n.lower().split())] for i, s, n in rows if s == 9)
    assert {got[i].subject_conflicts for i, s, _ in rows if s == 9} == {sum(conflicts.values()) // 2}


def test_files(spark, tmp_path):
    contents = {"a.PDF": b"%PDF-1.7 x", "b.jpg": b"\xff\xd8\xff\xe0", "c.png": b"\x89PNG\r\n\x1a\n", "d.tif": b"MM\x00*", "e": b"RIFF1234WEBPVP8",
                "f.pdf": b"GIF89a", "g.txt": b"plain", "h.bin": b"\x00\x01", "i.pdf": b"%PDF-" + b"x" * 100}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    checked = files.validate_files(files.scan_files(spark, str(tmp_path)), max_bytes=50)
    got = {r.path.rsplit("/", 1)[1]: r for r in checked.collect()}
    assert {n for n, r in got.items() if r.verdict == "accepted"} == {"a.PDF", "b.jpg", "c.png", "d.tif", "e"}
    assert got["i.pdf"].verdict == "FileTooLargeError" and got["f.pdf"].mime == "image/gif" and got["h.bin"].mime == "application/octet-stream"
    assert got["g.txt"].message.startswith("MIME type 'text/plain' is not supported. Allowed: application/pdf, ")
    assert got["e"].suffix == ".bin" and got["a.PDF"].is_pdf
    good, bad = files.accepted_and_rejected(files.scan_files(spark, str(tmp_path)), 50)
    assert (good.count(), bad.count()) == (5, 4)


def test_every_upload_is_listed_and_large_ones_are_not_opened(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "in/b.jpg": b"", "in/deep/c.png": b"\x89PNG\r\n\x1a\n", "d.txt": b"", "in/e.pdf": b"%PDF-" + b"x" * 100,
                       "_part/f.pdf": b"%PDF-", ".g.pdf": b"%PDF-", "lang=_x/h.pdf": b"%PDF-2"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "in/e.pdf").chmod(0)  # may not be opened; its length is enough
    got = {r.path.split(str(tmp_path))[1]: r for r in files.scan_uploads(spark, str(tmp_path), 50).collect()}
    assert {n: (r.mime, r.verdict) for n, r in got.items()} == {
        "/a.pdf": ("application/pdf", "accepted"), "/in/deep/c.png": ("image/png", "accepted"), "/lang=_x/h.pdf": ("application/pdf", "accepted"),
        "/in/b.jpg": ("application/x-empty", "UnsupportedFileTypeError"), "/d.txt": ("application/x-empty", "UnsupportedFileTypeError"),
        "/in/e.pdf": (None, "FileTooLargeError")}
    # The same id as when Spark itself lists the file.
    assert {r.doc_id for r in got.values()} >= {r.doc_id for r in files.scan_files(spark, str(tmp_path)).where("length < 50").select("doc_id").collect()}
    assert files.list_files(spark, str(tmp_path / "nothing")).count() == 0


def test_empty_upload_is_refused(spark):
    df = spark.createDataFrame([("up/j.pdf", 0, bytearray())], "path string, length long, content binary")
    r = files.validate_files(files.with_file_columns(df)).first()
    assert (r.mime, r.verdict) == ("application/x-empty", "UnsupportedFileTypeError")
