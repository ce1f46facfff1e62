import datetime

import pytest
from pyspark.sql import functions as F

from docproof.functions.parse import parse_fields
from docproof.functions.rules import check_fields, summarise_checks
from docproof.operators import classify
from docproof.operators.layout import card_layout_score, layout_verdict
from docproof.operators.names import rank_names
from docproof.plans.extract import extract_documents
from docproof.schemas import FIELDS

AS_OF = datetime.date(2025, 1, 1)


def classified(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return classify.classify_weighted(df).orderBy("doc_id").collect()


def test_nothing_found_is_unknown_with_seven_scores(spark):
    (r,) = classified(spark, "nothing of note")
    assert (r.document_type, r.type_confidence, r.is_ambiguous) == ("unknown", 0.0, True)
    assert r.all_scores == dict.fromkeys([*classify.DOC_TYPES, "unknown"], 0.0)


def test_weights_count_presence_and_normalise(spark):
    (r,) = classified(spark, "aadhaar aadhaar uidai income tax")
    assert r.document_type == "aadhaar" and len(r.all_scores) == 6
    assert r.all_scores["aadhaar"] == round(6 / 7, 4) and r.all_scores["pan"] == round(1 / 7, 4)
    assert r.matched_signals["aadhaar"] == ["aadhaar", "uidai"]


def test_ties_go_to_the_earlier_type(spark):
    (r,) = classified(spark, "uidai mark sheet permanent account number")
    assert r.document_type == "aadhaar" and r.type_confidence == 0.3333


def test_ambiguous_below_a_quarter(spark):
    text = "uidai permanent account number passport curriculum vitae graduation certificate"
    r, q = classified(spark, text, "uidai permanent account number passport curriculum vitae")
    assert r.type_confidence == 0.2 and r.is_ambiguous
    assert q.type_confidence == 0.25 and not q.is_ambiguous


def test_half_even_share(spark):
    # 0.5 of 16.0 is 0.03125: half-even gives 0.0312.
    text = ("dob : graduation certificate awarded the degree bachelor of master of convocation "
            "university of passport")
    (r,) = classified(spark, text)
    total = 0.5 + 3 + 3 + 2.5 + 2.5 + 2.5 + 1 + 3
    assert r.all_scores["aadhaar"] == round(0.5 / total, 4)


def test_patterns_that_need_capitals_never_hit(spark):
    (r,) = classified(spark, "ABCDE1234F A1234567")
    assert r.document_type == "unknown"


def test_needles_never_change_a_result(spark):
    """Every pattern with a needle: text that matches must contain the needle."""
    samples = {
        r"enrolment\s*no": "enrolment  no", r"dob\s*:": "dob :", r"vid\s*:\s*\d{16}": "vid: 1234567890123456",
        r"income.tax.department": "income-tax department", r"pan\s*card": "pancard", r"father'?s?\s*name": "fathersname",
        r"income.tax": "income+tax", r"curriculum\s*vitae": "curriculum\nvitae", r"work\s*experience": "workexperience",
        r"skills?\s*:": "skill:", r"projects?\s*:": "project :", r"references?\s*(available)?": "reference",
        r"[a-z0-9.+-]+@[a-z0-9-]+\.[a-z]{2,}": "x.y@z-1.example", r"marks?\s*obtained": "mark obtained",
        r"awarded\s*(the\s*)?(degree|title)": "awardedtitle", r"roll\s*(no|number)": "rollno",
        r"semester\s*[ivx\d]+": "semester 4", r"result\s*(of|declared)": "resultdeclared",
        r"examination\s*(center|centre|board)": "examination centre", r"\bcv\b": "my cv!",
    }
    df = spark.createDataFrame(list(samples.items()), "p string, text string")
    weighted = {p: n for t in classify.WEIGHTED.values() for p, _, n in t}
    for p, text in samples.items():
        row = df.where(F.col("p") == p).select(classify.present(F.col("text"), p, weighted[p]).alias("hit")).first()
        assert row.hit, (p, text)


def test_keywords(spark):
    df = spark.createDataFrame([(1, "result subject grade"), (2, "zzz"), (3, "mrz bachelor")], "doc_id int, text string")
    rows = classify.classify_keywords(df).orderBy("doc_id").collect()
    assert [(r.keyword_type, r.keyword_hits) for r in rows] == [("marksheet", 3), ("unknown", 0), ("passport", 1)]


def test_long_scores_and_argmax(spark):
    df = spark.createDataFrame([(1, "uidai mark sheet"), (2, "x")], "doc_id int, text string")
    scores = classify.classify_scores(df)
    assert scores.count() == 12
    best = {r.doc_id: (r.document_type, r.share) for r in classify.argmax_type(scores).collect()}
    assert best == {1: ("aadhaar", 0.5), 2: ("aadhaar", 0.0)}


def parsed(spark, kind, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = df.withColumn("f", parse_fields(F.col("text"), F.lit(kind)))
    return [r.f for r in df.orderBy("i").collect()]


def test_id_card_fields(spark):
    text = "Government\nAsha Rao\nD0B: 05/06/1990\nFEMALE\n2345-6789 0123\nAddress: 12 Lake Road\nPune 411001\nMale\nrest"
    (f,) = parsed(spark, "aadhaar", text)
    assert (f.aadhaar_number, f.dob, f.gender, f.pincode, f.name) == ("234567890123", "05/06/1990", "Female", "411001", "Asha Rao")
    assert f.address == "12 Lake Road, Pune 411001"
    assert f.raw_text == text and f.pan_number is None


def test_number_is_the_first_twelve_of_sixteen_grouped_digits(spark):
    (f,) = parsed(spark, "aadhaar", "VID 9123 4567 8901 2345")
    assert f.aadhaar_number == "912345678901"


def test_address_strategies(spark):
    label, pin, scan, short, stop, blanks = parsed(
        spark, "aadhaar",
        "x\nS/O: Ravi Das\n\nLine Two\nl3\nl4\nl5\nl6\nl7",
        "one\nFlat 2\nnear market\nnothing\nCity 411001\nafter 1a\nxx\n9z zz",
        "Flat 12\nplain\nMain Street\nend",
        "Flat 12\nplain",
        "Address: Lake View\n1234 5678 9012\nmore",
        "Address: A1\n\n\nB2")
    assert label.address == "Ravi Das, Line Two, l3, l4, l5, l6"
    assert pin.address == "Flat 2, near market, City 411001, after 1a"
    assert scan.address == "Flat 12, Main Street"
    assert short.address is None
    assert stop.address == "Lake View"
    assert blanks.address == "A1"


def test_card_name_needs_a_mark_after_it(spark):
    none, later = parsed(spark, "aadhaar", "Asha Rao\nnothing follows", "x\nAsha Rao\nfoo\n01/02/1999")
    assert none.name is None and later.name == "Asha Rao"


def test_tax_card_fields(spark):
    (f,) = parsed(spark, "pan", "ABCPD1234E\nName: Asha Rao\nFather's Name: RAVI\nKUMAR\n05-06-1990")
    assert (f.pan_number, f.dob, f.father_name) == ("ABCPD1234E", "05-06-1990", "Ravi\nKumar")
    assert f.name == "Asha Rao\nFather"  # the name pattern runs over line ends


def test_passport_fields(spark):
    mrz = "P<IND" + "A" * 39
    (f,) = parsed(spark, "passport", f"A1234567\nNationality: INDIAN\n01/02/1990\n03/04/2010\n05/06/2030\nName: Asha Rao\n{mrz}")
    assert (f.passport_number, f.nationality, f.dob, f.expiry_date, f.surname) == (
        "A1234567", "Indian", "01/02/1990", "05/06/2030", "Asha Rao")
    assert (f.mrz_line1, f.mrz_line2, f.given_names) == (mrz, None, None)


def test_resume_fields(spark):
    f, blank, none = parsed(spark, "resume", "Name: Asha Rao\na.b+c@mail-1.example\n+91 98765 43210\nSkills: sql, spark\npython • r|c\nEducation",
                            "x         y", "nothing")
    assert (f.email, f.phone, f.name) == ("a.b+c@mail-1.example", "+91 98765 43210", "Asha Rao")
    assert f.skills == ["sql", "spark", "python", "r", "c"]
    assert blank.phone == "" and none.phone is None and none.skills == [] and none.email is None


def test_certificate_fields(spark):
    f, bare = parsed(spark, "marksheet", "Name: Asha Rao\nRoll No: R-12/A\n2019\n81.25 %\nThe City College of Arts ",
                     "University of Pune\n1899 2100")
    assert (f.year, f.percentage, f.roll_number, f.student_name, f.institution) == (
        "2019", "81.25 %", "R-12/A", "Asha Rao\nRoll No", "The City College of Arts")
    assert bare.institution is None and bare.year is None  # a letter must come before the word


def test_unknown_type_has_only_raw_text(spark):
    (f,) = parsed(spark, "unknown", "1234 5678 9012 a@b.cd")
    assert {k: v for k, v in f.asDict().items() if v is not None} == {"raw_text": "1234 5678 9012 a@b.cd"}


def test_rank_names(spark):
    df = spark.createDataFrame([(1, 0, "Asha Rao"), (1, 1, "Asha Devi Rao"), (1, 2, "Asha Devi Das"), (1, 3, "Asha Devi Iyer"),
                                (1, 4, "x"), (2, 0, "Bo")], "doc_id int, ord int, name string")
    assert [tuple(r) for r in rank_names(df).collect()] == [(1, "Asha Devi Iyer", 4)]


def test_cleaning_comes_before_classifying(spark):
    df = spark.createDataFrame([(1, "PASSPORT", 0.5, 1)], "doc_id long, text string, confidence double, page_count long")
    assert extract_documents(df).first().document_type == "unknown"  # the capital O became a zero
    assert extract_documents(df, confuse_o=False).first().document_type == "passport"


def checks(spark, kind, **values):
    fields = F.struct(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name)
                        if not isinstance(values.get(f.name), list)
                        else F.array(*[F.lit(v) for v in values[f.name]]).alias(f.name) for f in FIELDS])
    df = spark.range(1).select(check_fields(fields, F.lit(kind), F.lit(AS_OF)).alias("c"))
    return [(c.field_name, c.passed, c.severity) for c in df.first().c]


def test_id_card_rules(spark):
    assert checks(spark, "aadhaar", aadhaar_number="234567890124", dob="01/01/1990", name="A B", gender="Male", pincode="011111") == [
        ("aadhaar_number_format", True, "high"), ("aadhaar_first_digit", True, "high"),
        ("aadhaar_verhoeff_checksum", True, "high"), ("dob_not_future", True, "high"),
        ("dob_realistic_age", True, "medium"), ("name_present", True, "medium"), ("gender_valid", True, "low"),
        ("pincode_valid", False, "low")]
    assert checks(spark, "aadhaar", aadhaar_number="1234", dob="01/01/2025", gender="other") == [
        ("aadhaar_number_format", False, "high"), ("aadhaar_first_digit", False, "high"), ("dob_not_future", False, "high"),
        ("dob_realistic_age", False, "medium"), ("name_present", False, "medium"), ("gender_valid", False, "low")]
    assert checks(spark, "aadhaar", dob="31/02/1990")[:2] == [
        ("aadhaar_number_present", False, "high"), ("dob_present", False, "medium")]
    assert ("dob_realistic_age", False, "medium") in checks(spark, "aadhaar", dob="01/01/1900")


def test_tax_card_rules(spark):
    assert checks(spark, "pan", pan_number="ABCXD1234E", dob="01/01/2030") == [
        ("pan_format", True, "high"), ("pan_entity_code", False, "medium"), ("pan_dob_valid", False, "high"),
        ("pan_name_present", False, "medium")]
    assert checks(spark, "pan", name="A B") == [("pan_number_present", False, "high"), ("pan_name_present", True, "medium")]


def test_passport_rules(spark):
    assert checks(spark, "passport", passport_number="A1234567", dob="01/01/1990", expiry_date="31/12/2024", mrz_line1="A" * 44) == [
        ("passport_number_format", True, "high"), ("passport_dob_past", True, "high"), ("passport_not_expired", False, "high"),
        ("expiry_after_dob", True, "high"), ("mrz_present", True, "medium")]
    assert checks(spark, "passport", expiry_date="01/01/2025") == [
        ("passport_number_present", False, "high"), ("passport_not_expired", True, "low"), ("mrz_present", False, "medium")]
    assert ("expiry_after_dob", False, "high") in checks(spark, "passport", dob="01/01/2030", expiry_date="01/01/2026")


def test_certificate_rules(spark):
    assert checks(spark, "marksheet", year="2026", percentage="100.5 %", institution="X") == [
        ("certificate_year_valid", False, "medium"), ("percentage_range", False, "high"), ("institution_present", True, "medium")]
    assert checks(spark, "graduation_certificate", year="MMXX", percentage="99 %") == [
        ("certificate_year_format", False, "low"), ("percentage_range", True, "low"), ("institution_present", False, "medium")]
    assert checks(spark, "marksheet")[0] == ("certificate_year_present", False, "low")
    assert checks(spark, "marksheet", year="1950")[0] == ("certificate_year_valid", True, "medium")


def test_resume_and_other_rules(spark):
    assert checks(spark, "resume", email="a@b.co", phone="123456", skills=["sql"]) == [
        ("email_format", True, "low"), ("phone_length", False, "low"), ("resume_has_skills", True, "low")]
    assert checks(spark, "resume", phone="", skills=[]) == [("email_present", False, "low"), ("resume_has_skills", False, "low")]
    assert checks(spark, "unknown") == [("doc_type_supported", False, "low")]


def test_report(spark):
    c = F.array(*[F.struct(F.lit("x").alias("field_name"), F.lit(p).alias("passed"), F.lit("m").alias("message"), F.lit(s).alias("severity"))
                  for p, s in [(True, "high"), (False, "high"), (False, "low")]])
    r = spark.range(1).select(summarise_checks(c).alias("r")).first().r
    assert (r.passed, r.failed, r.critical_failures, r.validation_score) == (1, 2, 1, 0.3333)
    assert r.summary == "1/3 checks passed (1 critical failure(s))"


def test_layout_verdict(spark):
    rows = [(1, "aadhaar uidai\na\nb\nc\nd", "aadhaar", 150, 100), (2, "aadhaar", "aadhaar", 300, 100), (3, "x", "unknown", None, None),
            (4, "aadhaar uidai\na\n \nb\nc\nd", "aadhaar", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, document_type string, width int, height int")
    got = {r.doc_id: (r.layout_validation, r.layout_violations) for r in layout_verdict(df).collect()}
    assert got[1] == ("valid", []) and got[4] == ("valid", [])
    assert got[2] == ("invalid", ["keyword_hits=1 (expected ≥2)", "text_lines=1 (expected ≥5)", "aspect_ratio=3.00 (expected 0.55–1.8)"])
    assert got[3][0] == "unknown" and got[3][1][0] == "keyword_hits=0 (expected ≥2)"


def test_lines_are_told_apart_until_there_are_enough(spark):
    """The count is exact below the greatest least number of lines, with every line end and any blank lines; beyond it no text is cut further."""
    from docproof.operators.layout import BREAK, MOST_LINES
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = [(lines, blank + (end + blank).join(["a b"] * lines) + end * 3) for lines in range(1, 13) for end in ends for blank in ("", " \t\x1f", "\n \n")]
    df = spark.createDataFrame([(i, t, "resume", None, None, n) for i, (n, t) in enumerate(texts)],
                               "doc_id int, text string, document_type string, width int, height int, n int")
    for r in layout_verdict(df).collect():
        assert r.layout_violations[1:] == ([f"text_lines={r.n} (expected ≥10)"] if r.n < 10 else []), r
    pieces = spark.range(1).select(F.size(F.split(F.repeat(F.lit("a\n"), 1000), BREAK, MOST_LINES + 2)).alias("n")).first().n
    assert pieces == MOST_LINES + 2


def test_card_layout(spark):
    full = "Unique Identification Government of India uidai aadhaar अ"
    rows = [(1, full, "2", 1585, 1000, 100.0, 50.0, True, True), (2, "x", None, 100, 100, 10.0, 200.0, False, False),
            (3, full, "2", 1585, 1000, None, None, None, None), (4, "uidai 123412341234 अ", None, 1585, 1000, 100.0, 181.0, True, True)]
    df = spark.createDataFrame(rows, "doc_id int, text string, aadhaar_number string, width int, height int, brightness double, "
                                     "saturation double, qr_region_found boolean, photo_found boolean")
    got = {r.doc_id: r.card_layout for r in card_layout_score(df).collect()}
    assert (got[1].status, got[1].penalty, got[1].issues) == ("valid", 0, [])
    assert got[2].status == "invalid" and got[2].penalty == 20 and "penalty=27" in got[2].detail
    assert (got[3].status, got[3].penalty) == ("suspicious", 2)
    assert (got[4].status, got[4].penalty) == ("suspicious", 8)  # 3 for signals, 5 for saturation
