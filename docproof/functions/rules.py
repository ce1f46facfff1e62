"""Business rules on extracted fields. Each rule yields a check struct, or NULL if it does not apply.

"Today" is always passed in as ``as_of``, so a run can be repeated.
"""

from pyspark.sql import Column, functions as F

from ..schemas import CHECK, DEGREE, ID_CARD, MARKSHEET, PASSPORT, RESUME, TAX_CARD
from .checksum import digits, verhoeff_check
from .dates import parse_date
from .parse import first
from .text import U, UI, blank_to_null, let

# --- fixed values: accepted forms -----------------------------------------------------
ENTITY_CODES = "ABCFGHLJPTK"
GENDERS = ["male", "female", "transgender", ""]
FIRST_YEAR = 1950
DATES = ["dob", "expiry_date"]
# --- end of fixed values --------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def check(name: str, passed, message, severity) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(name).alias("field_name"),
        F.coalesce(as_col(passed), F.lit(False)).alias("passed"),
        as_col(message).alias("message"),
        as_col(severity).alias("severity"),
    )


def _presence(name: str, value: Column, found: str, missing: str, severity: str) -> Column:
    return check(name, value.isNotNull(), F.when(value.isNotNull(), found).otherwise(missing), severity)


def id_card_rules(f, date, as_of: Column) -> list[Column]:
    number, name, pin = f("aadhaar_number"), f("name"), f("pincode")
    dob, gender = date("dob"), F.lower(F.coalesce(f("gender"), F.lit("")))
    clean = digits(number)
    length = F.length(clean)
    checksum = verhoeff_check(clean)
    age = F.floor(F.date_diff(as_of, dob) / 365)
    pin_ok = pin.rlike(U + r"^[1-9]\d{5}$")
    has = lambda c, rule: F.when(c.isNotNull(), rule)
    lacks = lambda c, rule: F.when(c.isNull(), rule)
    return [
        has(number, check("aadhaar_number_format", length == 12,
                          _text("Aadhaar must be 12 digits (got ", length.cast("string"), ")"), "high")),
        has(number, check("aadhaar_first_digit", (length >= 1) & ~F.left(clean, F.lit(1)).isin("0", "1"),
                          "First digit of Aadhaar cannot be 0 or 1", "high")),
        F.when(length == 12, check("aadhaar_verhoeff_checksum", checksum["valid"], checksum["reason"], "high")),
        lacks(number, check("aadhaar_number_present", False, "Aadhaar number not found", "high")),
        has(dob, check("dob_not_future", dob < as_of,
                       F.when(dob >= as_of, _text("DOB ", dob.cast("string"), " is in the future")).otherwise("DOB OK"),
                       "high")),
        has(dob, check("dob_realistic_age", (age > 0) & (age < 120),
                       _text("Age computed as ", age.cast("string"), " years — ",
                             F.when(age >= 120, "suspicious").otherwise("OK")), "medium")),
        lacks(dob, check("dob_present", False, "DOB not found", "medium")),
        _presence("name_present", name, "Name field extracted", "Name not detected", "medium"),
        check("gender_valid", gender.isin(*GENDERS),
              F.when(gender == "", "Gender not found").otherwise(_text("Gender value '", gender, "' is valid")), "low"),
        has(pin, check("pincode_valid", pin_ok,
                       F.when(pin_ok, _text("Pincode ", pin, " valid")).otherwise(_text("Invalid pincode: ", pin)),
                       "low")),
    ]


def tax_card_rules(f, date, as_of: Column) -> list[Column]:
    pan, name, dob = f("pan_number"), f("name"), date("dob")
    ok = pan.rlike(U + r"^[A-Z]{5}\d{4}[A-Z]$")
    fourth = F.substring(pan, 4, 1)
    entity = (F.length(pan) >= 4) & F.contains(F.lit(ENTITY_CODES), fourth)
    return [
        F.when(pan.isNotNull(), check(
            "pan_format", ok, _text("PAN format ", F.when(ok, "valid").otherwise("INVALID"), ": ", pan), "high")),
        F.when(pan.isNotNull(), check(
            "pan_entity_code", entity,
            F.when(entity, _text("PAN 4th char '", fourth, "' entity code valid")).otherwise("Invalid PAN entity code"),
            "medium")),
        F.when(pan.isNull(), check("pan_number_present", False, "PAN number not found", "high")),
        F.when(dob.isNotNull(), check(
            "pan_dob_valid", dob < as_of,
            F.when(dob < as_of, "DOB is valid").otherwise("DOB is in the future"), "high")),
        _presence("pan_name_present", name, "Name present", "Name missing", "medium"),
    ]


def passport_rules(f, date, as_of: Column) -> list[Column]:
    number, mrz = f("passport_number"), f("mrz_line1")
    dob, expiry = date("dob"), date("expiry_date")
    ok, expired = number.rlike(U + r"^[A-Z]\d{7}$"), expiry < as_of
    return [
        F.when(number.isNotNull(), check(
            "passport_number_format", ok,
            _text("Passport number ", F.when(ok, "valid").otherwise("INVALID"), ": ", number), "high")),
        F.when(number.isNull(), check("passport_number_present", False, "Passport number missing", "high")),
        F.when(dob.isNotNull(), check(
            "passport_dob_past", dob < as_of,
            F.when(dob < as_of, "DOB is valid").otherwise("DOB in future"), "high")),
        F.when(expiry.isNotNull(), check(
            "passport_not_expired", ~expired,
            F.when(expired, "Passport is expired").otherwise(_text("Passport valid until ", expiry.cast("string"))),
            F.when(expired, "high").otherwise("low"))),
        F.when(dob.isNotNull() & expiry.isNotNull(), check(
            "expiry_after_dob", expiry > dob,
            F.when(expiry > dob, "Expiry is after DOB").otherwise("Expiry date before DOB — impossible"), "high")),
        check("mrz_present", F.length(mrz) >= 40,
              F.when(mrz.isNotNull(), "MRZ line detected").otherwise("MRZ line not found"), "medium"),
    ]


def certificate_rules(f, date, as_of: Column) -> list[Column]:
    year, institution = f("year"), f("institution")
    number = year.try_cast("int")
    in_range = number.between(F.lit(FIRST_YEAR), F.year(as_of))
    value = first(f("percentage"), r"(\d+(?:\.\d+)?)").cast("double")
    possible = value.between(0, 100)
    return [
        F.when(number.isNotNull(), check(
            "certificate_year_valid", in_range,
            _text("Certificate year ", number.cast("string"), " is ", F.when(in_range, "valid").otherwise("suspicious")),
            "medium")),
        F.when(year.isNotNull() & number.isNull(), check(
            "certificate_year_format", False, _text("Cannot parse year: ", year), "low")),
        F.when(year.isNull(), check(
            "certificate_year_present", False, "Year not found in certificate", "low")),
        F.when(value.isNotNull(), check(
            "percentage_range", possible,
            F.when(possible, _text("Percentage ", value.cast("string"), "% in valid range"))
             .otherwise(_text("Impossible percentage: ", value.cast("string"), "%")),
            F.when(value > 100, "high").otherwise("low"))),
        _presence("institution_present", institution,
                  "Institution name found", "Institution name missing", "medium"),
    ]


def resume_rules(f, date, as_of: Column) -> list[Column]:
    email, phone = f("email"), f("phone")
    ok = email.rlike(UI + r"^[\w.+-]+@[\w-]+\.[a-z]{2,}$")
    count = F.length(digits(phone))
    fits = count.between(7, 15)
    listed = F.coalesce(F.size(f("skills")) > 0, F.lit(False))
    return [
        F.when(email.isNotNull(), check(
            "email_format", ok, _text("Email ", F.when(ok, "valid").otherwise("invalid"), ": ", email), "low")),
        F.when(email.isNull(), check("email_present", False, "No email found in resume", "low")),
        F.when(phone.isNotNull(), check(
            "phone_length", fits,
            _text("Phone digit count ", count.cast("string"), ": ", F.when(fits, "OK").otherwise("suspicious")), "low")),
        check("resume_has_skills", listed,
              F.when(listed, "Skills section found").otherwise("No skills listed"), "low"),
    ]


#: Extension point: document type -> rules, a function of field(name), date(name) and as_of.
RULES = {
    ID_CARD: id_card_rules,
    TAX_CARD: tax_card_rules,
    PASSPORT: passport_rules,
    RESUME: resume_rules,
    DEGREE: certificate_rules,
    MARKSHEET: certificate_rules,
}


def check_fields(fields: Column, doc_type: Column, as_of: Column, rules: dict = RULES) -> Column:
    """Array of the checks that apply to a document, in rule order."""
    def field(name):
        value = fields[name]
        return value if name == "skills" else blank_to_null(value)

    # A date is read once for all rules that ask for it.
    dates = F.struct(*[parse_date(field(n)).alias(n) for n in DATES])
    by_rules = {}
    for kind, rule in rules.items():
        by_rules.setdefault(rule, []).append(kind)
    empty = F.array().cast(f"array<{CHECK.simpleString()}>")
    chosen = None
    for rule, kinds in by_rules.items():
        checks = let(dates, lambda d: F.array_compact(F.array(*rule(field, lambda name: d[name], as_of))))
        chosen = (F if chosen is None else chosen).when(doc_type.isin(*kinds), checks)
    unsupported = F.array(check(
        "doc_type_supported", False, F.concat(F.lit("No validation rules for "), doc_type), "low"))
    return F.coalesce(chosen.otherwise(unsupported), empty)


def summarise_checks(checks: Column) -> Column:
    """Report struct from the check array of one document; nothing is shuffled."""
    passed = F.size(F.filter(checks, lambda c: c["passed"]))
    failed = F.size(checks) - passed
    critical = F.size(F.filter(checks, lambda c: ~c["passed"] & (c["severity"] == "high")))
    return report_struct(passed, failed, critical)


def report_struct(passed: Column, failed: Column, critical: Column) -> Column:
    total = passed + failed
    return F.struct(
        passed.cast("int").alias("passed"),
        failed.cast("int").alias("failed"),
        critical.cast("int").alias("critical_failures"),
        F.when(total > 0, F.bround(passed / total, 4)).otherwise(1.0).alias("validation_score"),
        F.concat(passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" checks passed ("),
                 critical.cast("string"), F.lit(" critical failure(s))")).alias("summary"),
    )
