"""Two sources of truth per document: fields read by OCR, and the decoded QR payload."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checksum import digits
from ..functions.dates import date_digits, date_without_separators
from ..functions.text import blank_to_null, mask_id, strip, token_match, tokens_match, name_tokens, valid_name, let

# --- fixed values: similarity levels and points ------------------------------------------
DEEP_NAME, QUICK_NAME = 0.55, 0.6
POINTS = {"no_qr": 5, "decode_error": 8, "suspicious": 5, "verified": -5, "partial_match": 10, "mismatch": 30}
# --- end of fixed values --------------------------------------------------------------


def _pair(field: str, qr: Column, ocr: Column, matched: Column, counts=None, note: Column = None) -> Column:
    return F.struct(
        F.lit(field).alias("field"), qr.alias("qr"), ocr.alias("ocr"), matched.alias("matched"),
        (F.lit(True) if counts is None else counts).alias("counts"),
        (F.lit(None).cast("string") if note is None else note).alias("note"))


def _said(label: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(f"{label} QR='"), a, F.lit("' vs OCR='"), b, F.lit("'"))


def compare(df: DataFrame, qr: str = "qr", name: str = "name", dob: str = "dob",
            number: str = "aadhaar_number", gender: str = "gender") -> DataFrame:
    """Add ``match``: (status, penalty, pairs, mismatches, matches, summary).

    The OCR columns must be the uncorrected readings; comparing corrected ones would compare
    the QR with itself.
    """
    q = lambda n: blank_to_null(F.col(f"{qr}.{n}"))
    o_name, o_dob, o_gender = (blank_to_null(F.col(n)) for n in (name, dob, gender))
    o_uid = blank_to_null(digits(F.col(number)))
    qr_name, ocr_name = strip(q("name")), strip(o_name)
    year = F.left(q("dob"), F.lit(4))
    same_date = (date_digits(q("dob")) == date_digits(o_dob)) | (
        year.rlike(r"(?U)^\d{4}$") & (year == F.left(o_dob, F.lit(4))))
    last4 = F.right(o_uid, F.lit(4))
    same_gender = F.upper(F.left(q("gender"), F.lit(1))) == F.upper(F.left(o_gender, F.lit(1)))
    pairs = F.array_compact(F.array(
        F.when(q("name").isNotNull() & o_name.isNotNull(), _pair(
            "name", qr_name, ocr_name, token_match(qr_name, ocr_name, DEEP_NAME),
            note=_said("name:", qr_name, ocr_name))),
        F.when(q("dob").isNotNull() & o_dob.isNotNull(), _pair(
            "dob", q("dob"), o_dob, same_date, note=_said("dob:", q("dob"), o_dob))),
        F.when(q("uid_full").isNotNull() & o_uid.isNotNull(), _pair(
            "aadhaar_number", mask_id(q("uid_last4")), mask_id(o_uid), q("uid_full") == o_uid,
            note=_said("aadhaar_number: last4", q("uid_last4"), last4))),
        F.when(q("uid_full").isNull() & q("uid_last4").isNotNull() & (F.length(o_uid) >= 4), _pair(
            "aadhaar_last4", mask_id(q("uid_last4")), mask_id(o_uid), q("uid_last4") == last4,
            note=_said("aadhaar last4:", q("uid_last4"), last4))),
        # A gender that differs is recorded but never counted against the document.
        F.when(q("gender").isNotNull() & o_gender.isNotNull(), _pair(
            "gender", q("gender"), o_gender, same_gender, counts=same_gender)),
    ))
    p, found = F.col("_pairs"), F.col(f"{qr}.fields_found")
    hits = F.filter(p, lambda x: x["matched"])
    misses = F.filter(p, lambda x: ~x["matched"] & x["counts"])
    n_hit, n_miss = F.col("_hits"), F.size("_misses")
    checked = n_hit + n_miss
    absent = F.col(qr).isNull() | (F.col(f"{qr}.qr_type") == "not_found")
    empty = F.size(found) == 0
    error = q("parse_error")
    status = (
        F.when(absent, "no_qr")
        .when(error.isNotNull() & empty, "decode_error")
        .when(empty | (checked == 0), "suspicious")
        .when(n_miss == 0, "verified")
        .when(n_miss >= 2, "mismatch")
        .otherwise("partial_match"))
    s = F.col("_status")
    notes = F.array_join("_misses", "; ")
    summary = (
        F.when(s == "no_qr", "No QR code found — cannot perform QR cross-validation")
        .when(s == "decode_error", F.concat(F.lit("QR decode error: "), error))
        .when(empty, "QR found but no Aadhaar fields extracted — suspicious structure")
        .when(s == "suspicious", "QR decoded but no comparable fields found in OCR")
        .when(s == "verified", F.concat(
            F.lit("QR VERIFIED — "), n_hit.cast("string"), F.lit("/"), checked.cast("string"),
            F.lit(" fields match (type: "), F.col(f"{qr}.qr_type"), F.lit(")")))
        .when(s == "mismatch", F.concat(
            F.lit("QR MISMATCH — "), n_miss.cast("string"), F.lit(" field(s) differ: "), notes))
        .otherwise(F.concat(
            F.lit("QR PARTIAL — "), n_hit.cast("string"), F.lit(" match, "), n_miss.cast("string"),
            F.lit(" mismatch: "), notes)))
    points = F.create_map(*[F.lit(v) for kv in POINTS.items() for v in kv])
    return (
        df.withColumn("_pairs", pairs)
        .withColumn("_hits", F.size(hits))
        .withColumn("_misses", F.transform(misses, lambda x: x["note"]))
        .withColumn("_status", status)
        .withColumn("match", F.struct(
            s.alias("status"),
            points[s].alias("penalty"),
            F.coalesce(F.col(f"{qr}.qr_type"), F.lit("not_found")).alias("qr_type"),
            F.coalesce(found, F.array().cast("array<string>")).alias("fields_found"),
            F.transform(hits, lambda x: x["field"]).alias("matches"),
            F.col("_misses").alias("mismatches"),
            F.transform(p, lambda x: F.struct(x["field"].alias("field"), x["qr"].alias("qr"),
                                              x["ocr"].alias("ocr"), x["matched"].alias("match"))).alias("pairs"),
            summary.alias("summary"),
        ))
        .drop("_pairs", "_hits", "_misses", "_status")
    )


def reconcile_qr_ocr(ocr: DataFrame, qr: DataFrame) -> DataFrame:
    """ocr(doc_id, name, dob, aadhaar_number, gender) left join decoded qr(doc_id, qr)."""
    return compare(ocr.join(qr.select("doc_id", "qr"), "doc_id", "left"))


def correct_from_qr(df: DataFrame, name: str = "name", dob: str = "dob") -> DataFrame:
    """Add corrected_name, corrected_dob and the map of fields filled in from the QR.

    Reads ``match`` and ``qr``. A name that matched takes the QR's spelling; missing fields are
    filled only where the QR was accepted. The original columns stay as they were read.
    """
    accepted = F.col("match.status").isin("verified", "partial_match")
    own_name, own_dob = blank_to_null(F.col(name)), blank_to_null(F.col(dob))
    qr_name, qr_dob = blank_to_null(F.col("qr.name")), blank_to_null(F.col("qr.dob"))
    fill = lambda own, other: F.when(own.isNull() & accepted, other)
    filled = {"name": fill(own_name, qr_name), "dob": fill(own_dob, qr_dob)}
    entries = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in filled.items()]))
    matched = F.array_contains("match.matches", "name")
    return df.withColumns({
        "corrected_name": F.coalesce(F.when(matched, strip(qr_name)), own_name, filled["name"]),
        "corrected_dob": F.coalesce(own_dob, filled["dob"]),
        "corrections": F.map_from_entries(entries),
    })


def quick_verdict(df: DataFrame, name: str = "name", dob: str = "dob") -> DataFrame:
    """Add qr_quick and quick_name. Only an XML payload carries fields for this older check.

    A differing name is replaced by the QR's and never held against the document, so only a
    differing date gives a mismatch.
    """
    plain_xml = F.startswith(strip(F.col("payload")), F.lit("<"))
    q = lambda n: blank_to_null(F.when(plain_xml, strip(F.col(f"qr.{n}"))))
    qr_name, qr_dob = q("name"), q("dob")
    own_name, own_dob = blank_to_null(strip(F.col(name))), blank_to_null(strip(F.col(dob)))
    usable = valid_name(own_name, max_words=6, min_alpha=0.75)
    agrees = let(
        F.struct(name_tokens(qr_name).alias("a"), name_tokens(own_name).alias("b")),
        lambda t: tokens_match(t["a"], t["b"], QUICK_NAME) | F.arrays_overlap(t["a"], t["b"]))
    same_date = date_without_separators(qr_dob) == date_without_separators(own_dob)
    return df.withColumns({
        "qr_quick": F.when(qr_name.isNull() & qr_dob.isNull(), "not_found")
                     .when(F.coalesce(same_date, F.lit(True)), "verified").otherwise("mismatch"),
        "quick_name": F.when(qr_name.isNotNull() & ~(usable & F.coalesce(agrees, F.lit(False))), qr_name)
                       .otherwise(F.col(name)),
    })


def qr_quick_verdict(ocr: DataFrame, qr: DataFrame) -> DataFrame:
    return quick_verdict(ocr.join(qr.select("doc_id", "payload", "qr"), "doc_id", "left"))
