"""QR payloads as columns: kind, XML attributes, plain text, and parts of an inflated payload."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import U, WHITESPACE, blank_to_null, let, strip

# --- fixed values: attribute names and shapes --------------------------------------------
ADDRESS_ATTRIBUTES = ["co", "house", "street", "lm", "loc", "vtc", "subdist", "dist", "state", "country"]
OTHER_ATTRIBUTES = ["signature", "name", "nm", "dob", "yob", "gender", "gentype", "uid", "pc", "m", "mobile_hash"]
TEXT_UID = r"\b([2-9]\d{11})\b"
TEXT_DATE = r"\b(\d{2}[/-]\d{2}[/-]\d{4}|\d{4}[/-]\d{2}[/-]\d{2})\b"
PART_DATE = r"^\d{2}[/-]\d{2}[/-]\d{4}"
PART_NAME = r"^[A-Z][a-z]+(?: [A-Z][a-z]+){0,4}$"
PART_PINCODE = r"^\d{6}$"
MIN_INFLATED = 20
# --- end of fixed values --------------------------------------------------------------

XML = T.StructType(
    [T.StructField(f"_{a}", T.StringType()) for a in OTHER_ATTRIBUTES + ADDRESS_ATTRIBUTES]
    + [T.StructField("_corrupt_record", T.StringType())])

PAYLOAD_FIELDS = ["qr_type", "name", "dob", "gender", "uid_full", "uid_last4", "address", "pincode",
                  "mobile_hash", "has_photo", "parse_error", "fields_found"]


def _payload(**known) -> Column:
    defaults = {"has_photo": F.lit(False), "fields_found": F.array().cast("array<string>")}
    return F.struct(*[
        known.get(n, defaults.get(n, F.lit(None).cast("string"))).alias(n) for n in PAYLOAD_FIELDS])


def _found(**present) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in present.items()]))


def payload_type(payload: Column) -> Column:
    """Kind of a payload that is not compressed."""
    start = F.decode(F.substring(F.encode(payload, "UTF-8"), 1, 50), "UTF-8")
    text = strip(payload)
    return (
        F.when(payload.isNull() | (payload == ""), "not_found")
        .when(F.startswith(text, F.lit("<")) & F.contains(text, F.lit(">")), "xml")
        .when(start.rlike(r"(?U)\d"), "text")
        .otherwise("unknown")
    )


def parse_xml(source: Column) -> Column:
    """Attributes of the root element; bad XML gives a parse error and no field."""
    parsed = F.from_xml(source, XML, {"mode": "PERMISSIVE"})

    def build(x):
        a = lambda n: blank_to_null(x[f"_{n}"])
        either = lambda m, n: F.coalesce(a(m), a(n))
        name, gender, mobile = either("name", "nm"), either("gender", "gentype"), either("m", "mobile_hash")
        uid = blank_to_null(F.regexp_replace(a("uid"), r"(?U)\D", ""))
        address = blank_to_null(F.concat_ws(", ", *[a(n) for n in ADDRESS_ATTRIBUTES]))
        pin = F.when(a("pc").rlike(U + r"^\d{6}$"), a("pc"))
        photo = source.rlike(r"<pht[^>]*>[^<]")
        good = _payload(
            qr_type=F.when(a("signature").isNotNull(), "xml_signed").otherwise("xml_plain"),
            name=name, dob=either("dob", "yob"), gender=gender,
            uid_full=F.when(F.length(uid) == 12, uid),
            uid_last4=F.when(F.length(uid) == 12, F.right(uid, F.lit(4))).when(F.length(uid) == 4, uid),
            address=address, pincode=pin, mobile_hash=mobile, has_photo=photo,
            fields_found=_found(
                name=name.isNotNull(), dob=a("dob").isNotNull(),
                dob_year=a("dob").isNull() & a("yob").isNotNull(), gender=gender.isNotNull(),
                uid=uid.isNotNull(), address=address.isNotNull(), pincode=pin.isNotNull(),
                photo=photo, mobile_hash=mobile.isNotNull()))
        bad = _payload(qr_type=F.lit("xml_plain"), parse_error=F.lit("XML parse error"))
        return F.when(x["_corrupt_record"].isNull(), good).otherwise(bad)

    return F.when(source.isNotNull(), let(parsed, build))


def parse_text(source: Column) -> Column:
    uid = blank_to_null(F.regexp_extract(source, U + TEXT_UID, 1))
    dob = blank_to_null(F.regexp_extract(source, U + TEXT_DATE, 1))
    return _payload(qr_type=F.lit("text_plain"), uid_full=uid, uid_last4=F.right(uid, F.lit(4)), dob=dob,
                    fields_found=_found(uid=uid.isNotNull(), dob=dob.isNotNull()))


def parse_parts(inflated: Column) -> Column:
    """Readable parts between control characters; the last part of a kind wins."""
    parts = F.filter(F.transform(F.split(inflated, r"[\x00-\x1f]+"), strip), lambda p: F.length(p) >= 3)

    def build(ps):
        last = lambda test: F.try_element_at(F.filter(ps, test), F.lit(-1))
        only_digits = lambda p: F.regexp_replace(p, r"(?U)\D", "")
        dob = last(lambda p: p.rlike(U + PART_DATE))
        uid = only_digits(last(lambda p: F.length(only_digits(p)) == 12))
        name = last(lambda p: p.rlike(PART_NAME))
        pin = last(lambda p: p.rlike(U + PART_PINCODE))
        return _payload(qr_type=F.lit("secure_v2"), dob=dob, uid_full=uid, uid_last4=F.right(uid, F.lit(4)),
                        name=name, pincode=pin,
                        fields_found=_found(dob=dob.isNotNull(), uid=uid.isNotNull(),
                                            name=name.isNotNull(), pincode=pin.isNotNull()))

    return let(parts, build)


def decode_qr(df: DataFrame, payload: str = "payload", inflated: str = "inflated") -> DataFrame:
    """Add ``qr``: the parsed payload of whichever kind it is."""
    p, i = F.col(payload), F.col(inflated)
    is_xml = F.contains(i, F.lit("<")) & F.contains(i, F.lit(">"))
    kind = (F.when(p.isNull() | (p == ""), "not_found")
            .when((F.length(i) > MIN_INFLATED) & is_xml, "inflated_xml")
            .when(F.length(i) > MIN_INFLATED, "inflated_parts")
            .otherwise(payload_type(p)))
    source = F.when(F.col("_kind") == "inflated_xml", i).when(F.col("_kind") == "xml", p)
    qr = (F.when(F.col("_xml_text").isNotNull(), parse_xml(F.col("_xml_text")))
          .when(F.col("_kind") == "inflated_parts", parse_parts(i))
          .when(F.col("_kind") == "text", parse_text(p))
          .when(F.col("_kind") == "unknown", _payload(
              qr_type=F.lit("unknown"),
              parse_error=F.concat(F.lit("Unknown QR format — "),
                                   F.octet_length(p).cast("string"), F.lit(" bytes"))))
          .otherwise(_payload(qr_type=F.lit("not_found"))))
    return (
        df.withColumn("_kind", kind)
        .withColumn("_xml_text", F.ltrim(strip(source), F.lit("\ufeff")))
        # A generator: filters on and columns of the payload are not rewritten through it, so each payload is parsed once.
        .select(*df.columns, F.inline(F.array(F.struct(qr.alias("qr")))))
    )
