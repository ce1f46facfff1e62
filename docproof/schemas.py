"""Fixed schemas and enumerations. Nothing is inferred at run time."""

from pyspark.sql import types as T

# --- fixed values: document types in declaration order (ties go to the earlier one) ---
DOC_TYPES = [
    "aadhaar",
    "pan",
    "passport",
    "resume",
    "graduation_certificate",
    "marksheet",
]
UNKNOWN = "unknown"
ID_CARD, TAX_CARD, PASSPORT, RESUME, DEGREE, MARKSHEET = DOC_TYPES

# --- fixed values: final verdict labels ---
GENUINE = "Likely Genuine"
SUSPICIOUS = "Suspicious"
FAKE = "Likely Fake / Tampered"

#: One box of one OCR engine; ``ord`` is the engine's own reading order on the page.
BOXES = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("page_no", T.IntegerType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("engine", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("x0", T.IntegerType()),
    T.StructField("y0", T.IntegerType()),
    T.StructField("x1", T.IntegerType()),
    T.StructField("y1", T.IntegerType()),
])

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("page_count", T.LongType()),
])

SIGNALS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("ela_score", T.DoubleType()),
    T.StructField("blur_score", T.DoubleType()),
    T.StructField("dct_mid_ratio", T.DoubleType()),
    T.StructField("noise_uniformity", T.DoubleType()),
    T.StructField("edge_density", T.DoubleType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("brightness", T.DoubleType()),
    T.StructField("saturation", T.DoubleType()),
    T.StructField("qr_region_found", T.BooleanType()),
    T.StructField("photo_found", T.BooleanType()),
    T.StructField("suffix", T.StringType()),
    T.StructField("exif_state", T.StringType()),
    T.StructField("software", T.StringType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("datetime_original", T.StringType()),
])

#: Union of the fields of all document types; a type fills its own part, the rest is NULL.
FIELDS = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "name", "dob", "gender", "aadhaar_number", "address", "pincode",
        "father_name", "pan_number",
        "surname", "given_names", "nationality", "passport_number", "expiry_date",
        "mrz_line1", "mrz_line2",
        "email", "phone",
    )]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("skills", "education", "experience")]
    + [T.StructField(n, T.StringType()) for n in (
        "student_name", "institution", "degree", "year", "roll_number", "percentage",
        "raw_text",
    )]
)

CHECK = T.StructType([
    T.StructField("field_name", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
])

#: What a vision-model reply may hold (all optional).
REPLY_JSON = T.StructType([
    T.StructField("document_type_confirmed", T.StringType()),
    T.StructField("vlm_confidence", T.DoubleType()),
    T.StructField("field_validation", T.MapType(T.StringType(), T.StringType())),
    T.StructField("logical_inconsistencies", T.ArrayType(T.StringType())),
    T.StructField("fraud_signals", T.ArrayType(T.StructType([
        T.StructField("signal", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]))),
    T.StructField("font_consistency", T.StringType()),
    T.StructField("layout_authenticity", T.StringType()),
    T.StructField("seal_signature_present", T.BooleanType()),
    T.StructField("visible_tampering", T.BooleanType()),
    T.StructField("overall_assessment", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("suggested_risk_adjustment", T.DoubleType()),
])
