"""Layout verdicts: keyword, line-count and shape rules per document type."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import U, WS, fixed2, not_blank
from ..schemas import UNKNOWN

# --- fixed values: (keywords, least lines, least and greatest width/height) -------------
SPECS = {
    "aadhaar": (["aadhaar", "uidai", "unique", "government", "india", "enrolment"], 5, 0.55, 1.8),
    "pan": (["permanent", "account", "income", "tax", "department"], 5, 0.55, 1.8),
    "passport": (["passport", "republic", "india", "nationality", "surname"], 8, 0.6, 1.6),
    "resume": (["experience", "education", "skills", "email", "name"], 10, 0.6, 1.8),
    "graduation_certificate": (["university", "degree", "awarded", "student", "college"], 5, 0.6, 1.8),
    "marksheet": (["marks", "examination", "roll", "subject", "result"], 6, 0.6, 1.8),
}
DEFAULT_SPEC = ([], 4, 0.5, 2.5)
MIN_KEYWORD_HITS = 2
CARD_RATIO = 85.6 / 54.0
CARD_TOLERANCE = 0.15
CARD_SIGNALS = ["unique identification", "government of india", "uidai", "aadhaar"]
DARK_BELOW, SATURATED_ABOVE = 40, 180
# --- end of fixed values --------------------------------------------------------------

MOST_LINES = max(least for _, least, _, _ in [*SPECS.values(), DEFAULT_SPEC])
#: The end of a line and what white space follows. Single Latin characters of a class are looked up in one table.
BREAK = f"(?U)[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028-\\u2029]{WS}*"


def _by_type(doc_type: Column, pick) -> Column:
    chosen = None
    for kind, spec in SPECS.items():
        chosen = (F if chosen is None else chosen).when(doc_type == kind, pick(spec))
    return chosen.otherwise(pick(DEFAULT_SPEC))


def layout_verdict(df: DataFrame, text: str = "text", doc_type: str = "document_type",
                   width: str = "width", height: str = "height") -> DataFrame:
    """Add layout_validation (valid / invalid / unknown) and layout_violations."""
    kind, w, h = F.col(doc_type), F.col(width), F.col(height)
    lower = F.lower(F.col(text))
    hits = _by_type(kind, lambda s: sum(
        (F.contains(lower, F.lit(k)).cast("int") for k in s[0]), F.lit(0)))
    # Lines are told apart until every type has enough of them; white space after a line's end is the end's, so that no blank line counts.
    lines = F.size(F.filter(F.split(F.col(text), BREAK, MOST_LINES + 2), lambda ln: not_blank(ln)))
    ratio = F.when(h > 0, w / h).when(w.isNotNull() & h.isNotNull(), 1.0)
    low, high = _by_type(kind, lambda s: F.lit(s[2])), _by_type(kind, lambda s: F.lit(s[3]))
    least = _by_type(kind, lambda s: F.lit(s[1]))
    return (
        df.withColumns({"_hits": hits, "_lines": lines, "_ratio": ratio})
        .withColumn("layout_violations", F.array_compact(F.array(
            F.when(F.col("_hits") < MIN_KEYWORD_HITS, F.concat(
                F.lit("keyword_hits="), F.col("_hits").cast("string"), F.lit(f" (expected ≥{MIN_KEYWORD_HITS})"))),
            F.when(F.col("_lines") < least, F.concat(
                F.lit("text_lines="), F.col("_lines").cast("string"), F.lit(" (expected ≥"),
                least.cast("string"), F.lit(")"))),
            F.when(~F.col("_ratio").between(low, high), F.concat(
                F.lit("aspect_ratio="), fixed2(F.col("_ratio")), F.lit(" (expected "),
                low.cast("string"), F.lit("–"), high.cast("string"), F.lit(")"))),
        )))
        .withColumn("layout_validation",
                    F.when(kind == UNKNOWN, "unknown")
                    .when(F.size("layout_violations") > 0, "invalid").otherwise("valid"))
        .drop("_hits", "_lines", "_ratio")
    )


def card_layout_score(df: DataFrame, text: str = "text", number: str = "aadhaar_number", only: Column | None = None) -> DataFrame:
    """Add card_layout: (status, penalty, issues, detail) for ID cards. Rows outside ``only`` are not tested, their answers mean nothing.

    Reads width, height, brightness, saturation, qr_region_found and photo_found. A NULL
    brightness, saturation or photo answer means a grey image, which passes those tests.
    """
    c = F.col
    lower = F.lower(c(text))
    ratio = F.when((c("width") > 0) & (c("height") > 0), c("width") / c("height"))
    off = F.abs(ratio - CARD_RATIO) / CARD_RATIO
    missing = F.filter(F.array(*[F.lit(s) for s in CARD_SIGNALS]), lambda s: ~F.contains(c("_lower"), s))
    found = len(CARD_SIGNALS) - F.size(c("_missing"))
    listed = F.concat(F.lit("['"), F.array_join("_missing", "', '"), F.lit("']"))
    unreadable = (c(number).isNull() & ~c("_lower").rlike(U + r"\b\d{4}\s+\d{4}\s+\d{4}\b")
                  & ~c("_lower").rlike(U + r"\d{12}"))
    dark = c("brightness") < DARK_BELOW
    tests = [
        (off > CARD_TOLERANCE, 5, F.concat(
            F.lit("Aspect ratio "), fixed2(ratio), F.lit(" deviates from standard "),
            F.lit(f"{CARD_RATIO:.2f}"), F.lit(" by "), F.replace(F.format_number(off * 100, 1), F.lit(","), F.lit("")),
            F.lit("%"))),
        (found == 0, 8, F.concat(F.lit("Missing critical Aadhaar text signals: "), listed)),
        (found == 1, 3, F.concat(F.lit("Some Aadhaar text signals absent: "), listed)),
        (unreadable, 4, F.lit("Aadhaar number not found or incorrectly formatted")),
        (~c("_lower").rlike("[\u0900-\u097F]"), 2, F.lit("Devanagari (Hindi) script not detected")),
        (dark, 3, F.concat(F.lit("Image very dark (brightness="), F.format_number(c("brightness"), 0),
                           F.lit(") — possible heavily degraded scan"))),
        (~dark & (c("saturation") > SATURATED_ABOVE), 5, F.concat(
            F.lit("Unusually high saturation ("), F.format_number(c("saturation"), 0),
            F.lit(") — possible AI-generated/printed fake"))),
        (~F.coalesce(c("qr_region_found"), F.lit(False)), 2, F.lit("QR code region not detected visually")),
        (~c("photo_found"), 3, F.lit("Biometric photo region not detected")),
    ]
    issues = F.array_compact(F.array(*[
        F.when(failed, F.struct(F.lit(points).alias("points"), text_.alias("text")))
        for failed, points, text_ in tests]))
    if only is not None:
        missing, issues = F.when(only, missing), F.when(only, issues)
    points = F.aggregate("_issues", F.lit(0), lambda total, i: total + i["points"])
    status = (F.when(F.size("_issues") == 0, "valid").when(c("_points") <= 8, "suspicious").otherwise("invalid"))
    texts = F.transform("_issues", lambda i: i["text"])
    return (
        df.withColumn("_lower", lower)
        .withColumn("_missing", missing)
        .withColumn("_issues", issues)
        .withColumn("_points", points)
        .withColumn("card_layout", F.struct(
            status.alias("status"),
            F.least(c("_points"), F.lit(20)).alias("penalty"),
            texts.alias("issues"),
            F.concat(F.lit("Layout "), status, F.lit(": "), F.size("_issues").cast("string"),
                     F.lit(" issue(s), penalty="), c("_points").cast("string"), F.lit(". "),
                     F.when(F.size("_issues") == 0, "All checks passed.")
                      .otherwise(F.array_join(texts, "; "))).alias("detail"),
        ))
        .drop("_lower", "_missing", "_issues", "_points")
    )
