"""Output for people and for audit: summary lines, stage names, one JSON per document."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import title_case
from ..schemas import ID_CARD

# --- fixed values: stage names in order ----------------------------------------------------
STAGES = [
    "load_images", "layout_detection", "ocr_extraction", "document_classification", "field_parsing",
    "llm_credential_extraction", "vlm_understanding", "fraud_detection", "qr_validation",
    "aadhaar_deep_verification", "validation_engine", "risk_scoring",
]
CARD_STAGE = "aadhaar_deep_verification"
# --- end of fixed values --------------------------------------------------------------


def audit_stages(doc_type: Column) -> Column:
    """Ordered stage names; ID cards have one more."""
    return F.array_compact(F.array(*[
        F.when(doc_type == ID_CARD, s) if s == CARD_STAGE else F.lit(s) for s in STAGES]))


def human_summary(df: DataFrame) -> DataFrame:
    """Add human_summary: ten fixed lines and up to three that appear when there is something to say."""
    reply, checks = F.col("reply"), F.col("checks")
    words = lambda c: title_case(F.replace(c, F.lit("_"), F.lit(" ")))
    high = F.transform(F.filter(reply["fraud_signals"], lambda s: s["severity"] == "high"), lambda s: s["signal"])
    failed = F.transform(F.filter(checks, lambda c: ~c["passed"] & (c["severity"] == "high")), lambda c: c["message"])
    line = lambda label, *parts: F.concat(F.lit(label), *parts)
    listed = lambda label, items: F.when(F.size(items) > 0, line(label, F.array_join(items, "; ")))
    return df.withColumn("human_summary", F.concat_ws(
        "\n",
        line("Document Type: ", words(F.col("document_type"))),
        line("Verification Status: ", F.col("status")),
        line("Risk Score: ", F.col("risk_score").cast("string"), F.lit("/100")),
        line("OCR Confidence: ", F.format_number(F.col("confidence") * 100, 0), F.lit("%")),
        line("VLM Assessment: ", title_case(reply["overall_assessment"]), F.lit(" — "), reply["reasoning"]),
        line("Layout Authenticity: ", words(reply["layout_authenticity"])),
        line("Font Consistency: ", words(reply["font_consistency"])),
        line("Visible Tampering Detected: ", F.when(reply["visible_tampering"], "Yes ⚠️").otherwise("No ✓")),
        line("Seal/Signature Present: ", F.when(reply["seal_signature_present"], "Yes ✓").otherwise("Not detected")),
        line("Validation: ", F.col("report.summary")),
        listed("High-Severity Fraud Signals: ", high),
        listed("Critical Field Issues: ", failed),
        listed("Logical Inconsistencies: ", reply["logical_inconsistencies"]),
    ))


#: What a card's part of the response is called, by the evidence it comes from.
CARD_PARTS = {
    "card": {"verhoeff_valid": "verhoeff_valid", "verhoeff_reason": "verhoeff_reason", "verhoeff_penalty": "verhoeff_penalty",
             "total_penalty": "total_aadhaar_penalty", "risk_level": "aadhaar_risk_level", "checks_passed": "checks_passed",
             "checks_failed": "checks_failed", "summary": "summary"},
    "match": {"qr_type": "qr_type", "fields_found": "qr_fields_found", "status": "qr_cross_validation_status",
              "mismatches": "qr_mismatches", "penalty": "qr_penalty", "summary": "qr_summary"},
    "font": {"status": "font_status", "variance_ratio": "font_variance_ratio", "suspicious_blocks": "font_suspicious_blocks",
             "high_frequency_anomaly": "font_high_frequency_anomaly", "compression_inconsistency": "font_compression_inconsistency",
             "penalty": "font_penalty", "detail": "font_detail"},
    "card_layout": {"status": "layout_status", "issues": "layout_issues", "penalty": "layout_penalty", "detail": "layout_detail"},
}
FRAUD = ["ela", "metadata", "blur", "duplicate_regions", "layout_validation", "qr_validation", "ai_artifacts", "ela_score", "blur_score"]


def response(df: DataFrame) -> Column:
    """The nested response of a verified document: every part under its published name, the card's part NULL for other documents."""
    c = F.col
    pairs = F.map_from_entries(F.transform(c("match.pairs"), lambda p: F.struct(
        p["field"], F.struct(p["qr"].alias("qr"), p["ocr"].alias("ocr"), p["match"].alias("match")))))
    card = F.struct(
        *[c(part)[key].alias(name) for part, keys in CARD_PARTS.items() for key, name in keys.items()],
        pairs.alias("qr_field_matches"), c("corrections").alias("corrected_fields"))
    return F.struct(
        c("document_type"), c("fields").alias("extracted_fields"), F.struct(*FRAUD).alias("fraud_analysis"),
        c("risk_score"), c("status"), c("confidence"), c("page_count"),
        F.struct(c("document_type").alias("primary_type"), c("type_confidence").alias("primary_confidence"),
                 c("all_scores"), c("is_ambiguous"), c("matched_signals")).alias("classification"),
        c("reply").alias("vlm_analysis"),
        F.struct(c("checks"), *[c(f"report.{n}").alias(n) for n in (
            "passed", "failed", "critical_failures", "validation_score", "summary")]).alias("validation"),
        F.when(c("card").isNotNull(), card).alias("aadhaar_verification"),
        c("stages").alias("pipeline_stages"))


def with_response(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., response): through a generator, so that each part is computed once however many of its fields are read."""
    return df.select(*keep, F.explode(F.array(response(df))).alias("response"))


def verdict_json(df: DataFrame) -> DataFrame:
    """Each verified document as one nested JSON text: (doc_id, json)."""
    return with_response(df, "doc_id").select("doc_id", F.to_json("response", {"ignoreNullFields": "false"}).alias("json"))


def read_json(texts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, response) of (doc_id, json): the text becomes a VARIANT, and the variant a response of the given type."""
    return texts.select("doc_id", F.explode(F.array(F.variant_get(F.parse_json("json"), "$", kind))).alias("response"))
