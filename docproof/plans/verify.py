"""Full plan: extraction, evidence, rules and risk, one verdict row per document."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import blur_band, blur_value, ela_band, ela_value, metadata_verdict, synthetic_vote
from ..functions.qr import decode_qr
from ..functions.reply import attach_model_reply
from ..functions.rules import check_fields, summarise_checks
from ..operators.copymove import copy_move_verdict
from ..operators.layout import card_layout_score, layout_verdict
from ..operators.qr import compare, correct_from_qr, quick_verdict
from ..operators.report import audit_stages, human_summary
from ..operators.risk import base_score, card_verification, final_risk
from ..operators.stats import TOO_FEW_BLOCKS, font_consistency
from ..schemas import ID_CARD
from .extract import extract_documents


def fraud_columns(df: DataFrame) -> DataFrame:
    """Bands and verdicts from the measured image values of a document."""
    c = F.col
    return df.withColumns({
        "ela": ela_band(c("ela_score")),
        "blur": blur_band(c("blur_score")),
        "metadata": metadata_verdict(c("suffix"), c("exif_state"), c("software"),
                                     c("datetime"), c("datetime_original")),
        "ai_artifacts": synthetic_vote(c("dct_mid_ratio"), c("noise_uniformity"), c("edge_density")),
        "duplicate_regions": F.coalesce(c("duplicate_regions"), F.lit("not_detected")),
        "ela_score": ela_value(c("ela_score")),
        "blur_score": blur_value(c("blur_score")),
    })


def _default_font() -> Column:
    return F.struct(F.lit("consistent").alias("status"), F.lit(0.0).alias("variance_ratio"),
                    F.lit(0).alias("penalty"), F.lit(0).cast("bigint").alias("suspicious_blocks"),
                    F.lit(0).cast("bigint").alias("total_text_blocks"), F.lit(False).alias("high_frequency_anomaly"),
                    F.lit(False).alias("compression_inconsistency"), F.lit(TOO_FEW_BLOCKS).alias("detail"))


def card_evidence(df: DataFrame) -> DataFrame:
    """Add match, quick verdict, corrections and card to the ID cards; NULL for other types."""
    card = F.col("document_type") == ID_CARD
    # What the tests read is NULL for other types, so that none of them works on a document whose answers are dropped.
    flat = df.withColumns({n: F.when(card, F.col(f"fields.{n}")) for n in ("name", "dob", "aadhaar_number", "gender")}).withColumns(
        {n: F.when(card, F.col(n)) for n in ("qr", "payload")})
    done = (
        flat.transform(compare)
        .transform(correct_from_qr)
        .transform(quick_verdict)
        .withColumn("font", F.coalesce("font", _default_font()))
        # Only a card's own text is searched for the card's marks.
        .withColumn("_card_text", F.when(card, F.col("text")))
        .transform(card_layout_score, text="_card_text", only=card)
        .drop("_card_text")
        .transform(card_verification)
    )
    return (
        done.withColumn("qr_validation",
                        F.when(~card, "not_found")
                        .when(F.col("match.status").isin("verified", "mismatch"), F.col("match.status"))
                        .otherwise(F.col("qr_quick")))
        # The rules see the fields as the QR completes them, the original readings stay.
        .withColumn("checked_fields", F.when(card, F.col("fields")
                    .withField("name", F.coalesce("quick_name", "corrected_name"))
                    .withField("dob", F.col("corrected_dob"))).otherwise(F.col("fields")))
        .withColumns({n: F.when(card, F.col(n)) for n in ("card", "match", "font", "card_layout", "corrections")})
        .drop("name", "dob", "aadhaar_number", "gender", "qr_quick", "quick_name",
              "corrected_name", "corrected_dob", "qr", "payload", "inflated")
    )


def verify_documents(docs: DataFrame, signals: DataFrame, qr: DataFrame, replies: DataFrame,
                     blocks: DataFrame, tiles: DataFrame, descriptors: DataFrame, as_of: Column) -> DataFrame:
    """One verdict row per document.

    docs(doc_id, text, confidence, page_count) and tables keyed by doc_id with at most one row
    per document, except blocks, tiles and descriptors, which are reduced to one first. All
    joins are on doc_id, so the document side is exchanged once and stays in place.
    """
    extracted = extract_documents(docs)
    joined = (
        extracted
        .join(signals, "doc_id", "left")
        .join(copy_move_verdict(descriptors).select("doc_id", "duplicate_regions"), "doc_id", "left")
        .join(font_consistency(blocks, tiles), "doc_id", "left")
        .join(decode_qr(qr), "doc_id", "left")
    )
    checked = (
        attach_model_reply(joined, replies)
        .transform(layout_verdict)
        .transform(fraud_columns)
        .transform(card_evidence)
        .withColumn("checks", check_fields(F.col("checked_fields"), F.col("document_type"), as_of))
        .withColumn("report", summarise_checks(F.col("checks")))
    )
    return (
        checked.transform(base_score).transform(final_risk)
        .withColumn("stages", audit_stages(F.col("document_type")))
    )


def analyze_documents(*args, **kwargs) -> DataFrame:
    """verify_documents plus the readable summary."""
    return human_summary(verify_documents(*args, **kwargs))
