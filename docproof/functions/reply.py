"""Model replies: find the JSON object in free text, parse it, and default what is missing."""

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import REPLY_JSON
from .text import blank_to_null, strip

# --- fixed values: accepted ranges -----------------------------------------------------
DELTA_RANGE = (-20, 40)
CONFIDENCE_RANGE = (0, 1)
# --- end of fixed values --------------------------------------------------------------


def json_text(c: Column) -> Column:
    """Drop code fences, take the first '{' to the last '}', drop commas before a closing bracket."""
    c = F.regexp_replace(F.regexp_replace(strip(c), "(?i)```json", ""), "```", "")
    return F.regexp_replace(F.regexp_extract(c, r"(?s)(\{.*\})", 1), r",(\s*[}\]])", "$1")


def parse_model_json(df: DataFrame, text: str = "reply_text") -> DataFrame:
    """Add reply_json (struct), reply_extra and reply_error: NULL, 'empty', 'no JSON' or 'bad JSON'.

    A blank text is an empty object, all of whose keys take their defaults; NULL is no reply. Keys that the struct does not
    know are kept in reply_extra, a map from key to VARIANT, so nothing a model says is lost.
    """
    valid = F.try_parse_json(F.col("_json"))
    known = [f.name for f in REPLY_JSON.fields]
    extra = F.map_filter(F.try_variant_get(valid, "$", "map<string,variant>"), lambda k, _: ~k.isin(*known))
    return (
        df.withColumn("_json", F.when(F.col(text) == "", "{}").otherwise(json_text(F.col(text))))
        .withColumn("reply_error",
                    F.when(F.col(text).isNull(), "empty")
                    .when(F.col("_json") == "", "no JSON")
                    .when(valid.isNull(), "bad JSON"))
        .withColumn("reply_json", F.when(F.col("reply_error").isNull(), F.from_json(
            F.col("_json"), REPLY_JSON)))
        .withColumn("reply_extra", F.when(F.col("reply_error").isNull(), extra))
        .drop("_json")
    )


def reply_text(content: Column, reasoning: Column, reasoning_content: Column, parts: Column = None) -> Column:
    """First non-empty of the places a reply may be in; list content is joined by blanks."""
    joined = F.lit(None) if parts is None else F.when(F.size(parts) > 0, F.array_join(parts, " "))
    return strip(F.coalesce(joined, blank_to_null(content), blank_to_null(reasoning),
                            blank_to_null(reasoning_content)))


def neutral_reply(reply: Column, reason: Column) -> Column:
    """Reply struct with every key set; the neutral one where there is a reason not to use the reply, which it states."""
    available = reason.isNull()

    def pick(name, default, kind="string"):
        return F.coalesce(F.when(available, reply[name]), F.lit(default) if not isinstance(default, Column) else default).cast(kind)

    signals = F.transform(
        F.filter(reply["fraud_signals"], lambda s: s.isNotNull()),
        lambda s: F.struct(F.coalesce(s["signal"], F.lit("")).alias("signal"),
                           F.coalesce(s["severity"], F.lit("medium")).alias("severity")))
    return F.struct(
        pick("document_type_confirmed", "unknown").alias("document_type_confirmed"),
        pick("vlm_confidence", 0.0, "double").alias("vlm_confidence"),
        F.coalesce(F.when(available, reply["field_validation"]), F.create_map().cast("map<string,string>")).alias("field_validation"),
        F.coalesce(F.when(available, reply["logical_inconsistencies"]), F.array().cast("array<string>")).alias("logical_inconsistencies"),
        F.coalesce(F.when(available, signals), F.array().cast("array<struct<signal:string,severity:string>>")).alias("fraud_signals"),
        pick("font_consistency", "unknown").alias("font_consistency"),
        pick("layout_authenticity", "unknown").alias("layout_authenticity"),
        pick("seal_signature_present", False, "boolean").alias("seal_signature_present"),
        pick("visible_tampering", False, "boolean").alias("visible_tampering"),
        pick("overall_assessment", "unknown").alias("overall_assessment"),
        F.when(available, F.coalesce(reply["reasoning"], F.lit(""))).otherwise(
            F.concat(F.lit("VLM analysis skipped: "), reason)).alias("reasoning"),
        F.when(available, F.coalesce(reply["suggested_risk_adjustment"], F.lit(0.0))).otherwise(0.0)
         .cast("int").alias("suggested_risk_adjustment"),
        available.alias("vlm_available"),
    )


def coalesce_model_reply(replies: DataFrame) -> DataFrame:
    """replies(doc_id, content, reasoning, reasoning_content[, parts]) -> doc_id, reply, quarantine_reason.

    A reply with a value out of range is not used; the reason is kept.
    """
    parts = F.col("parts") if "parts" in replies.columns else None
    r = F.col("reply_json")
    reason = (
        F.col("reply_error"),
        F.when(~r["suggested_risk_adjustment"].cast("int").between(*DELTA_RANGE), "risk adjustment out of range"),
        F.when(~r["vlm_confidence"].between(*CONFIDENCE_RANGE), "confidence out of range"),
    )
    return (
        replies.withColumn("reply_text", reply_text(
            F.col("content"), F.col("reasoning"), F.col("reasoning_content"), parts))
        .transform(parse_model_json)
        .withColumn("quarantine_reason", F.coalesce(*reason))
        .withColumn("reply", neutral_reply(r, F.col("quarantine_reason")))
        .drop("content", "reasoning", "reasoning_content", "parts", "reply_text", "reply_json", "reply_extra", "reply_error")
    )


def attach_model_reply(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Left join of the raw replies; a document without one gets the neutral reply."""
    parsed = coalesce_model_reply(replies).select("doc_id", "reply", "quarantine_reason")
    return (
        docs.join(parsed, "doc_id", "left")
        .withColumn("quarantine_reason", F.when(F.col("reply").isNull(), "no reply").otherwise(F.col("quarantine_reason")))
        .withColumn("reply", F.coalesce(F.col("reply"), neutral_reply(F.lit(None).cast(REPLY_JSON), F.lit("no reply"))))
    )
