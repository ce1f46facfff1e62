"""Risk arithmetic: points per signal, the order of the clamps, and the final status."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import RISK_LOW, RISK_MEDIUM, status_band
from ..functions.checksum import verhoeff_check
from ..schemas import ID_CARD

# --- fixed values: points by signal and value --------------------------------------------
POINTS = {
    "ela": {"clean": 0, "suspicious": 15, "tampered": 35},
    "metadata": {"normal": 0, "suspicious": 12, "missing": 8},
    "blur": {"sharp": 0, "slightly_blurry": 5, "blurry": 10},
    "duplicate_regions": {"not_detected": 0, "detected": 20},
    "layout_validation": {"valid": 0, "unknown": 5, "invalid": 15},
    "qr_validation": {"verified": -5, "not_found": 0, "decode_error": 5, "mismatch": 25},
    "ai_artifacts": {"not_detected": 0, "suspected": 12},
}
LEVELS = {
    "clean": "green", "not_detected": "green", "sharp": "green",
    "normal": "green", "verified": "green", "valid": "green",
    "suspicious": "amber", "slightly_blurry": "amber",
    "missing": "amber", "unknown": "amber", "decode_error": "amber", "not_found": "amber",
    "tampered": "red", "detected": "red", "blurry": "red",
    "mismatch": "red", "invalid": "red", "suspected": "red",
}
SIGNALS = ["ela", "blur", "duplicate_regions", "metadata", "ai_artifacts", "qr_validation", "layout_validation"]
ELA_SHARE = 0.1
TAMPERING_POINTS = 15
CRITICAL_POINTS = 8
MISSING_NUMBER_POINTS = 15
CARD_RANGE = (-5, 100)
CARD_LEVELS = [(5, "low"), (20, "medium"), (40, "high")]
# --- end of fixed values --------------------------------------------------------------


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def signals_long(df: DataFrame, *keep: str) -> DataFrame:
    """Unpivot the seven verdict columns to (doc_id, document_type, ela_score, keep..., signal, value)."""
    return df.unpivot(["doc_id", "document_type", "ela_score", *keep], SIGNALS, "signal", "value")


def penalty_lookup(long: DataFrame, points: dict = POINTS) -> DataFrame:
    """(doc_id, document_type, signal, value) -> + points. The dimension is a fixed short list.

    A QR verdict counts for ID cards only; a value not listed counts nothing.
    """
    rows = [(s, v, p) for s, values in points.items() for v, p in values.items()]
    dim = long.sparkSession.createDataFrame(rows, "signal string, value string, _p int")
    counts = (F.col("signal") != "qr_validation") | (F.col("document_type") == ID_CARD)
    return long.join(F.broadcast(dim), ["signal", "value"], "left").withColumn(
        "points", F.when(counts, F.coalesce("_p", F.lit(0))).otherwise(0)).drop("_p")


def signal_levels(df: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep..., signal, value, level) for monitoring counts; an unlisted value has level none."""
    dim = df.sparkSession.createDataFrame(list(LEVELS.items()), "value string, level string")
    return signals_long(df, *keep).join(F.broadcast(dim), "value", "left").select(
        "doc_id", *keep, "signal", "value", F.coalesce("level", F.lit("none")).alias("level"))


def ela_share(ela_score: Column) -> Column:
    return (ela_score * ELA_SHARE).cast("int")


def signal_points(doc_type: Column) -> Column:
    """Points of the seven verdict columns of one row; the same rule as penalty_lookup."""
    total = F.lit(0)
    for signal, values in POINTS.items():
        lookup = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        points = F.coalesce(F.try_element_at(lookup, F.col(signal)), F.lit(0))
        total = total + (F.when(doc_type == ID_CARD, points).otherwise(0) if signal == "qr_validation" else points)
    return total


def base_risk(signals: DataFrame) -> DataFrame:
    """Long signals(doc_id, document_type, ela_score, signal, value) -> base score.

    One group-by on the document; the sum combines before the shuffle.
    """
    summed = penalty_lookup(signals).groupBy("doc_id", "document_type", "ela_score").agg(F.sum("points").alias("signal_points"))
    return summed.withColumn(
        "base_score", clamp((F.col("signal_points") + ela_share(F.col("ela_score"))).cast("int")))


def base_score(df: DataFrame) -> DataFrame:
    """The same score where the verdicts are columns of one row; no shuffle."""
    return df.withColumn("base_score", clamp(
        signal_points(F.col("document_type")) + ela_share(F.col("ela_score"))))


def card_verification(df: DataFrame) -> DataFrame:
    """Add ``card``: composite of checksum, QR match, font and layout for ID cards.

    Reads aadhaar_number, match, font and card_layout.
    """
    check = F.col("_v")
    count = lambda *tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    qr, font, layout = F.col("match.status"), F.col("font.status"), F.col("card_layout.status")
    valid = F.coalesce(check["valid"], F.lit(False))
    penalty = clamp(
        F.coalesce(check["penalty"], F.lit(MISSING_NUMBER_POINTS)) + F.col("match.penalty")
        + F.col("font.penalty") + F.col("card_layout.penalty"), *CARD_RANGE)
    level = F.when(F.col("_penalty") <= CARD_LEVELS[0][0], CARD_LEVELS[0][1])
    for limit, name in CARD_LEVELS[1:]:
        level = level.when(F.col("_penalty") <= limit, name)
    passed, failed = F.col("_passed"), F.col("_failed")
    text = lambda c: c.cast("string")
    return (
        df.withColumn("_v", verhoeff_check(F.col("aadhaar_number")))
        .withColumns({
            "_penalty": penalty,
            "_passed": count(valid, qr == "verified", font == "consistent", layout == "valid"),
            "_failed": count(~valid, qr == "mismatch", font == "inconsistent", layout == "invalid"),
        })
        .withColumn("_level", level.otherwise("critical"))
        .withColumn("card", F.struct(
            valid.alias("verhoeff_valid"),
            F.coalesce(check["reason"], F.lit("Aadhaar number not found in OCR")).alias("verhoeff_reason"),
            F.coalesce(check["penalty"], F.lit(MISSING_NUMBER_POINTS)).alias("verhoeff_penalty"),
            F.col("_penalty").alias("total_penalty"),
            F.col("_level").alias("risk_level"),
            passed.alias("checks_passed"), failed.alias("checks_failed"),
            F.concat(
                F.lit("Aadhaar verification: "), text(passed), F.lit("/"), text(passed + failed),
                F.lit(" checks passed | penalty="), text(F.col("_penalty")), F.lit(" | risk="), F.col("_level"),
                F.lit(" | verhoeff="), F.when(valid, "True").otherwise("False"),
                F.lit(" | qr="), qr, F.lit(" | font="), font, F.lit(" | layout="), layout).alias("summary"),
        ))
        .drop("_v", "_penalty", "_passed", "_failed", "_level")
    )


def final_risk(df: DataFrame, low: int = RISK_LOW, medium: int = RISK_MEDIUM) -> DataFrame:
    """Add risk_score and status. Reads base_score, reply, card (NULL for other types), report.

    Each step is clamped before the next. A negative card penalty must not push the score
    below zero, so the lower bound holds there as well.
    """
    r = F.col("reply")
    swayed = clamp(F.col("base_score") + r["suggested_risk_adjustment"]
                   + F.when(r["visible_tampering"], TAMPERING_POINTS).otherwise(0))
    adjusted = F.when(r["vlm_available"], swayed).otherwise(F.col("base_score"))
    with_card = clamp(adjusted + F.coalesce(F.col("card.total_penalty"), F.lit(0)))
    score = F.least(F.lit(100), with_card + F.col("report.critical_failures") * CRITICAL_POINTS)
    return df.withColumn("risk_score", score).withColumn("status", status_band(F.col("risk_score"), low, medium))
