"""Bands and verdicts from single measured values."""

from pyspark.sql import Column, functions as F

from ..schemas import FAKE, GENUINE, SUSPICIOUS
from .text import round_exact

# --- fixed values: limits --------------------------------------------------------------
ELA_SUSPICIOUS, ELA_TAMPERED, ELA_FAILED = 30.0, 60.0, 50.0
BLURRY_BELOW, SLIGHTLY_BELOW, BLUR_FAILED = 80.0, 200.0, 0.0
MID_RATIO_ABOVE, UNIFORMITY_ABOVE = 0.35, 0.92
EDGES_BELOW, EDGES_ABOVE = 0.02, 0.40
RISK_LOW, RISK_MEDIUM = 30, 60
EDITING_TOOLS = [
    "photoshop", "gimp", "lightroom", "affinity", "paint.net",
    "canva", "snapseed", "pixlr", "corel", "adobe",
]
FONT_SUSPICIOUS, FONT_INCONSISTENT = 0.25, 0.45
SHARPNESS_ANOMALY, BLOCKINESS_ABOVE = 0.8, 1.2
# --- end of fixed values --------------------------------------------------------------


def ela_band(score: Column) -> Column:
    return (F.when(score >= ELA_TAMPERED, "tampered")
            .when((score >= ELA_SUSPICIOUS) | score.isNull(), "suspicious").otherwise("clean"))


def ela_value(score: Column) -> Column:
    return F.coalesce(round_exact(score, 2), F.lit(ELA_FAILED))


def blur_band(score: Column) -> Column:
    return (F.when(score < BLURRY_BELOW, "blurry")
            .when((score < SLIGHTLY_BELOW) | score.isNull(), "slightly_blurry").otherwise("sharp"))


def blur_value(score: Column) -> Column:
    return F.coalesce(round_exact(score, 2), F.lit(BLUR_FAILED))


def metadata_verdict(suffix: Column, exif_state: Column, software: Column,
                     modified: Column, original: Column) -> Column:
    """First rule that applies wins; unreadable metadata is suspicious, absent is missing."""
    tool = lambda name: F.contains(F.lower(software), F.lit(name))
    edited = tool(EDITING_TOOLS[0])
    for name in EDITING_TOOLS[1:]:
        edited = edited | tool(name)
    return (
        F.when(F.lower(suffix) == ".pdf", "missing")
        .when(exif_state == "absent", "missing")
        .when(exif_state.isNull() | (exif_state != "present"), "suspicious")
        .when(edited, "suspicious")
        .when((modified != "") & (original != "") & (modified != original), "suspicious")
        .otherwise("normal")
    )


def synthetic_vote(mid_ratio: Column, uniformity: Column, edges: Column) -> Column:
    """Suspected if two of the three tests fire; an absent value does not fire."""
    fires = [mid_ratio > MID_RATIO_ABOVE, uniformity > UNIFORMITY_ABOVE,
             (edges < EDGES_BELOW) | (edges > EDGES_ABOVE)]
    votes = sum((F.coalesce(f, F.lit(False)).cast("int") for f in fires), F.lit(0))
    return F.when(votes >= 2, "suspected").otherwise("not_detected")


def status_band(score: Column, low: int = RISK_LOW, medium: int = RISK_MEDIUM) -> Column:
    return F.when(score < low, GENUINE).when(score < medium, SUSPICIOUS).otherwise(FAKE)


def font_verdict(cv_block: Column, cv_edge: Column, compression: Column) -> Column:
    """Struct (status, ratio, penalty) from two coefficients of variation and a flag."""
    ratio = round_exact(F.least(F.lit(1.0), cv_block * 0.6 + cv_edge * 0.4), 4)
    bonus = (F.when(cv_edge > SHARPNESS_ANOMALY, 0.15).otherwise(0.0)
             + F.when(compression, 0.10).otherwise(0.0))
    total = ratio + bonus
    return F.struct(
        F.when(total >= FONT_INCONSISTENT, "inconsistent")
         .when(total >= FONT_SUSPICIOUS, "suspicious").otherwise("consistent").alias("status"),
        ratio.alias("variance_ratio"),
        F.when(total >= FONT_INCONSISTENT, 20).when(total >= FONT_SUSPICIOUS, 10).otherwise(0).alias("penalty"),
    )
