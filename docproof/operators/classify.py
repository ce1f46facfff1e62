"""Document classification by weighted and unweighted signatures.

A signature is (pattern, weight, needle). The needle is a literal that any match must
contain; a substring test on it is far cheaper than the pattern and rules out most rows.
``None`` means there is no such literal. The text is lower-cased before matching, so a
pattern needing a capital letter can never hit; it stays listed and is not evaluated.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import U
from ..schemas import DOC_TYPES, UNKNOWN

# --- fixed values: (pattern, weight, needle) by type ----------------------------------
WEIGHTED = {
    "aadhaar": [
        (r"aadhaar", 3.0, "aadhaar"),
        (r"uidai", 3.0, "uidai"),
        (r"unique identification authority", 3.0, "unique identification authority"),
        (r"\d{4}\s\d{4}\s\d{4}", 2.5, None),
        (r"enrolment\s*no", 2.0, "enrolment"),
        (r"government of india", 1.0, "government of india"),
        (r"dob\s*:", 0.5, "dob"),
        (r"vid\s*:\s*\d{16}", 2.0, "vid"),
    ],
    "pan": [
        (r"permanent account number", 3.0, "permanent account number"),
        (r"income.tax.department", 3.0, "department"),
        (r"\b[A-Z]{5}\d{4}[A-Z]\b", 3.0, None),
        (r"pan\s*card", 2.0, "card"),
        (r"father'?s?\s*name", 1.5, "father"),
        (r"income.tax", 1.0, "income"),
    ],
    "passport": [
        (r"\bpassport\b", 3.0, "passport"),
        (r"republic of india", 2.0, "republic of india"),
        (r"place of birth", 2.0, "place of birth"),
        (r"date of expiry", 2.0, "date of expiry"),
        (r"date of issue", 1.5, "date of issue"),
        (r"[A-Z]{1}\d{7}", 2.5, None),
        (r"[A-Z0-9<]{44}", 2.0, None),
        (r"nationality", 1.0, "nationality"),
        (r"machine readable", 1.5, "machine readable"),
    ],
    "resume": [
        (r"\bresume\b", 2.5, "resume"),
        (r"curriculum\s*vitae", 3.0, "curriculum"),
        (r"\bcv\b", 1.5, "cv"),
        (r"work\s*experience", 2.0, "experience"),
        (r"employment\s*history", 2.0, "employment"),
        (r"objective\s*:", 1.5, "objective"),
        (r"skills?\s*:", 1.5, "skill"),
        (r"education\s*:", 1.5, "education"),
        (r"projects?\s*:", 1.0, "project"),
        (r"references?\s*(available)?", 1.0, "reference"),
        (r"[a-z0-9.+-]+@[a-z0-9-]+\.[a-z]{2,}", 1.0, "@"),
    ],
    "graduation_certificate": [
        (r"bachelor\s*of", 2.5, "bachelor"),
        (r"master\s*of", 2.5, "master"),
        (r"degree\s*of", 2.0, "degree"),
        (r"awarded\s*(the\s*)?(degree|title)", 3.0, "awarded"),
        (r"convocation", 2.5, "convocation"),
        (r"chancellor", 2.0, "chancellor"),
        (r"registrar", 1.5, "registrar"),
        (r"graduation\s*certificate", 3.0, "graduation"),
        (r"university\s*of", 1.0, "university"),
    ],
    "marksheet": [
        (r"mark\s*sheet", 3.0, "mark"),
        (r"marks?\s*obtained", 2.5, "obtained"),
        (r"total\s*marks", 2.0, "total"),
        (r"roll\s*(no|number)", 2.0, "roll"),
        (r"semester\s*[ivx\d]+", 2.0, "semester"),
        (r"result\s*(of|declared)", 1.5, "result"),
        (r"subject\s*code", 1.5, "subject"),
        (r"grade\s*point", 1.5, "grade"),
        (r"percentage\s*:", 1.0, "percentage"),
        (r"examination\s*(center|centre|board)", 1.5, "examination"),
    ],
}

KEYWORDS = {
    "aadhaar": [
        r"aadhaar", r"unique identification", r"uidai", r"\d{4}\s\d{4}\s\d{4}",
        r"government of india", r"enrolment",
    ],
    "pan": [
        r"permanent account number", r"income tax", r"\b[A-Z]{5}\d{4}[A-Z]\b",
        r"income tax department", r"pan card",
    ],
    "passport": [
        r"passport", r"republic of india", r"nationality", r"place of birth",
        r"date of issue", r"date of expiry", r"[A-Z]{1}\d{7}", r"machine readable", r"mrz",
    ],
    "resume": [
        r"curriculum vitae", r"\bcv\b", r"\bresume\b", r"objective", r"work experience",
        r"employment history", r"references", r"skills", r"education", r"projects",
    ],
    "graduation_certificate": [
        r"bachelor", r"master", r"degree", r"university", r"college", r"awarded", r"conferred",
        r"graduation", r"convocation", r"chancellor", r"registrar",
    ],
    "marksheet": [
        r"mark sheet", r"marksheet", r"result", r"semester", r"examination", r"roll no",
        r"subject", r"marks obtained", r"total marks", r"grade", r"percentage",
    ],
}
MIN_CONFIDENCE = 0.25
# --- end of fixed values --------------------------------------------------------------

# A match exists exactly where this shorter form matches; it does not re-read long runs, nor look for capitals in lower-cased text.
_PRESENCE = {r"[a-z0-9.+-]+@[a-z0-9-]+\.[a-z]{2,}": r"[a-z0-9.+-]@[a-z0-9-]+\.[a-z]{2}", r"[A-Z0-9<]{44}": r"[0-9<]{44}"}
_NEEDS_CAPITAL = {r"\b[A-Z]{5}\d{4}[A-Z]\b", r"[A-Z]{1}\d{7}"}


def present(lower: Column, pattern: str, needle: str | None = None) -> Column:
    """Does the pattern occur in the lower-cased text?"""
    if pattern in _NEEDS_CAPITAL:
        return F.lit(False)
    if not re.search(r"[\\\[\](){}.*+?^$|]", pattern):
        return F.contains(lower, F.lit(pattern))
    test = lower.rlike(U + _PRESENCE.get(pattern, pattern))
    return F.contains(lower, F.lit(needle)) & test if needle else test


def _plain(table: dict) -> dict:
    needles = {r"\bcv\b": "cv", r"\bresume\b": "resume"}
    return {t: [(p, 1.0, needles.get(p)) for p in patterns] for t, patterns in table.items()}


def _scored(df: DataFrame, text: str, table: dict) -> DataFrame:
    """Add _hits (per type: array of entries found), _raw_<i> and _total.

    The types are written out rather than looped over in a lambda: a column used several
    times keeps its own projection, so every pattern is tried once per document.
    """
    def hits(entries):
        return F.array_compact(F.array(*[
            F.when(present(F.col("_lower"), p, needle),
                   F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("weight")))
            for p, w, needle in entries]))

    weights = lambda i: F.aggregate(F.get(F.col("_hits"), F.lit(i)), F.lit(0.0),
                                    lambda total, h: total + h["weight"])
    raw = [F.col(f"_raw_{i}") for i in range(len(DOC_TYPES))]
    return (
        df.withColumn("_lower", F.lower(F.col(text)))
        .withColumn("_hits", F.array(*[hits(table[t]) for t in DOC_TYPES]))
        .drop("_lower")
        .withColumns({f"_raw_{i}": weights(i) for i in range(len(DOC_TYPES))})
        .withColumn("_total", sum(raw[1:], raw[0]))
    )


def settle(df: DataFrame, columns: dict) -> DataFrame:
    """Add columns that later filters must not be rewritten through.

    A filter on an ordinary derived column is pushed below its projection with the whole
    derivation copied into it, level by level; for the classification that copies every
    pattern many times. Filters on a generator's output stay above the generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def _signals(i: int) -> Column:
    return F.transform(F.get(F.col("_hits"), F.lit(i)), lambda h: h["pattern"])


def _share(i: int) -> Column:
    return F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(
        F.bround(F.col(f"_raw_{i}") / F.col("_total"), 4))


def _first_at_maximum(measures: list[Column]) -> Column:
    """Type with the highest measure; ties go to the earlier type."""
    top = F.greatest(*measures)
    pick = F.when(measures[0] == top, DOC_TYPES[0])
    for t, m in zip(DOC_TYPES[1:], measures[1:]):
        pick = pick.when(m == top, t)
    return pick


_SCRATCH = ["_hits", "_total"] + [f"_raw_{i}" for i in range(len(DOC_TYPES))]


def classify_weighted(df: DataFrame, text: str = "text",
                      min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Add document_type, type_confidence, all_scores, matched_signals, is_ambiguous. No shuffle."""
    types = range(len(DOC_TYPES))
    share = [F.col(f"_share_{i}") for i in types]
    known = F.col("_total") > 0
    pairs = [c for i, t in enumerate(DOC_TYPES) for c in (F.lit(t), share[i])]
    return (
        _scored(df, text, WEIGHTED)
        .withColumns({f"_share_{i}": _share(i) for i in types})
        .transform(settle, {
            "document_type": F.when(known, _first_at_maximum(share)).otherwise(UNKNOWN),
            "type_confidence": F.greatest(*share),
            "is_ambiguous": F.greatest(*share) < min_confidence,
        })
        .withColumns({
            "all_scores": F.when(known, F.create_map(*pairs))
                           .otherwise(F.create_map(*pairs, F.lit(UNKNOWN), F.lit(0.0))),
            "matched_signals": F.create_map(*[
                c for i, t in enumerate(DOC_TYPES) for c in (F.lit(t), _signals(i))]),
        })
        .drop(*_SCRATCH, *[f"_share_{i}" for i in types])
    )


def classify_scores(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Long form: one row per document and type, without a join or a shuffle."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("type_ord"),
            F.lit(t).alias("document_type"),
            F.col(f"_raw_{i}").alias("raw_score"),
            _signals(i).alias("signals"),
            F.size(F.get(F.col("_hits"), F.lit(i))).alias("hits"),
            _share(i).alias("share"),
        ) for i, t in enumerate(DOC_TYPES)])
    return _scored(df.select(key, text), text, WEIGHTED).select(key, F.inline(rows))


def classify_keywords(df: DataFrame, text: str = "text") -> DataFrame:
    """Older detector: number of keywords present, unweighted."""
    raw = [F.col(f"_raw_{i}") for i in range(len(DOC_TYPES))]
    return (
        _scored(df, text, _plain(KEYWORDS))
        .transform(settle, {
            "keyword_type": F.when(F.col("_total") > 0, _first_at_maximum(raw)).otherwise(UNKNOWN),
            "keyword_hits": F.greatest(*raw).cast("int"),
        })
        .drop(*_SCRATCH)
    )


def argmax_type(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """From the long form: the type with the highest share, ties to declared order.

    An aggregate, not a window: the maximum is combined before the shuffle, so no document
    is ever gathered whole.
    """
    rank = F.struct(F.col("share"), (-F.col("type_ord")).alias("o"))
    return scores.groupBy(key).agg(
        F.max_by("document_type", rank).alias("document_type"),
        F.max("share").alias("share"),
    )
