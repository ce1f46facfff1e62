"""Light plan: clean, classify, parse. Everything after the page roll-up stays on one row."""

from pyspark.sql import DataFrame, functions as F

from ..functions.parse import parse_fields
from ..functions.text import clean_text, round_exact
from ..operators.classify import classify_weighted


def clean_and_classify(docs: DataFrame, confuse_o: bool = True) -> DataFrame:
    """Replace ``text`` by its cleaned form and add the classification columns."""
    return classify_weighted(docs.withColumn("text", clean_text(F.col("text"), confuse_o)))


def extract_documents(docs: DataFrame, confuse_o: bool = True) -> DataFrame:
    """docs(doc_id, text, confidence, page_count) -> + document_type, fields, ... per document."""
    return (
        clean_and_classify(docs, confuse_o)
        .withColumn("fields", parse_fields(F.col("text"), F.col("document_type")))
        .withColumn("confidence", round_exact(F.col("confidence"), 4))
    )
