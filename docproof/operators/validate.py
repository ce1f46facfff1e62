"""Rule checks as a long table, and their roll-up per document."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import check_fields, report_struct


def validate_fields(docs: DataFrame, as_of: Column) -> DataFrame:
    """docs(doc_id, document_type, fields) -> one row per check, in rule order from 1."""
    checks = check_fields(F.col("fields"), F.col("document_type"), as_of)
    return (
        docs.select("doc_id", F.posexplode(checks).alias("pos", "check"))
        .select("doc_id", (F.col("pos") + 1).alias("seq"), "check.*")
    )


def validation_report(checks: DataFrame) -> DataFrame:
    """Counts per document. Sums combine before the shuffle, so a huge document is no hot spot."""
    failed = ~F.col("passed")
    counted = checks.groupBy("doc_id").agg(
        F.count_if("passed").alias("p"),
        F.count_if(failed).alias("f"),
        F.count_if(failed & (F.col("severity") == "high")).alias("c"),
    )
    return (counted.withColumn("r", report_struct(F.col("p"), F.col("f"), F.col("c")))
            .select("doc_id", "r.*"))
