"""Choosing among candidate names."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import valid_name, words


def rank_names(candidates: DataFrame) -> DataFrame:
    """candidates(doc_id, ord, name) -> the valid name with most words, then longest, then first.

    A maximum over a struct: combined before the shuffle, no group is gathered.
    """
    rank = F.struct(F.size(words(F.col("name"))), F.length("name"), -F.col("ord"))
    return candidates.where(valid_name(F.col("name"))).groupBy("doc_id").agg(
        F.max_by("name", rank).alias("name"), F.count("*").alias("candidates"))
