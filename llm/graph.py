"""Connected components by alternating stars, and tables written to the shared folder between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and lost executors lose nothing of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges(a, b): the smallest id that it is connected with.

    Large stars hang a vertex's larger neighbours on its smallest neighbour, small stars its smaller ones; both keep what is
    connected so, and the edges end as one star per component. Neighbours are never gathered, only their minima."""
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select("low", F.explode(F.array("a", "b")).alias("b")).where("low <> b")
        now = stored(small.select(F.col("low").alias("a"), "b").distinct(), "stars")
        # Done when every vertex is either a centre or a leaf of one star.
        place = now.select(F.explode(F.array(
            F.struct(F.col("a").alias("id"), F.lit(None).alias("centre")), F.struct(F.col("b").alias("id"), F.col("a").alias("centre")))).alias("v"))
        odd = place.groupBy("v.id").agg(F.count("v.centre").alias("leaf"), F.count_if(F.col("v.centre").isNull()).alias("centre"))
        if odd.where("leaf > 1 or leaf = 1 and centre > 0").isEmpty():
            break
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
