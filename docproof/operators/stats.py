"""Grouped statistics over image blocks and tiles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import BLOCKINESS_ABOVE, SHARPNESS_ANOMALY, font_verdict as _verdict

# --- fixed values ------------------------------------------------------------------------
MIN_TEXT_DENSITY = 0.05
MIN_BLOCKS, MIN_TILES = 5, 4
SIGMAS = 2
MIN_SPREAD = 1e-3
TOO_FEW_BLOCKS = "Insufficient text blocks for analysis"
# --- end of fixed values --------------------------------------------------------------


def _cv(value: str) -> Column:
    return F.stddev_pop(value) / (F.avg(value) + 1e-6)


def _uneven(value: str) -> Column:
    return F.when(F.count(value) < MIN_TILES, False).otherwise(_cv(value) > BLOCKINESS_ABOVE)


def text_block_filter(blocks: DataFrame, min_density: float = MIN_TEXT_DENSITY) -> DataFrame:
    return blocks.where(F.col("text_density") >= min_density)


def dispersion_profile(df: DataFrame, key: str, value: str,
                       k_sigma: float = SIGMAS, min_n: int = MIN_BLOCKS) -> DataFrame:
    """Per group: n, mean, population sd, cv, and how many values exceed mean + k sd.

    Groups with fewer than min_n values carry no statistics and no outliers. Equal values are
    counted together first, so the second pass joins distinct values only.
    """
    counted = df.groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    stats = df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"), _cv(value).alias("cv"))
    limits = stats.select(key, (F.col("mean") + k_sigma * F.col("sd")).alias("_limit"))
    outliers = (
        counted.join(limits, key).where(F.col("_v") > F.col("_limit"))
        .groupBy(key).agg(F.sum("_k").alias("outliers")))
    enough = F.col("n") >= min_n
    return stats.join(outliers, key, "left").select(
        key, "n",
        *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "sd", "cv")],
        F.when(enough, F.coalesce("outliers", F.lit(0))).otherwise(0).cast("bigint").alias("outliers"),
        enough.alias("enough"))


def blockiness_flag(tiles: DataFrame, key: str = "doc_id", value: str = "blockiness") -> DataFrame:
    return tiles.groupBy(key).agg(
        F.count(value).alias("tiles"), _uneven(value).alias("compression_inconsistency"))


def noise_uniformity(df: DataFrame, key: str, cell: str, value: str) -> DataFrame:
    """Mean of the spread inside cells over the spread of all values; NULL if there is none."""
    # The spread of all values is that inside the cells and that of the cells' means, weighted by their sizes.
    n, mean, sd = F.col("_n"), F.col("_mean"), F.col("_sd")
    inside = df.groupBy(key, cell).agg(
        F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    total = F.sum("_n")
    centre = F.sum(n * mean) / total
    spread = F.sum(n * (sd * sd + mean * mean)) / total - centre * centre
    return inside.groupBy(key).agg(
        F.avg("_sd").alias("cell_sd"), F.count("*").alias("cells"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("overall_sd")).withColumn(
        "uniformity", F.when(F.col("overall_sd") >= MIN_SPREAD, F.col("cell_sd") / (F.col("overall_sd") + 1e-9)))


def top_blocks(blocks: DataFrame, n: int = 5) -> DataFrame:
    """The n blocks with the highest metric per document; ties by position.

    The row limit is applied inside each partition before the shuffle as well.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("hf_ratio"), "y", "x", "block_id")
    return blocks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _font_detail(font: Column) -> Column:
    """The sentence on a document's font test."""
    yes = lambda c: F.when(c, "True").otherwise("False")
    share = F.concat(F.lit(", suspicious_blocks="), font["suspicious_blocks"].cast("string"), F.lit("/"), font["total_text_blocks"].cast("string"))
    start = lambda words: F.concat(F.lit(f"{words} — variance_ratio="), F.format_number(font["variance_ratio"], 3))
    return (
        F.when(font["status"] == "inconsistent", F.concat(
            start("Font inconsistency DETECTED"), share, F.lit(", hf_anomaly="), yes(font["high_frequency_anomaly"]),
            F.lit(", compression_inconsistency="), yes(font["compression_inconsistency"])))
        .when(font["status"] == "suspicious", F.concat(start("Font rendering suspicious"), share))
        .otherwise(start("Font rendering consistent")))


def font_consistency(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """font(doc_id, font): the whole block test per document, from text blocks and tiles."""
    profile = dispersion_profile(text_block_filter(blocks), "doc_id", "hf_ratio")
    edges = tiles.groupBy("doc_id").agg(
        _cv("sharpness").alias("cv_edge"), _uneven("blockiness").alias("compression_inconsistency"))
    return (
        profile.join(edges, "doc_id", "left")
        .withColumn("cv_edge", F.coalesce("cv_edge", F.lit(0.0)))
        .withColumn("compression_inconsistency", F.coalesce("compression_inconsistency", F.lit(False)))
        .withColumn("_f", _verdict(F.col("cv"), F.col("cv_edge"), F.col("compression_inconsistency")))
        .select("doc_id", F.struct(
            F.when(F.col("enough"), F.col("_f.status")).otherwise("consistent").alias("status"),
            F.when(F.col("enough"), F.col("_f.variance_ratio")).otherwise(0.0).alias("variance_ratio"),
            F.when(F.col("enough"), F.col("_f.penalty")).otherwise(0).alias("penalty"),
            F.col("outliers").alias("suspicious_blocks"),
            F.when(F.col("enough"), F.col("n")).otherwise(0).cast("bigint").alias("total_text_blocks"),
            (F.col("enough") & (F.col("cv_edge") > SHARPNESS_ANOMALY)).alias("high_frequency_anomaly"),
            (F.col("enough") & F.col("compression_inconsistency")).alias("compression_inconsistency"),
        ).alias("font"), "enough")
        .select("doc_id", F.col("font").withField(
            "detail", F.when(F.col("enough"), _font_detail(F.col("font"))).otherwise(TOO_FEW_BLOCKS)).alias("font"))
    )
