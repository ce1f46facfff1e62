"""Session helpers: runtime settings the plans rely on, and the shared checkpoint folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession, shuffle_partitions: int | None = None) -> SparkSession:
    """Turn on the runtime re-planning the operators count on. All are plain runtime settings.

    shuffle_partitions is how finely an exchange is cut before small partitions are joined again: give about one per
    100 MB of the largest exchange. Without it the session's own number stays.
    """
    if shuffle_partitions is not None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A document that owns most rows must be split even where that costs another exchange.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def builder(app: str = "docproof") -> SparkSession.Builder:
    """Session builder with the one static setting worth having: the expressions are long, and
    recording a Python call site for every column costs more than planning them."""
    return SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data: spark.checkpoint.dir, or else a folder in the session's warehouse.

    On a cluster that folder has to be one that all executors see: a warehouse in a local folder is refused there.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not usable(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def usable(master: str, folder: str) -> bool:
    """Whether all executors under this master see the folder; a path without a scheme, or of file:, is one machine's."""
    return master.startswith("local[") or master == "local" or not (folder.startswith("file:") or "://" not in folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
