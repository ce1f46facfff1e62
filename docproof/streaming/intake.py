"""Documents arriving as files, verified in micro-batches by the batch plan itself."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.risk import signal_levels
from ..plans.extract import extract_documents
from ..schemas import DOCS
from ..session import scratch_path


def read_arrivals(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return read_arrivals(spark, path, DOCS, files_per_batch)


def _place():
    """Where a row lies: its file and its number there."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")


def read_places(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """The arrivals as (doc_id, arrived, place), for a stream that keeps them for a while."""
    return read_arrivals(spark, path, schema, files_per_batch).select("doc_id", "arrived", _place())


def rows_at(places: DataFrame, path: str, schema: StructType) -> DataFrame:
    """The whole rows of arrivals at places(doc_id, place), a row for each; places is a stored table.

    The rows are dealt by doc_id, as what follows needs them; those without one, which no join by doc_id finds, are looked up by their place.
    """
    spark = places.sparkSession
    files = [r.file for r in places.select("place.file").distinct().collect()]
    rows = spark.read.schema(schema).parquet(path).where(F.col("_metadata.file_path").isin(files)).select("*", _place())
    wanted = places.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("place").alias("_places"))
    found = rows.join(wanted, "doc_id").select(
        *schema.names, F.explode(F.filter("_places", lambda p: p == F.col("place"))).alias("_at")).select(*schema.names)
    without = places.where("doc_id IS NULL").select("place")
    return found if without.isEmpty() else found.unionByName(rows.where("doc_id IS NULL").join(without, "place").select(*schema.names))


def stream_extract(spark: SparkSession, in_dir: str, out_dir: str, checkpoint_dir: str):
    """Row-wise plan only: runs as one continuous query straight into the partitioned sink."""
    return (
        read_documents(spark, in_dir).transform(extract_documents)
        .writeStream.format("parquet").partitionBy("document_type")
        .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True).start())


def stored(batch: DataFrame, spark: SparkSession) -> DataFrame:
    """The batch's rows, worked out once and written to the shared folder, as a table of the session ``spark``.

    A verdict reads its batch many times, and each reading would run the stream's joins and their state again where the cache is passed over. A
    batch's own session has no adaptive execution, which the batch plan counts on; the table's session has.
    """
    path = scratch_path(spark, "batch")
    batch.write.parquet(path)
    return spark.read.parquet(path)


def stream_verify(spark: SparkSession, in_dir: str, out_dir: str, checkpoint_dir: str,
                  verify, evidence: list[DataFrame], files_per_batch: int = 1000):
    """Run ``verify(batch, *evidence) -> DataFrame`` on every micro-batch and append its rows.

    Each evidence table is cut down to the batch's documents before anything is aggregated, so a batch costs what its own
    documents cost and not what has been stored so far.

    Each batch writes its own folder and overwrites it, so a batch replayed after a failure
    leaves no double rows.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch = stored(batch, spark)
        ids = batch.select("doc_id").distinct()
        own = [table.join(ids, "doc_id", "left_semi") for table in evidence]
        verify(batch, *own).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return (
        read_documents(spark, in_dir, files_per_batch)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True).start())


#: How long a document waits for its evidence, and by how much rows may come out of order.
WAIT, DELAY = "1 hour", "10 minutes"


def await_evidence(docs: DataFrame, evidence: dict[str, DataFrame], wait: str = WAIT, delay: str = DELAY) -> DataFrame:
    """Streams docs(doc_id, arrived, ...) and evidence(doc_id, arrived, ...) -> docs and a struct per kind of evidence.

    A document is held in state until every kind has come, or until the watermark says that none within ``wait`` of its
    arrival can come any more; what is missing then is NULL. Of several rows of a kind for a document the first counts. Rows behind the
    watermark, which follows the slowest stream by ``delay``, are dropped: evidence that late changes no verdict, and a document that late is
    not verified. State is bounded by what arrives within wait + delay.
    """
    out = docs.withWatermark("arrived", delay)
    for name, table in evidence.items():
        own = [c for c in table.columns if c not in ("doc_id", "arrived")]
        held = table.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["doc_id"]).select(
            F.col("doc_id").alias(f"_{name}_id"), F.col("arrived").alias(f"_{name}_at"), F.struct(*own).alias(name))
        out = out.join(held, F.expr(
            f"doc_id = _{name}_id AND _{name}_at BETWEEN arrived - INTERVAL {wait} AND arrived + INTERVAL {wait}"), "leftOuter")
    return out.drop(*[f"_{name}_{c}" for name in evidence for c in ("id", "at")])


def stream_verify_awaiting(docs: DataFrame, awaited: dict[str, DataFrame], at_hand: dict[str, DataFrame], out_dir: str,
                           checkpoint_dir: str, verify, wait: str = WAIT, delay: str = DELAY, whole=None):
    """Run ``verify(batch, {name: evidence}) -> DataFrame`` once for each document, when its awaited evidence is there or overdue.

    ``awaited`` are streams, ``at_hand`` tables; verify gets the rows of both that belong to the batch. Each batch overwrites its own folder.

    Every join of the stream keeps its documents, so long texts are best left where they arrived: let docs be ``read_places`` and
    ``whole(batch)`` give the whole rows, as ``rows_at`` does. The files then have to stay until their documents are verified.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch = stored(batch, docs.sparkSession)
        if batch.isEmpty():  # nothing is due yet
            return
        ids = batch.select("doc_id").distinct()
        own = {name: batch.where(F.col(name).isNotNull()).select("doc_id", f"{name}.*") for name in awaited}
        own |= {name: table.join(ids, "doc_id", "left_semi") for name, table in at_hand.items()}
        due = batch.drop(*awaited) if whole is None else whole(batch.select("doc_id", "place"))
        verify(due.drop("arrived"), own).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return (
        await_evidence(docs, awaited, wait, delay).writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def count_levels(verdicts: DataFrame, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """A stream of verified documents(arrived, ...) -> (start, signal, level, n): how often each level was raised in each window of time.

    A window comes out once, when the watermark has passed its end; rows of documents behind the watermark are not counted.
    """
    levels = signal_levels(verdicts.withWatermark("arrived", delay), "arrived")
    return levels.groupBy(F.window("arrived", window), "signal", "level").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "signal", "level", "n")


def stream_level_counts(verdicts: DataFrame, out_dir: str, checkpoint_dir: str, window: str = "1 hour", delay: str = DELAY):
    return (
        count_levels(verdicts, window, delay).writeStream.format("parquet").outputMode("append")
        .option("path", out_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
