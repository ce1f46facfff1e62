"""Document files as rows: scan, sniff the format, accept or reject; typed table readers and sinks."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import report
from ..schemas import BOXES
from .listing import list_files

# --- fixed values: limits and leading bytes ------------------------------------------------
MAX_BYTES = 20 * 1024 * 1024
SNIFF_BYTES = 2048
ALLOWED = ["application/pdf", "image/jpeg", "image/png", "image/tiff", "image/webp"]
LEADING_BYTES = [
    ("application/pdf", r"^255044462D"),
    ("image/jpeg", r"^FFD8FF"),
    ("image/png", r"^89504E470D0A1A0A"),
    ("image/tiff", r"^(49492A00|4D4D002A)"),
    ("image/webp", r"^52494646.{8}57454250"),
    ("image/gif", r"^474946383[79]61"),
    ("application/zip", r"^504B0304"),
]
# --- end of fixed values --------------------------------------------------------------


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path as (doc_id, digest, path, suffix, is_pdf, length, content).

    Every upload has an id of its own, from its path; uploads of one file share the content's digest.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path)
        .transform(with_file_columns)
    )


def scan_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every upload under a path, checked: the columns of scan_files with mime, verdict and message.

    Files of zero bytes, which Spark's file source leaves out, and files over the limit come from the listing alone and
    are never opened; their content is empty or NULL.
    """
    listed = list_files(spark, path)
    unread = listed.where((F.col("length") == 0) | (F.col("length") > max_bytes)).withColumn(
        "content", F.when(F.col("length") == 0, F.lit(b""))).transform(with_file_columns)
    read = scan_files(spark, path).where(F.col("length") <= max_bytes)
    return validate_files(read.unionByName(unread), max_bytes)


def with_file_columns(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select(
        F.xxhash64("path").alias("doc_id"), F.sha2("content", 256).alias("digest"), "path",
        F.when(suffix == "", ".bin").otherwise(suffix).alias("suffix"),
        (suffix == ".pdf").alias("is_pdf"), "length", "content")


def sniff_mime(content: Column) -> Column:
    """MIME type from the leading bytes; text and anything else are told apart only roughly. NULL where nothing was read."""
    head = F.hex(F.substring(content, 1, SNIFF_BYTES))
    mime = None
    for name, pattern in LEADING_BYTES:
        mime = (F if mime is None else mime).when(head.rlike(pattern), name)
    binary = head.rlike(r"^(?:..)*?0[0-8]")
    return F.when(content.isNotNull(), mime.when(F.length(content) == 0, "application/x-empty")
                  .when(binary, "application/octet-stream").otherwise("text/plain"))


def validate_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add mime, verdict (accepted / FileTooLargeError / UnsupportedFileTypeError) and message.

    Size is tested first, on the ``length`` column, so that a filter on the verdict reaches the file source and files
    too large are not read. The declared suffix is not consulted.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    too_large = F.col("length") > max_bytes
    limit = f"{max_bytes / 1048576:.10f}".rstrip("0").rstrip(".")
    refused = ~F.col("mime").isin(*ALLOWED)
    return (
        files.withColumn("mime", sniff_mime(F.col("content")))
        .withColumn("verdict", F.when(too_large, "FileTooLargeError")
                    .when(refused, "UnsupportedFileTypeError").otherwise("accepted"))
        .withColumn("message", F.when(too_large, F.concat(
            F.lit("File '"), name, F.lit("' is "), F.format_string("%.1f", F.col("length") / 1048576),
            F.lit(f" MB — limit is {limit} MB.")))
            .when(refused, F.concat(
                F.lit("MIME type '"), F.col("mime"), F.lit("' is not supported. Allowed: " + ", ".join(ALLOWED)))))
    )


def accepted_and_rejected(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two DataFrames. The size is a filter of its own, which the file source can apply to the listing."""
    checked = validate_files(files, max_bytes)
    return checked.where(F.col("length") <= max_bytes).where(F.col("verdict") == "accepted"), checked.where(F.col("verdict") != "accepted")


def scan_boxes(spark: SparkSession, path: str) -> DataFrame:
    """OCR boxes written outside, under their fixed schema."""
    return spark.read.schema(BOXES).parquet(path)


def write_extracted(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Light response, one folder per document type so readers of a type skip the rest."""
    df.write.mode(mode).partitionBy("document_type").parquet(path)


def write_verdicts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Full response with its nested columns."""
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str, key: str = "doc_id") -> DataFrame:
    """A table in buckets of the key, sorted, at a path; returns it as the session's catalog reads it.

    Tables with the same number of buckets join on the key, and group by it, without an exchange: the documents and each kind of evidence are
    dealt once, when they are written, however often they are verified. Choose the number so that a bucket's
    documents with all their evidence fit a task, about one per 100 MB of the largest table, and not below the session's
    shuffle partitions, as Spark otherwise deals the tables anew into more parts.
    """
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_verdict_json(verdicts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The nested responses as JSON lines, one file a partition."""
    report.verdict_json(verdicts).select("json").write.mode(mode).text(path)
