"""Streams whose evidence and rows come late, against the batch plan."""

import datetime
import glob
import inspect
import os
import random

import pytest
from pyspark.sql import functions as F

from docproof import catalog
from docproof.operators import risk
from docproof.session import scratch_path
from docproof.streaming import intake

def minutes(n):
    return catalog.after(F.lit(60 * n))


class Arrivals:
    """A folder into which rows are put file by file; one file is one batch."""

    def __init__(self, spark, like):
        self.path, self.like, self.schema = scratch_path(spark, "arrivals"), like, like.withColumn("arrived", minutes(0)).schema

    def put(self, rows, at):
        rows.withColumn("arrived", minutes(at)).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def pass_time(self, at):
        """A row that matches nothing, for the watermark."""
        self.marks = getattr(self, "marks", -id(self) % 10**6 - 10**7) - 1
        return self.put(self.like.limit(1).withColumn("doc_id", F.lit(self.marks).cast("bigint")), at)

    def stream(self):
        return intake.read_arrivals(self.like.sparkSession, self.path, self.schema, 1)


@pytest.fixture
def one_partition(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_evidence_a_batch_later_counts_and_too_late_evidence_does_not(spark, one_partition):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    replies = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("said "), "id").alias("content"))
    qr = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("code "), "id").alias("payload"))
    late, last = F.col("doc_id") % 3 == 0, F.col("doc_id") % 10 == 7
    # Batch by batch: documents; QR contents, two of each; replies in time; time passes; replies too late, and documents behind the watermark.
    d = Arrivals(spark, docs).put(docs.where(~last), 0).pass_time(5).pass_time(20).pass_time(300).pass_time(310).put(docs.where(last), 2).pass_time(900)
    q = Arrivals(spark, qr).pass_time(1).put(qr.union(qr), 10).pass_time(20).pass_time(300).pass_time(310).pass_time(400).pass_time(900)
    r = Arrivals(spark, replies).pass_time(1).pass_time(5).put(replies.where(~late), 15).pass_time(300).pass_time(310).put(replies.where(late), 16).pass_time(900)
    hand = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("score"))

    def verify(batch, own):
        for table in ("qr", "reply", "signals"):
            batch = batch.join(own[table], "doc_id", "left")
        return batch

    out, marks = scratch_path(spark, "streamed"), scratch_path(spark, "marks")
    intake.stream_verify_awaiting(d.stream(), {"qr": q.stream(), "reply": r.stream()}, {"signals": hand}, out, marks, verify).awaitTermination()
    got = spark.read.parquet(out).where("doc_id >= 0")  # without the rows for the watermark
    assert {(x.doc_id, x.text, x.payload, x.content, x.score) for x in got.collect()} == {
        (i, "text", f"code {i}" if i < 20 else None, f"said {i}" if i < 40 and i % 3 else None, 2 * i) for i in range(60) if i % 10 != 7}
    assert got.count() == got.select("doc_id").distinct().count()
    assert got.select("batch_id").distinct().count() >= 2  # those with all evidence did not wait for the others


def test_a_batch_is_worked_out_once_however_often_it_is_read(spark, one_partition):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    qr = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("code "), "id").alias("payload"))
    d, q = Arrivals(spark, docs).put(docs, 0).pass_time(900), Arrivals(spark, qr).put(qr, 10).pass_time(900)
    runs = []

    def verify(batch, own):
        runs.append((batch.inputFiles(), own["qr"].inputFiles(), batch.sparkSession.conf.get("spark.sql.adaptive.enabled")))
        return batch.join(own["qr"], "doc_id", "left").join(own["signals"], "doc_id", "left")

    hand = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("score"))
    out, marks = scratch_path(spark, "streamed"), scratch_path(spark, "marks")
    intake.stream_verify_awaiting(d.stream(), {"qr": q.stream()}, {"signals": hand}, out, marks, verify).awaitTermination()
    got = spark.read.parquet(out).where("doc_id >= 0")
    assert {(x.doc_id, x.payload, x.score) for x in got.collect()} == {(i, f"code {i}" if i < 40 else None, 2 * i) for i in range(60)}
    # Both readings are the stored rows, not the stream's join and its state, and are planned adaptively.
    assert runs and all(files and files == evidence and adaptive == "true" for files, evidence, adaptive in runs)


def test_texts_stay_where_they_arrived(spark, one_partition):
    """Documents wait as places in their files: the same verdicts as with whole rows, also of repeated ids and none, and no text in the state."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    docs = spark.createDataFrame([(None if i % 9 == 8 else i // 2, text[i:] + text[:i]) for i in range(30)], "doc_id long, text string")
    qr = spark.range(10).select(F.col("id").alias("doc_id"), F.concat(F.lit("code "), "id").alias("payload"))
    d = Arrivals(spark, docs).put(docs.limit(20), 0).put(docs.subtract(docs.limit(20)), 1).pass_time(900).pass_time(901)
    q = Arrivals(spark, qr).pass_time(1).put(qr, 10).pass_time(900).pass_time(901)
    verify = lambda batch, own: batch.join(own["qr"], "doc_id", "left")
    sizes, rows = [], []
    for places in (False, True):
        out, marks = scratch_path(spark, "streamed"), scratch_path(spark, "marks")
        stream = intake.read_places(spark, d.path, d.schema, 1) if places else d.stream()
        whole = (lambda at: intake.rows_at(at, d.path, docs.schema)) if places else None
        intake.stream_verify_awaiting(stream, {"qr": q.stream()}, {}, out, marks, verify, whole=whole).awaitTermination()
        got = spark.read.parquet(out).where("doc_id IS NULL OR doc_id >= 0").select("doc_id", F.md5("text").alias("text"), "payload")
        rows.append(sorted(map(repr, got.collect())))
        sizes.append(sum(os.path.getsize(f) for f in glob.glob(f"{marks.removeprefix('file:')}/state/**", recursive=True)))
    assert rows[0] == rows[1] and len(set(rows[0])) == 30
    assert sizes[0] > 30 * 100_000 and sizes[1] < 1_000_000


def test_documents_arrive_in_one_batch_however_finely_they_are_dealt(spark):
    limit = inspect.signature(intake.read_places).parameters["files_per_batch"].default
    assert catalog.ARRIVAL_FILES < limit
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        texts = catalog.fixture(spark, "/root/testdata/sf0.001", "page_lines", by_document=True)
        assert texts.rdd.getNumPartitions() > limit and texts.coalesce(catalog.ARRIVAL_FILES).rdd.getNumPartitions() < limit
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_windowed_levels_equal_a_batch_count(spark, one_partition):
    rows = [(i, "pan", 1.0, *(["detected", "low", "high", "suspicious", "valid", "mismatch", "not_detected"][(i + k) % 7] for k in range(7))) for i in range(300)]
    verdicts = spark.createDataFrame(rows, "doc_id long, document_type string, ela_score double, " + ", ".join(f"{s} string" for s in risk.SIGNALS))
    early, later, behind = (verdicts.where(f"doc_id % 3 = {k}") for k in range(3))
    a = Arrivals(spark, verdicts).put(early, 30).put(later, 90).pass_time(400).pass_time(410).put(behind, 45).pass_time(900)
    out = scratch_path(spark, "counts")
    intake.stream_level_counts(a.stream(), out, scratch_path(spark, "marks")).awaitTermination()
    got = {(r.start.astimezone(datetime.timezone.utc).hour, r.signal, r.level): r.n for r in spark.read.parquet(out).collect()}
    want = {}
    for hour, part in ((0, early), (1, later)):
        for r in risk.signal_levels(part).groupBy("signal", "level").count().collect():
            want[hour, r.signal, r.level] = r["count"]
    assert {k: n for k, n in got.items() if k[0] < 2} == want
    # What moved the watermark on is counted in its own window; the rows behind it are nowhere.
    assert sum(got.values()) - sum(want.values()) == 14
