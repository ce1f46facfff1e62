"""Whole plans: shape of the physical plan, batch against stream, and every query against its SQL."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docproof import catalog
from docproof.operators import ocr
from docproof.session import checkpoint, scratch_path, usable

SF = os.environ.get("DOCPROOF_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(entry.oracle_sql())))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, cur.fetchall())


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())


def test_no_field_is_pruned_from_the_extraction(spark):
    from docproof.functions import parse
    plan = entry.queries()["extract_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (parse.ID_NUMBER, parse.DATE, parse.PINCODE, parse.TAX_NUMBER, parse.PASSPORT_NUMBER):
        assert pattern in plan


def test_a_batch_cuts_the_evidence_before_it_is_aggregated(spark):
    from docproof.plans.verify import verify_documents
    docs = spark.createDataFrame([(1, "x", 1.0, 1)], "doc_id long, text string, confidence double, page_count long")
    ids = docs.select("doc_id")
    side = [t.join(ids, "doc_id", "left_semi") for t in catalog.evidence(spark, SF)]
    plan = verify_documents(docs, *side, F.lit(catalog.AS_OF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= len(side)


def test_tiles_and_residuals_are_read_once(spark):
    for name, scans in (("noise_uniformity", 1), ("blockiness_flag", 1)):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == scans


@pytest.mark.parametrize("name", ["verify_documents", "fuse_ocr", "copy_move_pairs", "classify_scores", "assign_lines",
                                  "dispersion_profile", "cross_document_check", "merge_tokens", "top_blocks"])
def test_plan_stays_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "InPandas"):
        assert unwanted not in plan


def test_lines_of_words_are_built_where_their_document_is(spark):
    plan = entry.queries()["merge_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_row_wise_plan_has_no_exchange(spark):
    docs = catalog.fixture(spark, SF, "corpus").withColumn("confidence", F.lit(1.0))
    plan = catalog.extract_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scan_reads_only_what_is_used_and_filters_reach_it(spark):
    plan = entry.queries()["text_block_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_tax,0.05)" in plan and "l_extendedprice" not in plan


def test_top_blocks_limits_before_the_shuffle(spark):
    plan = entry.queries()["top_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filter_on_the_type_does_not_copy_the_patterns(spark):
    docs = catalog.classified(spark, SF).where("document_type = 'pan'")
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("permanent account number") < 10


def test_shared_folder_is_taken_from_the_session(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(spark.sparkContext.getCheckpointDir())
    assert checkpoint(spark.range(3)).count() == 3


@pytest.mark.parametrize("master, folder, ok", [
    ("local[4]", "file:/tmp/w", True), ("local", "/tmp/w", True), ("yarn", "file:/tmp/w", False), ("spark://h:7077", "/tmp/w", False),
    ("k8s://h", "s3a://bucket/w", True), ("yarn", "hdfs://n/w", True)])
def test_a_local_folder_is_refused_on_a_cluster(master, folder, ok):
    assert usable(master, folder) is ok


def test_scores_stay_in_range(spark):
    r = catalog.verified(spark, SF).agg(F.min("risk_score"), F.max("risk_score"), F.count("*"), F.countDistinct("doc_id")).first()
    assert r[0] >= 0 and r[1] <= 100 and r[2] == r[3] == catalog.fixture(spark, SF, "corpus").count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["document_type", "documents", "mean_risk", "genuine", "suspicious", "fake"]


def test_two_batches_equal_one_plan(spark):
    from docproof.plans.verify import verify_documents
    from docproof.streaming import intake
    into, out, marks = (scratch_path(spark, n) for n in ("arrivals", "streamed", "marks"))
    docs = ocr.pages_to_document(catalog.fixture(spark, SF, "page_lines")).where("doc_id % 5 = 0")
    for odd in (0, 1):
        docs.where(F.col("doc_id") % 2 == odd).coalesce(1).write.mode("append").parquet(into)
    shown = ["doc_id", "risk_score", "status", "duplicate_regions", "font_status", "qr_validation", "reply_reasoning"]
    verify = lambda df, *side: catalog.verdict_columns(verify_documents(df, *side, F.lit(catalog.AS_OF))).select(*shown)
    intake.stream_verify(spark, into, out, marks, verify, catalog.evidence(spark, SF), files_per_batch=1).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.select("batch_id").distinct().count() == 2
    assert comparable(shown, streamed.select(*shown).collect()) == comparable(shown, verify(docs, *catalog.evidence(spark, SF)).collect())


def test_bucketed_tables_need_no_exchange_of_documents(spark):
    """Documents and evidence in buckets of doc_id: what is left are the exchanges inside the copy-move search, and one of its result."""
    from docproof.plans.verify import verify_documents
    from docproof.sources import files
    some = lambda df: df.where("doc_id % 25 = 0")
    run, old = scratch_path(spark, "buckets"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else small tables are broadcast and show nothing
    try:
        tables = [some(df) for df in [ocr.pages_to_document(catalog.fixture(spark, SF, "page_lines")), *catalog.evidence(spark, SF)]]
        plain = [checkpoint(df) for df in tables]
        stored = [files.write_bucketed(df, f"t{k}_{run[-8:]}", 8, f"{run}/{k}") for k, df in enumerate(plain)]
        verify = lambda side: catalog.verdict_columns(verify_documents(*side, F.lit(catalog.AS_OF)))
        exchanges = lambda df: len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\)", df._jdf.queryExecution().executedPlan().toString()))
        assert exchanges(verify(stored)) <= 1 and exchanges(verify(plain)) > 6
        assert comparable(["doc_id", "risk_score"], verify(stored).select("doc_id", "risk_score").collect()) == comparable(
            ["doc_id", "risk_score"], verify(plain).select("doc_id", "risk_score").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_whole_response_stays_in_the_plan(spark):
    plan = entry.queries()["verify_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert all(name in plan for name in ("all_scores", "matched_signals", "fields_found", "verhoeff_penalty", "pipeline_stages"))


def test_payloads_are_parsed_once_and_over_all_tasks(spark):
    plan = entry.queries()["parse_qr_xml"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") <= 1
    for name in ("qr", "replies"):
        assert catalog.fixture(spark, SF, name).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scanned_files_stay_below_the_size_limit(spark):
    """Two languages of 24 MB each: written as one file a language, both would be refused unopened and their lines lost."""
    sf = scratch_path(spark, "long")
    spark.range(480).select(F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.repeat(F.lit("word word\n"), 10_000).alias("text")) \
        .coalesce(1).write.parquet(f"{sf}/documents.parquet")
    got = {r.lang: r for r in entry.queries()["scan_files"](spark, sf).collect()}
    assert {n: (r.bytes, r.lines, r.mime) for n, r in got.items() if n != "none"} == {n: (240 * 100_001, 240 * 10_001, "text/plain") for n in ("en", "de")}


def test_a_date_is_read_once_for_all_rules(spark):
    """Three layouts of two dates for each of the five sets of rules; written out at every use they were some hundred."""
    plan = entry.queries()["final_risk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("gettimestamp(") <= 30


def test_card_tests_work_on_cards_only(spark):
    """The evidence of other types is NULL before any card test reads it; their answers were worked out and dropped."""
    from docproof.operators.layout import card_layout_score
    df = catalog.verified(spark, SF).select("document_type", "card")
    assert df.where((F.col("document_type") == "aadhaar") != F.col("card").isNotNull()).isEmpty()
    rows = spark.createDataFrame([(1, True, "uidai"), (2, False, None)], "doc_id int, mine boolean, text string").withColumns({
        "aadhaar_number": F.lit(None).cast("string"), "width": F.lit(100), "height": F.lit(900), "brightness": F.lit(1.0), "saturation": F.lit(1.0),
        "qr_region_found": F.lit(False), "photo_found": F.lit(False)})
    got = {r.doc_id: r.card_layout for r in card_layout_score(rows, only=F.col("mine")).collect()}
    assert len(got[1].issues) > 3 and got[2].issues is None


def test_scans_are_rendered_over_all_tasks(spark):
    """The source of the scans is small and lies in one task, which rendered all of them and cut them into lines."""
    assert catalog.fixture(spark, SF, "page_lines").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
