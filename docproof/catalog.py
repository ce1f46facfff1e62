"""Every query by name: (spark, folder of the input tables) -> DataFrame."""

import datetime

from pyspark.sql import functions as F

from .functions import bands as B
from .functions import checksum as C
from .functions import dates as D
from .functions import qr as Q
from .functions import reply as RP
from .functions import text as X
from .functions.parse import extract_name as name_of
from .operators import classify as cls
from .operators import copymove, crosscheck, layout, names, ocr, qr as QR, report, risk, stats, validate
from .plans import verify as plan
from .plans.extract import clean_and_classify, extract_documents as extract_plan
from .schemas import DOC_TYPES, FIELDS
from .session import checkpoint, scratch_path
from .sources import files
from .sources.fixtures import document_parts, fixture
from .streaming import intake

AS_OF = datetime.date(2025, 1, 1)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def cleaned(spark, sf):
    return fixture(spark, sf, "corpus").withColumn("text", X.clean_text(F.col("text")))


def classified(spark, sf):
    return clean_and_classify(fixture(spark, sf, "corpus"))


def with_fields(spark, sf):
    return extract_plan(fixture(spark, sf, "corpus").withColumn("confidence", F.lit(1.0)))


def fields_of(spark, sf, types, names):
    df = with_fields(spark, sf).where(F.col("document_type").isin(*types))
    return df.select("doc_id", *[
        F.array_join(f"fields.{n}", "; ").alias(n) if n == "skills" else F.col(f"fields.{n}").alias(n)
        for n in names])


# --- files and sinks -----------------------------------------------------------------------

SIZE_LIMIT = 4096  # small enough that the prose documents fall on both sides


@query
def scan_files(spark, sf):
    """The documents written out as files, then scanned as whole files: bytes and lines by language, however the files
    were cut. No file of several texts passes the size limit, beyond which uploads are not opened and their lines not counted.
    A file of zero bytes is among them, and refused like the others, which are no images."""
    path = scratch_path(spark, "files")
    texts = fixture(spark, sf, "documents").select("lang", "text")
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0] or 0
    texts.write.partitionBy("lang").option("maxRecordsPerFile", max(1, min(10_000, files.MAX_BYTES // (longest + 1)))).text(path)
    texts.where("false").select("text").coalesce(1).write.text(f"{path}/lang=none")
    breaks = F.octet_length("content") - F.octet_length(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")))
    return files.scan_uploads(spark, path).groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum("length").alias("bytes"), F.sum(breaks.cast("long")).alias("lines"),
        F.max("suffix").alias("suffix"), F.bool_or("is_pdf").alias("any_pdf"), F.max("mime").alias("mime"), F.max("verdict").alias("verdict"),
        F.count_if(F.col("length") == 0).alias("empty"))


@query
def validate_files(spark, sf):
    df = files.validate_files(files.with_file_columns(fixture(spark, sf, "files")), SIZE_LIMIT)
    return df.select("digest", "path", "suffix", "is_pdf", "length", "mime", "verdict", "message")


@query
def sink_extracted(spark, sf):
    path = scratch_path(spark, "extracted")
    files.write_extracted(extract_plan(ocr.pages_to_document(fixture(spark, sf, "page_lines"))), path)
    return extract_columns(spark.read.parquet(path))


@query
def sink_verdicts(spark, sf):
    path = scratch_path(spark, "verdicts")
    files.write_verdicts(report.with_response(verified(spark, sf), *BESIDE), path)
    return response_columns(spark.read.parquet(path), *BESIDE[1:])


@query
def sink_json(spark, sf):
    """The nested responses written as JSON lines, and read back as variants."""
    path = scratch_path(spark, "json")
    done = verified(spark, sf)
    kind = report.with_response(done, "doc_id").schema["response"].dataType.simpleString()
    files.write_verdict_json(done, path)
    lines = spark.read.text(path).withColumnRenamed("value", "json").withColumn("doc_id", F.lit(None).cast("bigint"))
    scores = report.read_json(lines, kind).select("response.*")
    return scores.groupBy("document_type", "status").agg(
        F.count("*").alias("n"), F.sum("risk_score").cast("bigint").alias("risk"), F.bround(F.sum("confidence"), 6).alias("confidence"),
        F.sum(F.size("validation.checks")).cast("bigint").alias("checks"), F.count("aadhaar_verification").alias("cards"))


BUCKETS = 8


@query
def verify_bucketed(spark, sf):
    """Documents and evidence written in buckets of doc_id, then verified: the joins of a verdict need no exchange."""
    docs = ocr.pages_to_document(fixture(spark, sf, "page_lines"))
    run = scratch_path(spark, "buckets")
    name = run.rsplit("-", 1)[1]
    stored = [files.write_bucketed(df, f"{kind}_{name}", BUCKETS, f"{run}/{kind}") for kind, df in zip(
        ("docs", "signals", "qr", "replies", "blocks", "tiles", "descriptors"), [docs, *evidence(spark, sf)], strict=True)]
    return verdict_columns(plan.verify_documents(*stored, F.lit(AS_OF)))


@query
def stream_verify(spark, sf):
    """The documents as an arriving stream; rows equal those of the batch plan."""
    into, out, marks = (scratch_path(spark, n) for n in ("arrivals", "streamed", "marks"))
    ocr.pages_to_document(fixture(spark, sf, "page_lines")).write.parquet(into)
    intake.stream_verify(spark, into, out, marks, lambda batch, *side: verdict_columns(
        plan.verify_documents(batch, *side, F.lit(AS_OF))), evidence(spark, sf)).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query
def stream_extract(spark, sf):
    into, out, marks = (scratch_path(spark, n) for n in ("arrivals", "streamed", "marks"))
    ocr.pages_to_document(fixture(spark, sf, "page_lines")).write.parquet(into)
    intake.stream_extract(spark, into, out, marks).awaitTermination()
    return extract_columns(spark.read.parquet(out))


ARRIVALS_FROM = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)


def after(seconds):
    """The first arrival and so many seconds."""
    return F.timestamp_seconds(F.lit(int(ARRIVALS_FROM.timestamp())) + seconds)


def arriving(df, path, seconds, last, mark=-1, read=intake.read_arrivals):
    """df with its times of arrival, stored, and a last row (doc_id ``mark``) that moves the watermark past all of them; read as a stream."""
    timed = df.withColumn("arrived", after(seconds))
    timed.write.parquet(path)
    end = df.sparkSession.range(1).select(*[F.lit(mark).cast("bigint").alias("doc_id") if f.name == "doc_id" else after(F.lit(last)).alias("arrived")
                                            if f.name == "arrived" else F.lit(None).cast(f.dataType).alias(f.name) for f in timed.schema.fields])
    end.write.mode("append").parquet(path)
    return read(df.sparkSession, path, timed.schema)


#: Fewer than a batch takes: the evidence comes at once, and documents of a later batch would be behind the watermark.
ARRIVAL_FILES = 500


@query
def stream_verify_awaiting(spark, sf):
    """Documents, QR contents and replies as three streams, the evidence 20 to 30 minutes behind its document: every document waits
    for its evidence or the end of the time allowed, so rows equal those of the batch plan."""
    minutes = lambda low, spread: 60 * low + F.pmod(F.col("doc_id"), F.lit(60 * spread))
    stream = lambda name, df, seconds, mark: arriving(df, scratch_path(spark, name), seconds, 36_000, mark)
    texts, into = ocr.pages_to_document(fixture(spark, sf, "page_lines", by_document=True)), scratch_path(spark, "arrivals")
    docs = arriving(texts.coalesce(ARRIVAL_FILES), into, minutes(0, 30), 36_000, read=intake.read_places)
    awaited = {"qr": stream("qr", fixture(spark, sf, "qr"), minutes(20, 30), -2),
               "reply": stream("replies", replies(spark, sf), minutes(30, 30), -3)}
    tables = {n: fixture(spark, sf, n) for n in ("signals", "blocks", "tiles")} | {"descriptors": checkpoint(fixture(spark, sf, "descriptors"))}

    def verify(batch, own):
        return verdict_columns(plan.verify_documents(
            batch, own["signals"], own["qr"], own["reply"], own["blocks"], own["tiles"], own["descriptors"], F.lit(AS_OF)))

    out = scratch_path(spark, "streamed")
    intake.stream_verify_awaiting(docs, awaited, tables, out, scratch_path(spark, "marks"), verify,
                                  whole=lambda places: intake.rows_at(places, into, texts.schema)).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query
def stream_level_counts(spark, sf):
    """Levels of the verified documents counted by the hour of their arrival, over a day."""
    verdicts = verified(spark, sf).select("doc_id", "document_type", "ela_score", *risk.SIGNALS)
    stream = arriving(verdicts, scratch_path(spark, "verdicts"), F.pmod(F.col("doc_id") * 97, F.lit(86_400)), 3 * 86_400)
    out = scratch_path(spark, "counts")
    intake.stream_level_counts(stream, out, scratch_path(spark, "marks")).awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


# --- text and classification ---------------------------------------------------------------

@query
def clean_text(spark, sf):
    return cleaned(spark, sf).select("doc_id", "text")


@query
def normalise_ws(spark, sf):
    t = F.col("text")
    return fixture(spark, sf, "corpus").select(
        "doc_id", X.normalise_ws(t).alias("collapsed"), X.normalise_ws(t, lower=True).alias("dedup_key"))


@query
def classify_weighted(spark, sf):
    df = classified(spark, sf)
    return df.select(
        "doc_id", "document_type", "type_confidence", "is_ambiguous",
        F.size("all_scores").alias("score_keys"),
        *[F.try_element_at("all_scores", F.lit(t)).alias(f"score_{t}") for t in DOC_TYPES],
        *[F.array_join(F.try_element_at("matched_signals", F.lit(t)), " ; ").alias(f"hits_{t}") for t in DOC_TYPES])


@query
def classify_scores(spark, sf):
    return cls.classify_scores(cleaned(spark, sf)).select(
        "doc_id", "type_ord", "document_type", "raw_score", "share", "hits",
        F.array_join("signals", " ; ").alias("signals"))


@query
def classify_keywords(spark, sf):
    return cls.classify_keywords(cleaned(spark, sf)).select("doc_id", "keyword_type", "keyword_hits")


@query
def argmax_type(spark, sf):
    return cls.argmax_type(cls.classify_scores(cleaned(spark, sf)))


@query
def parse_id_card(spark, sf):
    return fields_of(spark, sf, ["aadhaar"], ["aadhaar_number", "dob", "gender", "pincode", "address", "name"])


@query
def parse_tax_card(spark, sf):
    return fields_of(spark, sf, ["pan"], ["pan_number", "dob", "name", "father_name"])


@query
def parse_passport(spark, sf):
    return fields_of(spark, sf, ["passport"], [
        "passport_number", "dob", "expiry_date", "nationality", "mrz_line1", "mrz_line2", "surname"])


@query
def parse_resume(spark, sf):
    return fields_of(spark, sf, ["resume"], ["email", "phone", "skills", "name"])


@query
def parse_certificate(spark, sf):
    return fields_of(spark, sf, ["graduation_certificate", "marksheet"], [
        "year", "percentage", "roll_number", "student_name", "institution"])


@query
def extract_address(spark, sf):
    return fields_of(spark, sf, ["aadhaar"], ["address"])



@query
def extract_name(spark, sf):
    return classified(spark, sf).select("doc_id", name_of(F.col("text")).alias("name"))


@query
def valid_name(spark, sf):
    t = F.col("text")
    return fixture(spark, sf, "page_lines").select(
        "doc_id", "ord", X.valid_name(t).alias("valid"),
        X.valid_name(t, max_words=6, min_alpha=0.75).alias("plausible"))


@query
def rank_names(spark, sf):
    lines = fixture(spark, sf, "page_lines").select("doc_id", "ord", F.col("text").alias("name"))
    return names.rank_names(lines)


@query
def parse_fields(spark, sf):
    f = F.col("fields")
    never_set = ("given_names", "degree", "education", "experience")
    shown = [n for n in FIELDS.names if n not in never_set and n != "skills"]
    return with_fields(spark, sf).select(
        "doc_id", "document_type", *[f[n].alias(n) for n in shown], F.array_join(f["skills"], "; ").alias("skills"))


# --- single values -------------------------------------------------------------------------

@query
def parse_date(spark, sf):
    return fixture(spark, sf, "dates").select("doc_id", D.parse_date(F.col("written")).cast("string").alias("parsed"))


@query
def normalise_date_digits(spark, sf):
    w = F.col("written")
    return fixture(spark, sf, "dates").select(
        "doc_id", D.date_digits(w).alias("date_key"), D.date_without_separators(w).alias("loose_key"))


@query
def verhoeff_check(spark, sf):
    return fixture(spark, sf, "numbers").withColumn("v", C.verhoeff_check(F.col("number"))).select("doc_id", "v.*")


@query
def verhoeff_append(spark, sf):
    full = C.verhoeff_append(F.col("stem"))
    return fixture(spark, sf, "numbers").select("doc_id", full.alias("number"), C.verhoeff_check(full)["valid"].alias("valid"))


@query
def luhn_check(spark, sf):
    return fixture(spark, sf, "numbers").select("doc_id", C.luhn_check(F.col("number")).alias("luhn_ok"))


@query
def mask_id(spark, sf):
    return fixture(spark, sf, "numbers").select("doc_id", X.mask_id(F.col("number")).alias("masked"))


@query
def token_match(spark, sf):
    a, b = F.col("a"), F.col("b")
    return fixture(spark, sf, "name_pairs").select(
        "doc_id", X.token_match(a, b, 0.55).alias("deep"), X.token_match(a, b, 0.6).alias("quick"))


@query
def trigram_similarity(spark, sf):
    a = fixture(spark, sf, "page_lines").select("doc_id", "ord", F.col("text").alias("a"))
    b = fixture(spark, sf, "primary_lines").select("doc_id", "ord", F.col("text").alias("b"))
    sim = X.trigram_similarity(F.col("a"), F.col("b"))
    return a.join(b, ["doc_id", "ord"]).select(
        "doc_id", "ord", F.bround(sim, 6).alias("similarity"), (sim >= 0.75).alias("near_duplicate"))


# --- replies -------------------------------------------------------------------------------

def replies(spark, sf):
    return fixture(spark, sf, "replies").withColumn(
        "parts", F.when(F.col("part_1").isNotNull(), F.array("part_1", "part_2"))).drop("part_1", "part_2")


@query
def parse_model_json(spark, sf):
    texts = replies(spark, sf).select("doc_id", RP.reply_text(
        F.col("content"), F.col("reasoning"), F.col("reasoning_content"), F.col("parts")).alias("reply_text"))
    j = F.col("reply_json")
    return RP.parse_model_json(texts).select(
        "doc_id", "reply_error", j["vlm_confidence"].alias("vlm_confidence"),
        j["overall_assessment"].alias("overall_assessment"), j["visible_tampering"].alias("visible_tampering"),
        j["suggested_risk_adjustment"].cast("int").alias("delta"), j["reasoning"].alias("reasoning"),
        F.array_join(F.array_sort(F.map_keys("reply_extra")), ",").alias("extra_keys"))


def reply_columns(df):
    r = F.col("reply")
    return df.select(
        "doc_id", "quarantine_reason", r["vlm_available"].alias("available"),
        r["vlm_confidence"].alias("vlm_confidence"), r["overall_assessment"].alias("overall_assessment"),
        r["layout_authenticity"].alias("layout_authenticity"), r["font_consistency"].alias("font_consistency"),
        r["visible_tampering"].alias("visible_tampering"), r["seal_signature_present"].alias("seal_signature_present"),
        r["reasoning"].alias("reasoning"), r["suggested_risk_adjustment"].alias("delta"),
        F.array_join(F.transform(r["fraud_signals"], lambda s: F.concat_ws("/", s["signal"], s["severity"])), ";").alias("signals"),
        F.array_join(r["logical_inconsistencies"], "; ").alias("inconsistencies"))


@query
def coalesce_model_reply(spark, sf):
    return reply_columns(RP.coalesce_model_reply(replies(spark, sf)))


@query
def attach_model_reply(spark, sf):
    return reply_columns(RP.attach_model_reply(fixture(spark, sf, "corpus").select("doc_id"), replies(spark, sf)))


# --- QR ------------------------------------------------------------------------------------

def decoded(spark, sf):
    return Q.decode_qr(fixture(spark, sf, "qr"))


def payload_columns(df):
    return df.select("doc_id", *[
        F.array_join("qr.fields_found", ",").alias(n) if n == "fields_found" else F.col(f"qr.{n}").alias(n)
        for n in Q.PAYLOAD_FIELDS])


@query
def qr_payload_type(spark, sf):
    return fixture(spark, sf, "qr").select("doc_id", Q.payload_type(F.col("payload")).alias("kind"))


@query
def decode_qr(spark, sf):
    return payload_columns(decoded(spark, sf))


@query
def parse_qr_xml(spark, sf):
    return payload_columns(decoded(spark, sf).where(F.col("qr.qr_type").isin("xml_signed", "xml_plain")))


@query
def parse_qr_text(spark, sf):
    return payload_columns(decoded(spark, sf).where(F.col("qr.qr_type") == "text_plain"))


@query
def parse_qr_parts(spark, sf):
    return payload_columns(decoded(spark, sf).where(F.col("qr.qr_type") == "secure_v2"))


def match_columns(df):
    m = F.col("match")
    return df.select(
        "doc_id", m["status"].alias("status"), m["penalty"].alias("penalty"), m["qr_type"].alias("qr_type"),
        F.array_join(m["matches"], ",").alias("matches"), F.array_join(m["mismatches"], "; ").alias("mismatches"),
        m["summary"].alias("summary"))


@query
def reconcile_qr_ocr(spark, sf):
    return match_columns(QR.reconcile_qr_ocr(fixture(spark, sf, "readings"), decoded(spark, sf)))


@query
def correct_from_qr(spark, sf):
    df = QR.correct_from_qr(QR.reconcile_qr_ocr(fixture(spark, sf, "readings"), decoded(spark, sf)))
    fill = lambda k: F.try_element_at("corrections", F.lit(k)).alias(f"filled_{k}")
    return df.select("doc_id", "corrected_name", "corrected_dob", fill("name"), fill("dob"))


@query
def qr_quick_verdict(spark, sf):
    return QR.qr_quick_verdict(fixture(spark, sf, "readings"), decoded(spark, sf)).select("doc_id", "qr_quick", "quick_name")


# --- image signals -------------------------------------------------------------------------

def imaged(spark, sf):
    return fixture(spark, sf, "corpus").select("doc_id").join(fixture(spark, sf, "signals"), "doc_id", "left")


@query
def metadata_verdict(spark, sf):
    c = F.col
    return fixture(spark, sf, "signals").select("doc_id", B.metadata_verdict(
        c("suffix"), c("exif_state"), c("software"), c("datetime"), c("datetime_original")).alias("metadata"))


@query
def ela_band(spark, sf):
    s = F.col("ela_score")
    return fixture(spark, sf, "signals").select("doc_id", B.ela_band(s).alias("ela"), B.ela_value(s).alias("ela_score"))


@query
def blur_band(spark, sf):
    s = F.col("blur_score")
    return fixture(spark, sf, "signals").select("doc_id", B.blur_band(s).alias("blur"), B.blur_value(s).alias("blur_score"))


@query
def synthetic_vote(spark, sf):
    c = F.col
    return fixture(spark, sf, "signals").select("doc_id", B.synthetic_vote(
        c("dct_mid_ratio"), c("noise_uniformity"), c("edge_density")).alias("ai_artifacts"))


@query
def layout_verdict(spark, sf):
    df = layout.layout_verdict(classified(spark, sf).join(imaged(spark, sf), "doc_id"))
    return df.select("doc_id", "layout_validation", F.array_join("layout_violations", "; ").alias("violations"))


@query
def card_layout_score(spark, sf):
    cards = with_fields(spark, sf).where(F.col("document_type") == "aadhaar").select(
        "doc_id", "text", F.col("fields.aadhaar_number").alias("aadhaar_number"))
    df = layout.card_layout_score(cards.join(fixture(spark, sf, "signals"), "doc_id", "left"))
    return df.select("doc_id", "card_layout.status", "card_layout.penalty",
                     F.array_join("card_layout.issues", "; ").alias("issues"), "card_layout.detail")


# --- statistics ----------------------------------------------------------------------------

@query
def text_block_filter(spark, sf):
    return stats.text_block_filter(fixture(spark, sf, "blocks"))


@query
def dispersion_profile(spark, sf):
    blocks = stats.text_block_filter(fixture(spark, sf, "blocks"))
    df = stats.dispersion_profile(blocks, "doc_id", "hf_ratio")
    return df.select("doc_id", "n", *[F.bround(c, 9).alias(c) for c in ("mean", "sd", "cv")], "outliers", "enough")


@query
def font_verdict(spark, sf):
    df = stats.font_consistency(fixture(spark, sf, "blocks"), fixture(spark, sf, "tiles"))
    return df.select("doc_id", "font.*")


@query
def blockiness_flag(spark, sf):
    return stats.blockiness_flag(fixture(spark, sf, "tiles"))


@query
def noise_uniformity(spark, sf):
    df = stats.noise_uniformity(fixture(spark, sf, "tiles"), "doc_id", "cell", "residual")
    return df.select("doc_id", "cells", F.bround("uniformity", 9).alias("uniformity"))


@query
def top_blocks(spark, sf):
    return stats.top_blocks(fixture(spark, sf, "blocks"))


@query
def copy_move_pairs(spark, sf):
    return copymove.copy_move_pairs(checkpoint(fixture(spark, sf, "descriptors")))


@query
def copy_move_verdict(spark, sf):
    return copymove.copy_move_verdict(checkpoint(fixture(spark, sf, "descriptors")), min_pairs=1)


# --- OCR boxes -----------------------------------------------------------------------------

def lines_of_tokens(spark, sf):
    return ocr.lines_of_tokens(fixture(spark, sf, "tokens", by_document=True))


def secondary_lines(spark, sf):
    return lines_of_tokens(spark, sf).select(
        "doc_id", "page_no", F.col("line_no").alias("ord"), "text", F.bround("confidence", 6).alias("confidence"))


def by_document(spark, df, name):
    """df stored in buckets of doc_id, as many as its documents are dealt into, so that nothing made of both is sent again."""
    path = scratch_path(spark, name)
    return files.write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), document_parts(spark), path)


def fused(spark, sf, second):
    return ocr.fuse_ocr(fixture(spark, sf, "primary_lines", by_document=True), second)


@query
def scan_boxes(spark, sf):
    """Boxes written as an OCR engine leaves them, read back under their fixed schema."""
    path = scratch_path(spark, "boxes")
    fixture(spark, sf, "tokens").select(
        "doc_id", "page_no", (F.col("line") * 10_000 + F.col("word")).cast("int").alias("ord"),
        F.lit("second").alias("engine"), "text", "confidence", "x0", "y0", "x1", "y1").write.parquet(path)
    return files.scan_boxes(spark, path)


@query
def pages_to_document(spark, sf):
    df = ocr.pages_to_document(fixture(spark, sf, "page_lines"))
    return df.select("doc_id", "text", F.bround("confidence", 9).alias("confidence"), "page_count")


@query
def assign_lines(spark, sf):
    return ocr.assign_lines(fixture(spark, sf, "tokens")).select("doc_id", "page_no", "line", "word", "line_no")


@query
def merge_tokens(spark, sf):
    return lines_of_tokens(spark, sf).withColumn("confidence", F.bround("confidence", 6))


@query
def fuse_ocr(spark, sf):
    return fused(spark, sf, by_document(spark, secondary_lines(spark, sf), "second"))


@query
def secondary_only_lines(spark, sf):
    second = by_document(spark, secondary_lines(spark, sf), "second")
    return ocr.secondary_only_lines(by_document(spark, fused(spark, sf, second), "fused"), second)


@query
def label_regions(spark, sf):
    return ocr.label_regions(fixture(spark, sf, "page_lines"))


# --- rules and risk ------------------------------------------------------------------------

@query
def validate_fields(spark, sf):
    return validate.validate_fields(with_fields(spark, sf), F.lit(AS_OF))


@query
def validation_report(spark, sf):
    return validate.validation_report(validate.validate_fields(with_fields(spark, sf), F.lit(AS_OF)))


def evidence(spark, sf):
    """The tables of evidence; the descriptors, which cost much to derive and are read several times, stored."""
    return [fixture(spark, sf, "signals"), fixture(spark, sf, "qr"), replies(spark, sf),
            fixture(spark, sf, "blocks"), fixture(spark, sf, "tiles"), checkpoint(fixture(spark, sf, "descriptors"))]


def verified(spark, sf, build=plan.verify_documents):
    docs = ocr.pages_to_document(fixture(spark, sf, "page_lines"))
    return build(docs, *evidence(spark, sf), F.lit(AS_OF))


@query
def penalty_lookup(spark, sf):
    return risk.penalty_lookup(risk.signals_long(verified(spark, sf))).select("doc_id", "signal", "value", "points")


@query
def signal_levels(spark, sf):
    return risk.signal_levels(verified(spark, sf))


@query
def base_risk(spark, sf):
    return risk.base_risk(risk.signals_long(verified(spark, sf))).select("doc_id", "base_score")


@query
def card_verification(spark, sf):
    c = F.col("card")
    return verified(spark, sf).where(c.isNotNull()).select(
        "doc_id", c["verhoeff_valid"].alias("verhoeff_valid"), c["verhoeff_reason"].alias("verhoeff_reason"),
        c["total_penalty"].alias("total_penalty"), c["risk_level"].alias("risk_level"),
        c["checks_passed"].alias("checks_passed"), c["checks_failed"].alias("checks_failed"), c["summary"].alias("summary"))


@query
def final_risk(spark, sf):
    return verified(spark, sf).select("doc_id", "base_score", "risk_score")


@query
def status_band(spark, sf):
    return verified(spark, sf).groupBy("document_type", "status").agg(F.count("*").alias("n"))


@query
def cross_document_check(spark, sf):
    f = F.col("fields")
    docs = with_fields(spark, sf).select(
        "doc_id", "document_type", F.coalesce(f["name"], f["surname"], f["student_name"]).alias("name"), f["dob"].alias("dob"))
    return crosscheck.cross_document_check(checkpoint(docs.join(fixture(spark, sf, "subjects"), "doc_id")))


# --- whole plans and outputs ---------------------------------------------------------------

@query
def extract_documents(spark, sf):
    return extract_columns(extract_plan(ocr.pages_to_document(fixture(spark, sf, "page_lines"))))


def field_columns(f):
    """Every field, lists as joined text."""
    return [F.array_join(f[n.name], "; ").alias(n.name) if n.dataType.typeName() == "array" else f[n.name].alias(n.name)
            for n in FIELDS.fields]


def extract_columns(df):
    return df.select(
        "doc_id", "document_type", "type_confidence", "is_ambiguous", "confidence", "page_count", *field_columns(F.col("fields")),
        *[F.try_element_at("all_scores", F.lit(t)).alias(f"score_{t}") for t in DOC_TYPES],
        *[F.array_join(F.try_element_at("matched_signals", F.lit(t)), " ; ").alias(f"hits_{t}") for t in DOC_TYPES])


BESIDE = ["doc_id", "base_score", "quarantine_reason"]


def response_columns(df, *more):
    """A nested response as flat columns: lists and maps as joined text."""
    r = F.col("response")
    reply, card, found, rules = (r[n] for n in ("vlm_analysis", "aadhaar_verification", "classification", "validation"))
    said = [n for n in df.schema["response"].dataType["vlm_analysis"].dataType.names
            if n not in ("field_validation", "logical_inconsistencies", "fraud_signals", "vlm_available")]
    check = lambda c: F.concat_ws("|", c["field_name"], c["passed"].cast("string"), c["severity"], c["message"])
    lists = ("qr_fields_found", "qr_mismatches", "layout_issues")
    names = [n for keys in report.CARD_PARTS.values() for n in keys.values()]
    joined = lambda c, by: F.array_join(F.array_sort(c), by)
    pairs = lambda m: joined(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    matched = F.map_keys(F.map_filter(card["qr_field_matches"], lambda k, v: v["match"]))
    return df.select(
        "doc_id", r["document_type"].alias("document_type"), *[r["fraud_analysis"][n].alias(n) for n in report.FRAUD],
        *[r[n].alias(n) for n in ("risk_score", "status", "confidence", "page_count")],
        found["primary_confidence"].alias("type_confidence"), found["is_ambiguous"].alias("is_ambiguous"),
        *[F.try_element_at(found["all_scores"], F.lit(t)).alias(f"score_{t}") for t in DOC_TYPES],
        *[F.array_join(F.try_element_at(found["matched_signals"], F.lit(t)), " ; ").alias(f"hits_{t}") for t in DOC_TYPES],
        *field_columns(r["extracted_fields"]),
        reply["vlm_available"].alias("reply_available"), *[reply[n].alias(f"reply_{n}") for n in said],
        pairs(reply["field_validation"]).alias("reply_field_validation"),
        F.array_join(F.transform(reply["fraud_signals"], lambda s: F.concat_ws("/", s["signal"], s["severity"])), ";").alias("reply_signals"),
        F.array_join(reply["logical_inconsistencies"], "; ").alias("reply_inconsistencies"),
        F.array_join(F.transform(rules["checks"], check), " ; ").alias("checks"),
        rules["passed"].alias("validation_passed"), rules["failed"].alias("validation_failed"),
        rules["critical_failures"].alias("critical_failures"), rules["validation_score"].alias("validation_score"),
        rules["summary"].alias("validation_summary"),
        *[(F.array_join(card[n], "; ") if n in lists else card[n]).alias("card_summary" if n == "summary" else n) for n in names],
        joined(matched, ",").alias("qr_matches"),
        *[F.try_element_at(card["corrected_fields"], F.lit(n)).alias(f"filled_{n}") for n in ("name", "dob")],
        F.array_join(r["pipeline_stages"], ",").alias("stages"), *more)


def verdict_columns(df, *more):
    """The whole response of verified documents, and what stands beside it."""
    return response_columns(report.with_response(df, *BESIDE, *more), *BESIDE[1:], *more)


@query
def verify_documents(spark, sf):
    return verdict_columns(verified(spark, sf))


@query
def analyze_documents(spark, sf):
    return verdict_columns(verified(spark, sf, plan.analyze_documents), "human_summary")


@query
def human_summary(spark, sf):
    return verified(spark, sf, plan.analyze_documents).select("doc_id", "human_summary")


@query
def audit_stages(spark, sf):
    stages = report.audit_stages(F.col("document_type"))
    return classified(spark, sf).select("doc_id", F.array_join(stages, ",").alias("stages"), F.size(stages).alias("stage_count"))


@query
def verdict_json(spark, sf):
    """Each response as one nested JSON text, read back key by key."""
    done = verified(spark, sf)
    kind = report.with_response(done, "doc_id").schema["response"].dataType.simpleString()
    return response_columns(report.read_json(report.verdict_json(done), kind))


def flagship(spark, sf):
    """Verdicts and mean risk by document type: the whole plan on every document."""
    return verified(spark, sf).groupBy("document_type").agg(
        F.count("*").alias("documents"), F.bround(F.avg("risk_score"), 4).alias("mean_risk"),
        F.count_if(F.col("status") == "Likely Genuine").alias("genuine"),
        F.count_if(F.col("status") == "Suspicious").alias("suspicious"),
        F.count_if(F.col("status") == "Likely Fake / Tampered").alias("fake"))


QUERIES["risk_by_type"] = flagship
