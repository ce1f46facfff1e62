"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. A rule set has a version; the ledger holds the
(blob, rule version) pairs scanned so far with their findings. A run scans one copy of each blob that the ledger lacks
under the current rules, and joins all findings back to every path that ever held the blob.

Rules run in a fixed order: assign, access and hex are the base; pem and token_prefix are the method's own. Every match
is leftmost and non-overlapping within its kind; a match that fails its length test is dropped but stays consumed. A pem span
holds the key as well as its header line; a header alone is a span, too.

Defined results: a null text is the empty blob, with no spans. Repeated rows and equal texts share one scan and each get
their row. Ties of start are ordered by kind as listed. An empty table, or one that the ledger covers, scans nothing.
Offsets are code points, end exclusive. Only path and text are read, so further columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.graph import stored
from llm.words import slices

# The patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

# AKIA[A-Z0-9]+ and [0-9a-f]+ take whole runs, so a least length in the pattern drops the same matches as a test after it.
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4))
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
# From BEGIN through the next END, if no other BEGIN comes first; else through the base64 lines that follow, where the last may be
# short. Line ends may be escaped, as in JSON, and lines quoted.
PEM = re.compile(r"""-----BEGIN\ (?:[A-Z]+\ )?PRIVATE\ KEY-----
    (?: (?:(?!-----BEGIN\ )[\s\S])*? -----END\ (?:[A-Z]+\ )?PRIVATE\ KEY-----
      | (?: (?:[\s>]|\\[nr])* (?:(?:Proc-Type|DEK-Info):[^\n\\]* | [A-Za-z0-9+/=]{16,}+) )+
        (?: [\ \t>]* (?:\r?\n|(?:\\r)?\\n) [\ \t>]* [A-Za-z0-9+/=]+ (?=["'\\,;<)-]|\s*?(?:\n|\Z)) )?
    )?""", re.X)
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,})(?![A-Za-z0-9])")
KINDS = ("assign", "access", "hex", "pem", "token_prefix")
BASE = KINDS[:3]
RULES_VERSION = "2024-2"

_OUT = pa.schema([
    ("blob", pa.string()), ("kind", pa.list_(pa.string())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    for k, pattern in ((1, LONG_ACCESS), (2, LONG_HEX), (3, PEM), (4, PREFIXED)):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def address(text) -> F.Column:
    """The content address; a null text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION) -> DataFrame:
    """The ledger's new rows for versions(path, text): one per blob that has no row under ``rules`` yet.

    Blobs are chosen on (address, path) pairs alone; texts move only if the chosen paths are too many to send around."""
    known = versions.select(F.col("path").alias("path"), address(F.col("text")).alias("blob"))
    # A path may hold several versions, so a copy is chosen by path and address.
    chosen = known.groupBy("blob").agg(F.min("path").alias("chosen"))
    if ledger is not None:
        seen = ledger.where(F.col("rules") == rules).select("blob").distinct()
        chosen = chosen.join(seen, "blob", "left_anti")
    # A blob that only null paths hold is chosen with a null path.
    texts = versions.select("path", "text").join(chosen, F.col("path").eqNullSafe(F.col("chosen")))
    texts = texts.where(address(F.col("text")) == F.col("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [find(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("blob"), *(pa.array([[x[k] for x in f] for f in found], t) for k, t in (
                        (1, pa.list_(pa.string())), (0, pa.list_(pa.int64())), (2, pa.list_(pa.int64()))))], schema=_OUT)

    fresh = texts.select("blob", "text").mapInArrow(run, "blob string, kind array<string>, start array<bigint>, end array<bigint>")
    # Repeated rows bring a blob more than once; all of its rows are equal.
    fresh = fresh.groupBy("blob").agg(*(F.first(c).alias(c) for c in ("kind", "start", "end")))
    return fresh.select("blob", F.lit(rules).alias("rules"), "kind", "start", "end")


def findings(versions: DataFrame, ledger: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """Every row of versions(path, text) that holds findings: path, blob, kind, start, end (arrays in order)."""
    rows = ledger.where((F.col("rules") == rules) & (F.size("kind") > 0)).select("blob", "kind", "start", "end")
    return versions.select("path", address(F.col("text")).alias("blob")).join(rows, "blob")


def redact(text: str, kinds: list[str], starts: list[int], ends: list[int]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first one's kind stands for all."""
    out, at = [], 0
    for kind, start, end in zip(kinds, starts, ends, strict=True):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_all(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """docs with the ledger's findings cut out of their texts and n_chars, if there, counted anew; no row goes."""
    spans = ledger.where(F.size("kind") > 0).select("blob", "kind", "start", "end")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), address(docs["text"]).alias("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column("row"))
            for name in ("kind", "start", "end"):
                row = row.append_column(f"\0{name}", batch.column(name))
            for part in slices(row, "text"):
                kinds, starts, ends = (part.column(f"\0{n}").to_pylist() for n in ("kind", "start", "end"))
                texts = [t if not k else redact(t, k, s, e) for t, k, s, e in zip(
                    part.column("text").to_pylist(), kinds, starts, ends, strict=True)]
                new = {"text": texts, "n_chars": [t if t is None else len(t) for t in texts]}
                yield pa.RecordBatch.from_arrays([
                    pa.array(new[f.name], f.type) if f.name in new else part.column(f.name)
                    for f in part.schema if f.name[0] != "\0"], [f.name for f in part.schema if f.name[0] != "\0"])

    return rows.join(spans, "blob", "left").select("row", "kind", "start", "end").mapInArrow(run, docs.schema)


def digest(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts and digests of every document, from the ledger."""
    rows = ledger.select("blob", "kind", "start", "end")
    spans = F.transform(F.arrays_zip("kind", "start", "end"), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = F.filter(spans, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).isin(*BASE))
    count = lambda kind: F.size(F.filter("kind", lambda x: x == kind)).cast("long")
    per_blob = rows.where(F.size("kind") > 0).select(
        "blob", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))
    out = docs.select("doc_id", address(F.col("text")).alias("blob")).join(per_blob, "blob", "left")
    return out.select(
        "doc_id", *(F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in BASE),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION) -> DataFrame:
    """The ledger with the rows of what ``versions`` brings that it lacks under ``rules``; the new rows are stored."""
    fresh = stored(scan_unseen(versions, ledger, rules), "ledger")
    return fresh if ledger is None else ledger.unionByName(fresh)


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two halves; the second one is scanned only where the ledger of the first lacks its blobs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0))
    ledger = None
    for k in (0, 1):
        ledger = update_ledger(docs.where(half == k).select(F.col("doc_id").alias("path"), "text"), ledger)
    return digest(docs, ledger)
