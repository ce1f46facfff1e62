"""Removal of repeated passages: a count-min prefilter, then exact groups of the windows it lets through.

A window is ``window`` consecutive words of one document. First pass: each bucket of documents counts its windows in a
count-min sketch of two rows, kept sparse and cut into segments by cell; the segments of all buckets are added up, and each
bucket learns which of its cells reached two. A cell never counts too low, so every repeated window passes. Second pass:
windows that both rows estimate as repeated are grouped exactly by 96 bits of hash; of each group all but the first
occurrence (smallest doc_id, then smallest start) cover the words to remove. A bucket sends a window once, however often it
holds it, so a passage in most documents costs no more than one entry per bucket.

Defined results: a null or empty text, or one shorter than a window, loses nothing. Rows with one doc_id count as parts of
it in the order of their texts, so of repeated rows the later ones go. Null ids come last. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.buckets import (
    bucketed, in_order, pack, pack_sorted, power_of_two, row_of, segments, text_bytes, unpack, unpack_sorted, word_hashes)
from llm.words import combine, mix

WINDOW = 20
DEPTH = 2
#: Cells of a sketch row per byte of text. Words take about 6 bytes, so a row has about 8 cells per window.
CELLS_PER_BYTE = 1.4
SEGMENT_CELLS = 1 << 23

ASK = "row int, segment int, bucket int, cells binary, twice binary"
TELL = "bucket int, row int, segment int, repeated binary"
SEND = "segment int, bucket int, h1 binary, h2 binary, doc binary, at binary, local binary"


def starts_of(bounds: np.ndarray, window: int) -> np.ndarray:
    row = row_of(bounds)
    return np.flatnonzero(row[:len(row) - window + 1] == row[window - 1:]) if len(row) >= window else np.zeros(0, np.int64)


def windows_of(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    at = starts_of(bounds, window)
    return at, (mix(combine(hashes, window)[at], 3) if len(at) else np.zeros(0, np.uint64))


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys, 100 + row) >> np.uint64(64 - bits)


def estimate(rows: DataFrame, n_bytes: int, window: int, segment_cells: int = SEGMENT_CELLS) -> tuple[DataFrame, int, int]:
    """What each bucket learns of its cells, the bits of a cell's number, and the number of segments."""
    cells = power_of_two(max(1 << 16, int(n_bytes * CELLS_PER_BYTE)))
    bits, n_segments = cells.bit_length() - 1, max(1, cells // segment_cells)

    def ask(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        _, keys = windows_of(*word_hashes(in_order(group)), window)
        out = []
        for row in range(DEPTH):
            found, times = np.unique(cells_of(keys, row, bits), return_counts=True)
            cut = segments(found, bits, n_segments)
            out += [(row, s, bucket, pack_sorted(found[a:b]), np.packbits(times[a:b] > 1).tobytes())
                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        names = ("row", "segment", "bucket", "cells", "twice")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    def tell(group: pa.Table) -> pa.Table:
        first = np.uint64(group.column("segment")[0].as_py() * (cells // n_segments))
        counts = np.zeros(cells // n_segments, np.uint8)  # 2 stands for two or more
        asked = [unpack_sorted(x) - first for x in group.column("cells").to_pylist()]
        for at, twice in zip(asked, group.column("twice").to_pylist(), strict=True):
            more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
            counts[at] = np.minimum(counts[at] + 1 + more, 2)
        return group.select(["bucket", "row", "segment"]).append_column(
            "repeated", pa.array([np.packbits(counts[at] > 1).tobytes() for at in asked], pa.binary()))

    asked = rows.groupBy("bucket").applyInArrow(ask, ASK)
    return asked.groupBy("row", "segment").applyInArrow(tell, TELL), bits, n_segments


def repeated(keys: np.ndarray, told: pa.Table, bits: int, n_segments: int) -> np.ndarray:
    """Of a bucket's windows those that every row of the sketch estimates as repeated."""
    passed = np.ones(len(keys), bool)
    answers = {(r, s): b for r, s, b in zip(*(told.column(c).to_pylist() for c in ("row", "segment", "repeated")), strict=True)}
    for row in range(DEPTH):
        found, back = np.unique(cells_of(keys, row, bits), return_inverse=True)
        cut = segments(found, bits, n_segments)
        flags = [np.unpackbits(np.frombuffer(answers[row, s], np.uint8), count=b - a)
                 for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if flags:
            passed &= np.concatenate(flags)[back] > 0
    return passed


def later_windows(rows: DataFrame, told: DataFrame, n_buckets: int, bits: int, n_segments: int, window: int) -> DataFrame:
    """(bucket, at): packed numbers of the words, counted through the bucket, where a window starts that started earlier."""
    n_groups = power_of_two(n_buckets)

    def send(group: pa.Table, answer: pa.Table) -> pa.Table:
        group = in_order(group)
        bucket = group.column("bucket")[0].as_py()
        hashes, bounds = word_hashes(group)
        at, keys = windows_of(hashes, bounds, window)
        passed = repeated(keys, answer, bits, n_segments)
        at, keys = at[passed], keys[passed]
        if not len(at):
            return pa.table({f.name: pa.array([], f.type) for f in SENT}, schema=SENT)
        other = mix(combine(mix(hashes, 7), window)[at], 8) >> np.uint64(32)
        order = np.lexsort((at, other, keys))
        keys, other, at = keys[order], other[order], at[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])
        local = np.sort(at[~first])
        keys, other, at = keys[first], other[first], at[first]
        ids = group.column("doc_id").cast(pa.int64()).fill_null(2**63 - 1).to_numpy()
        doc = (ids.view(np.uint64) ^ np.uint64(1 << 63))[np.searchsorted(bounds, at, "right") - 1]
        cut = segments(keys, 64, n_groups)
        out = [(s, bucket, pack_sorted(keys[a:b]), pack(other[a:b]), pack(doc[a:b] - doc[a:b].min()), pack(at[a:b]), None, int(doc[a:b].min()))
               for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if len(local):  # decided already; goes along
            out.append((bucket % n_groups, bucket, None, None, None, None, pack_sorted(local), 0))
        return pa.table({f.name: pa.array([x[k] if f.name != "least" else x[k] - 2**63 for x in out], f.type) for k, f in enumerate(SENT)}, schema=SENT)

    def decide(group: pa.Table) -> pa.Table:
        sent = group.filter(pc.is_valid(group.column("h1")))
        local = group.filter(pc.is_valid(group.column("local"))).select(["bucket", "local"]).rename_columns(["bucket", "at"])
        if not sent.num_rows:
            return local
        h1, h2, at = (np.concatenate([f(x) for x in sent.column(c).to_pylist()]) for c, f in (
            ("h1", unpack_sorted), ("h2", unpack), ("at", unpack)))
        docs = [unpack(x) + np.uint64(m + 2**63) for x, m in zip(sent.column("doc").to_pylist(), sent.column("least").to_pylist(), strict=True)]
        source = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        order = np.lexsort((at, np.concatenate(docs), h2, h1))
        later = np.zeros(len(order), bool)
        later[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        source, at = source[order[later]], at[order[later]]
        found = [(b, np.sort(at[source == k])) for k, b in enumerate(sent.column("bucket").to_pylist())]
        found = [(b, pack_sorted(x)) for b, x in found if len(x)]
        return pa.concat_tables([local, pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "at": pa.array([x for _, x in found], pa.binary())})])

    sent = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(send, SEND + ", least long")
    return sent.groupBy("segment").applyInArrow(decide, "bucket int, at binary")


SENT = pa.schema([
    ("segment", pa.int32()), ("bucket", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary()),
    ("at", pa.binary()), ("local", pa.binary()), ("least", pa.int64())])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the words that stay, joined by one space), n_words and n_removed of every row."""
    n_bytes = text_bytes(docs)
    rows, n_buckets = bucketed(docs, n_bytes)
    told, bits, n_segments = estimate(rows, n_bytes, window)
    later = later_windows(rows, told, n_buckets, bits, n_segments, window)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def remove(group: pa.Table, later: pa.Table) -> pa.Table:
        group = in_order(group)
        texts = [(t or "").encode().split() for t in group.column("text").to_pylist()]
        counts = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(counts)
        opened = np.zeros(int(ends[-1]) + window + 1, np.int64)
        for packed in later.column("at").to_pylist():
            at = unpack_sorted(packed).astype(np.int64)
            opened[at] += 1
            opened[at + window] -= 1
        gone = np.cumsum(opened)[:ends[-1]] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
        kept = []
        for words, end, n in zip(texts, ends, removed, strict=True):
            if n:
                words = [w for w, g in zip(words, gone[end - len(words):end], strict=True) if not g]
            kept.append(b" ".join(words).decode())
        return pa.table({
            "doc_id": group.column("doc_id"), "text": pa.array(kept, pa.string()), "n_words": pa.array(counts),
            "n_removed": pa.array(removed.astype(np.int64))})

    return rows.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(
        remove, f"doc_id {kind}, text string, n_words long, n_removed long")


def op10_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
