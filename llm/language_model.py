"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

The count table of each order is partitioned by the n-gram's hash. Documents are exploded into n-grams, joined to the
tables by hash, and summed per document; n-grams travel packed, a row per bucket of documents and segment of the hash
space, as a row per n-gram would be several times the size of the text.

A document's own occurrences do not count in its favour: c(g) below is the count of g in all other rows. The score of
a word w after the words h (up to order - 1 of them, none across documents) is c(hw) / c(h) if c(hw) > 0, else ALPHA times
the score of w after h without its first word. A word alone scores c(w) / (N + 1), or ALPHA / (N + 1) if c(w) = 0, where N counts the
words of all other rows. log_score is the sum of natural logarithms over a row's words, mean_log_score that over n_words.

Defined results: a null or empty text has 0 words, log_score 0.0 and a null mean. Repeated rows and equal texts are rows
of their own and so count for each other. Null ids are scored. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.buckets import (
    bucketed, in_order, pack, pack_sorted, power_of_two, row_of, segments, text_bytes, unpack, unpack_sorted, word_hashes)
from llm.words import combine, mix

ALPHA = 0.4
ORDER = 2
#: Bits of an n-gram's hash that travel. Fewer would be smaller; two of 10**9 n-grams share one with a chance of about 1e-8 each.
BITS = 56


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams within one row start, and their hashes of BITS bits."""
    row = row_of(bounds)
    at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
    return at, (mix(combine(hashes, n)[at], 200 + n) >> np.uint64(64 - BITS) if len(at) else np.zeros(0, np.uint64))


def count_tables(rows: DataFrame, n_buckets: int, order: int) -> DataFrame:
    """What each bucket learns: bucket, n, segment, the corpus counts of its distinct n-grams there, and all words' number."""
    n_segments = power_of_two(n_buckets)

    def ask(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        hashes, bounds = word_hashes(in_order(group))
        out = []
        for n in range(1, order + 1):
            found, times = np.unique(grams(hashes, bounds, n)[1], return_counts=True)
            cut = segments(found, BITS, n_segments)
            # Every segment of single words is sent, so that each of them knows all words.
            out += [(n, s, bucket, pack_sorted(found[a:b]), pack(times[a:b]), len(hashes))
                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a or n == 1]
        return pa.table({f.name: pa.array([x[k] for x in out], f.type) for k, f in enumerate(_ASK)})

    def total(group: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x) for x in group.column("grams").to_pylist()]
        times = [unpack(x) for x in group.column("times").to_pylist()]
        _, back = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(back, np.concatenate(times)).astype(np.uint64)[back]  # exact below 2**53
        parts = np.split(sums, np.cumsum([len(x) for x in asked])[:-1])
        words = int(group.column("words").combine_chunks().sum().as_py()) if len(asked) else 0
        return pa.table({
            "bucket": group.column("bucket"), "n": group.column("n"), "segment": group.column("segment"),
            "counts": pa.array([pack(x) for x in parts], pa.binary()), "words": pa.array([words] * len(asked), pa.int64())})

    asked = rows.groupBy("bucket").applyInArrow(ask, "n int, segment int, bucket int, grams binary, times binary, words long")
    return asked.groupBy("n", "segment").applyInArrow(total, "bucket int, n int, segment int, counts binary, words long")


_ASK = pa.schema([
    ("n", pa.int32()), ("segment", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("times", pa.binary()),
    ("words", pa.int64())])


def other_counts(hashes: np.ndarray, bounds: np.ndarray, n: int, told: dict[int, bytes]) -> np.ndarray:
    """For each word that ends an n-gram within its row: its count in all other rows; 0 elsewhere."""
    at, keys = grams(hashes, bounds, n)
    out = np.zeros(len(hashes), np.int64)
    if not len(at):
        return out
    found, back = np.unique(keys, return_inverse=True)
    counts = np.concatenate([unpack(told[s]) for s in sorted(told)]).astype(np.int64)
    if len(counts) != len(found):
        raise ValueError("an answer does not fit its question")
    row = row_of(bounds)[at]
    _, own, times = np.unique(row * len(found) + back, return_inverse=True, return_counts=True)
    out[at + n - 1] = counts[back] - times[own]
    return out


def row_scores(hashes: np.ndarray, bounds: np.ndarray, told: dict[int, dict[int, bytes]], total: int, order: int) -> np.ndarray:
    """Logarithm of each word's score."""
    row = row_of(bounds)
    counts = {n: other_counts(hashes, bounds, n, told.get(n, {})) for n in range(1, order + 1)}
    rest = (total - np.diff(bounds)[row] + 1).astype(float)
    out = np.log(np.where(counts[1] > 0, counts[1], ALPHA) / rest)
    place = np.arange(len(row)) - bounds[row]
    for n in range(2, order + 1):
        whole = counts[n] > 0
        before = np.concatenate([[0], counts[n - 1][:-1]])
        found = np.log(np.where(whole, counts[n], 1)) - np.log(np.where(whole, before, 1))
        out = np.where(place < n - 1, out, np.where(whole, found, math.log(ALPHA) + out))
    return out


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every row."""
    rows, n_buckets = bucketed(docs, text_bytes(docs))
    told = count_tables(rows, n_buckets, order)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sum_up(group: pa.Table, answer: pa.Table) -> pa.Table:
        group = in_order(group)
        hashes, bounds = word_hashes(group)
        told: dict[int, dict[int, bytes]] = {}
        for n, s, counts in zip(*(answer.column(c).to_pylist() for c in ("n", "segment", "counts")), strict=True):
            told.setdefault(n, {})[s] = counts
        total = answer.filter(pc.equal(answer.column("n"), 1)).column("words")[0].as_py()
        n_words = np.diff(bounds)
        if len(hashes):
            sums = np.bincount(row_of(bounds), row_scores(hashes, bounds, told, total, order), minlength=len(n_words))
        else:
            sums = np.zeros(len(n_words))
        mean = np.divide(sums, n_words, out=np.zeros(len(sums)), where=n_words > 0)
        return pa.table({
            "doc_id": group.column("doc_id"), "n_words": pa.array(n_words), "log_score": pa.array(sums),
            "mean_log_score": pa.array(mean, mask=n_words == 0)})

    return rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        sum_up, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))
