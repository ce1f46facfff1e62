"""Quality rules by compression bands.

A text is judged by its zstandard ratio (compressed bytes over bytes) as a whole and in fixed chunks. Repetitive
text compresses too well, random text too badly; both limits depend on the length, as short inputs carry relatively
more frame and less history. Counts of words, symbols and repeats come with the verdict.

The upper limits lie between prose and base64. In the given documents (sf0.1, four languages) the worst ratio is 0.86 from 200
bytes on, 0.75 from 300, 0.70 from 500, 0.64 from 700, 0.60 from 1,000, 0.53 in chunks and 0.48 from 4,000; the limits leave 0.04
or more above it at 200 bytes and 0.08 or more from 300 on. Base64 has 0.91, 0.84, 0.81, 0.79, 0.77, 0.77 and 0.75 at least
there. Random text of two chunks fills at least one; a shorter stretch can hide beside prose in its chunk. Hex digits, at 0.50 to
0.64, compress like prose: no limit of the ratio alone can tell them, and they are kept.

Defined results: a null text is an empty one, with 0 words, ratio 1.0 and a failed base rule. Texts below the first
band's length are judged by the base rule alone. Each row is judged by itself, so repeated rows, ties and null ids are
kept as they are and an empty table gives an empty result. Only the id and the text are read, so further columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.words import Words, buffers, slices


@dataclass(frozen=True)
class Band:
    """Texts of at least ``least`` bytes (up to the next band) must have a ratio between low and high."""
    least: int
    low: float
    high: float


@dataclass(frozen=True)
class Bands:
    """whole: limits of the whole text's ratio. chunk_bytes: size of a chunk. chunk: limits of one full chunk's ratio; what
    is left behind the last is a chunk judged by the whole limits of its length, if it reaches the first of them.
    bad_share: a text fails when more than this share of its judged chunks lies outside their limits."""
    whole: tuple[Band, ...] = (
        Band(200, 0.35, 0.90), Band(300, 0.35, 0.83), Band(500, 0.35, 0.80), Band(700, 0.35, 0.77), Band(1000, 0.30, 0.73),
        Band(2000, 0.30, 0.68), Band(4000, 0.25, 0.64), Band(20000, 0.20, 0.62))
    chunk_bytes: int = 2048
    chunk: Band = Band(2048, 0.25, 0.68)
    bad_share: float = 0.1
    level: int = 3


MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, ratio double, n_chunks long, bad_chunks long, kept boolean"
)


def in_band(bands: Iterable[Band], n_bytes: int, ratio: float) -> bool:
    fit = [b for b in bands if b.least <= n_bytes]
    return not fit or fit[-1].low <= ratio <= fit[-1].high


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def repeated_words(words: Words) -> np.ndarray:
    """Per row: words inside windows of five words that the row holds twice or more."""
    at, key = words.runs(5, words.hashes())
    if not len(at):
        return np.zeros(words.rows, np.int64)
    key = key ^ (words.row[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    opened = np.zeros(len(words) + 6, np.int64)
    hit = at[times[back] > 1]
    opened[hit] += 1
    opened[hit + 5] -= 1
    covered = np.cumsum(opened)[:len(words)] > 0
    return np.bincount(words.row[covered], minlength=words.rows)


def measure(column, bands: Bands) -> dict[str, list | np.ndarray]:
    words = Words(column)
    data, bounds = buffers(column)
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    starts_char = (data & 0xC0) != 0x80
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    repeats = repeated_words(words)
    squeeze = zstandard.ZstdCompressor(level=bands.level)
    raw = data.tobytes()
    dup_lines, ratio, chunks, bad, kept = [], [], [], [], []
    failed = (words.count < MIN_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * words.count)
    for i in range(words.rows):
        text = raw[bounds[i]:bounds[i + 1]]
        dup_lines.append(duplicate_lines(text))
        ratio.append(len(squeeze.compress(text)) / len(text) if text else 1.0)
        parts = [text[k:k + bands.chunk_bytes] for k in range(0, len(text), bands.chunk_bytes)]
        parts = [p for p in parts if len(p) >= min(bands.chunk_bytes, bands.whole[0].least)]
        chunks.append(len(parts))
        bad.append(sum(not in_band(
            (bands.chunk,) if len(p) == bands.chunk_bytes else bands.whole, len(p), len(squeeze.compress(p)) / len(p)) for p in parts))
        kept.append(not failed[i] and in_band(bands.whole, len(text), ratio[-1]) and bad[-1] <= bands.bad_share * chunks[-1])
    return {
        "n_words": words.count, "word_chars": per_row(starts_char & ~white), "n_symbols": per_row(SYMBOLS[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": repeats, "base_failed": failed, "n_bytes": np.diff(bounds),
        "ratio": ratio, "n_chunks": chunks, "bad_chunks": bad, "kept": kept,
    }


def assess(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id, all measures and the verdict of every row."""
    fields = [x.strip().split()[0] for x in MEASURES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measure(part.column("text"), bands)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(found[f]) for f in fields)], ["doc_id", *fields])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(measure(part.column("text"), bands)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("ratio", 6).alias("ratio"), "n_chunks", "bad_chunks")
