"""Exact corpus-wide counts without a row per word: documents are dealt into buckets, and each bucket asks hash segments.

A bucket is a bounded share of the documents (by the hash of doc_id). It sends each segment of the hash space one packed
row of the distinct hashes it holds there; a segment answers each bucket in the order of its question. However often a
key occurs, a bucket sends it once, so a hot key costs a segment at most one entry per bucket. The bucketed text is shuffled
once and read again from the same exchange by the later steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import Words, slices

#: Bytes of text in a bucket, on average; a longer document makes its bucket larger.
BUCKET_BYTES = 8 << 20


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucketed(docs: DataFrame, n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text), each bucket in one partition, and the number of buckets."""
    n = max(1, -(-n_bytes // bucket_bytes))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    return docs.select(bucket.alias("bucket"), "doc_id", "text").repartition(n, "bucket"), n


def in_order(rows: pa.Table) -> pa.Table:
    """The rows of a bucket by doc_id (null last), then text: the same order whenever the bucket is read."""
    return rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))


def word_hashes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the rows, and the number of words before each row (and in all)."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for batch in rows.select(["text"]).combine_chunks().to_batches():
        for part in slices(batch, "text", 1 << 20):
            words = Words(part.column("text"))
            found.append(words.hashes())
            counts.append(words.count)
    return np.concatenate(found), np.cumsum(np.concatenate(counts))


def row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, compressed; small numbers leave their high planes empty."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def segments(hashes: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n equal segments (n a power of two) starts in sorted hashes of so many bits, and the end."""
    width = 1 << (bits - n.bit_length() + 1)
    return np.searchsorted(hashes, np.arange(n + 1, dtype=object) * width if n * width >= 2**64 else np.arange(n + 1, dtype=np.uint64) * np.uint64(width))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())
