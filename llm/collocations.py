"""Phrase collocations: frequent phrases of two to five words, scored by their least surprising cut.

First pass: documents are dealt into buckets, and each bucket sends every hash partition (segment) the distinct n-grams of 1 to
``LONGEST`` words it holds there, with their counts. A segment first learns its mass, then adds the buckets' counts up in
one Misra-Gries summary of more counters than mass / ``LEAST``: when it overflows, the count of the first counter that has no room
is taken off all. At most mass / (counters + 1) < LEAST is taken off any n-gram in all, so each that occurs LEAST times
survives. A survivor whose count cannot have reached LEAST goes. Summaries merge in any order and hold a bounded number of
counters, whatever the number of distinct n-grams. Second pass: each bucket learns which of its n-grams survive and writes those out
as phrases with their counts, one packed row for each language and hash partition; there they are added up exactly by the phrase itself, so
hashes never decide a count.

Words are cut out as the contract of ``phrases`` says; counts are per language. Exact arithmetic of scores is done in decimals of 38 digits.

Defined results: a null or empty text has no words, a null language is ``und``. Repeated rows and equal texts count each
time. A phrase that is a language's whole vocabulary is treated like any other. A language without a candidate has no rows. Only lang and text are
read (doc_id, where there is one, helps to deal the rows).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.buckets import BUCKET_BYTES, pack, pack_sorted, power_of_two, segments, text_bytes, unpack, unpack_sorted
from llm.graph import stored
from llm.words import Words, combine, mix, slices

LONGEST, LEAST, TOP = 5, 100, 2000
#: Buckets that a segment serves, by their size.
SEGMENT_BUCKETS = 4
SALTS = 64

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
BETWEEN = BREAKS.copy()
BETWEEN[[0x20, 0x09]] = True

ASK = "segment int, bucket int, kind int, mass long, grams binary, times binary"
TELL = "bucket int, segment int, kept binary"
FOUND = "part int, lang string, phrases binary, times binary"


class Pieces:
    """The words of a text column, their pieces, and hashes; of a part of a bucket's rows."""

    def __init__(self, rows: pa.RecordBatch):
        words = Words(rows.column("text"), lower=True, between=BETWEEN)
        self.row, self.hash = words.row, words.hashes()
        # A piece is told by the breaks before it and its row.
        breaks = np.cumsum(BREAKS[words.data]) if len(words.data) else np.zeros(0, np.int64)
        self.piece = breaks[words.start] + words.row if len(words) else np.zeros(0, np.int64)
        self.lang = rows.column("lang_hash").to_numpy().view(np.uint64)
        sizes = words.end - words.start
        self.end = np.cumsum(sizes + 1) - 1 if len(words) else np.zeros(0, np.int64)  # in .text, where one space follows each word
        self.start = self.end - sizes
        if len(words):
            text = np.full(int(self.end[-1]) + 1, 0x20, np.uint8)
            letters = np.ones(len(text), bool)
            letters[self.end] = False
            text[letters] = words.data[~words.between[words.data]]
            self.text = text.tobytes()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams within a piece start, and their hashes, which the language is part of."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:len(self.piece) - n + 1] == self.piece[n - 1:])
        return at, mix(combine(self.hash, n)[at] ^ self.lang[self.row[at]], 1300 + n)


def parts(group: pa.Table):
    for batch in group.combine_chunks().to_batches():
        yield from slices(batch, "text", 2 << 20)


def dealt(docs: DataFrame, n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(bucket, lang, lang_hash, text) and the number of buckets. A row's place in its input deals it, together with what
    it holds, so that repeated ids and copies spread; the input's own order decides, as it is read the same way each time."""
    n = max(1, -(-n_bytes // bucket_bytes))
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    rows = docs.where(F.octet_length("text") > 0).select(lang.alias("lang"), "text").withColumn("_at", F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64("_at", "text"), F.lit(n)).cast("int")
    return rows.select(bucket.alias("bucket"), "lang", F.xxhash64("lang").alias("lang_hash"), "text").repartition(n, "bucket"), n


def bucket_grams(group: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's distinct n-grams of all lengths by their leading bits, ascending, and their counts."""
    found = [np.zeros(0, np.uint64)]
    for rows in parts(group):
        pieces = Pieces(rows)
        found += [pieces.grams(n)[1] >> np.uint64(64 - bits) for n in range(1, LONGEST + 1)]
    return np.unique(np.concatenate(found), return_counts=True)


class MisraGries:
    """At most ``capacity`` counters. ``taken`` is what any key has lost at most, and every key counted more often has a counter."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Take in counts of distinct keys, or the counters of another summary (whose ``taken`` the caller adds)."""
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both, sums = both[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        keys, counts = both[first], np.add.reduceat(sums, first) if len(first) else sums
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += off
            keys, counts = keys[counts > off], counts[counts > off] - off
        self.keys, self.counts = keys, counts

    def reaching(self, least: int) -> np.ndarray:
        """The keys that may have been counted ``least`` times; none that was is missing."""
        return self.keys[self.counts + self.taken >= least]


def summarise(asked: list[tuple[np.ndarray, np.ndarray]], mass: int, least: int) -> np.ndarray:
    """The keys of the questions that may occur ``least`` times in all of them, ascending."""
    summary = MisraGries(mass // least + 1)
    keys, counts, held = [], [], 0
    for k, c in asked:
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > summary.capacity:  # several small questions cost one merge
            summary.add(*merged(keys, counts))
            keys, counts, held = [], [], 0
    if keys:
        summary.add(*merged(keys, counts))
    return summary.reaching(least)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, back = np.unique(np.concatenate(keys), return_inverse=True)
    return both, np.bincount(back, np.concatenate(counts), minlength=len(both)).astype(np.int64)


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n): every phrase of 1 to LONGEST words that occurs ``least`` times, exactly counted, and for each language a row
    of 0 words with the number of all its words."""
    n_bytes = text_bytes(docs)
    rows, n_buckets = dealt(docs, n_bytes)
    # 16 values or more for each byte of text: a rare n-gram seldom shares a frequent one's bits, and if so, the exact count drops it.
    bits = min(64, max(16, math.ceil(math.log2(max(2, n_bytes)))) + 4)
    n_segments = power_of_two(max(1, n_buckets // SEGMENT_BUCKETS))

    def ask(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        found, times = bucket_grams(group, bits)
        cut = segments(found, bits, n_segments)
        out = [(s, bucket, 1, int(times[a:b].sum()), pack_sorted(found[a:b]), pack(times[a:b]))
               for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ("segment", "bucket", "kind", "mass", "grams", "times")
        return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    def tell(group: pa.Table) -> pa.Table:
        mass = sum(group.column("mass").to_pylist())
        packed = list(zip(group.column("grams").to_pylist(), group.column("times").to_pylist(), strict=True))
        kept = summarise(((unpack_sorted(g), unpack(t).astype(np.int64)) for g, t in packed), mass, least)
        # The same questions once more: exact sums of what survived, under its bits.
        sums = np.zeros(len(kept), np.int64)
        for grams, times in packed:
            keys = unpack_sorted(grams)
            at = np.minimum(np.searchsorted(kept, keys), max(0, len(kept) - 1))
            hit = kept[at] == keys if len(kept) else np.zeros(len(keys), bool)
            sums[at[hit]] += unpack(times)[hit].astype(np.int64)
        kept = kept[sums >= least]
        flags = []
        for grams, _ in packed:
            keys = unpack_sorted(grams)
            at = np.minimum(np.searchsorted(kept, keys), max(0, len(kept) - 1))
            flags.append(np.packbits(kept[at] == keys if len(kept) else np.zeros(len(keys), bool)).tobytes())
        return pa.table({"bucket": group.column("bucket"), "segment": group.column("segment"), "kept": pa.array(flags, pa.binary())})

    def write_out(group: pa.Table, answer: pa.Table) -> pa.Table:
        if not group.num_rows:
            return EMPTY
        found, _ = bucket_grams(group, bits)
        cut = segments(found, bits, n_segments)
        told = dict(zip(answer.column("segment").to_pylist(), answer.column("kept").to_pylist(), strict=True))
        flags = [np.unpackbits(np.frombuffer(told[s], np.uint8), count=b - a)
                 for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        kept = found[np.concatenate(flags) > 0] if flags else found[:0]
        out: dict[str, dict[bytes, int]] = {lang: {} for lang in group.column("lang").unique().to_pylist()}
        for rows in parts(group):
            pieces, langs = Pieces(rows), rows.column("lang").to_pylist()
            for lang, n in zip(langs, np.bincount(pieces.row, minlength=rows.num_rows).tolist(), strict=True):
                out[lang][b""] = out[lang].get(b"", 0) + n
            for n in range(1, LONGEST + 1) if len(kept) else ():
                at, keys = pieces.grams(n)
                place = np.minimum(np.searchsorted(kept, keys >> np.uint64(64 - bits)), len(kept) - 1)
                hit = kept[place] == keys >> np.uint64(64 - bits)
                at, keys = at[hit], keys[hit]
                # Equal by the whole hash and by a second one: 128 bits within one part of a bucket.
                second = combine(mix(pieces.hash, 99), n)[at] if len(at) else keys
                order = np.lexsort((second, keys))
                keys, second, at = keys[order], second[order], at[order]
                first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (second[1:] != second[:-1]))) if len(at) else at
                counts = np.diff(np.append(first, len(at)))
                at = at[first]
                for lang, a, b, c in zip(pieces.row[at].tolist(), pieces.start[at].tolist(), pieces.end[at + n - 1].tolist(), counts.tolist(), strict=True):
                    own, phrase = out[langs[lang]], pieces.text[a:b]
                    own[phrase] = own.get(phrase, 0) + c
        return by_part(out, n_segments)

    asked = rows.groupBy("bucket").applyInArrow(ask, ASK)
    told = asked.groupBy("segment").applyInArrow(tell, TELL)
    found = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(write_out, FOUND)

    def total(group: pa.Table) -> pa.Table:
        return add_up(group, least)

    return found.groupBy("part", "lang").applyInArrow(total, "lang string, words int, phrase string, n long")


EMPTY = pa.table({"part": pa.array([], pa.int32()), "lang": pa.array([], pa.string()), "phrases": pa.array([], pa.binary()), "times": pa.array([], pa.binary())})


def by_part(counts: dict[str, dict[bytes, int]], n_parts: int) -> pa.Table:
    """{lang: {phrase: n}} as a packed row for each language and part that a phrase's hash names. The empty phrase stands for all words."""
    out = []
    for lang, own in counts.items():
        split: dict[int, list[bytes]] = {}
        for phrase in sorted(own):
            split.setdefault(zlib.crc32(phrase) % n_parts, []).append(phrase)
        out += [(part, lang, zstandard.ZstdCompressor(level=1).compress(b"\n".join(phrases)), pack(np.array([own[x] for x in phrases])))
                for part, phrases in split.items()]
    return pa.table({f.name: pa.array([x[k] for x in out], f.type) for k, f in enumerate(EMPTY.schema)})


def add_up(group: pa.Table, least: int) -> pa.Table:
    """The exact sums of a part's phrases that reach ``least``, and of the numbers of words."""
    phrases = [pa.array(zstandard.ZstdDecompressor().decompress(x).split(b"\n"), pa.binary()).cast(pa.string()) for x in group.column("phrases").to_pylist()]
    times = [pa.array(unpack(x).astype(np.int64)) for x in group.column("times").to_pylist()]
    sums = pa.table({"phrase": pa.chunked_array(phrases), "n": pa.chunked_array(times)}).group_by("phrase").aggregate([("n", "sum")])
    phrase, n = sums.column("phrase"), sums.column("n_sum")
    words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
    found = pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(sums), pa.string()), "words": words, "phrase": phrase, "n": n})
    return found.filter(pc.or_(pc.greater_equal(n, least), pc.equal(words, 0)))


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` collocations.

    Texts (A-Z lowered) are split at .,;:!? and line breaks, and the pieces at spaces and tabs into words. A candidate is a phrase of 2 to LONGEST words
    within pieces with a >= least occurrences. Cut after k words into parts with l and r occurrences, it scores floor(1000 a n / (l r)), n being the
    language's words; the lowest cut counts, of equal ones the first. A candidate inside a longer one of as many occurrences goes."""
    counts = stored(frequent(docs, least), "phrases")
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = lambda name, n: counts.where("words between 1 and 4").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns(
        {"head": cut(F.lit(1), F.col("k")), "tail": cut(F.col("k") + 1, F.col("words") - F.col("k"))})
    wide = "decimal(38,0)"
    size = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(size, "lang").withColumn(
        "score", F.expr(f"(cast(1000 as {wide}) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # A part of a candidate occurs as often as the candidate at least; where it does not occur more often, it goes.
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: F.array_join(F.slice(words, s, m), " ")))))
    inside = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), spans.alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    # A language may own most candidates: its first ones are found in SALTS parts of them first.
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    return first(first(salted, "salt").drop("rank")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_misra_gries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
