"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-cased words; a character of a script written without spaces is a word of its own. The CGK random
walk reads a sequence x: at step t it writes the word under it and moves on if a random bit of (t, word) says so. Two walks that
an edit has put out of step meet again by chance, so sequences at a small edit distance write mostly the same: their distance
becomes a Hamming distance. Samples of a few steps are LSH keys, which such sequences share the more likely the fewer
edits lie between them.

An item of n words is found where a passage is within k = floor(EDITS * n) edits of it. Windows are as long as the item up to
``WHOLE`` words. The longer a walk, the more edits it has to survive, so longer items are walked in overlapping segments of
``SEGMENT`` words, as one of them holds no more than its share of the k edits. Half of the walks read windows forwards from
each word, half backwards, so that edits at one end leave the other in step. How many walks, with ``SAMPLES`` keys each, is
measured: as many as find ``TARGET`` of made-up windows with the most edits for their length, for every kind of edit
(``walks_needed``). A hit says where the passage must lie, up to 2 * k words, and that stretch is searched by the exact word
edit distance with both ends free, so all that is reported is true.

At k edits a passage, at most n + k words, keeps at least n - 1 - 2k word pairs of its item. Only windows of that many words
with so many pairs that occur in any item are walked, and only stretches with so many pairs of their item are searched; this
loses nothing. Items are grouped by length in steps of a tenth for the windows.

Items of fewer than ``LEAST_WORDS`` words allow no edit and are looked up by their whole sequence. They are reported, but
``drop_contaminated`` keeps documents that hold only such items, as chance produces them.

Items are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text. A pass over the documents for each block is stored
before the next block is read, so that one block is held at a time.

Defined results: a null or empty text holds nothing. Items without words, nulls included, are not searched. Items with equal
words are found together. Of an item's passages in a text the one with the fewest edits counts, then the earliest, then the
shortest. Repeated rows each get their row; null ids are kept. An empty benchmark or table gives no findings. Only doc_id and
text, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.graph import stored
from llm.words import PUNCTUATION, Words, buffers, combine, mix, slices

EDITS = 0.2
LEAST_WORDS = 8
#: Items of at most so many words are walked whole, longer ones in segments of SEGMENT words, one every STRIDE words.
WHOLE = 16
SEGMENT = 12
STRIDE = 6
#: Steps in a sample, samples of a walk, and the share of windows at the most edits that all walks together shall find.
SAMPLE = 3
SAMPLES = 4
TARGET = 0.998
WALKS = range(4, 65, 4)
TRIALS = 500
BLOCK_BYTES = 4 << 20
#: Steps per word from which samples are drawn. A walk makes two steps a word, so it is still inside the window there.
REACH = 1.7
#: Scripts written without spaces, and the bytes their characters start with (other scripts share some of these).
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
UNSPACED_BYTES = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])
END = np.uint64(0)  # what a walk writes past the end

FOUND = "item_ids array<bigint>, edits array<int>, starts array<bigint>, ends array<bigint>"


def words_of(column) -> Words:
    data, _ = buffers(column)
    if UNSPACED_BYTES[data].any():
        column = pc.replace_substring_regex(column.cast(pa.large_string()), UNSPACED, r" \0 ")
    return Words(column, lower=True, between=PUNCTUATION)


def embed(symbols: np.ndarray, walk: int, steps: np.ndarray) -> np.ndarray:
    """What the walk writes at the given steps (ascending), for each row of symbols; END fills the rows."""
    n, width = symbols.shape
    padded = np.concatenate([symbols, np.full((n, 1), END)], axis=1).ravel()
    at = np.arange(n) * (width + 1)
    last = at + width
    out = np.empty((len(steps), n), np.uint64)
    k = 0
    for t in range(int(steps[-1]) + 1):
        if t % 64 == 0:  # a hash of a word holds its bits for 64 steps
            bits = mix(padded, 1000 * (walk + 1) + t)
        if t == steps[k]:
            out[k] = padded[at]
            k += 1
        at += ((bits[at] >> np.uint64(t % 64)) & np.uint64(1)).view(np.int64)
        if t >= width:
            np.minimum(at, last, out=at)
    return out


def sample_keys(symbols: np.ndarray, walk: int) -> np.ndarray:
    """The SAMPLES keys of each row for one walk."""
    width = symbols.shape[1]
    every = int(REACH * width)
    written = embed(symbols, walk, np.arange(every))
    rng = np.random.default_rng([walk, width])
    out = np.empty((SAMPLES, len(symbols)), np.uint64)
    for k in range(SAMPLES):
        key = np.full(len(symbols), (walk * SAMPLES + k) * 1000 + width, np.uint64)
        for c in written[np.sort(rng.choice(every, min(SAMPLE, every), replace=False))]:
            key = key * np.uint64(0x9E3779B97F4A7C15) + c
        out[k] = mix(key, 5)
    return out


def window(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, back: bool) -> np.ndarray:
    """size words from each place on, or back from it; END outside low to high."""
    place = at[:, None] + (-np.arange(size) if back else np.arange(size))
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, hashes[np.where(inside, place, 0)], END)


def backwards(walk: int) -> bool:
    return walk % 2 == 1


@lru_cache(maxsize=1024)
def walks_needed(length: int, edits: int) -> int:
    """How many walks find TARGET of windows with so many edits, for each kind of edit: swapped, dropped or added words at random
    places, all of these, swaps at even distances, and a dropped run. Measured on TRIALS windows of random words a kind."""
    rng = np.random.default_rng([length, edits])

    def words(n: int) -> np.ndarray:
        return rng.integers(1, 1 << 62, n).astype(np.uint64)

    pairs = []
    for kind in ("swap", "drop", "add", "any", "even", "run") if edits else ("any",):
        for _ in range(TRIALS):
            item = words(length)
            text = item
            if kind == "run":
                at = rng.integers(length - edits + 1)
                text = np.delete(text, slice(at, at + edits))
            if kind == "even":
                text = item.copy()
                text[(2 * np.arange(edits) + 1) * length // (2 * edits)] = words(edits)
            for _ in range(0 if kind in ("run", "even") else edits):
                at, what = rng.integers(len(text)), ("swap", "drop", "add")[rng.integers(3)] if kind == "any" else kind
                text = np.delete(text, at) if what == "drop" else np.concatenate([text[:at], words(1), text[at + (what == "swap"):]])
            pairs.append((item, np.concatenate([text, words(length)])[:length], np.concatenate([words(length), text])[-length:][::-1]))
    items, ahead, behind = (np.stack(x) for x in zip(*pairs, strict=True))
    found = np.zeros(len(items), bool)
    for walk in range(WALKS[-1]):
        asked, known = (behind, items[:, ::-1]) if backwards(walk) else (ahead, items)
        found |= (sample_keys(asked, walk) == sample_keys(known, walk)).any(0)
        if walk + 1 in WALKS and found.reshape(-1, TRIALS).mean(1).min() >= TARGET:
            return walk + 1
    return WALKS[-1]


def segments(n: int) -> tuple[list[int], int]:
    """Where the segments of an item of n words start, evenly spread from its first to its last word, and their length."""
    if n <= WHOLE:
        return [0], n
    some = -(-(n - SEGMENT) // STRIDE)
    return [j * (n - SEGMENT) // some for j in range(some + 1)], SEGMENT


def edit_distance(item: list, text: list, most: int) -> tuple[int, int] | None:
    """Fewest edits from item to a prefix of text and the shortest such prefix; None if more than ``most``.

    Bit-parallel by columns: bit i of up and down says that the distance rises or falls from row i to row i + 1."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, now, best = full, 0, n, (n, 0)
    for j, w in enumerate(text[:n + most], 1):
        same = where.get(w, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right_up = down | (full & ~(zero | up))
        right_down = up & zero
        now += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1 | 1) & full
        up = (right_down << 1 & full) | (full & ~(zero | right_up))
        down = right_up & zero
        if now < best[0]:
            best = (now, j)
    return best if best[0] <= most else None


def nearest(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the passage of text with the fewest edits from item, then the earliest, then the shortest.

    Both are read backwards with a free begin, so the last row holds the distance to the best passage from each start."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict = {}
    for i, w in enumerate(reversed(item)):
        where[w] = where.get(w, 0) | 1 << i
    up, down, now, best = full, 0, n, (n + 1, 0)
    for start in range(len(text) - 1, -1, -1):
        same = where.get(text[start], 0)
        zero = (((same & up) + up) ^ up) | same | down
        right_up = down | (full & ~(zero | up))
        right_down = up & zero
        now += bool(right_up & top) - bool(right_down & top)
        right_up = right_up << 1 & full
        up = (right_down << 1 & full) | (full & ~(zero | right_up))
        down = right_up & zero
        if now <= best[0]:
            best = (now, start)
    edits, start = best
    if edits > most:
        return None
    return edits, start, start + edit_distance(item, text[start:start + n + most], edits)[1]


@dataclass
class Table:
    """The keys of segments of one length, in order, and the segment of each; item and start of each segment."""
    walks: int
    keys: np.ndarray
    segment: np.ndarray
    item: np.ndarray
    start: np.ndarray
    maybe: np.ndarray  # by the first bits of a key

    @classmethod
    def of(cls, size: int, edits: int, words: list[np.ndarray], some: list[tuple[int, int]]) -> Table:
        item, start = np.array(some, np.int64).T
        rows = np.stack([words[k][s:s + size] for k, s in some])
        walks = walks_needed(size, edits)
        keys = np.concatenate([sample_keys(rows[:, ::-1] if backwards(w) else rows, w).ravel() for w in range(walks)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        maybe = np.zeros(1 << min(27, 4 + len(keys).bit_length()), bool)
        maybe[keys >> np.uint64(65 - len(maybe).bit_length())] = True
        return cls(walks, keys, (order % len(rows)).astype(np.int32), item, start, maybe)

    def look_up(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in asked, segment) of each match; asked holds SAMPLES rows of keys."""
        n = asked.shape[1]
        asked = asked.ravel()
        at = np.flatnonzero(self.maybe[asked >> np.uint64(65 - len(self.maybe).bit_length())])
        low, high = np.searchsorted(self.keys, asked[at], "left"), np.searchsorted(self.keys, asked[at], "right")
        many = high - low
        where = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(at, many) % n, self.segment[where].astype(np.int64)


@dataclass
class Index:
    """Items with the keys of their segments; pairs holds every pair of words that an item has, in order, own those of each item."""
    ids: list[int]
    words: list[list[int]]
    pairs: np.ndarray
    own: list[np.ndarray]
    edits: float
    windows: list[tuple[int, int, int]]  # length of segments, most words of a passage, pairs needed
    tables: dict[int, Table]  # by length of segments
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: hashes of whole items in order, item of each

    @classmethod
    def of(cls, ids: list[int], texts: list[str], edits: float = EDITS) -> Index:
        found = words_of(pa.array(texts, pa.string()))
        hashes = found.hashes()
        cut = found.first
        use = [k for k in range(len(ids)) if cut[k + 1] > cut[k]]
        words = [hashes[cut[k]:cut[k + 1]] for k in use]
        own = [np.unique(combine(w, 2)) if len(w) > 1 else w[:0] for w in words]
        long = [k for k in range(len(words)) if len(words[k]) >= LEAST_WORDS]
        pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(own[k] for k in long)]))
        by_size: dict[int, list[tuple[int, int]]] = {}
        bounds: dict[tuple[int, int], list[int]] = {}
        group = 0
        for k in sorted(long, key=lambda k: len(words[k])):
            n = len(words[k])
            most = int(edits * n)
            starts, size = segments(n)
            by_size.setdefault(size, []).extend((k, s) for s in starts)
            group = n if n > 1.1 * group else group
            bound = bounds.setdefault((size, group), [0, n])
            bound[0], bound[1] = max(bound[0], n + most), min(bound[1], n - 1 - 2 * most)
        short = {}
        for n in {len(w) for w in words if len(w) < LEAST_WORDS}:
            item = np.array([k for k in range(len(words)) if len(words[k]) == n])
            keys = np.concatenate([mix(combine(words[k], n), n) for k in item])
            order = np.argsort(keys, kind="stable")
            short[n] = keys[order], item[order]
        return cls([ids[k] for k in use], [w.tolist() for w in words], pairs, own, edits,
                   [(size, *b) for (size, _), b in bounds.items()],
                   {size: Table.of(size, int(edits * size), words, some) for size, some in by_size.items()}, short)

    def candidates(self, found: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, last word + 1) of stretches in which a passage of the item that shares a key must lie, in the order
        of items and first words; stretches of an item that meet within a row are one."""
        if not len(hashes) or not self.tables:
            return
        hits = [np.zeros((3, 0), np.int64)]
        row_begin, row_end = found.first[:-1][found.row], found.first[1:][found.row]
        pair = np.zeros(len(hashes) + 1, np.int64)  # pair k joins the words k - 1 and k
        if len(hashes) > 1:
            keys = combine(hashes, 2)
            maybe = np.zeros(1 << 20, bool)
            maybe[self.pairs >> np.uint64(44)] = True
            hit = np.flatnonzero(maybe[keys >> np.uint64(44)] & (found.row[1:] == found.row[:-1]))
            place = np.minimum(np.searchsorted(self.pairs, keys[hit]), len(self.pairs) - 1)
            pair[hit + 1] = self.pairs[place] == keys[hit]
        known = np.cumsum(pair)  # known[k]: pairs that end at word k or before
        every = np.arange(len(hashes))
        lengths = np.array([len(w) for w in self.words])
        walked = {size: np.zeros(len(hashes) + 1, np.int64) for size in self.tables}
        for size, width, need in self.windows:
            stop = np.minimum(every + width, row_end)
            some = np.flatnonzero(known[stop - 1] - known[every] >= need)
            if len(some):
                walked[size][some] += 1
                walked[size] -= np.bincount(stop[some], minlength=len(hashes) + 1)
        for size, table in self.tables.items():
            at = np.flatnonzero(np.cumsum(walked[size])[:-1] > 0)
            for k in range(0, len(at), 50000):
                some = at[k:k + 50000]
                ways = [window(hashes, some, row_begin[some], row_end[some], size, back) for back in (False, True)]
                keyed = [np.zeros(0, np.int64)]
                for walk in range(table.walks):
                    which, segment = table.look_up(sample_keys(ways[backwards(walk)], walk))
                    keyed.append((which * 2 + backwards(walk)) * len(table.item) + segment)
                which, segment = np.divmod(np.unique(np.concatenate(keyed)), len(table.item))
                place, item = some[which // 2], table.item[segment]
                most = (self.edits * lengths[item]).astype(np.int64)
                begin = place - which % 2 * (size - 1) - table.start[segment]
                end = np.minimum(begin + lengths[item] + 2 * most, row_end[place])
                begin = np.maximum(begin - 2 * most, row_begin[place])
                hits.append(np.stack([item, begin, end]))
        item, begin, end = np.concatenate(hits, axis=1)
        if not len(item):
            return
        order = np.lexsort((begin, item))
        item, begin, end = item[order], begin[order], end[order]
        # An item's words come after those of all items before it, so that one running maximum serves for all.
        shift = item * (len(hashes) + 1)
        reach = np.maximum.accumulate(end + shift)
        opens = np.ones(len(item), bool)
        opens[1:] = (item[1:] != item[:-1]) | (begin[1:] + shift[1:] > reach[:-1]) | (found.row[begin[1:]] != found.row[begin[:-1]])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(item)) - 1
        yield from zip(item[first].tolist(), begin[first].tolist(), (reach - shift)[last].tolist(), strict=True)

    def search(self, column, least: int = 1) -> list[dict[int, tuple[int, int, int]]]:
        """Per row: item number to (edits, first word in the row, last word + 1) of its best passage, for items of ``least`` words or more."""
        found = words_of(column)
        hashes = found.hashes()
        keys = combine(hashes, 2) if len(hashes) > 1 else np.zeros(0, np.uint64)
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(found.rows)]
        for n, (known, items) in self.short.items():
            if n < least:
                continue
            at, asked = found.runs(n, hashes)
            low, high = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
            for k in np.flatnonzero(high > low):
                row = int(found.row[at[k]])
                start = int(at[k] - found.first[row])
                for item in items[low[k]:high[k]].tolist():
                    out[row].setdefault(item, (0, start, start + n))
        stretches: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, begin, end in self.candidates(found, hashes):
            stretches.setdefault((int(found.row[begin]), item), []).append((begin, end))
        for (row, item), some in stretches.items():
            begun, words, own = int(found.first[row]), self.words[item], self.own[item]
            most = int(self.edits * len(words))
            need = len(words) - 1 - 2 * most
            got = []
            for begin, end in some:
                if need > 0:
                    asked = keys[begin:end - 1]
                    if (own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked).sum() < need:
                        continue
                if (d := nearest(words, hashes[begin:end].tolist(), most)) is not None:
                    got.append((d[0], d[1] + begin - begun, d[2] + begin - begun))
            if got:
                out[row][item] = min(got)
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The items in blocks of bounded text, read a partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
        if size >= block_bytes:
            yield Index.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index.of(ids, texts)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and FOUND (items in ascending order) of every row; starts and ends count words of the row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [x.split() for x in FOUND.split(", ")]
    rows = docs.select("doc_id", "text", *(F.array().cast(t).alias(f) for f, t in fields))
    for k, index in enumerate(blocks(benchmark)):
        if k:
            rows = stored(rows, "findings")

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    had = [zip(*r, strict=True) for r in zip(*(part.column(f).to_pylist() for f, _ in fields), strict=True)]
                    new = index.search(part.column("text"))
                    both = [sorted([*h, *((index.ids[k], *v) for k, v in n.items())]) for h, n in zip(had, new, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), part.column("text"),
                        *(pa.array([[x[c] for x in r] for r in both], part.column(f).type) for c, (f, _) in enumerate(fields))],
                        ["doc_id", "text", *(f for f, _ in fields)])

        rows = rows.mapInArrow(run, f"doc_id {kind}, text string, {FOUND}")
    return rows.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no item of ``LEAST_WORDS`` words or more is found, with all their columns."""
    for k, index in enumerate(blocks(benchmark)):
        if k:
            docs = stored(docs, "uncontaminated")

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield part.filter(pa.array([not r for r in index.search(part.column("text"), LEAST_WORDS)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_cgk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "edits", "starts", "ends")
