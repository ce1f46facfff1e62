"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Each task reads its documents in blocks of at least ``BLOCK_TOKENS`` tokens (the last block of a task is what is left) and
packs a block on its own, so nothing is shuffled and memory is bounded by a block and the longest document. A block of T
tokens gets T // length full sequences and, for the rest, one sequence per binary digit of T % length: sequences whose
length is a power of two need no padding, so none is padded. A piece costs linear * n + quadratic * n * n, as attention
does not cross documents. Pieces go, longest first, to the cheapest sequence with room for them; a piece that fits nowhere
fills the widest room and its rest waits again.

Defined results: a null or empty text is the end token alone. Equal lengths are taken in the order of the rows, equal costs
in the order of the sequences. Repeated rows are packed like any others; an empty table gives no pieces. Sequence ids are
unique but have gaps: the task's number times 2**33 plus a count. Only id and text are read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from llm.words import LOWER, Words, slices

SEQUENCE = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 21
#: Distinct words whose ids a worker keeps; beyond it the cache starts anew, ids are unaffected.
CACHE_WORDS = 2_000_000
#: Below this character, letters stay letters of one word when they are normalised.
BEYOND = "\u0130"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"


@dataclass(frozen=True)
class Cost:
    """Of a piece of n tokens. The default weighs a model of width 4096: attention equals the rest at 6 * 4096 tokens."""
    linear: float = 1.0
    quadratic: float = 1.0 / (6 * 4096)

    def of(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


class WordIds:
    """Ids of texts by a tokenizer that treats the words between white space apart, as a table of words seen before.

    Letters A-Z are lowered first, as the tokenizer does so itself, unless a text may hold a special token; a word's last
    full stop or comma after an ASCII letter or digit is a token of its own."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.at), len(words)
        while k + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.size[k:k + n] = sizes
        self.start[k:k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.at.update(zip(words, range(k, k + n), strict=True))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers, and how many each has."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def learn(self, words: list[bytes]) -> None:
        """Ids of words not seen before. Words of letters alone are encoded together, as each gives one run of tokens up to
        one that ends a word; the others are encoded one by one."""
        ends = [w for w in words if len(w) > 1 and w[-1] in b".," and (48 <= w[-2] <= 57 or 97 <= w[-2] <= 122)]
        new = {w for w in (*(w[:-1] for w in ends), *(w[-1:] for w in ends), *set(words).difference(ends)) if w not in self.at}
        texts = {w: w.decode("utf-8", "replace") for w in new}
        plain = [w for w, t in texts.items() if t.isalpha() and max(t) < BEYOND]
        joined = self.tokenizer.encode(" ".join(texts[w] for w in plain), add_special_tokens=False).ids if plain else []
        ids = np.array(joined, np.int32)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(plain):
            raise ValueError("a word of letters did not end in one token that ends words")
        self._add(plain, ids, np.diff(stops, prepend=0))
        rest = sorted(new.difference(plain))
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([texts[w] for w in rest], add_special_tokens=False)]
        self._add(rest, np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded], np.int64))
        if ends := [w for w in ends if w not in self.at]:
            pairs = np.array([[self.at[w[:-1]], self.at[w[-1:]]] for w in ends])
            ids, size = self.gather(pairs.ravel())
            self._add(ends, ids, size.reshape(-1, 2).sum(axis=1))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by END_ID, and the boundaries between them."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        words = Words(column)
        if b"<|" not in words.data.tobytes():
            words.data = LOWER[words.data]
        which, known = words.distinct()
        at = np.fromiter(map(self.at.get, known, repeat(-1)), np.int64, len(known))
        if len(missing := np.flatnonzero(at < 0)):
            self.learn([known[k] for k in missing])
            at[missing] = [self.at[known[k]] for k in missing]
        ids, size = self.gather(at[which])
        ends = np.concatenate([[0], np.cumsum(size)])[words.first]
        return np.insert(ids, ends[1:], END_ID), ends + np.arange(len(ends))


def pack(sizes: list[int], length: int = SEQUENCE, cost: Cost = Cost()) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Pieces (document, start, size, sequence, offset), and capacity and cost of each sequence; capacities sum to the sizes."""
    total = sum(sizes)
    room = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    full = cost.of(length)
    pieces, spent, free = [], [0.0] * len(room), list(room)
    rest, k = [], 0  # rest: (-size, document, start), a heap with the longest first
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            pieces.append((d, start, length, k, 0))
            spent[k], free[k] = full, 0
            k += 1
        if n % length:
            rest.append((-(n % length), d, n - n % length))
    heapq.heapify(rest)
    open_, waiting = [(0.0, s) for s in range(k, len(room))], []  # by cost; waiting: too narrow so far, widest first
    heapq.heapify(open_)
    while rest:
        size, d, start = heapq.heappop(rest)
        size = -size
        while waiting and -waiting[0][0] >= size:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(open_, (spent[s], s))
        while open_ and free[open_[0][1]] < size:
            s = heapq.heappop(open_)[1]
            if free[s]:
                heapq.heappush(waiting, (-free[s], s))
        s = heapq.heappop(open_ if open_ else waiting)[1]
        n = min(size, free[s])
        pieces.append((d, start, n, s, room[s] - free[s]))
        free[s] -= n
        spent[s] += cost.of(n)
        if free[s]:
            heapq.heappush(open_, (spent[s], s))
        if n < size:
            heapq.heappush(rest, (n - size, d, start + n))
    return pieces, room, spent


_kept: dict[str, WordIds] = {}


def pack_documents(docs: DataFrame, tokenizer_file: str, length: int = SEQUENCE, cost: Cost = Cost()) -> DataFrame:
    """Pieces of all documents. tokenizer_file must have the same place on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _kept:
            _kept[tokenizer_file] = WordIds(tokenizer_file)
        words = _kept[tokenizer_file]
        first = TaskContext.get().partitionId() << 33
        keys, ids, sizes, have = [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])
            pieces, room, spent = pack(sizes, length, cost)
            pieces.sort()
            d, start, n, s, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(flat[a:a + k].astype("<u4").tobytes()) for a, k in zip(starts[d] + start, n, strict=True)]
            out = pa.RecordBatch.from_arrays([
                pa.concat_arrays(keys).take(pa.array(d)), *map(pa.array, (
                    start, n, np.array(crc, np.int64), np.array(sizes)[d], first + s, offset, np.array(room)[s], np.array(spent)[s]))],
                ["doc_id", *(f.strip().split()[0] for f in PIECES.split(","))])
            first += len(room)
            return out

        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                got, bounds = words.encode(part.column("text"))
                keys.append(part.column("doc_id"))
                ids.append(got)
                sizes += np.diff(bounds).tolist()
                have += len(got)
                if have >= BLOCK_TOKENS:
                    yield packed()
                    keys, ids, sizes, have = [], [], [], 0
        if sizes:
            yield packed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
