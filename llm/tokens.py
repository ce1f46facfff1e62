"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over characters. A node v holds two precomputed values: where matching goes on after v fails
(its failure link) and how many pieces that takes off the front of v's string (its popped count). Reading a word follows
edges and, where there is none, failure links, adding their counts; no piece is built and no character is read twice.

The pieces of ``piece_bpe_32k.model`` mark a word's first piece by U+2581, which is read as the word's first character, so a
word is that mark and its characters. Words are runs of bytes outside 0x20 and 0x09-0x0D.

Defined results: a null text has 0 words and 0 tokens. A character that no piece starts with counts as its UTF-8 bytes. Rows are counted one by
one, so repeated rows, ties and null ids stay as they are. Words of any length take linear time. Only id and text are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from llm.words import Words, slices

MARK = "▁"
#: Distinct words whose counts a worker keeps between batches; beyond it the cache starts anew, counts are unaffected.
CACHE_WORDS = 400_000


class Automaton:
    """Nodes are numbers; 0 is the root. next: edges by (node, character); fail and popped as above (the root fails to -1).

    A character that only occurs inside longer pieces is a piece too, worth its UTF-8 bytes; so matching never gets stuck."""

    def __init__(self, pieces: Iterable[str]):
        pieces = {p: 1 for p in pieces if p}
        pieces = {c: len(c.encode("utf-8", "surrogatepass")) for p in pieces for c in p} | pieces
        self.next: list[dict[str, int]] = [{}]
        worth, parent = [0], [(-1, "")]
        for piece, n in pieces.items():
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    worth.append(0)
                    parent.append((at, c))
                at = to
            worth[at] = n
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            v = todo.popleft()
            todo.extend(self.next[v].values())
            if worth[v]:  # the whole string is one piece
                self.fail[v], self.popped[v] = 0, worth[v]
                continue
            u, c = parent[v]
            z, n = self.fail[u], self.popped[u]
            while c not in self.next[z]:  # ends at the root at the latest, which has an edge for every character
                n += self.popped[z]
                z = self.fail[z]
            self.fail[v], self.popped[v] = self.next[z][c], n

    def length(self, text: str) -> int:
        """Pieces of the greedy longest-match cut."""
        nexts, fail, popped = self.next, self.fail, self.popped
        at = count = 0
        for c in text:
            while (to := nexts[at].get(c)) is None and at:
                count += popped[at]
                at = fail[at]
            if to is None:
                count += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = to
        while at:
            count += popped[at]
            at = fail[at]
        return count


def pieces_of(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


_kept: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row. model_file must have the same place on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _kept:
            _kept[model_file] = (Automaton(pieces_of(model_file)), {})
        automaton, cache = _kept[model_file]
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                which, known = words.distinct()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                lengths = np.fromiter(map(cache.get, known, repeat(-1)), np.int64, len(known))
                for k in np.flatnonzero(lengths < 0):
                    lengths[k] = automaton.length(MARK + known[k].decode("utf-8", "replace"))
                    if len(known[k]) <= 64:
                        cache[known[k]] = int(lengths[k])
                total = np.diff(np.concatenate([[0], np.cumsum(lengths[which])])[words.first])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.count), pa.array(total)], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def op8_longest_match(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_file)
