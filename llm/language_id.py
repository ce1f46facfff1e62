"""Language of a text by a convolutional network over its bytes.

Bytes (A-Z lowered) are embedded, filters of several widths slide over a window of fixed length, each filter keeps its
largest answer, and a softmax over these gives the chances of the languages. The network is trained in numpy by Adam on
windows of labelled texts, as many of each language and some cut short, so that short texts are known too; then every whole text is cut into
overlapping windows, and a text's chances are the languages' shares times the product of its windows' chances.

A filter over embedded bytes is a sum of one table entry per byte, so scoring looks pairs of bytes up in tables instead of
multiplying: the same numbers, up to rounding of float32.

Training reads a bounded sample of labelled rows (``Bounds``): of the most frequent languages, the first documents by the
hash of doc_id, and windows spread over the whole of each text. The shares of the languages are counted over all labelled rows.

Defined results: a null text, or one without any letter, is ``und`` with score 0.0; so is every text where nothing can be learned.
Repeated rows each get their row. A null doc_id is predicted and not held out, and teaches nothing. A language without a
letter in its texts is not learned. Only doc_id and text are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.words import LOWER, buffers, slices

FOLDS, HELD_OUT = 3, 1
LENGTH = 128  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDED = 16, 8
UNDETERMINED = "und"


@dataclass(frozen=True)
class Bounds:
    """The most languages, documents of each, and windows of a document that training reads."""
    languages: int = 64
    documents: int = 1000
    windows: int = 4


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def has_letter(text) -> F.Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Network:
    """embedding (256, E), one (width * E, F) matrix and F offsets a width, and the softmax's matrix and offsets."""
    languages: list[str]
    log_shares: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    out: np.ndarray
    out_offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.offsets, self.out, self.out_offset]


def new_network(languages: list[str], log_shares: np.ndarray, seed: int = 12) -> Network:
    rng = np.random.default_rng(seed)
    k = len(languages)
    embedding = rng.normal(0, 1, (256, EMBEDDED))
    embedding[0] = 0.0  # stands for what a short window lacks
    return Network(
        languages, log_shares, embedding, [rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, k)), np.zeros(k))


def patches(embedded: np.ndarray, width: int) -> np.ndarray:
    """(rows, places, width * E): what a filter of a width sees at each place."""
    seen = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1)
    return seen.transpose(0, 1, 3, 2).reshape(len(embedded), embedded.shape[1] - width + 1, width * embedded.shape[2])


def forward(net: Network, windows: np.ndarray):
    """Log chances of (rows, LENGTH) bytes, and for each width the place of each filter's largest answer and that answer."""
    embedded = net.embedding[windows]
    pooled, places = [], []
    for w, kernel, offset in zip(WIDTHS, net.filters, net.offsets, strict=True):
        answers = patches(embedded, w) @ kernel
        at = answers.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(answers, at[:, None, :], 1)[:, 0] + offset)
    hidden = np.maximum(np.concatenate(pooled, 1), 0.0)
    z = hidden @ net.out + net.out_offset
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), hidden, places


def gradients(net: Network, windows: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy and its slope along each parameter, in the order of parameters()."""
    log_p, hidden, places = forward(net, windows)
    n = len(windows)
    loss = -float(log_p[np.arange(n), truth].mean())
    slope = np.exp(log_p)
    slope[np.arange(n), truth] -= 1
    slope /= n
    back = (slope @ net.out.T) * (hidden > 0)
    on_embedding = np.zeros_like(net.embedding)
    on_filters, on_offsets = [], []
    for k, w in enumerate(WIDTHS):
        own = back[:, k * FILTERS:(k + 1) * FILTERS]
        seen = windows[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]  # (rows, F, width) bytes
        patch = net.embedding[seen].reshape(n, FILTERS, w * EMBEDDED)
        on_filters.append(np.einsum("nf,nfd->df", own, patch))
        on_offsets.append(own.sum(axis=0))
        step = own[:, :, None] * net.filters[k].T[None]
        np.add.at(on_embedding, seen.ravel(), step.reshape(-1, EMBEDDED))
    on_embedding[0] = 0.0
    return loss, [on_embedding, *on_filters, *on_offsets, hidden.T @ slope, slope.sum(axis=0)]


def train(windows: np.ndarray, truth: np.ndarray, net: Network, epochs: int = 6, batch: int = 64, rate: float = 4e-3,
          seed: int = 12) -> Network:
    """Adam over shuffled windows, each language weighted alike by repeating its windows; steps shrink to nothing."""
    rng = np.random.default_rng(seed)
    sizes = np.bincount(truth, minlength=len(net.languages))
    each = int(sizes.max(initial=0))
    steps = max(1, epochs * -(-each * int((sizes > 0).sum()) // batch))
    means, squares = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = np.concatenate([rng.permutation(np.resize(rng.permutation(own), each))
                                for k in range(len(sizes)) if len(own := np.flatnonzero(truth == k))])
        rng.shuffle(order)
        for i in range(0, len(order), batch):
            t += 1
            got = windows[order[i:i + batch]].copy()
            cut = rng.random(len(got)) < 0.4  # some are cut short, as short texts are
            ends = np.where(cut, rng.integers(4, LENGTH, len(got)), LENGTH)
            got[np.arange(LENGTH)[None, :] >= ends[:, None]] = 0
            _, slopes = gradients(net, got, truth[order[i:i + batch]])
            pace = rate * (1 - (t - 1) / steps)
            for p, g, m, s in zip(net.parameters(), slopes, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= pace * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def window_matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(rows, LENGTH) bytes, lowered, from each start to at most its end; 0 beyond."""
    at = start[:, None] + np.arange(LENGTH)
    out = LOWER[data[np.minimum(at, max(0, len(data) - 1))]] if len(data) else np.zeros(at.shape, np.uint8)
    out[at >= end[:, None]] = 0
    return out


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the windows that cover each row; they overlap by less than a filter, the last takes what is left."""
    step = LENGTH - max(WIDTHS) + 1
    sizes = np.diff(bounds)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - LENGTH) // step) + 1), 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return row, start, np.minimum(start + LENGTH, bounds[1:][row])


class Tables:
    """The network's filters as tables over pairs of bytes, and the scoring by them."""

    def __init__(self, net: Network):
        self.net = net
        one = lambda kernel, k: (net.embedding @ kernel[k * EMBEDDED:(k + 1) * EMBEDDED]).astype(np.float32)
        self.parts = []
        for kernel, w in zip(net.filters, WIDTHS, strict=True):
            pairs = [(k, (one(kernel, k)[:, None] + one(kernel, k + 1)[None]).reshape(65536, -1)) for k in range(0, w - 1, 2)]
            self.parts.append((pairs, [(w - 1, one(kernel, w - 1))] if w % 2 else []))

    def log_chances(self, windows: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(windows.T)  # places first, so that the largest over places runs along memory
        pair = x[:-1].astype(np.uint16) * 256 + x[1:]
        pooled = []
        for (pairs, single), w, offset in zip(self.parts, WIDTHS, self.net.offsets, strict=True):
            n = LENGTH - w + 1
            answers = np.take(pairs[0][1], pair[:n], axis=0)
            for k, entries in pairs[1:]:
                answers += np.take(entries, pair[k:k + n], axis=0)
            for k, entries in single:
                answers += np.take(entries, x[k:k + n], axis=0)
            pooled.append(answers.max(axis=0) + offset)
        z = np.maximum(np.concatenate(pooled, 1), 0.0) @ self.net.out + self.net.out_offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def text_chances(self, column, most: int = 1024) -> np.ndarray:
        """(rows, languages): the chances of each whole text."""
        data, bounds = buffers(column)
        row, start, end = windows_of(bounds)
        total = np.tile(self.net.log_shares, (len(bounds) - 1, 1))
        for i in range(0, len(row), most):
            part = slice(i, i + most)
            np.add.at(total, row[part], self.log_chances(window_matrix(data, start[part], end[part])))
        total -= total.max(axis=1, keepdims=True)
        chances = np.exp(total)
        return chances / chances.sum(axis=1, keepdims=True)


def training_windows(docs: DataFrame, bounds: Bounds) -> tuple[DataFrame, dict[str, int]]:
    """(lang, piece) of the sample, and the number of labelled rows of each of its languages."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(bounds.languages).collect()
    shares = {r.lang: r.n for r in counts}
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # A share of the hashes that holds twice as many as wanted: the ranking then meets a bounded number of rows of any language.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    wanted = F.create_map(*[F.lit(x) for lang, n in shares.items() for x in (lang, 2.0 * bounds.documents / n)]).cast("map<string,double>")
    chosen = known.where(F.col("lang").isin(*shares)).select("lang", "doc_id").where(part < wanted[F.col("lang")]).withColumn(
        "_n", F.row_number().over(first)).where(F.col("_n") <= bounds.documents).select("lang", "doc_id").distinct()
    room = F.greatest(F.length("text") - LENGTH, F.lit(0))
    at = lambda i: (1 + (room * i / max(1, bounds.windows - 1)).cast("int")).cast("int")
    pieces = F.array_distinct(F.array(*[F.substring(F.col("text"), at(i), F.lit(LENGTH)) for i in range(bounds.windows)]))
    # The sample is bounded by the parameters, whatever the size of the table.
    return known.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).select(
        "lang", F.explode(pieces).alias("piece")).orderBy("lang", F.xxhash64("piece"), "piece").limit(
        bounds.languages * bounds.documents * bounds.windows), shares


def fit(docs: DataFrame, bounds: Bounds = Bounds()) -> Network | None:
    """None if no labelled row can teach."""
    pieces, shares = training_windows(docs, bounds)
    if not shares:
        return None
    got = pieces.toArrow()
    languages = sorted(shares)
    number = {name: k for k, name in enumerate(languages)}
    truth = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    data, ends = buffers(got.column("piece"))
    windows = window_matrix(data, ends[:-1], np.minimum(ends[:-1] + LENGTH, ends[1:]))
    total = sum(shares.values())
    return train(windows, truth, new_network(languages, np.log([shares[x] / total for x in languages])))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = has_letter(F.col("text"))
    if net is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(net)
        names = np.array(net.languages, dtype=object)
        for batch in batches:
            for part in slices(batch, "text"):
                chances = tables.text_chances(part.column("text"))
                which = chances.argmax(axis=1)
                known = part.column("lettered").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.where(known, names[which], UNDETERMINED), pa.string()),
                    pa.array(np.where(known, chances[np.arange(len(which)), which], 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.when(lettered, F.col("text")).alias("text"), lettered.alias("lettered")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def op12_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
