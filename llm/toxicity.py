"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words is trained from confirmed toxic texts (P) and from a sample of all training rows, whether they carry a label or
not and P's among them (U): the case-control scenario, in which U is drawn from the whole mixture and its labels are not looked at. With the class
prior q, the risk is q R+(P) + max(0, R-(U) - q R-(P)): the second part estimates the risk on clean texts from U less the
toxic share in it, and may not go below zero; where it would, it counts as zero and has no slope. Losses are logistic, so the logistic
function of the output estimates the chance that a text is toxic.

Terms are runs of letters and digits, A-Z lowered; only their presence counts, so length does not dilute a text. The
vocabulary holds the terms that stand out most in P against U. P, U and the vocabulary are bounded by parameters: chosen
by the hash of doc_id, so any size of input is treated alike. Scores are given to every row.

Defined results: a null or empty text has no terms and gets the score of the intercept alone. Without positives the
score is 0.0. A document with several labels is toxic if one says so; labels without a text or with a null id or label
teach nothing. Repeated rows each get their row. A null doc_id is scored and not held out. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from llm.words import PUNCTUATION, Words, slices, table


@dataclass(frozen=True)
class Bounds:
    """The most positives and unlabelled texts that training reads, the most terms, and the least positives with a term."""
    positives: int = 4000
    unlabelled: int = 10000
    terms: int = 4000
    least: int = 5


FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Term hashes in ascending order, their weights, and the intercept."""
    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        row, term = present(column, self.terms)
        z = np.full(len(column), self.bias) + np.bincount(row, self.weights[term], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def present(column, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the term) of each term that a row holds, each once."""
    words = Words(column, lower=True, between=PUNCTUATION)
    if not len(words) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = words.hashes()
    maybe = np.zeros(1 << 20, bool)
    maybe[terms & np.uint64((1 << 20) - 1)] = True
    at = np.flatnonzero(maybe[hashes & np.uint64((1 << 20) - 1)])
    place = np.minimum(np.searchsorted(terms, hashes[at]), len(terms) - 1)
    hit = terms[place] == hashes[at]
    both = np.unique(words.row[at[hit]] * len(terms) + place[hit])
    return both // len(terms), both % len(terms)


def training_ids(docs: DataFrame, labels: DataFrame, bounds: Bounds) -> DataFrame:
    """doc_id, positive: at most bounds.positives confirmed and bounds.unlabelled other rows of the folds for training."""
    order = F.xxhash64("doc_id")
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    toxic = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 1").select("doc_id")
    pool = docs.select("doc_id").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return toxic.orderBy(order).limit(bounds.positives).withColumn("positive", F.lit(True)).unionAll(
        pool.orderBy(order).limit(bounds.unlabelled).withColumn("positive", F.lit(False)))


def class_prior(labels: DataFrame) -> float | None:
    """The share of toxic documents among those with a label in the folds for training."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("t")).agg(F.avg((F.col("t") == 1).cast("double"))).first()[0]


def term_counts(rows: DataFrame) -> DataFrame:
    """term, in_p, in_u: in how many rows of each kind a term occurs."""
    schema = pa.schema([("term", pa.int64()), ("in_p", pa.int64()), ("in_u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words = Words(part.column("text"), lower=True, between=PUNCTUATION)
                if not len(words):
                    continue
                order = np.lexsort((words.row, hashes := words.hashes()))
                h, r = hashes[order], words.row[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                h, r = h[once], r[once]
                positive = part.column("positive").to_numpy(zero_copy_only=False)[r]
                terms, back = np.unique(h, return_inverse=True)
                in_p = np.bincount(back, positive, minlength=len(terms))
                in_u = np.bincount(back, ~positive, minlength=len(terms))
                yield table(schema, terms.view(np.int64), in_p.astype(np.int64), in_u.astype(np.int64))

    return rows.mapInArrow(run, "term long, in_p long, in_u long").groupBy("term").agg(
        F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))


def choose_terms(rows: DataFrame, n_p: int, n_u: int, bounds: Bounds) -> np.ndarray:
    """The bounds.terms terms whose shares in P and U differ by most standard errors, of those common enough in P."""
    p, u = F.col("in_p") / n_p, F.col("in_u") / n_u
    both = (F.col("in_p") + F.col("in_u")) / (n_p + n_u)
    z = (p - u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-9)
    best = term_counts(rows).where(F.col("in_p") >= min(bounds.least, n_p)).select("term", z.alias("z"))
    found = best.orderBy(F.desc(F.abs("z")), "term").limit(bounds.terms).select("term").toArrow()
    return np.sort(found.column("term").to_numpy().view(np.uint64))


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of outputs z, and its slope along each of them (0.0 for U's part where that is at its bound)."""
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = share * np.logaddexp(0, z)  # loss of calling a row clean
    toxic = share * np.logaddexp(0, -z)  # loss of calling it toxic
    negative_part = clean[~positive].sum() - prior * clean[positive].sum()
    whole = prior * toxic[positive].sum() + max(0.0, negative_part)
    if negative_part >= 0:
        return whole, share * np.where(positive, prior * (s - 1) - prior * s, s)
    return whole, share * np.where(positive, prior * (s - 1), 0.0)  # only the confirmed texts count


def train(row: np.ndarray, term: np.ndarray, positive: np.ndarray, n_terms: int, prior: float, rounds: int = 500,
          rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam on the non-negative risk, from (row, term) pairs.

    Steps shrink to nothing and the last half of the weights is averaged, as steps to and fro at the bound do not settle."""
    n = len(positive)
    w = np.zeros(n_terms + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, kept = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[term], minlength=n)
        _, slope = risk(z, positive, prior)
        grad = np.append(np.bincount(term, slope[row], minlength=n_terms), slope.sum())
        grad[:-1] += decay * w[:-1]
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad * grad - square)
        w -= rate * (1 - t / (rounds + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        kept += w * (2 * t > rounds)
    kept /= max(1, rounds - rounds // 2)
    return kept[:-1], float(kept[-1])


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model | None:
    """None if the labels confirm no document that has a text."""
    prior = class_prior(labels)
    ids = F.broadcast(training_ids(docs, labels, bounds))  # bounded by the parameters
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("positive", "text").persist(StorageLevel.DISK_ONLY)
    try:
        counts = {r.positive: r.n for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
        n_p, n_u = counts.get(True, 0), counts.get(False, 0)
        if not prior or not n_p or not n_u:
            return None
        terms = choose_terms(rows, n_p, n_u, bounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    row, term = present(part.column("text"), terms)
                    at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("positive"), lists], ["positive", "terms"])

        got = rows.mapInArrow(run, "positive boolean, terms array<int>").toArrow().combine_chunks()
    finally:
        rows.unpersist()
    lists = got.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    term = lists.flatten().to_numpy().astype(np.int64)
    positive = got.column("positive").to_numpy().astype(bool)
    weights, bias = train(row, term, positive, len(terms), min(0.99, prior))
    return Model(terms, weights, bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.scores(part.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op1_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
