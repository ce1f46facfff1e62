"""Hard negatives of anchors: rows of another label whose score lies in a band below a positive's score.

Components become floor(256 * x); a score is the integer inner product. Anchors and all other rows are dealt into cells, each
a bounded block of anchors against a bounded tile of rows, and every cell multiplies its two int64 matrices by Strassen's
recursion with zero padding, in exact integer additions (a wrap of an intermediate sum is undone by a later one, as all
is modulo 2**64). A first round keeps the best ``POSITIVES`` rows of an anchor's label in each cell, a second one the best
``NEGATIVES`` rows in the band of each positive; these heaps are merged inside a cell from part to part and between cells by rank.

Order: higher score first, ties by smaller vec_id. The band of a positive with score p holds the scores n of
3 p <= 10 n <= 9 p; for a negative p it is empty.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component take no part. A shorter
vector counts as padded by zeros, an empty one scores 0. Rows of an anchor's vec_id are not "other" rows; repeated
rows count once as an anchor, and each time as a positive or negative. An anchor without positives, and a positive without a negative in its
band, has no rows. Values whose scores could pass 2**59 raise an ArithmeticError. Other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.graph import stored

ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: Rows of a tile and anchors of a block at most, on average; entries of one product held at a time.
TILE_ROWS, BLOCK_ROWS, PRODUCT = 1 << 16, 1 << 13, 1 << 22
#: Strassen's recursion ends where a side is this short.
LEAF = 16
LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a times b transposed, both int64 with one vector a row, modulo 2**64."""
    if min(a.shape[0], a.shape[1], b.shape[0]) <= leaf:
        return a @ b.T
    rows, columns = a.shape[0], b.shape[0]
    a, b = (np.pad(x, [(0, n % 2) for n in x.shape]) if any(n % 2 for n in x.shape) else x for x in (a, b))
    m, d, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[0] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b21, b12, b22 = b[:n, :d], b[:n, d:], b[n:, :d], b[n:, d:]  # quarters of b transposed, each still a vector a row
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of float lists take part, and their vectors as int64 rows, padded by zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros(0, bool), np.zeros((0, 0), np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lists)), lengths)
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row, ~np.isfinite(values), minlength=len(lists)) == 0)
    place = np.arange(len(values)) - (np.cumsum(lengths) - lengths)[row]
    scaled = np.floor(256.0 * values[good[row]])
    if len(scaled) and np.abs(scaled).max() >= 2.0**59:
        raise ArithmeticError("a component is too large for scores of 64 bits")
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[row[good[row]], place[good[row]]] = scaled.astype(np.int64)
    return good, out[good]


class Side:
    """Rows of one side of a cell: id, label and vector, in the order of their ids, and the rows they come from."""

    def __init__(self, rows: pa.Table):
        good, vectors = matrix(rows.column("embedding"))
        at = np.flatnonzero(good)
        ids = rows.column("vec_id").to_numpy()[at]
        order = np.argsort(ids, kind="stable")
        self.at, self.id, self.vector = at[order], ids[order], vectors[order]
        self.label = rows.column("label").to_numpy()[self.at]


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    largest = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if largest[0] * largest[1] * d >= 1 << 59:
        raise ArithmeticError("a score could pass 64 bits")
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def best(heap: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Of (row, score, id) the first ``most`` of each row: a heap that takes in another by being joined to it."""
    row, score, ids = heap
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return [x[rank < most] for x in (row, score, ids)]


def top(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """(row, score, id) of the first ``most`` allowed entries of each row; ids ascend."""
    held = np.where(allowed, scores, LOWEST)
    if held.shape[1] > most:
        least = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
        row, column = np.nonzero((held >= least[:, None]) & allowed)
    else:
        row, column = np.nonzero(allowed)
    return best([row, held[row, column], ids[column]], most)


def products(a: np.ndarray, b: np.ndarray):
    """The product of a and b transposed in parts of bounded size: slices of both, and the part."""
    a, b = same_width(a, b)
    height = max(1, min(len(a), 512))
    width = max(1, PRODUCT // height)
    for i in range(0, len(a), height):
        for j in range(0, len(b), width):
            yield slice(i, i + height), slice(j, j + width), strassen(a[i:i + height], b[j:j + width])


NONE = [np.zeros(0, np.int64)] * 3


def positives_of(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """A cell's first positives of each of its anchors."""
    left, right = Side(anchors), Side(rows)
    heap = NONE
    for label in np.unique(left.label):
        a, b = np.flatnonzero(left.label == label), np.flatnonzero(right.label == label)
        for i, j, scores in products(left.vector[a], right.vector[b]):
            other = left.id[a[i]][:, None] != right.id[b[j]][None, :]
            row, score, ids = top(scores, other, right.id[b[j]], most)
            heap = best([np.concatenate(x) for x in zip(heap, [a[i][row], score, ids], strict=True)], most)
    row, score, ids = heap
    at = pa.array(left.at[row])
    return pa.table({"anchor_id": anchors.column("vec_id").take(at), "anchor": anchors.column("anchor").take(at),
                     "positive_id": pa.array(ids), "positive_score": pa.array(score)})


def negatives_of(anchors: pa.Table, rows: pa.Table, places: int, most: int) -> pa.Table:
    """A cell's first negatives in the band of each positive of its anchors."""
    left, right = Side(anchors), Side(rows)
    low, high = (np.stack([anchors.column(f"{edge}_{k}").to_numpy()[left.at] for k in range(1, places + 1)], 1)
                 for edge in ("low", "high"))
    heaps = [NONE] * places
    for i, j, scores in products(left.vector, right.vector):
        other = left.label[i][:, None] != right.label[j][None, :]
        for k in range(places):
            within = other & (scores >= low[i, k][:, None]) & (scores <= high[i, k][:, None])
            row, score, ids = top(scores, within, right.id[j], most)
            heaps[k] = best([np.concatenate(x) for x in zip(heaps[k], [row + i.start, score, ids], strict=True)], most)
    place = np.repeat(np.arange(1, places + 1), [len(h[0]) for h in heaps])
    row, score, ids = (np.concatenate(x) for x in zip(*heaps, strict=True))
    at = pa.array(left.at[row])
    return pa.table({"anchor_id": anchors.column("vec_id").take(at), "anchor": anchors.column("anchor").take(at),
                     "place": pa.array(place.astype(np.int32)), "negative_id": pa.array(ids), "negative_score": pa.array(score)})


def cells(anchors: DataFrame, rows: DataFrame, n_blocks: int, n_tiles: int):
    """Both sides by (block, tile): each anchor in one block for all tiles, each row in one tile for all blocks."""
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # A row's place in its input deals it, not its content: copies of one row spread like any others.
    tiles = rows.withColumn("tile", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_tiles)).cast("int")).select(
        "*", numbers(n_blocks, "block"))
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns apart from those of rows
    blocks = own.withColumn("block", F.pmod(F.xxhash64("vec_id", "anchor"), F.lit(n_blocks)).cast("int")).select(
        "*", numbers(n_tiles, "tile"))
    return blocks.groupBy("block", "tile").cogroup(tiles.groupBy("block", "tile"))


def ranked(df: DataFrame, by: list[str], score: str, ids: str, most: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), ids)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def mine(embeddings: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for embeddings(vec_id, label, embedding)."""
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    counts = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks = max(1, -(-counts[1] // block_rows))
    # Small tables are cut finer, so that all cores have a tile.
    n_tiles = max(1, -(-counts[0] // tile_rows), min(-(-counts[0] // 512), 2 * spark.sparkContext.defaultParallelism))
    anchors = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("anchor", F.xxhash64("label", "embedding"))
    first = cells(anchors, rows, n_blocks, n_tiles).applyInArrow(
        partial(positives_of, most=positives), "anchor_id long, anchor long, positive_id long, positive_score long")
    key = ["anchor_id", "anchor"]
    found = stored(ranked(first, key, "positive_score", "positive_id", positives, "place"), "positives")
    edges = {"low": lambda p: F.expr(f"(3 * {p} + 9) div 10"), "high": lambda p: F.expr(f"9 * {p} div 10")}
    empty = {"low": 1, "high": 0}
    bands = found.where("positive_score >= 0").groupBy(*key).agg(*[
        F.coalesce(F.max(F.when(F.col("place") == k, edge("positive_score"))), F.lit(empty[name])).cast("long").alias(f"{name}_{k}")
        for name, edge in edges.items() for k in range(1, positives + 1)])
    banded = anchors.join(bands.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "anchor"])
    second = cells(banded, rows, n_blocks, n_tiles).applyInArrow(
        partial(negatives_of, places=positives, most=negatives),
        "anchor_id long, anchor long, place int, negative_id long, negative_score long")
    last = ranked(second, [*key, "place"], "negative_score", "negative_id", negatives, "rank")
    return last.join(found, [*key, "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_strassen(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved))
