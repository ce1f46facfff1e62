"""Copy-move search: nearest descriptors within one document, by Hamming distance.

A descriptor of 256 bits (32 bytes) is an array of four BIGINT words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# --- fixed values ------------------------------------------------------------------------
MAX_HAMMING = 40
MAX_RATIO = 0.75
MIN_DISTANCE = 50.0
MIN_PAIRS = 10
# --- end of fixed values --------------------------------------------------------------

TILE_ROWS = 512
FAR = 1 << 30  # beyond any distance


def _unpacked(lists: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """A tile's descriptors as words, and as their 256 bits for the product that counts common ones; float32 holds the counts exactly."""
    words = lists.values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
    return words, np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32)


class Nearest:
    """The two smallest distances of a tile's points over the tiles they have met, and the words of the nearest."""

    def __init__(self, points: pa.ListScalar):
        self.words, self.bits = _unpacked(points)
        self.ones = self.bits.sum(axis=1)
        self.d1 = np.full(len(self.words), FAR, np.int64)
        self.d2, self.near = self.d1.copy(), self.words.copy()

    def meet(self, others: pa.ListScalar, copies: pa.ListScalar) -> None:
        words, bits = _unpacked(others)
        away = (self.ones[:, None] + bits.sum(axis=1)[None, :] - 2 * (self.bits @ bits.T)).astype(np.int64)
        away[away == 0] = FAR  # the point itself: different points differ
        row, at = np.arange(len(away)), away.argmin(axis=1)
        d1 = away[row, at]
        several = copies.values.to_numpy(zero_copy_only=False)[at] > 1
        away[row, at] = FAR
        # Two others at one distance, or a nearest one of several copies, are the second nearest as well.
        d2 = np.where(several, d1, away.min(axis=1))
        self.d2 = np.minimum(np.minimum(self.d2, d2), np.maximum(self.d1, d1))
        closer = d1 < self.d1
        self.near[closer] = words[at[closer]]
        self.d1 = np.minimum(self.d1, d1)

    def rows(self, doc_id: pa.Scalar) -> pa.RecordBatch:
        lists = lambda words: pa.ListArray.from_arrays(np.arange(0, 4 * len(words) + 1, 4, dtype=np.int32), words.ravel())
        return pa.RecordBatch.from_arrays(
            [pa.array([doc_id.as_py()] * len(self.words), doc_id.type), lists(self.words), pa.array(self.d1), lists(self.near), pa.array(self.d2)],
            ["doc_id", "bits", "d1", "b1", "d2"])


def _two_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tile, points, others, copies), those of a tile one after another -> a row per point. One tile is held at a time."""
    key, tile = None, None
    for batch in batches:
        doc, number, points, others, copies = (batch.column(n) for n in ("doc_id", "tile", "points", "others", "copies"))
        for i in range(batch.num_rows):
            if key is None or not (doc[i].equals(key[0]) and number[i].equals(key[1])):
                if tile is not None:
                    yield tile.rows(key[0])
                key, tile = (doc[i], number[i]), Nearest(points[i])
            tile.meet(others[i], copies[i])
    if tile is not None:
        yield tile.rows(key[0])


def nearest_pairs(descriptors: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per point that can pass the ratio test: its nearest other point and both distances.

    Exact. Points of a document with equal bits are folded into one row first: with three or
    more copies both distances are zero and the ratio is undefined; with two, the twin is the
    nearest. What remains is distributed over tiles of bounded size. Tiles of a document meet
    pairwise and hand on only the two nearest per point, so no pair of points is ever a row
    and no task holds a whole document. The work is quadratic in the different descriptors of one document, as exact
    nearest neighbours need; tiles meet as one product of their bits. ``descriptors`` is read several times: pass a stored table.
    """
    point = F.struct("kp_id", "x", "y")
    distinct = descriptors.groupBy("doc_id", "bits").agg(
        F.count("*").alias("copies"), F.min(point).alias("p1"), F.max(point).alias("p2"))
    sizes = distinct.groupBy("doc_id").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    tiled = (
        distinct.where(F.col("bits").isNotNull()).join(sizes, "doc_id")
        .withColumn("tile", F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int"))
        .groupBy("doc_id", "tile", "tiles")
        .agg(F.collect_list(F.struct("bits", F.col("copies").cast("int").alias("copies"))).alias("points"))
    )
    # Each tile is sent to every tile of its document under that tile's number. The tiles are few bytes and much work: the number of
    # parts is given, or they would be joined into one task.
    parts = int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = tiled.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
                        F.col("points.bits").alias("others"), F.col("points.copies").alias("copies")).repartition(parts, "doc_id", "tile")
    met = tiled.select("doc_id", "tile", F.col("points.bits").alias("points")).repartition(parts, "doc_id", "tile").join(
        sent, ["doc_id", "tile"]).sortWithinPartitions("doc_id", "tile")
    # The nearest two are found tile by tile; only they leave the task. A tile whose meetings were split over tasks has several rows a point.
    kind = descriptors.schema["doc_id"].dataType.simpleString()
    found = met.mapInArrow(_two_nearest, f"doc_id {kind}, bits array<bigint>, d1 bigint, b1 array<bigint>, d2 bigint").groupBy("doc_id", "bits").agg(
        F.array_sort(F.collect_list(F.struct("d1", "b1"))).alias("n"), F.min("d2").alias("d2"))
    first, second = F.get("n", F.lit(0)), F.get("n", F.lit(1))
    near = found.select("doc_id", "bits", first["d1"].cast("int").alias("d1"), first["b1"].alias("b1"),
                        F.least("d2", second["d1"]).cast("int").alias("d2"))
    own = distinct.join(near, ["doc_id", "bits"])
    # Two copies: each other's nearest at distance 0; the next one is the nearest other bits.
    twins = own.where((F.col("copies") == 2) & (F.col("d1") < FAR))
    twin_rows = twins.select(
        "doc_id", F.inline(F.array(F.struct(F.col("p1").alias("a"), F.col("p2").alias("b")),
                                   F.struct(F.col("p2").alias("a"), F.col("p1").alias("b")))),
        F.lit(0).alias("d1"), F.col("d1").alias("d2"))
    # Single points: a strictly nearer first neighbour is unique, so its row gives the place.
    places = distinct.where(F.col("copies") == 1).select(
        "doc_id", F.col("bits").alias("b1"), F.col("p1").alias("b"))
    singles = (
        own.where((F.col("copies") == 1) & (F.col("d2") < FAR) & (F.col("d1") < F.col("d2")))
        .join(places, ["doc_id", "b1"])
        .select("doc_id", F.col("p1").alias("a"), "b", "d1", "d2"))
    return twin_rows.unionByName(singles)


def copy_move_pairs(descriptors: DataFrame, max_hamming: int = MAX_HAMMING, ratio: float = MAX_RATIO,
                    min_dist: float = MIN_DISTANCE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs that pass the distance, ratio and place tests. One row per query point."""
    apart = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return (
        nearest_pairs(descriptors, tile_rows)
        .where((F.col("d1") <= max_hamming) & (F.col("d2") > 0) & (F.col("d1") / F.col("d2") <= ratio))
        .where(apart > min_dist)
        .select("doc_id", F.col("a.kp_id").alias("kp_id"), F.col("b.kp_id").alias("nearest_kp"), "d1", "d2")
    )


def copy_move_verdict(descriptors: DataFrame, min_pairs: int = MIN_PAIRS, **limits) -> DataFrame:
    """Per document with descriptors: number of suspicious pairs, and the verdict."""
    pairs = copy_move_pairs(descriptors, **limits).groupBy("doc_id").agg(F.count("*").alias("pairs"))
    count = F.coalesce("pairs", F.lit(0))
    return descriptors.select("doc_id").distinct().join(pairs, "doc_id", "left").select(
        "doc_id", count.alias("pairs"),
        F.when(count >= min_pairs, "detected").otherwise("not_detected").alias("duplicate_regions"))
