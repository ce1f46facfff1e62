"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``SHINGLE`` lower-cased words (as 64-bit hashes). Equal sets collapse to the
class of their smallest doc_id; the join runs over one set per class, each with a sketch of ``COORDINATES`` minwise values.

Join. Each of ``TREES`` trees starts with all sets in one node. A node picks a coordinate by its own number, and in
a quarter of the cases a second one, and hands each set down to the child of its minwise value there: at similarity 0.8 a pair
keeps 1.25 * 0.8 = 1 common child on average. Nodes above ``FIRST_DEPTH`` only branch. Below, a node with at most ``NODE`` sets is
a leaf; a larger one branches on, to ``LAST_DEPTH`` at most. All trees draw from the same coordinates, so they are not independent:
averaged over the sketch (binomial), a pair at similarity 0.8 is missed with a chance of 4.2e-4 where its nodes branch to depth 4,
1.0e-4 to depth 3 and 0.5e-4 at depth 2, the cut at ``LEAST_EQUAL`` included (4.3e-5). Most are linked through other copies.

Links are confirmed on the full sets, in two rounds. First every node compares its sets with one pivot, the one that comes first in
an order common to all nodes, and each set's most promising pivot is confirmed: large groups of copies become one component at
the cost of one link per set. Then nodes whose sets are all in one component are done. The other leaves are compared
exhaustively, across components, by sketches, and what may be similar is confirmed. Sets that were together in a last node
with several components form a family; those outside the family's largest component are compared with all of it, in
blocks, on the full sets. So no pair is dropped; what is not compared is connected already.

Defined results: a null or empty text, or one without words, has an empty set and is its own component; with fewer words than a
shingle the whole sequence is the one shingle. Rows with one doc_id but different texts are judged row by row. A null doc_id gets the
smallest id of its equal sets, or null, and is kept only then. Only doc_id (a long) and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.buckets import pack_sorted, unpack_sorted
from llm.graph import components, stored
from llm.words import Words, combine, mix, slices, table

SHINGLE = 5
PERCENT = 80
COORDINATES = 64
TREES = 12
FIRST_DEPTH = 2
LAST_DEPTH = 4
NODE = 64
#: Sketches that agree on fewer coordinates are not compared further: four standard errors below 0.8.
LEAST_EQUAL = int(COORDINATES * (PERCENT / 100 - 4 * (0.16 / COORDINATES) ** 0.5))
BLOCK = 200
SALT = 2000
SET_BITS = 48

SKETCHED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sketch", pa.binary())])


def shingles(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and hash."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    at, keys = words.runs(size, hashes)
    rows, all_keys = [words.row[at]], [keys]
    for n in range(1, size):
        short = np.flatnonzero(words.count == n)
        rows.append(short)
        all_keys.append(mix(combine(hashes, n)[words.first[short]], n) if len(short) else np.zeros(0, np.uint64))
    row, key = np.concatenate(rows), np.concatenate(all_keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    once = np.ones(len(key), bool)
    once[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[once], key[once]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that stand for the set) and the sketch of every row."""
    draw = np.random.default_rng(11)
    turn = draw.integers(0, 2**64, COORDINATES, np.uint64)
    scale = draw.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, key = shingles(part.column("text"), size)
                n = np.bincount(row, minlength=part.num_rows)
                some = np.flatnonzero(n)
                low = np.full((part.num_rows, COORDINATES), 65535, np.uint16)
                ids = np.zeros((2, part.num_rows), np.uint64)
                if len(some):
                    cut = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    for k in range(COORDINATES):
                        low[some, k] = (mix(np.minimum.reduceat((key ^ turn[k]) * scale[k], cut), k) & np.uint64(65535)).astype(np.uint16)
                    for k in range(2):
                        ids[k, some] = np.add.reduceat(mix(key, 50 + k), cut)
                raw = low.tobytes()
                yield table(SKETCHED, part.column("doc_id"), n, ids[0].view(np.int64), ids[1].view(np.int64),
                            [raw[i:i + 2 * COORDINATES] for i in range(0, len(raw), 2 * COORDINATES)])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def branch(node: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, row of the input) of every set in a node; the node alone decides on which coordinates."""
    every = np.arange(len(node))
    first = (mix(node, 1) % np.uint64(COORDINATES)).astype(np.int64)
    second = (mix(node, 2) % np.uint64(COORDINATES)).astype(np.int64)
    also = np.flatnonzero((mix(node, 3) % np.uint64(4) == 0) & (second != first))
    child = lambda rows, at: mix(node[rows] ^ (at.astype(np.uint64) << np.uint64(16) | values[rows, at].astype(np.uint64)), 4)
    return np.concatenate([child(every, first), child(also, second[also])]), np.concatenate([every, also])


_NODES = pa.schema([("node", pa.int64()), ("rep", pa.int64())])


def descend(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """Children (node, rep) of rows(node, rep, sketch); with a depth, of rows(rep, sketch) that deep in every tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                values, rep = matrix(part.column("sketch")), part.column("rep").to_numpy()
                starts = [part.column("node").to_numpy().view(np.uint64)] if depth is None else [
                    np.full(len(rep), mix(np.array([t], np.uint64), 99)[0]) for t in range(TREES)]
                for node in starts:
                    at = np.arange(len(rep))
                    for _ in range(depth or 1):
                        node, back = branch(node, values[at])
                        at = at[back]
                    yield table(_NODES, node.view(np.int64), rep[at])

    return rows.mapInArrow(run, "node long, rep long")


_PAIRS = pa.schema([("rep", pa.int64()), ("hub", pa.int64()), ("equal", pa.int32())])
PAIRS = "rep long, hub long, equal int"


def pairs_of(rep: np.ndarray, hub: np.ndarray, equal: np.ndarray) -> pa.RecordBatch:
    keep = (equal >= LEAST_EQUAL) & (rep != hub)
    return table(_PAIRS, rep[keep], hub[keep], equal[keep].astype(np.int32))


def compare_leaves(rows: DataFrame) -> DataFrame:
    """Candidates across components among rows(node, rep, sketch, component) of leaves, read in the order of the nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rep, component = (np.zeros(0, np.int64) for _ in range(3))
        values = np.zeros((0, COORDINATES), np.uint16)

        def pairs(upto: int) -> Iterator[pa.RecordBatch]:
            left = np.arange(upto - 1)
            for step in range(1, upto):
                left = left[left + step < upto]
                left = left[node[left] == node[left + step]]
                if not len(left):
                    return
                apart = left[component[left] != component[left + step]]
                for k in range(0, len(apart), 1 << 15):
                    some = apart[k:k + (1 << 15)]
                    low, high = np.minimum(rep[some], rep[some + step]), np.maximum(rep[some], rep[some + step])
                    yield pairs_of(high, low, (values[some] == values[some + step]).sum(axis=1))

        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(k, 1 << 15)
                node, rep, component = (np.concatenate([x, part.column(c).to_numpy()]) for x, c in (
                    (node, "node"), (rep, "rep"), (component, "component")))
                values = np.concatenate([values, matrix(part.column("sketch"))])
                done = int(np.searchsorted(node, node[-1], "left"))  # the last node may go on
                yield from pairs(done)
                node, rep, component, values = node[done:], rep[done:], component[done:], values[done:]
        yield from pairs(len(node))

    return rows.select("node", "rep", "sketch", "component").repartition("node").sortWithinPartitions("node").mapInArrow(run, PAIRS)


def compare_pivots(rows: DataFrame) -> DataFrame:
    """Candidates between each set of rows(node, rep, sketch) and its node's pivot, the set with the smallest hash."""
    pick = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "sketch")).alias("p"))
    both = rows.join(pick.select("node", F.col("p.rep").alias("pivot"), F.col("p.sketch").alias("of")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (matrix(batch.column("sketch")) == matrix(batch.column("of"))).sum(axis=1)
            yield pairs_of(batch.column("rep").to_numpy(), batch.column("pivot").to_numpy(), equal)

    return both.select("rep", "sketch", "pivot", "of").mapInArrow(run, PAIRS)


def grow_trees(reps: DataFrame) -> DataFrame:
    """(node, leaf, last, rep, sketch) of every node with two sets or more from FIRST_DEPTH on, for reps(rep, sketch): leaves
    are compared exhaustively, larger nodes branch on unless they are the last on their path."""
    found, rows = None, descend(reps, FIRST_DEPTH)
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        rows = stored(rows, "nodes")
        size = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        leaf = F.col("size") <= NODE
        sized = stored(rows.join(size, "node").join(reps, "rep").select(
            "node", leaf.alias("leaf"), (~leaf & F.lit(depth == LAST_DEPTH)).alias("last"), "rep", "sketch"), "sized")
        found = sized if found is None else found.unionAll(sized)
        large = sized.where("not leaf")
        if depth == LAST_DEPTH or large.isEmpty():
            return found
        rows = descend(large.select("node", "rep", "sketch"))


def sets_of(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(rep, n, shingles) for ids(rep): n distinct shingles and their hashes, packed."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, key = shingles(part.column("text"), size)
                key = key >> np.uint64(64 - SET_BITS)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield table(schema, part.column("rep"), np.diff(cut), [
                    pack_sorted(key[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])

    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    # Merged at any size, so that small tables move as large ones do.
    return texts.join(ids.hint("merge"), "rep").select("rep", "text").mapInArrow(run, "rep long, n long, shingles binary")


def linked(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[place] == y).sum())
    return 100 * both >= PERCENT * (n + m - both)


def confirm(rows: DataFrame, first_only: bool) -> DataFrame:
    """Links (a, b) between rows(group, salt, held, rep, n, shingles[, component]) that are held and the others of the group.

    The held ones of a group come first in their partition and stay in memory; the others pass by one at a time. With
    first_only, a held set is compared with sets of other components, until one of that component is linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], set()
        for batch in batches:
            links = []
            for row in batch.to_pylist():
                at = (row["group"], row["salt"])
                if at != now:
                    now, held, done = at, [], set()
                values = unpack_sorted(row["shingles"])
                if row["held"]:
                    held.append((row["rep"], row["n"], values, row["component"]))
                    continue
                for rep, n, other, component in held:
                    if first_only and (component == row["component"] or (rep, row["component"]) in done):
                        continue
                    if rep != row["rep"] and linked(other, n, values, row["n"]):
                        links.append((rep, row["rep"]))
                        done.add((rep, row["component"]))
            yield table(schema, [x for x, _ in links], [x for _, x in links])

    order = ("group", "salt")
    return rows.repartition(*order).sortWithinPartitions(*order, F.desc("held")).mapInArrow(run, "a long, b long")


def confirm_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(hub, rep) that are links, as (a, b)."""
    salt = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col("size") / SALT))).cast("int")
    size = pairs.groupBy("hub").agg(F.count("*").alias("size"))
    other = pairs.join(size, "hub").select(F.col("hub").alias("group"), salt.alias("salt"), F.lit(False).alias("held"), "rep")
    salts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("size") / SALT)).cast("int") - 1))
    held = size.select(F.col("hub").alias("group"), salts.alias("salt"), F.lit(True).alias("held"), F.col("hub").alias("rep"))
    return confirm(other.unionAll(held).join(sets, "rep").withColumn("component", F.lit(0).cast("long")), False)


def label(df: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """df with the component of its key; a key in no link is its own component."""
    return df.join(found.select(F.col("id").alias(key), F.col("component").alias("\0c")), key, "left").withColumn(
        name, F.coalesce("\0c", key)).drop("\0c")


def family_links(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets of one family in different components, for members(family, rep): those outside the family's
    largest component against all members."""
    rows = stored(label(members, found, "rep", "component"), "members")
    count = rows.groupBy("family", "component").agg(F.count("*").alias("n"))
    most = count.groupBy("family").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("size"))
    rows = rows.join(most.where("m.n < size").select("family", F.col("m.component").alias("main"), "size"), "family")
    outside = rows.where(F.col("component") != F.col("main"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("outsiders") / BLOCK)).cast("int")
    per = outside.groupBy("family").agg(F.count("*").alias("outsiders")).select("family", blocks.alias("blocks"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / SALT)).cast("int")
    key = F.xxhash64("family", "block")
    outside = outside.join(per, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = outside.select(key.alias("group"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("held"), "rep", "component")
    others = rows.join(per, "family").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = others.select(key.alias("group"), F.pmod(F.hash("rep"), salts).alias("salt"), F.lit(False).alias("held"), "rep", "component")
    return confirm(others.unionAll(held).join(sets, "rep"), True)


def classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketched rows of docs, (set_a, set_b, n_shingles, rep) of every class, and (id, component) of every class that is
    linked with another."""
    rows = stored(sketches(docs, size), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    reps = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(
        F.min(F.struct("doc_id", "sketch")).alias("m")).select(*key, F.col("m.doc_id").alias("rep"), F.col("m.sketch").alias("sketch")), "reps")
    nodes = grow_trees(reps.select("rep", "sketch"))

    # A surely similar pivot that comes early in the common order, or else the most similar one.
    pivots = compare_pivots(nodes.select("node", "rep", "sketch"))
    sure = F.col("equal") >= int(COORDINATES * 0.9)
    rank = F.struct(~sure, F.when(sure, F.xxhash64("hub")).otherwise(-F.col("equal")), "hub")
    best = stored(pivots.groupBy("rep").agg(F.min_by("hub", rank).alias("hub")), "best")
    links = stored(confirm_pairs(best, sets_of(docs, ends(best), size)), "links")
    found = components(links)

    marked = label(nodes, found, "rep", "component")
    mixed = marked.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    marked = stored(marked.join(mixed.select("node"), "node"), "mixed")
    rest = stored(compare_leaves(marked.where("leaf")).select("rep", "hub").distinct(), "pairs")
    last = marked.where("last").select("node", "rep")
    sets = stored(sets_of(docs, ends(rest).unionAll(last.select("rep")).distinct(), size), "sets")
    more = confirm_pairs(rest, sets)
    if not last.isEmpty():
        tied = last.join(last.groupBy("node").agg(F.min("rep").alias("low")), "node").select(F.col("low").alias("a"), F.col("rep").alias("b"))
        family = components(tied).select(F.col("id").alias("rep"), F.col("component").alias("family"))
        more = more.unionAll(family_links(family, found, sets))
    more = stored(more, "links")
    if not more.isEmpty():
        found = components(links.unionAll(more))
    return rows, reps.select(*key, "rep"), found


def ends(pairs: DataFrame) -> DataFrame:
    """(rep) of both ends of pairs(rep, hub), each once."""
    return pairs.select(F.explode(F.array("rep", "hub")).alias("rep")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, reps, found = classes(docs, size)
    key = ["set_a", "set_b", "n_shingles"]
    # Classes that only null ids hold have no representative and no component.
    some = rows.where("n_shingles > 0").join(label(reps, found, "rep", "component_id"), key, "left").select("doc_id", "n_shingles", "component_id")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionAll(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id stands for its component, with all their columns. Rows that share such an id all stay, as
    do rows without an id."""
    gone = near_duplicates(docs, size).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
