"""Operators that compare documents with each other, and the pipeline, held against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from awkward import AWKWARD, documents, key, prose
from llm import buckets, graph, language_model, near_duplicates, quality, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    """Many buckets and segments even for small tables."""
    monkeypatch.setattr(buckets.bucketed, "__defaults__", (20000,))
    monkeypatch.setattr(substrings.estimate, "__defaults__", (1 << 14,))


def words(text):
    return WORD.findall(text or "")


def copies(seed=20, groups=12):
    """Groups of exact and near copies around one text each, with a chain whose ends are not linked."""
    rng, rows, i = random.Random(seed), [], 100
    for g in range(groups):
        base = prose(900 + g, rng.randint(6, 120)).split()
        for _ in range(rng.randint(2, 8)):
            some = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                some[rng.randrange(len(some))] = rng.choice(["swapped", "other", "x"])
            rows.append((i, " ".join(some)))
            i += rng.randint(1, 3)
    chain = prose(77, 100).split()
    for k in range(0, 16, 2):
        rows.append((i + k, " ".join(["new"] * k + chain[k:]).upper()))
    rng.shuffle(rows)
    return rows


# --- near duplicates ---------------------------------------------------------------------------------------------

def plain_components(rows, size):
    sets = {}
    for i, t in rows:
        w = [x.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in words(t)]
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), None if i is None else top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_all_pairs(spark, size):
    rows = copies() + AWKWARD
    got = near_duplicates.near_duplicates(documents(spark, rows), size).collect()
    want = plain_components(rows, size)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *x) for i, x in want.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """More copies than a node takes, around the threshold, so that families and blocks are at work."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 20)
    monkeypatch.setattr(near_duplicates, "SALT", 50)
    rng = random.Random(21)
    base, rows = prose(5, 120).split(), []
    for i in range(260):
        some = list(base)
        for _ in range(rng.randint(0, 7)):
            some[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(some)))
    got = near_duplicates.near_duplicates(documents(spark, rows), 4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *x) for i, x in plain_components(rows, 4).items()}


def test_near_duplicates_of_empty_tables(spark):
    docs = documents(spark)
    assert near_duplicates.near_duplicates(docs.where("false")).count() == 0
    assert near_duplicates.near_duplicates(docs.where("doc_id = 2")).collect()[0][:3] == (2, 0, 2)
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 7, 10, 11, 12, None], key=str)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200, 1) if i % 50 != 49] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (1059, 3000)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    for i in range(200):
        assert got[i] == i // 50 * 50
    assert {got[1000 + k] for k in range(60)} == {1000} == {got[3000]}


# --- substrings --------------------------------------------------------------------------------------------------

def plain_removal(rows, window):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    seen, out = set(), []
    for i, t in order:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                gone.update(range(k, k + window))
            seen.add(x)
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def test_repeated_passages_go(spark):
    rng = random.Random(22)
    shared = [prose(300 + k, 60) for k in range(4)]
    rows = list(AWKWARD)
    for i in range(50, 110):
        parts = [prose(i, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), prose(i + 1000, rng.randint(0, 30))]
        rows.append((i, "\n".join(parts)))
    got = sorted(map(tuple, substrings.remove_repeats(documents(spark, rows)).collect()), key=key)
    assert got == sorted(plain_removal(rows, 20), key=key)
    assert substrings.remove_repeats(documents(spark).where("false")).count() == 0


def test_the_sketch_never_counts_too_low(spark):
    """With a sketch of few cells nearly all windows pass; the result is the same."""
    rows = [(i, prose(i % 7, 50)) for i in range(30)]
    whole = sorted(map(tuple, substrings.remove_repeats(documents(spark, rows), 5).collect()), key=key)
    assert whole == sorted(plain_removal(rows, 5), key=key)


def test_packed_numbers_come_back():
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        for top in (1, 2**8, 2**33, 2**63):
            x = rng.integers(0, top, n, np.uint64)
            assert (buckets.unpack(buckets.pack(x)) == x).all()
            assert (buckets.unpack_sorted(buckets.pack_sorted(np.sort(x))) == np.sort(x)).all()


# --- language model ----------------------------------------------------------------------------------------------

def plain_scores(rows, order):
    texts = [words(t) for _, t in rows]
    own = [Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)) for w in texts]
    whole = sum(own, Counter())
    total = sum(map(len, texts))
    out = []
    for (i, _), w, mine in zip(rows, texts, own, strict=True):
        def count(g):
            return whole[g] - mine[g]

        def score(before, x):
            if not before:
                return (count((x,)) or 0.4) / (total - len(w) + 1)
            if count((*before, x)):
                return count((*before, x)) / count(before)
            return 0.4 * score(before[1:], x)

        logs = [math.log(score(tuple(w[max(0, k - order + 1):k]), x)) for k, x in enumerate(w)]
        out.append((i, len(w), sum(logs), sum(logs) / len(w) if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_plain_model(spark, order):
    rows = [r for r in AWKWARD if r[0] != 6] + [(i, prose(i % 40, 40) + " tail") for i in range(60, 130)]
    got = sorted(map(tuple, language_model.score(documents(spark, rows), order).collect()), key=lambda r: key(r[:2]) + (r[2],))
    want = sorted(plain_scores(rows, order), key=lambda r: key(r[:2]) + (r[2],))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-6)
        assert g[3] == (None if w[3] is None else pytest.approx(w[3], abs=1e-9))
    assert language_model.score(documents(spark).where("false"), order).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, tmp_path):
    items = [(i, prose(2000 + i, 40)) for i in range(5)]
    rows = copies() + AWKWARD + [(500 + i, f"{prose(600 + i, 60)} {t} {prose(700 + i, 60)}") for i, t in items]
    rows += [(600 + i, prose(800 + i, 50) + f' password = "{"%032x" % (i * 7**30)}"') for i in range(5)]
    spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, at = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        at[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    good = [(i, t) for i, t in rows if quality_keeps(t)]
    assert sorted((r.doc_id, r.text) for r in at["quality_rules"] if r.doc_id is not None) == sorted(x for x in good if x[0] is not None)
    first = plain_components(good, 5)
    alone = [(i, t) for i, t in good if i is None or first[i][1] == i]
    assert Counter(r.doc_id for r in at["near_dedup"]) == Counter(i for i, _ in alone)
    clean = [(i, t) for i, t in alone if not (i is not None and 500 <= i < 505)]
    assert Counter(r.doc_id for r in at["decontamination"]) == Counter(i for i, _ in clean)
    assert Counter(r.doc_id for r in at["secret_scan"]) == Counter(i for i, _ in clean)
    assert all("[assign]" in r.text and "password" not in r.text for r in at["secret_scan"] if r.doc_id and 600 <= r.doc_id < 605)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.groupBy("doc_id").agg(F.sum("length")).count() == len({i for i, _ in clean})
    assert sum(r.length for r in at["packing"]) == whole.agg(F.sum("length")).first()[0]


def quality_keeps(text):
    import pyarrow as pa
    return bool(quality.measure(pa.array([text], pa.string()), quality.Bands())["kept"][0])


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
