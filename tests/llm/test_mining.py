"""Hard negatives, language and collocations, held against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from awkward import AWKWARD, documents, prose
from llm import collocations, hard_negatives, language_id

# --- hard negatives ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (40, 64, 90), (33, 17, 65), (129, 70, 31), (5, 0, 7), (0, 64, 9)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, d, n = shape
    a, b = rng.integers(-10**6, 10**6, (m, d)), rng.integers(-10**6, 10**6, (n, d))
    assert (hard_negatives.strassen(a, b, leaf=4) == a @ b.T).all()
    wide = rng.integers(-2**62, 2**62, (m, d)), rng.integers(-2**62, 2**62, (n, d))  # sums wrap, and wrap back
    assert (hard_negatives.strassen(*wide, leaf=4) == wide[0] @ wide[1].T).all()


def test_strassen_recurses(monkeypatch):
    """Two levels take 49 products of quarter-sized leaves, not 64."""
    calls = []
    inner = hard_negatives.strassen
    monkeypatch.setattr(hard_negatives, "strassen", lambda a, b, leaf: calls.append(a.shape) or inner(a, b, leaf))
    a, b = np.ones((64, 64), np.int64), np.ones((64, 64), np.int64)
    inner(a, b, 16)
    assert calls.count((16, 16)) == 49 and calls.count((32, 32)) == 7


def plain_negatives(rows, every, n_pos, n_neg):
    usable = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows
              if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in usable if i % every == 0}:
        scored = [(-dot(v, w), j, k) for j, k, w in usable if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:n_pos]:
            inside = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:n_neg]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(inside)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, block int, tile int, anchor string, place string"


def vectors(rows):
    return [(*r, -1, -2, "c", "d") for r in rows]


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 13), (20, 3)])
def test_hard_negatives_equal_a_plain_search(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "PRODUCT", 256)
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(rng.choice([6, 6, 6, 3]))]) for i in range(160)]
    rows += [(1000 + i, 2, [0.5] * 6) for i in range(40)]  # equal vectors: ties
    rows += [rows[3], rows[10], rows[10], (10, 1, [1.0] * 6)]  # repeated rows, of an anchor too
    rows += [(500, None, [1.0] * 6), (501, 1, None), (None, 1, [1.0] * 6), (510, 1, [1.0, None]), (520, 1, [float("nan")]),
             (530, 2, [float("inf"), 1.0]), (540, 3, []), (-10, 1, [1.0, 1.0])]
    got = hard_negatives.mine(spark.createDataFrame(vectors(rows), SCHEMA).repartition(3), 10, 5, 10, *sizes)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10, 5, 10)


def test_hard_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none).count() == 0
    alone = spark.createDataFrame(vectors([(0, 1, [1.0]), (1, 2, [1.0])]), SCHEMA)  # no positive
    assert hard_negatives.mine(alone).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame(vectors([(0, 1, [1e12]), (1, 1, [1e12])]), SCHEMA)).count()


# --- language ----------------------------------------------------------------------------------------------------

TONGUES = {"aa": "ba be bi lo la nu ma".split(), "bb": "ust ert onk ilt arp".split(), "cc": "éna ôpi çula ñaro".split()}


def spoken(lang, seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(TONGUES[lang]) + rng.choice(TONGUES[lang]) for _ in range(n))


def test_gradients_equal_differences():
    """Each kind of parameter against a central difference of the loss."""
    rng = np.random.default_rng(3)
    net = language_id.new_network(["a", "b", "c"], np.zeros(3), seed=4)
    windows = rng.integers(0, 256, (6, language_id.LENGTH)).astype(np.uint8)
    truth = np.array([0, 1, 2, 0, 1, 2])
    _, slopes = language_id.gradients(net, windows, truth)
    for p, g in zip(net.parameters(), slopes):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(12)]:
            if p is net.embedding and at[0] == 0:
                continue
            old = p[at]
            losses = []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                losses.append(language_id.gradients(net, windows, truth)[0])
            p[at] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5


def test_tables_equal_the_network():
    net = language_id.new_network(["a", "b"], np.log([0.5, 0.5]), seed=5)
    windows = np.random.default_rng(6).integers(0, 256, (40, language_id.LENGTH)).astype(np.uint8)
    assert np.abs(language_id.Tables(net).log_chances(windows) - language_id.forward(net, windows)[0]).max() < 1e-4


def test_windows_cover_every_text():
    sizes = [0, 1, 5, 127, 128, 129, 253, 254, 1000]
    row, start, end = language_id.windows_of(np.concatenate([[0], np.cumsum(sizes)]))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for k, n in enumerate(sizes):
        own = sorted(zip(start[row == k], end[row == k]))
        assert bool(own) == (n > 0)
        if own:
            assert own[0][0] == bounds[k] and own[-1][1] == bounds[k + 1]
            assert all(b - a <= language_id.LENGTH for a, b in own)
            assert all(x[1] - y[0] >= max(language_id.WIDTHS) - 1 for x, y in zip(own, own[1:]))


def test_language_of_held_out_texts(spark):
    rows = [(i, spoken(lang := list(TONGUES)[i % 3], i, 3 + i % 60), lang if i % 11 else None) for i in range(600)]
    rows += [(None, spoken("aa", 1, 20), "bb"), (7000, None, "aa"), (7001, "", "aa"), (7002, "12 .. 34", "bb"), (7003, spoken("cc", 5, 30000), "aa"),
             (7004, "b", None), (7004, "b", None)]
    docs = spark.createDataFrame([(*r, "src", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, score int, piece string")
    net = language_id.fit(docs, language_id.Bounds(documents=150))
    got = language_id.predict(docs, net).collect()
    assert len(got) == len(rows)
    truth = {i: list(TONGUES)[i % 3] for i in range(600)}
    held = {r.doc_id for r in docs.where(language_id.held_out(F.col("doc_id"))).select("doc_id").collect()}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in held and r.doc_id in truth]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i][1:] == ("und", 0.0) for i in (7000, 7001, 7002))
    assert by_id[7003].lang_pred == "cc" and by_id[None].lang_pred == "aa"
    assert [r.lang_pred in TONGUES for r in got if r.doc_id == 7004] == [True, True]


def test_language_without_labels(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(docs) is None
    got = language_id.predict(docs, None).collect()
    assert len(got) == len(AWKWARD) and {r[1:] for r in got} == {("und", 0.0)}
    assert language_id.fit(docs.where("false")) is None
    net = language_id.fit(documents(spark), language_id.Bounds(documents=5))
    assert {r.lang_pred for r in language_id.predict(documents(spark), net).collect()} == {"und", "en"}
    assert language_id.predict(docs.where("false"), net).count() == 0


# --- collocations ------------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, top):
    size, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least}
        gone = {p[i:i + m] for p, a in kept.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if kept[p[i:i + m]] <= a}
        scored = []
        for p, a in kept.items():
            if len(p) > 1 and p not in gone:
                score, k = min((1000 * a * size[lang] // (kept[p[:k]] * kept[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), kept[p[:k]], kept[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, size[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def chatter():
    rng = random.Random(8)
    runs = ["Alpha beta  gamma", "alpha\tbeta gamma delta", "north of the river bank", "élan vital", "x", "a a a a a a a", "one, two three"]
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(runs) + rng.choice([" ", ". ", "\n", ", ", " zed "]) + rng.choice(["", "q", "the"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "fr", None]), text))
    return rows + [("en", None), ("en", ""), ("de", " .,;:!?\n\t "), ("fr", "élan vital " * 5000), ("xx", "only this " * 60)] + [("en", rows[0][1])] * 90


@pytest.mark.parametrize("least, top", [(20, 2000), (40, 5), (1, 50)])
def test_phrases_equal_a_plain_count(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations.dealt, "__defaults__", (6000,))
    monkeypatch.setattr(collocations, "SEGMENT_BUCKETS", 1)
    rows = chatter()
    docs = spark.createDataFrame([(i % 7, lang, t, 1, "x", "y", 3) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, lang string, text string, n long, phrase string, bucket string, words int").repartition(4)
    assert sorted(map(tuple, collocations.phrases(docs, least, top).collect())) == plain_phrases(rows, least, top)


def test_phrases_of_the_awkward_and_of_nothing(spark):
    rows = [("en", t) for _, t in AWKWARD] * 3
    docs = spark.createDataFrame([(None, *r) for r in rows], "doc_id long, lang string, text string")
    assert sorted(map(tuple, collocations.phrases(docs, 9).collect())) == plain_phrases(rows, 9, 2000)
    assert collocations.phrases(docs.where("false")).count() == 0


def test_no_frequent_key_is_lost_by_a_summary():
    """Keys around the bound, one very frequent key, many single ones, taken in by small parts and by merged summaries."""
    rng = np.random.default_rng(9)
    stream = np.concatenate([np.repeat(np.arange(1, 300, dtype=np.uint64), rng.integers(1, 60, 299)), np.full(5000, 7, np.uint64),
                             rng.integers(10**6, 10**9, 20000).astype(np.uint64)])
    rng.shuffle(stream)
    true = Counter(stream.tolist())
    for least in (25, 40):
        asked = [np.unique(x, return_counts=True) for x in np.array_split(stream, 60)]
        kept = set(collocations.summarise(asked, len(stream), least).tolist())
        assert {k for k, n in true.items() if n >= least} <= kept and len(kept) <= len(stream) // least + 1
        halves = []
        for part in (asked[:30], asked[30:]):
            halves.append(collocations.MisraGries(len(stream) // least + 1))
            for k, c in part:
                halves[-1].add(k, c)
        halves[0].add(halves[1].keys, halves[1].counts)
        halves[0].taken += halves[1].taken
        assert {k for k, n in true.items() if n >= least} <= set(halves[0].reaching(least).tolist())


def test_scores_beyond_64_bits(spark):
    """The product that is divided passes 64 bits; the quotient is exact."""
    counts = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 10**12 + 7), ("en", 1, "b", 10**12 + 9), ("en", 2, "a b", 10**12 + 3)]
    import llm.collocations as c
    frame = spark.createDataFrame(counts, "lang string, words int, phrase string, n long")
    original, c.frequent = c.frequent, lambda docs, least: frame
    try:
        got = c.phrases(None).collect()
    finally:
        c.frequent = original
    assert got[0].score == 1000 * (10**12 + 3) * 9 * 10**15 // ((10**12 + 7) * (10**12 + 9))


def test_prose_has_collocations(spark):
    rows = [("en", prose(i, 200) + " carry out the plan.") for i in range(130)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    found = {r.phrase for r in collocations.phrases(docs).collect()}
    assert "carry out the plan" in found and "out the" not in found
