"""Operators on boxes, blocks and key points against brute force in plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docproof.operators import copymove, ocr, similar, stats

TOKENS = "doc_id long, page_no int, line int, word int, text string, confidence double, x0 int, y0 int, x1 int, y1 int"


def walk(tokens):
    """Plain statement of the line rule: returns the line number of each token."""
    level, line, out = None, 0, {}
    for t in sorted(tokens, key=lambda t: (t[7], t[6], t[2], t[3])):
        if level is not None and abs(t[7] - level) <= 12:
            level = (level + t[7]) / 2
        else:
            line, level = line + 1, float(t[7])
        out[(t[2], t[3])] = line
    return out


def test_assign_lines_equals_the_walk(spark):
    rng, tokens = random.Random(3), []
    for page in range(12):
        spread = rng.choice([40, 120, 400, 3000])
        tokens += [(page % 3, page, i, 0, f"w{i}", 0.5, rng.randrange(500), rng.randrange(spread), 9, 9) for i in range(rng.randrange(1, 90))]
    # one page with most tokens on few rows, as a dense scan has
    tokens += [(9, 0, i, 0, "w", 0.5, i, rng.choice([0, 10, 12, 21, 33, 60]), 9, 9) for i in range(2000)]
    got = ocr.assign_lines(spark.createDataFrame(tokens, TOKENS)).collect()
    assert len(got) == len(tokens)
    for key in {(t[0], t[1]) for t in tokens}:
        want = walk([t for t in tokens if (t[0], t[1]) == key])
        assert {(r.line, r.word): r.line_no for r in got if (r.doc_id, r.page_no) == key} == want


def test_a_page_of_many_rows_is_walked_in_linear_time(spark):
    """50,000 distinct y without a gap wider than the band: one island, and a second page with a gap after every third y."""
    rng, y, pages = random.Random(4), 0, []
    for i in range(50_000):
        y += rng.choice([1, 2, 3, 5, 9, 12])
        pages.append((1, 1, i, 0, "w", 0.5, 0, y, 9, 9))
    pages += [(1, 2, i, 0, "w", 0.5, 0, 20 * (i // 3) + i % 3, 9, 9) for i in range(3000)]
    tokens = spark.createDataFrame(pages, TOKENS)
    start = time.time()
    got = ocr.assign_lines(tokens).select("page_no", "line", "line_no").collect()
    taken = time.time() - start
    for page in (1, 2):
        want = walk([t for t in pages if t[1] == page])
        assert {(r.line, 0): r.line_no for r in got if r.page_no == page} == want
    assert taken < 60


def test_merge_tokens(spark):
    rows = [(1, 1, 0, 1, "b", 0.5, 10, 2, 20, 9), (1, 1, 0, 0, "a", 1.0, 0, 2, 8, 12), (1, 1, 0, 2, "c", 0.3, 30, 0, 40, 8)]
    r = ocr.merge_tokens(spark.createDataFrame(rows, TOKENS).withColumn("line_no", F.lit(1))).first()
    assert (r.text, r.x0, r.y0, r.x1, r.y1, r.tokens) == ("c a b", 0, 0, 40, 12, 3)
    assert r.confidence == (0.3 + 1.0 + 0.5) / 3


def test_pages_to_document_means_of_page_means(spark):
    boxes = spark.createDataFrame([(1, 2, 0, "c", 1.0), (1, 1, 1, "b", 0.2), (1, 1, 0, "a", 0.4), (2, 1, 0, "z", 0.7)],
                                  "doc_id long, page_no int, ord int, text string, confidence double")
    got = {r.doc_id: r for r in ocr.pages_to_document(boxes).collect()}
    assert (got[1].text, got[1].confidence, got[1].page_count) == ("a\nb\nc", ((0.4 + 0.2) / 2 + 1.0) / 2, 2)
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)], "doc_id long, page_no int")
    got = {r.doc_id: r for r in ocr.pages_to_document(boxes, pages).collect()}
    assert got[1].confidence == ((0.4 + 0.2) / 2 + 1.0 + 0.0) / 3 and got[1].text == "a\nb\nc"
    assert (got[3].confidence, got[3].page_count, got[3].text) == (0.0, 1, "")


def grams(s):
    return {s[i:i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else {s}


def alike(a, b):
    return bool(a and b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.75


def norm(s):
    return " ".join(s.split()).lower()


def random_lines(rng, pages, base):
    rows = []
    for page in range(pages):
        for i in range(rng.randrange(1, 25)):
            text = rng.choice(base)
            at = rng.randrange(len(text))
            if rng.random() < 0.6:
                text = text[:at] + rng.choice("abc xyz") + text[at + 1:]
            if rng.random() < 0.1:
                text = rng.choice(["", "ab", "AB", "  "])
            rows.append((page % 2, page, i, text, rng.choice([0.1, 0.25, 0.3, 0.5, 0.9])))
    return rows


LINES = "doc_id long, page_no int, ord int, text string, confidence double"


@pytest.mark.parametrize("small", [False, True])
def test_fusing_equals_brute_force(spark, monkeypatch, small):
    """Once as it is, once with waves, walks and common trigrams so small that pages of 24 lines go through all of them."""
    if small:
        monkeypatch.setattr(similar, "COMMON", 3)
        monkeypatch.setattr(similar, "FIRST_WAVE", 2)
        monkeypatch.setattr(similar, "WAVE_GROWTH", 3)
        monkeypatch.setattr(ocr, "WALK", 2)
    rng = random.Random(5)
    base = ["permanent account number card", "permanent account numbers", "name of the holder here", "Total Marks five hundred", "abcdef"]
    first, second = random_lines(rng, 6, base), random_lines(rng, 6, base)
    fused_df = ocr.fuse_ocr(spark.createDataFrame(first, LINES), spark.createDataFrame(second, LINES))
    fused = [tuple(r) for r in fused_df.collect()]
    want = []
    for d, p, o, text, conf in first:
        best = (d, p, o, text, conf, "primary")
        for _, _, _, t, c in sorted((s for s in second if s[:2] == (d, p)), key=lambda s: s[2]):
            if alike(norm(text), norm(t)) and c > conf:
                best = (d, p, o, t, c, "fused")
                break
        want.append(best)
    assert sorted(fused) == sorted(want)

    got = [tuple(r) for r in ocr.secondary_only_lines(fused_df, spark.createDataFrame(second, LINES)).collect()]
    kept = list(want)
    for d, p, o, t, c in sorted(second, key=lambda s: (s[0], s[1], s[2])):
        if norm(t) and not any(alike(norm(t), norm(k[3])) for k in kept if k[:2] == (d, p)):
            kept.append((d, p, o, t, c, "secondary_only"))
    assert sorted(got) == sorted(k for k in kept if k[4] >= 0.3 and k[3])


def jobs_of(spark, run):
    """What run() returns, and how many jobs it started."""
    tracker, group = spark.sparkContext.statusTracker(), f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def letters(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_lines_of_tokens_send_a_row_for_each_y(spark):
    """The lines are those of the tokens one by one, with ties, empty pages' rows and repeated words; a y of a page is one row on its way."""
    rng = random.Random(21)
    rows = [(d, p, n, w, rng.choice(["a", "b", ""]), rng.choice([0.25, 0.5, None]), rng.randrange(5), y, 9, y + 9)
            for d in range(3) for p in (1, 2) for n in range(60) for w, y in [(rng.randrange(3), rng.randrange(150))]]
    tokens = spark.createDataFrame(rows, "doc_id long, page_no int, line int, word int, text string, confidence double, x0 int, y0 int, x1 int, y1 int")
    got = ocr.lines_of_tokens(tokens)
    assert sorted(got.collect()) == sorted(ocr.merge_tokens(ocr.assign_lines(tokens)).select(got.columns).collect())
    # No token's own columns enter an exchange: each carries lists or aggregates.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "line_no" in x and "word" in x]
    assert plan.count("collect_list(struct(x0") + plan.count("collect_list(named_struct(x0") >= 2


def exchanges_for_keys(df):
    """Exchanges that an operator needs for its own keys, in the plan before it is run; the dealing of its input is none of them."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("ENSURE_REQUIREMENTS")


def test_tokens_dealt_by_document_are_not_sent_again(spark):
    """The same lines, without another exchange, also where keys are absent."""
    rng = random.Random(22)
    some = lambda *values: rng.choice([None, *values])
    rows = [(some(1, 2, 3), some(1, 2), n, 0, some("a", "b"), some(0.25, 0.5), some(0, 5), some(*range(0, 90, 7)), some(9), some(20)) for n in range(600)]
    tokens = spark.createDataFrame(rows, TOKENS)
    dealt = ocr.lines_of_tokens(tokens.repartition(8, "doc_id"))
    assert exchanges_for_keys(dealt) == 0
    in_order = lambda df: sorted(map(repr, df.collect()))
    want = ocr.merge_tokens(ocr.assign_lines(tokens))
    assert in_order(dealt) == in_order(want.select(dealt.columns)) == in_order(ocr.lines_of_tokens(tokens))


def odd_lines(seed, spark):
    """Lines of which any cell may be absent, with copies, and pages of more lines than others."""
    rng = random.Random(seed)
    texts = ["permanent account number", "permanent account numbers", "Permanent  account number", "income tax department", "income tax departmenT x", "ab", "", " "]
    some = lambda *values: rng.choice([None, *values, *values])
    return spark.createDataFrame([(some(1, 2, 3), some(1, 2), n, some(*texts), some(0.0, 0.25, 0.5, float("nan"))) for n in range(160)] + [
        (4, 1, n, rng.choice(texts) + rng.choice("abcdefgh"), rng.choice([0.25, 0.5])) for n in range(90)], LINES)


def test_lines_dealt_by_document_meet_where_they_are(spark, monkeypatch):
    """The same rows as by the index and from lines dealt anyhow, with one exchange for each side at most."""
    first, second = odd_lines(31, spark), odd_lines(32, spark)
    dealt = ocr.fuse_ocr(first.repartition(8, "doc_id"), second.repartition(8, "doc_id"))
    assert exchanges_for_keys(dealt) == 0
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(dealt) == rows(ocr.fuse_ocr(first, second))
    assert {r.engine for r in dealt.collect()} == {"primary", "fused"}
    monkeypatch.setattr(similar, "FIRST_WAVE", 3)
    mixed = ocr.fuse_ocr(first, second)
    assert "ENSURE_REQUIREMENTS" in str(mixed._jdf.queryExecution().executedPlan()) and rows(dealt) == rows(mixed)


def test_secondary_lines_dealt_by_document_are_decided_where_they_are(spark, monkeypatch):
    """The same rows as by the index, in rounds and from lines dealt anyhow, without another exchange."""
    first, second = odd_lines(33, spark).withColumn("engine", F.lit("primary")).cache(), odd_lines(34, spark).cache()
    dealt = ocr.secondary_only_lines(first.repartition(8, "doc_id"), second.where("doc_id < 4").repartition(8, "doc_id"))
    assert exchanges_for_keys(dealt) == 0
    rows = lambda df: sorted(map(repr, df.collect()))
    assert {r.engine for r in dealt.collect()} == {"primary", "secondary_only"}
    assert rows(dealt) == rows(ocr.secondary_only_lines(first, second.where("doc_id < 4")))
    whole = rows(ocr.secondary_only_lines(first, second))
    monkeypatch.setattr(similar, "FIRST_WAVE", 3)
    monkeypatch.setattr(ocr, "WALK", 4)
    assert rows(ocr.secondary_only_lines(first, second)) == whole


def test_pages_of_few_lines_meet_once(spark):
    """Each side's texts are sent once, and no trigram is."""
    rows = [(d, 1, i, letters(100 * d + i // 2, 40) + "x" * (i % 2), 0.5) for d in range(5) for i in range(20)]
    side = lambda more: spark.createDataFrame([(d, p, 20 * d + i, text, *more(i)) for d, p, i, text, _ in rows],
                                              "doc_id long, page_no int, id long, norm string, " + ("above double" if len(more(0)) == 1 else "rank int, value double"))
    found = similar.first_alike(side(lambda i: (0.0,)), side(lambda i: (i, 0.1 if i % 2 else 0.0)), 0.75)
    assert {(r.id, r["rank"]) for r in found.collect()} == {(20 * d + i, i | 1) for d in range(5) for i in range(20)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") <= 2


def test_a_page_of_near_equal_lines(spark):
    """5,000 lines of one page, each other alike: the first sure one wins for each, and one second line at most is left."""
    base = letters(1, 200)
    near = lambda i, extra: f"{base[:40]}{extra}{i:05d}{base[40:]}"
    first = [(1, 1, i, near(i, "p"), 0.5) for i in range(5000)]
    second = [(1, 1, i, near(i, "s"), 0.4 if i < 7 else 0.9) for i in range(5000)]
    fused = ocr.fuse_ocr(spark.createDataFrame(first, LINES), spark.createDataFrame(second, LINES)).collect()
    assert len(fused) == 5000 and {r.text for r in fused} == {near(7, "s")}
    other = [(1, 1, 0, letters(2, 60), 0.5)]
    (got, jobs) = jobs_of(spark, lambda: ocr.secondary_only_lines(
        spark.createDataFrame(other, LINES).withColumn("engine", F.lit("primary")), spark.createDataFrame(second, LINES)).collect())
    assert {(r.ord, r.engine) for r in got} == {(0, "primary"), (0, "secondary_only")}
    assert jobs < 150


def test_a_chain_of_near_twins_and_a_page_of_unlike_lines(spark, monkeypatch):
    """Each line of the chain is like its neighbours only, so every other one stays; 3,000 unlike lines all stay."""
    tape = letters(3, 4000)
    chain = [(1, 1, i, tape[10 * i:10 * i + 100], 0.9) for i in range(200)]
    assert alike(chain[0][3], chain[1][3]) and not alike(chain[0][3], chain[2][3])
    unlike = [(1, 2, i, letters(1000 + i, 40), 0.9) for i in range(3000)]
    none = spark.createDataFrame([], LINES).withColumn("engine", F.lit("primary"))
    got, jobs = jobs_of(spark, lambda: ocr.secondary_only_lines(none, spark.createDataFrame(chain + unlike, LINES)).collect())
    assert sorted(r.ord for r in got if r.page_no == 1) == list(range(0, 200, 2))
    assert len([r for r in got if r.page_no == 2]) == 3000
    assert jobs < 250
    monkeypatch.setattr(ocr, "WALK", 50)  # the chain then takes several rounds
    got = ocr.secondary_only_lines(none, spark.createDataFrame(chain, LINES)).collect()
    assert sorted(r.ord for r in got) == list(range(0, 200, 2))


def test_label_regions_last_box_wins(spark):
    rows = [(1, 1, 0, "Name: A", 0.5), (1, 1, 1, "Roll name year", 0.5), (1, 2, 0, "NAME: B", 0.6), (1, 1, 2, "other", 0.5), (2, 1, 0, "Year", 0.1)]
    got = {(r.doc_id, r.region): r.text for r in ocr.label_regions(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {(1, "student_name"): "NAME: B", (1, "roll_number"): "Roll name year", (2, "year"): "Year"}


def words(bits):
    """256 bits as four signed words."""
    return [(w ^ 1 << 63) - (1 << 63) for w in (bits >> 64 * k & (1 << 64) - 1 for k in range(4))]


@pytest.mark.parametrize("tile_rows", [512, 7])
def test_copy_move_equals_brute_force(spark, tile_rows):
    rng, points = random.Random(11), []
    for doc in range(3):
        bits = [rng.getrandbits(256) for _ in range(40)]
        bits += [bits[0], bits[1], bits[1], bits[2] ^ 1, bits[3] ^ 7, bits[4] ^ 1, bits[4] ^ 1, bits[5] ^ (1 << 255), bits[6] ^ (7 << 120), bits[6] ^ (3 << 60)]
        points += [(doc, i, rng.randrange(400), rng.randrange(400), b) for i, b in enumerate(bits)]
    df = spark.createDataFrame([(*p[:4], words(p[4])) for p in points], "doc_id long, kp_id long, x int, y int, bits array<long>")
    got = sorted(tuple(r) for r in copymove.copy_move_pairs(df, tile_rows=tile_rows).collect())
    want = []
    for d, k, x, y, b in points:
        others = sorted((bin(b ^ q[4]).count("1"), q[1], q) for q in points if q[0] == d and q[1] != k)
        (d1, other, q), (d2, _, _) = others[0], others[1]
        if d1 <= 40 and d2 and d1 / d2 <= 0.75 and ((x - q[2]) ** 2 + (y - q[3]) ** 2) ** 0.5 > 50:
            want.append((d, k, other, d1, d2))
    assert got == sorted(want) and len(got) > 5


def test_copy_move_meets_tiles_over_all_tasks(spark):
    """Tiles are few bytes and much work: their exchanges keep the given number of parts, and they meet once."""
    rng = random.Random(5)
    bits = [rng.getrandbits(256) for _ in range(1500)]
    bits += [b ^ 1 << rng.randrange(256) for b in bits[:50]]
    df = spark.createDataFrame([(7, i, i % 1000, i * 7 % 700, words(b)) for i, b in enumerate(bits)], "doc_id long, kp_id long, x int, y int, bits array<long>")
    pairs = copymove.nearest_pairs(df)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 0
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    got = {r.a.kp_id: (r.b.kp_id, r.d1) for r in pairs.collect() if r.d1 <= 40}
    assert got == {**{i: (1500 + i, 1) for i in range(50)}, **{1500 + i: (i, 1) for i in range(50)}}


def test_copy_move_verdict_counts(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, words(5)), (1, 2, 300, 300, words(5)), (1, 3, 9, 9, words(2 ** 200 - 1)), (2, 1, 0, 0, words(1))],
                               "doc_id long, kp_id long, x int, y int, bits array<long>")
    got = {r.doc_id: (r.pairs, r.duplicate_regions) for r in copymove.copy_move_verdict(df, min_pairs=2).collect()}
    assert got == {1: (2, "detected"), 2: (0, "not_detected")}


def test_dispersion_and_blocks(spark):
    rows = [(1, i, 0, i, v, 0.5) for i, v in enumerate([1.0] * 9 + [10.0])] + [(2, i, 0, i, 1.0, 0.5) for i in range(4)] + [(1, 99, 0, 99, 500.0, 0.04)]
    blocks = spark.createDataFrame(rows, "doc_id int, x int, y int, block_id int, hf_ratio double, text_density double")
    kept = stats.text_block_filter(blocks)
    got = {r.doc_id: r for r in stats.dispersion_profile(kept, "doc_id", "hf_ratio").collect()}
    assert (got[1].n, got[1].outliers, got[1].enough) == (10, 1, True)
    assert (got[2].n, got[2].outliers, got[2].enough, got[2].cv) == (4, 0, False, None)
    top = stats.top_blocks(kept, 2).where("doc_id = 1").orderBy("rank").collect()
    assert [r.hf_ratio for r in top] == [10.0, 1.0] and top[1].x == 0


def test_blockiness_and_noise(spark):
    rows = [(1, 0, v) for v in [0.0] * 9 + [9.0]] + [(2, 0, v) for v in (0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id int, cell int, blockiness double")
    assert {r.doc_id: r.compression_inconsistency for r in stats.blockiness_flag(df).collect()} == {1: True, 2: False}
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 2.0), (1, 1, 2.0), (2, 0, 5.0)], "doc_id int, cell int, v double")
    got = {r.doc_id: r.uniformity for r in stats.noise_uniformity(cells, "doc_id", "cell", "v").collect()}
    assert got[1] == pytest.approx(0.5 / (0.5 ** 0.5)) and got[2] is None
