"""Which texts of a page are alike: page by page where few are on offer, else a trigram index with a positional prefix filter.

A text is the array of its distinct trigrams by hash. The trigrams of a page have one order in which those that many texts
of the page share come last. Two sets whose Jaccard similarity reaches t share at least ``need`` = t / (1 + t) times their
sizes together, so the first trigram they share in that order stands before the last need - 1 of either set: only such entries meet.

The right side is asked in waves of growing rank, so a left text that finds a partner early is not held against the rest of its page,
and a page of near-equal texts stays linear. No page gathers in one row beyond the first wave.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trigrams
from ..session import checkpoint

PAGE = ["doc_id", "page_no"]
#: A trigram that more texts of a page share comes late in the order of that page.
COMMON = 64
FIRST_WAVE, WAVE_GROWTH = 64, 32


def grams(norm: Column) -> Column:
    """A text as its trigrams' hashes of 64 bits (two trigrams of a pair of lines share one with a chance below 1e-14)."""
    return F.array_sort(F.transform(trigrams(norm), lambda g: F.xxhash64(g)))


def need(a: Column, b: Column, t: float) -> Column:
    """The least overlap of two sets of these sizes with a Jaccard of t; the margin keeps rounding from excluding an equal case."""
    return F.ceil((a + b) * (t / (1 + t)) - 1e-9)


def fits(a: Column, b: Column, t: float) -> Column:
    """Whether sets of these sizes can have a Jaccard of t."""
    return (a >= b * t - 1e-9) & (b >= a * t - 1e-9)


def alike(a: Column, b: Column, t: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared) >= t


def _common_last(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the grams in their page's order. Only pages of more than COMMON texts can have a common gram."""
    both = left.select(*PAGE, "id", F.lit(True).alias("is_left"), "grams").unionByName(
        right.select(*PAGE, "id", F.lit(False).alias("is_left"), "grams"))
    large = both.groupBy(*PAGE).agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON).select(*PAGE)
    long = both.join(large, PAGE, "left_semi").select(*PAGE, "id", "is_left", F.explode("grams").alias("gram"))
    common = long.groupBy(*PAGE, "gram").agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON)
    order = long.join(common, [*PAGE, "gram"], "left").groupBy("is_left", "id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram"))), lambda x: x["gram"]).alias("_grams"))
    side = lambda df, flag: df.join(order.where(F.col("is_left") == flag).select("id", "_grams"), "id", "left").withColumn(
        "grams", F.coalesce("_grams", "grams")).drop("_grams")
    return side(left, True), side(right, False)


def front(grams: Column, t: float) -> Column:
    """The grams in which a text can share its first gram with one that is alike."""
    size = F.size(grams)
    return F.slice(grams, F.lit(1), (size - F.ceil(size * t - 1e-9) + 1).cast("int"))


def _entries(df: DataFrame, side: str, t: float) -> DataFrame:
    """(key, id, size, place) of a text's front."""
    return df.select(*PAGE, F.col("id").alias(f"{side}_id"), F.size("grams").alias(f"{side}_size"),
                     F.posexplode(front(F.col("grams"), t)).alias(f"{side}_place", "gram")).select(
        F.xxhash64(*PAGE, "gram").alias("key"), f"{side}_id", f"{side}_size", f"{side}_place")


def candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Pairs (l_id, r_id) that may be alike, each once; a superset of those that are."""
    rest = F.least(F.col("l_size") - F.col("l_place"), F.col("r_size") - F.col("r_place"))
    return _entries(left, "l", t).join(_entries(right, "r", t), "key").where(
        rest >= need(F.col("l_size"), F.col("r_size"), t)).select("l_id", "r_id").distinct()


def _best_in(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    l = left.select(F.col("id").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in (*PAGE, "grams", "above")])
    r = right.select(F.col("id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in (*PAGE, "grams", "rank", "value")])
    same_page = (F.col("l_doc_id") == F.col("r_doc_id")) & (F.col("l_page_no") == F.col("r_page_no"))  # keys are hashes
    return (
        candidates(left, right, t).join(l, "l_id").join(r, "r_id")
        .where(same_page & (F.col("r_value") > F.col("l_above")) & alike(F.col("l_grams"), F.col("r_grams"), t))
        .groupBy(F.col("l_id").alias("id")).agg(F.min("r_rank").alias("rank")))


def _met_by_page(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """first_alike where no page has more than FIRST_WAVE right texts: a page's right texts pass every left text of it in one row.

    Only the texts are sent, each once. Their trigrams are made behind the exchange and pass a generator, as an expression over an
    ordinary column would make them anew for every pair. Fronts, in the order of the hashes, rule out most pairs before whole sets are compared.
    """
    once = lambda df, name, value: df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
    offers = once(right.groupBy(*PAGE).agg(F.collect_list(F.struct("rank", "value", "norm")).alias("_o")), "_g", F.transform(
        "_o", lambda o: F.struct(o["rank"].alias("rank"), o["value"].alias("value"), grams(o["norm"]).alias("grams"))))
    offers = once(offers, "_offers", F.transform("_g", lambda o: o.withField("front", front(o["grams"], t)))).select(*PAGE, "_offers")
    met = once(left.select("id", *PAGE, "norm", "above").join(offers, PAGE), "grams", grams(F.col("norm")))
    met = once(met, "front", front(F.col("grams"), t))
    own = F.col("grams")
    best = F.array_min(F.transform(F.filter("_offers", lambda o: (o["value"] > F.col("above")) & fits(
        F.size(own), F.size(o["grams"]), t) & F.arrays_overlap(F.col("front"), o["front"]) & alike(own, o["grams"], t)), lambda o: o["rank"]))
    return once(met, "_best", best).where(F.col("_best").isNotNull()).select("id", F.col("_best").alias("rank"))


def first_alike(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(id, rank): for each left text the smallest rank of a right text of its page that is alike and whose value is above its limit.

    left(doc_id, page_no, id, norm, above), right(doc_id, page_no, id, norm, rank, value) with ranks from 0 within a page.
    Ids are unique on a side. Both are read several times: pass stored tables. Pages of few right texts meet page by page, the others by the index.
    """
    last = right.agg(F.max("rank")).first()[0]
    if last is None or last < FIRST_WAVE:
        return _met_by_page(left, right, t)
    large = checkpoint(right.where(F.col("rank") >= FIRST_WAVE).select(*PAGE).distinct())
    side = lambda df, how: df.join(large, PAGE, how)
    return _met_by_page(side(left, "left_anti"), side(right, "left_anti"), t).unionByName(
        _in_waves(side(left, "left_semi"), side(right, "left_semi"), last, t))


def _in_waves(left: DataFrame, right: DataFrame, last: int, t: float) -> DataFrame:
    """first_alike by the index, for pages of any size."""
    with_grams = lambda df: checkpoint(df.withColumn("grams", grams(F.col("norm"))))
    left, right = _common_last(with_grams(left), with_grams(right))
    left, right, found = checkpoint(left), checkpoint(right), []
    low, high = 0, FIRST_WAVE
    while low <= last:
        wave = right.where(F.col("rank").between(low, high - 1))
        found.append(checkpoint(_best_in(left, wave, t)))
        # What is still open, on the pages that have more to offer.
        more = right.where(F.col("rank") >= high).select(*PAGE).distinct()
        left = checkpoint(left.join(found[-1], "id", "left_anti").join(more, PAGE, "left_semi"))
        if left.isEmpty():
            break
        low, high = high, high * WAVE_GROWTH
    out = found[0]
    for more in found[1:]:  # as many as waves: a handful
        out = out.unionByName(more)
    return out
