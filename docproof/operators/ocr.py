"""Boxes of OCR engines: roll-up to documents, line building, and fusing two engines.

Pages and documents can be very uneven, so nothing here gathers the rows of a page in one
place unless the result itself is one cell (the text of a line, page or document).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let, normalise_ws
from ..session import checkpoint
from . import similar
from .similar import PAGE, alike, first_alike, fits, front, grams

# --- fixed values ------------------------------------------------------------------------
Y_BAND = 12
MIN_SIMILARITY = 0.75
MIN_CONFIDENCE = 0.30
REGION_KEYS = [("roll", "roll_number"), ("name", "student_name"), ("year", "year")]
# --- end of fixed values --------------------------------------------------------------


def _in_order(order: list[str], *values: str) -> Column:
    """Rows of a group in the given order, as an array of structs."""
    return F.array_sort(F.collect_list(F.struct(*order, *values)))


def _joined(rows: Column, text: str, separator: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: r[text]), separator)


def _mean(rows: Column, value: str) -> Column:
    """Mean added up in row order, so that every run gives the same last digit; 0.0 if empty."""
    total = F.aggregate(rows, F.lit(0.0), lambda t, r: t + F.coalesce(r[value], F.lit(0.0)))
    return F.when(F.size(rows) > 0, total / F.size(rows)).otherwise(0.0)


def pages_to_document(boxes: DataFrame, pages: DataFrame = None) -> DataFrame:
    """Text of all pages in order, and the mean of the page means.

    ``pages(doc_id, page_no)`` lists pages that may hold no box; such a page counts as 0.0.
    Pages are put together first, which spreads the boxes of a huge document over its pages.
    """
    per_page = boxes.groupBy(*PAGE).agg(_in_order(["ord"], "text", "confidence").alias("_b")).select(
        *PAGE, _joined(F.col("_b"), "text", "\n").alias("_text"), _mean(F.col("_b"), "confidence").alias("_c"))
    if pages is not None:
        per_page = pages.select(*PAGE).distinct().join(per_page, PAGE, "left")
    return per_page.groupBy("doc_id").agg(_in_order(["page_no"], "_text", "_c").alias("_p")).select(
        "doc_id", _joined(F.col("_p"), "_text", "\n").alias("text"),
        _mean(F.col("_p"), "_c").alias("confidence"),
        F.size("_p").cast("bigint").alias("page_count"))


def assign_lines(tokens: DataFrame, y_band: int = Y_BAND) -> DataFrame:
    """Add line_no (from 1) to tokens(doc_id, page_no, x0, y0, ...).

    Tokens in (y, x) order join the running line while their y is within the band of its
    level, which then moves halfway to the token. x and the number of tokens on one y do not
    matter beyond that, so all is done on the distinct y values of a page with their counts.
    A level never passes the last y, so a gap wider than the band always opens a line: a window cuts the page into
    islands at such gaps, and only within an island the level is walked. The tokens then look their line up by (page, y).
    """
    return tokens.join(_line_numbers(tokens, y_band), [*PAGE, "y0"])


def _line_numbers(tokens: DataFrame, y_band: int) -> DataFrame:
    """(doc_id, page_no, y0, line_no) of the distinct y values."""
    page = Window.partitionBy(*PAGE).orderBy("y0")
    return _levels(tokens, y_band).select(*PAGE, "y0", F.sum(F.col("opens").cast("int")).over(page).cast("int").alias("line_no"))


def _levels(tokens: DataFrame, y_band: int) -> DataFrame:
    """(doc_id, page_no, y0, opens) of the distinct y values: whether a line begins there."""
    page = Window.partitionBy(*PAGE).orderBy("y0")
    gap = F.col("y0") - F.lag("y0").over(page)
    levels = tokens.groupBy(*PAGE, "y0").agg(F.count("*").alias("n")).withColumn("_cut", F.coalesce((gap > y_band).cast("int"), F.lit(1)))
    islands = levels.withColumn("_island", F.sum("_cut").over(page)).groupBy(*PAGE, "_island").agg(
        F.array_sort(F.collect_list(F.struct("y0", "n"))).alias("_ys"))
    return islands.select(*PAGE, F.inline(F.arrays_zip(F.col("_ys.y0").alias("y0"), _opens("_ys", y_band).alias("opens"))))


#: How many values a fold appends to before it starts a new list.
CHUNK = 128


def _opens(ys: str, y_band: int) -> Column:
    """For each y of an island whether it opens a line. Appending copies a list, so the fold appends to short ones: linear in the island."""
    empty = F.struct(
        F.lit(None).cast("double").alias("level"), F.array().cast("array<boolean>").alias("chunk"),
        F.array().cast("array<array<boolean>>").alias("done"))

    def settle(level: Column, y: Column, times: Column) -> Column:
        # Exact without a limit on the tokens: the distance is at most the band, and halved 64 times it is below the
        # last bit of any level, so that more halvings change nothing.
        return F.when(times <= 0, level).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.least(times, F.lit(64)), F.lit(1)).cast("int")), level,
            lambda at, _: (at + y) / 2))

    def step(state, s):
        y = s["y0"].cast("double")
        joins = F.coalesce(F.abs(y - state["level"]) <= y_band, F.lit(False))
        level = F.when(joins, settle(state["level"], y, s["n"])).otherwise(y)
        full = F.size(state["chunk"]) >= CHUNK
        return F.struct(
            level.alias("level"),
            F.when(full, F.array(~joins)).otherwise(F.concat(state["chunk"], F.array(~joins))).alias("chunk"),
            F.when(full, F.concat(state["done"], F.array(state["chunk"]))).otherwise(state["done"]).alias("done"))

    return F.aggregate(ys, empty, step, lambda end: F.concat(F.flatten(end["done"]), end["chunk"]))


def merge_tokens(tokens: DataFrame) -> DataFrame:
    """tokens with line_no -> one row per line: text, mean confidence, box around all."""
    return tokens.groupBy(*PAGE, "line_no").agg(
        _in_order(["y0", "x0", "line", "word"], "text", "confidence").alias("_t"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).select(
        *PAGE, "line_no", _joined(F.col("_t"), "text", " ").alias("text"),
        _mean(F.col("_t"), "confidence").alias("confidence"), "x0", "y0", "x1", "y1",
        F.size("_t").cast("bigint").alias("tokens"))


#: PAGE under names of its own, see _together.
OWN_PAGE = ["_doc_id", "_page_no"]


def _together(*rows: DataFrame) -> DataFrame:
    """Rows of several tables with their page as OWN_PAGE, absent columns NULL.

    Tables dealt alike stay so. Catalyst finds that only if the keys of a union are columns of their own, as the given ones may differ in whether they can be NULL.
    """
    out, *more = [df.withColumnsRenamed(dict(zip(PAGE, OWN_PAGE))) for df in rows]
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def lines_of_tokens(tokens: DataFrame, y_band: int = Y_BAND) -> DataFrame:
    """merge_tokens(assign_lines(tokens)), with fewer rows sent: all tokens on one y of a page are in one line, so they are put
    into one row before the lines are known, one list per column, and stay so on their way to the line.

    A y has the number of lines that began on its page so far: the y values that open a line are put among the rows and counted in
    order. That needs the rows of a page in one task and no join, so tokens dealt by page or by document are not sent again.
    """
    kept, known = ["x0", "line", "word", "text", "confidence"], F.lit(True)
    for key in (*OWN_PAGE, "y0"):
        known = known & F.col(key).isNotNull()
    rows = tokens.groupBy(*PAGE, "y0").agg(
        F.collect_list(F.struct(*kept)).alias("_t"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"))
    lists = rows.select(*PAGE, "y0", "_x0", "_x1", "_y1", *[F.col(f"_t.{c}").alias(c) for c in kept], F.lit(0).alias("_opens"))
    opened = _levels(tokens, y_band).where("opens").select(*PAGE, "y0", F.lit(1).alias("_opens"))
    so_far = Window.partitionBy(*OWN_PAGE).orderBy("y0", F.desc("_opens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _together(lists, opened).withColumn("line_no", F.sum("_opens").over(so_far).cast("int"))
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y0", *kept))), lambda r: F.array_sort(
        F.arrays_zip(*[r[c].alias(c) for c in kept]))))
    return placed.where((F.col("_opens") == 0) & known).groupBy(*OWN_PAGE, "line_no").agg(
        in_order.alias("_t"), F.min("_x0").alias("x0"), F.min("y0").alias("y0"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"),
    ).select(
        *[F.col(own).alias(c) for own, c in zip(OWN_PAGE, PAGE)], "line_no", _joined(F.col("_t"), "text", " ").alias("text"),
        _mean(F.col("_t"), "confidence").alias("confidence"), "x0", "y0", "x1", "y1",
        F.size("_t").cast("bigint").alias("tokens"))


# --- two engines --------------------------------------------------------------------------

#: How many of a page's next open lines are walked in one row.
WALK = 256


def _with_norm(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", normalise_ws(F.col("text"), lower=True))


def _numbered(df: DataFrame) -> DataFrame:
    """Stored, with an id of its own for each row."""
    return checkpoint(df.withColumn("id", F.monotonically_increasing_id()))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord", "norm", "value")) - 1)


def _of(df: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of these pages, pages without a key among them."""
    return df.join(pages, df.doc_id.eqNullSafe(pages.doc_id) & df.page_no.eqNullSafe(pages.page_no), "left_semi")


def _crowded(*sides: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """The pages of more texts than the limit of one of the sides (rows, their different texts, limit), stored; a page may come twice.

    The texts are looked at only on pages that have as many rows.
    """
    def more(tables: list[DataFrame]) -> DataFrame:
        out, *others = [df.groupBy(*PAGE).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*PAGE)
                        for df, (_, _, limit) in zip(tables, sides)]
        for df in others:
            out = out.unionByName(df)
        return checkpoint(out)

    pages = more([rows for rows, _, _ in sides])
    return pages if pages.isEmpty() else more([_of(texts, pages) for _, texts, _ in sides])


def _with_grams(norm: Column, t: float, use) -> Column:
    """use(trigrams, their front) of a text, made once however often they are used."""
    return let(grams(norm), lambda g: let(front(g, t), lambda f: use(g, f)))


def fuse_ocr(primary: DataFrame, secondary: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Each primary line takes text and confidence of the first secondary line that is similar
    and surer; otherwise it stays.

    Lines of one page are reduced to distinct (text, confidence) on both sides before they
    meet, so copies of a line cost nothing. Pages of few secondary texts meet in one pass, which sends each side once and tables dealt
    by page or by document not at all; larger ones go through the index. The secondary lines are read more than once: pass a stored table.
    """
    p = _with_norm(primary)
    offers = _with_norm(secondary.dropna(subset=PAGE)).where(F.col("norm") != "").groupBy(*PAGE, "norm", F.col("confidence").alias("value")).agg(
        F.min(F.struct("ord", "text")).alias("_first")).select(*PAGE, "norm", "value", "_first.ord", "_first.text")
    crowded = _crowded((secondary, offers, similar.FIRST_WAVE))
    fused = _fused_by_page(p, offers, min_similarity)
    if crowded.isEmpty():
        return fused
    return fused.unionByName(_fused_by_index(_of(p, crowded), _of(offers, crowded), min_similarity))


def _fused(rows: DataFrame, page: list[str], text: Column, confidence: Column) -> DataFrame:
    won = confidence.isNotNull()
    return rows.select(
        *[F.col(c).alias(name) for c, name in zip(page, PAGE)], "ord",
        F.when(won, text).otherwise(F.col("text")).alias("text"),
        F.when(won, confidence).otherwise(F.col("confidence")).alias("confidence"),
        F.when(won, "fused").otherwise("primary").alias("engine"))


def _fused_by_page(p: DataFrame, offers: DataFrame, t: float) -> DataFrame:
    """The lines of pages of up to FIRST_WAVE offers. A window gives a page's offers, with trigrams made once, to its lines; of
    equal lines, which follow each other, the first one looks for a partner."""
    few, on_page = similar.FIRST_WAVE, Window.partitionBy(*OWN_PAGE)
    rows = _together(p.select(*PAGE, "ord", "text", "confidence", "norm", F.lit(1).alias("_asks")), offers.select(
        *PAGE, "ord", "text", F.col("value").alias("confidence"), "norm", F.lit(0).alias("_asks")))
    in_order = on_page.orderBy("_asks", "norm", "confidence")
    before = lambda c: F.lag(c).over(in_order).eqNullSafe(F.col(c))
    rows = rows.withColumns({"_nth": F.row_number().over(in_order), "_copy": before("_asks") & before("norm") & before("confidence")})
    offer = F.when((F.col("_asks") == 0) & (F.col("_nth") <= few + 1), _with_grams(F.col("norm"), t, lambda g, f: F.struct(
        "ord", "norm", "confidence", "text", g.alias("grams"), f.alias("front"))))
    met = rows.withColumn("_offers", F.collect_list(offer).over(on_page)).where((F.col("_asks") == 1) & (F.size("_offers") <= few))
    like = lambda g, f: lambda o: (o["confidence"] > F.col("confidence")) & fits(F.size(g), F.size(o["grams"]), t) & F.arrays_overlap(
        f, o["front"]) & alike(g, o["grams"], t)
    first = lambda offers: F.array_min(F.transform(offers, lambda o: F.struct(*[o[c].alias(c) for c in ("ord", "norm", "confidence", "text")])))
    best = _with_grams(F.col("norm"), t, lambda g, f: first(F.filter("_offers", like(g, f))))
    asked = met.select(*OWN_PAGE, "ord", "text", "confidence", "norm", "_asks", F.when(~F.col("_copy"), F.struct(
        F.when(F.col("norm") != "", best).alias("best"))).alias("_found"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.withColumn("_found", F.last("_found", ignorenulls=True).over(so_far))
    return _fused(found, OWN_PAGE, F.col("_found.best.text"), F.col("_found.best.confidence"))


def _fused_by_index(p: DataFrame, offers: DataFrame, t: float) -> DataFrame:
    """The lines of pages of any size. Both sides are read more than once."""
    wanted = _numbered(p.where(F.col("norm") != "").select(*PAGE, "norm", F.col("confidence").alias("above")).distinct())
    offered = _numbered(_ranked(offers))
    best = (
        first_alike(wanted, offered, t).join(wanted.select("id", *PAGE, "norm", "above"), "id")
        .join(offered.select(*PAGE, "rank", F.col("text").alias("s_text"), F.col("value").alias("s_confidence")), [*PAGE, "rank"])
        .select(*PAGE, "norm", F.col("above").alias("confidence"), "s_text", "s_confidence"))
    return _fused(p.join(best, [*PAGE, "norm", "confidence"], "left"), PAGE, F.col("s_text"), F.col("s_confidence"))


def _walked(texts: DataFrame, page: list[str], carried: str, t: float) -> DataFrame:
    """(page, carried, keep) of a bounded number of texts per page: in rank order, each is kept that is like none kept before it."""
    def step(kept, x):
        fresh = ~F.exists(kept, lambda k: fits(F.size(k["grams"]), F.size(x["grams"]), t) & alike(k["grams"], x["grams"], t))
        return F.when(fresh, F.concat(kept, F.array(F.struct(x["rank"].alias("rank"), x["grams"].alias("grams"))))).otherwise(kept)

    rows = F.array_sort(F.collect_list(F.struct("rank", carried, "norm")))
    none = F.array().cast("array<struct<rank:int,grams:array<bigint>>>")
    # The texts are sent and their trigrams made behind the exchange, once: the generator keeps them from being made anew for each pair.
    with_grams = F.transform(rows, lambda x: F.struct(x["rank"].alias("rank"), x[carried].alias(carried), grams(x["norm"]).alias("grams")))
    pages = texts.groupBy(*page).agg(with_grams.alias("_xs")).select(*page, F.inline(F.array(F.struct(F.col("_xs").alias("xs"))))).withColumn(
        "kept", F.transform(F.aggregate("xs", none, step), lambda k: k["rank"]))
    return pages.select(*page, F.explode(F.transform("xs", lambda x: F.struct(
        x[carried].alias(carried), F.array_contains("kept", x["rank"]).alias("keep")))).alias("x")).select(*page, "x.*")


def kept_in_order(texts: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The ids of texts(doc_id, page_no, id, norm, rank), stored, that are like no earlier kept text of their page.

    In rounds, until nothing is open: the next WALK open texts of every page are walked in order; open texts like one that this keeps
    go; of the rest, those like no earlier open text are kept at once, and what is like them goes. A page of
    unlike texts, or of texts all alike, ends after a round or two however long it is, a chain of near twins after its length / WALK.
    """
    t, kept = min_similarity, []
    rank = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("rank")) - 1)
    limits = lambda df: df.withColumn("above", F.lit(0.0))
    values = lambda df: rank(df).withColumn("value", F.lit(1.0))
    without = lambda df, ids: df.join(ids, "id", "left_anti")
    open_texts = texts
    while True:
        numbered = rank(open_texts)
        walked = checkpoint(_walked(numbered.where(F.col("rank") < WALK), PAGE, "id", t).select("id", "keep"))
        kept.append(walked.where("keep").select("id"))
        later = checkpoint(without(open_texts, walked))
        if later.isEmpty():
            break
        later = _unlike(later, open_texts.join(kept[-1], "id", "left_semi"), limits, values, t)
        # Whoever is like no earlier open text: the first alike in rank order is the text itself.
        ranked = checkpoint(values(later))
        first = checkpoint(first_alike(limits(ranked), ranked, t))
        alone = checkpoint(ranked.join(first.withColumnRenamed("rank", "_first"), "id").where("_first = rank").select("id"))
        kept.append(alone)
        rest = checkpoint(without(later, alone))
        if rest.isEmpty():
            break
        open_texts = _unlike(rest, later.join(alone, "id", "left_semi"), limits, values, t)
        if open_texts.isEmpty():
            break
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _unlike(texts: DataFrame, kept: DataFrame, limits, values, t: float) -> DataFrame:
    """The texts like none that was kept, stored."""
    return checkpoint(texts.join(first_alike(limits(texts), checkpoint(values(kept)), t), "id", "left_anti").select(*texts.columns))


def secondary_only_lines(fused: DataFrame, secondary: DataFrame,
                         min_confidence: float = MIN_CONFIDENCE,
                         min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Fused lines plus the secondary lines like nothing kept so far, without the unsure ones.

    A secondary line is dropped if it is like a fused line or like an earlier secondary line
    that was kept. Copies of a text stand or fall with its first occurrence. Pages of few texts are decided in one pass, without sending
    tables again that are dealt by page or by document; larger ones through the index and in rounds. Both inputs are read more than once: pass stored tables.
    """
    f = _with_norm(fused).where(F.col("norm") != "").select(*PAGE, "norm").distinct()
    texts = _with_norm(secondary).where(F.col("norm") != "").groupBy(*PAGE, "norm").agg(
        F.min(F.struct("ord", "text", "confidence")).alias("first"))
    crowded = _crowded((fused, f, similar.FIRST_WAVE), (secondary, texts, WALK))
    added = _added_by_page(f, texts, min_similarity)
    if not crowded.isEmpty():
        added = added.unionByName(_added_by_index(_of(f, crowded), _of(texts, crowded), min_similarity))
    lines = added.select(*PAGE, "first.ord", "first.text", "first.confidence", F.lit("secondary_only").alias("engine"))
    return fused.select(*lines.columns).unionByName(lines).where(
        (F.col("confidence") >= min_confidence) & (F.col("text") != ""))


def _added_by_page(f: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """(doc_id, page_no, first) of the texts that stay, on pages of up to FIRST_WAVE fused and up to WALK secondary texts. A window gives a
    page's fused texts, with trigrams made once, to the secondary ones; what is left of a page is walked in one row."""
    few, on_page = similar.FIRST_WAVE, Window.partitionBy(*OWN_PAGE)
    rows = _together(texts.select(*PAGE, "norm", "first", F.lit(1).alias("_asks")), f.select(*PAGE, "norm", F.lit(0).alias("_asks")))
    in_order, without_page = on_page.orderBy("norm", "_asks"), F.col(OWN_PAGE[0]).isNull() | F.col(OWN_PAGE[1]).isNull()
    rows = rows.withColumns({
        "_equal": F.lag("norm").over(in_order).eqNullSafe(F.col("norm")),
        "_nth": F.sum(1 - F.col("_asks")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    offer = F.when((F.col("_asks") == 0) & (F.col("_nth") <= few) & ~without_page, _with_grams(
        F.col("norm"), t, lambda g, front: F.struct(g.alias("grams"), front.alias("front"))))
    met = rows.withColumns({
        "_offers": F.collect_list(offer).over(on_page), "_known": F.sum(1 - F.col("_asks")).over(on_page), "_asking": F.sum("_asks").over(on_page),
    }).where((F.col("_asks") == 1) & (F.col("_known") <= few) & (F.col("_asking") <= WALK) & (~F.col("_equal") | without_page))
    like = lambda g, front: lambda o: fits(F.size(g), F.size(o["grams"]), t) & F.arrays_overlap(front, o["front"]) & alike(g, o["grams"], t)
    unlike = ~_with_grams(F.col("norm"), t, lambda g, front: F.exists("_offers", like(g, front)))
    left = met.where(unlike).select(*OWN_PAGE, "norm", "first").withColumn("rank", F.row_number().over(on_page.orderBy("first.ord", "norm")) - 1)
    return _walked(left, OWN_PAGE, "first", t).where("keep").select(*[F.col(own).alias(c) for own, c in zip(OWN_PAGE, PAGE)], "first")


def _added_by_index(f: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """The same for pages of any size. Texts equal to a fused one go first, by a plain join; the others ask the index for a fused text
    that is alike, and what is left is decided by ``kept_in_order``."""
    f = checkpoint(f)
    unknown = _numbered(texts.join(f, [*PAGE, "norm"], "left_anti").withColumn("above", F.lit(0.0)))
    known = _numbered(_ranked(f.join(unknown.select(*PAGE).distinct(), PAGE, "left_semi").withColumns(
        {"ord": F.lit(0), "value": F.lit(1.0)})))
    open_texts = checkpoint(
        unknown.join(first_alike(unknown, known, t), "id", "left_anti").drop("above")
        .withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first.ord", "norm")) - 1))
    return open_texts.join(kept_in_order(open_texts, t), "id", "left_semi").select(*PAGE, "first")


def label_regions(boxes: DataFrame) -> DataFrame:
    """Per document and key, the last box whose text holds the key word.

    An aggregate that combines before the shuffle; no document is gathered.
    """
    lower = F.lower(F.col("text"))
    key = None
    for word, name in REGION_KEYS:
        key = (F if key is None else key).when(F.contains(lower, F.lit(word)), name)
    last = F.max_by(F.struct("page_no", "ord", "text", "confidence"), F.struct("page_no", "ord"))
    return (
        boxes.withColumn("region", key).where(F.col("region").isNotNull())
        .groupBy("doc_id", "region").agg(last.alias("b")).select("doc_id", "region", "b.*")
    )
