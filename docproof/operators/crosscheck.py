"""Documents of one subject checked against each other."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import date_digits
from ..functions.text import name_tokens, token_match, tokens_match
from ..schemas import DOC_TYPES

NAME_LEVEL = 0.6


def name_words(name: Column) -> Column:
    """The set of a name's words, in alphabetical order."""
    return F.array_sort(name_tokens(name))


def agreeing_names(names: DataFrame, subject: str, level: float = NAME_LEVEL) -> DataFrame:
    """(subject, key, agreeing): with how many other names of its subject each of names(subject, key, words) agrees.

    Two names agree if one's words lie within the other's, or enough of them are shared. Either way the smaller name shares one of the words
    with which it starts, rarest in the subject first, with some word of the larger one: such names meet, each pair under
    the first word they share in that order. No documents are paired, only different names, and no pair is stored.
    """
    rarity = names.select(subject, F.explode("words").alias("word")).groupBy(subject, "word").agg(F.count("*").alias("n"))
    rare_first = (
        names.select(subject, "key", F.explode("words").alias("word")).join(rarity, [subject, "word"])
        .groupBy(subject, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words")))
    size = F.size("words")
    reach = (size - F.ceil(size * level - 1e-9) + 1).cast("int")
    smaller = rare_first.select(subject, "key", "words", F.explode(F.slice("words", F.lit(1), reach)).alias("word"))
    larger = rare_first.select(subject, F.col("key").alias("other"), F.col("words").alias("other_words"), F.explode("words").alias("word"))
    in_order = (size < F.size("other_words")) | ((size == F.size("other_words")) & (F.col("key") < F.col("other")))
    first_shared = F.get(F.array_intersect("words", "other_words"), F.lit(0)) == F.col("word")
    pairs = smaller.join(larger, [subject, "word"]).where(
        in_order & first_shared & tokens_match(F.col("words"), F.col("other_words"), level))
    return pairs.select(subject, F.explode(F.array("key", "other")).alias("key")).groupBy(subject, "key").agg(
        F.count("*").alias("agreeing"))


def cross_document_check(docs: DataFrame, subject: str = "subject_id") -> DataFrame:
    """docs(doc_id, subject, document_type, name, dob): every document that states a name or a date, against its subject.

    Each field has its own anchor: the subject's first document in type order that states it. An agreement is NULL for
    the anchor itself and where nothing is stated. As agreement of names is not transitive, all pairs of the subject's
    different names (as sets of words) are judged as well: name_conflicts counts the names that the document's own
    disagrees with, subject_conflicts the disagreeing pairs of the subject. subject_names and subject_dates
    count its different names and dates. ``docs`` is read several times: pass a stored table.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in DOC_TYPES]), F.col("document_type"))
    stated = docs.where((F.col("document_type") != "unknown") & F.coalesce("name", "dob").isNotNull()).withColumn(
        "_words", name_words(F.col("name"))).withColumn("_key", F.array_join("_words", " "))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), "doc_id", c)))
    anchors = stated.groupBy(subject).agg(first("name").alias("_n"), first("dob").alias("_d"))
    dates = stated.select(subject, date_digits(F.col("dob")).alias("_date")).where("_date is not null").distinct().groupBy(subject).agg(
        F.count("*").alias("subject_dates"))
    names = stated.where("_key is not null").select(subject, F.col("_key").alias("key"), F.col("_words").alias("words")).distinct()
    judged = names.select(subject, "key").join(agreeing_names(names, subject), [subject, "key"], "left")
    counted = judged.groupBy(subject).agg(
        F.count("*").alias("subject_names"), F.coalesce(F.sum("agreeing"), F.lit(0)).alias("_agreeing")).withColumn(
        "subject_conflicts", F.expr("(subject_names * (subject_names - 1) - _agreeing) div 2"))
    agrees = lambda a, c, test: F.when(
        F.col(c).isNotNull() & (F.col(f"{a}.doc_id") != F.col("doc_id")), test(F.col(f"{a}.{c}"), F.col(c)))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (
        stated.join(anchors, subject).join(counted, subject, "left").join(dates, subject, "left")
        .join(judged.withColumnRenamed("key", "_key"), [subject, "_key"], "left")
        .select(
            subject, "doc_id", "document_type", F.col("_n.doc_id").alias("name_anchor"), F.col("_d.doc_id").alias("dob_anchor"),
            agrees("_n", "name", lambda a, b: token_match(a, b, NAME_LEVEL)).alias("name_agrees"),
            agrees("_d", "dob", lambda a, b: date_digits(a) == date_digits(b)).alias("dob_agrees"),
            F.when(F.col("_key").isNotNull(), F.col("subject_names") - 1 - F.coalesce("agreeing", F.lit(0))).alias("name_conflicts"),
            none("subject_names"), none("subject_dates"), none("subject_conflicts")))
