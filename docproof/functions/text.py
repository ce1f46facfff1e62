"""Text columns: cleaning, splitting, and set-based similarity of short strings."""

import sys

from pyspark.sql import Column, functions as F

# Java flags under which \d \s \w \b and '.' follow Unicode rules with '\n' as only line end.
U = "(?Ud)"
UI = "(?Udi)"

#: Every character that counts as white space (29 of them), derived from the Unicode tables.
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
#: The same as a regex class; Unicode \s leaves out the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
#: Characters that end a line, besides the pair \r\n.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def blank_to_null(c: Column) -> Column:
    """'' and NULL mean the same everywhere: absent."""
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, so nested lambdas do not evaluate it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def not_blank(c: Column) -> Column:
    """Is anything left of the text when it is stripped? Its end need not be looked at for that."""
    return F.ltrim(c, F.lit(WHITESPACE)) != ""


def clean_text(c: Column, confuse_o: bool = True) -> Column:
    """Undo common OCR confusions. ``confuse_o`` turns every capital O into zero."""
    c = F.replace(c, F.lit("\n\n"), F.lit("\n"))
    c = F.replace(c, F.lit("0l"), F.lit("01"))
    if confuse_o:
        c = F.replace(c, F.lit("O"), F.lit("0"))
    c = F.replace(c, F.lit("|"), F.lit("1"))
    c = F.regexp_replace(c, " {2,}", " ")
    return strip(c)


def normalise_ws(c: Column, lower: bool = False) -> Column:
    """Collapse white space to single spaces and strip; lower-case for duplicate tests."""
    c = strip(F.regexp_replace(c, f"(?U){WS}+", " "))
    return F.lower(c) if lower else c


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_ENDS)


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"(?U){WS}+"), lambda w: w != "")


def title_case(c: Column) -> Column:
    """Capitalise each run of letters; any non-letter starts a new word."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(
            F.upper(F.substring(p, F.lit(1), F.lit(1))),
            F.lower(F.substring(p, F.lit(2), F.length(p))),
        )), "")


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c))))


def valid_name(c: Column, max_words: int = 5, min_alpha: float = 0.8) -> Column:
    """A plausible person name: enough words, each mostly letters, no digit."""
    letters = lambda w: F.length(F.regexp_replace(w, r"\P{L}", ""))
    ok = (
        (F.length(c) >= 4)
        & F.size(words(c)).between(2, max_words)
        & F.forall(words(c), lambda w: (F.length(w) >= 2) & (letters(w) / F.length(w) >= min_alpha))
        & ~c.rlike(r"(?U)\d")
    )
    return F.coalesce(ok, F.lit(False))


def _overlap(a: Column, b: Column):
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def tokens_match(ta: Column, tb: Column, threshold: float) -> Column:
    """Token-set Jaccard reaches the threshold, or one non-empty set lies inside the other."""
    inter, union = _overlap(ta, tb)
    smaller = F.least(F.size(ta), F.size(tb))
    return F.coalesce((smaller > 0) & ((inter / union >= threshold) | (inter == smaller)), F.lit(False))


def token_match(a: Column, b: Column, threshold: float = 0.6) -> Column:
    return let(F.struct(name_tokens(a).alias("a"), name_tokens(b).alias("b")),
               lambda s: tokens_match(s["a"], s["b"], threshold))


def trigrams(c: Column) -> Column:
    """Distinct character trigrams; a shorter string is its own only element."""
    # A look-ahead at every character: one pass, where substrings by position would be quadratic.
    grams = F.regexp_extract_all(c, F.lit(r"(?s)(?=(...))."), F.lit(1))
    return F.array_distinct(F.when(F.length(c) >= 3, grams).otherwise(F.array(c)))


def trigram_sets_similarity(ta: Column, tb: Column) -> Column:
    inter, union = _overlap(ta, tb)
    return inter / union


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the trigram sets; 0 where a side is absent or empty."""
    sim = let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")),
              lambda s: trigram_sets_similarity(s["a"], s["b"]))
    return F.when((a != "") & (b != ""), sim).otherwise(F.lit(0.0))


def mask_id(c: Column) -> Column:
    """Show the last four characters only."""
    return F.concat(F.lit("****"), F.right(c, F.lit(4)))


def round_exact(c: Column, places: int) -> Column:
    """Round half-even on the exact binary value, as a double."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit("")).cast("double")


def fixed2(c: Column) -> Column:
    """A double with two decimals, rounded half-even on its exact value."""
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
