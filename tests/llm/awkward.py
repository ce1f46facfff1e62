"""Small tables with the awkward rows that every operator must take."""

import random

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "lo", "ti")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: doc_id, text: null and empty texts, white space alone, a long text, repeated rows, equal texts, a null id.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two three"), (6, prose(1, 30000)),
    (7, prose(2, 80)), (7, prose(2, 80)), (8, prose(2, 80)), (9, prose(2, 79) + " changed"), (10, "é ü ñ 日本 \x85 x y " * 9),
    (11, "word " * 400), (12, "x" * 5000), (None, prose(3, 60)),
]


def documents(spark, rows=AWKWARD):
    """documents with further columns whose names the operators use inside."""
    data = [(i, t, "en", "src0", None if t is None else len(t), -1, -2, -3, "c", "r") for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, n_words long, bucket int, start long, "
              "component string, rep string")


def key(row):
    return tuple((x is None, str(x)) for x in row)
