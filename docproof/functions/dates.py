"""Dates: as text in the fields, as DATE inside the rules."""

from pyspark.sql import Column, functions as F

from .text import strip

# Accepted layouts, tried in this order.
_LAYOUTS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
]


def parse_date(c: Column) -> Column:
    """DATE of the first layout that fits; NULL for anything else, impossible days included."""
    s = strip(c)
    return F.coalesce(*[
        F.when(s.rlike(shape), F.to_date(F.try_to_timestamp(s, F.lit(layout))))
        for shape, layout in _LAYOUTS
    ])


def date_digits(c: Column) -> Column:
    """Digits only, for comparing dates written with different separators."""
    return F.regexp_replace(c, "[^0-9]", "")


def date_without_separators(c: Column) -> Column:
    """Looser key of the quick QR comparison: only separators and white space go."""
    return F.regexp_replace(c, r"[/\-\s]", "")
