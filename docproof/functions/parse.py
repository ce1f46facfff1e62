"""Field extraction by document type, as column expressions over the cleaned text.

Each ``parse_*`` gives a dict of field name -> Column. ``parse_fields`` puts the
dicts behind the document type, so a row only runs the patterns of its own type.
"""

from pyspark.sql import Column, functions as F

from ..schemas import DEGREE, FIELDS, ID_CARD, MARKSHEET, PASSPORT, RESUME, TAX_CARD
from .text import (LINE_ENDS, U, UI, WS, blank_to_null, let, normalise_ws, split_lines, strip,
                   title_case, valid_name, capitalise)

# --- fixed values: shapes of numbers and labels -------------------------------------
ID_NUMBER = r"\b(\d{4}[\s-]?\d{4}[\s-]?\d{4})\b"
DATE = r"\b(\d{2}[/\-]\d{2}[/\-]\d{4})\b"
GENDER = r"\b(male|female|transgender)\b"
PINCODE = r"\b(\d{6})\b"
TAX_NUMBER = r"\b([A-Z]{5}\d{4}[A-Z])\b"
FATHER = r"father['’s]*\s*name[:\s]+([A-Z\s]+)"
PASSPORT_NUMBER = r"\b([A-Z]\d{7})\b"
NATIONALITY = r"nationality[:\s]+([A-Z]+)"
MRZ = r"([A-Z0-9<]{40,})"
EMAIL = r"([\w.+-]+@[\w-]+\.[a-z]{2,})"
PHONE = r"(\+?[\d\s\-()]{7,15})"
SKILLS = r"skills?[:\-\s]+([\s\S]{0,400}?)(?:\n{2,}|education|experience|$)"
SKILL_SEPARATORS = r"[,\n•\|·]"
YEAR = r"\b(20\d{2}|19\d{2})\b"
PERCENTAGE = r"(\d{1,3}(?:\.\d{1,2})?\s*%)"
ROLL = r"roll\s*(?:no|number)[:\s]+([A-Z0-9\-/]+)"
INSTITUTION_WORDS = r"university|college|institute"
NAME_WORDS = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"
NAME_AFTER_LABEL = r"Name[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
NAME_BEFORE_DATE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s*\n\s*\d{2}/"
BIRTH_MARK = r"DOB|D\.O\.B|\d{2}/\d{2}/\d{4}"
NUMBER_MARK = r"\d{4}\s?\d{4}\s?\d{4}"
ADDRESS_LABEL = r"(?:^|\n)\s*(?:address|addr|s/o|c/o|w/o|d/o|h\.?\s*no\.?)[:\s]+"
ADDRESS_STOP = (r"\b\d{4}\s?\d{4}\s?\d{4}\b|\b(DOB|D\.O\.B|Date of Birth)\b"
                r"|\b(Male|Female|Transgender)\b")
LOCALITY_WORDS = [
    "road", "rd", "street", "st", "nagar", "colony", "sector", "phase", "block", "district",
    "tehsil", "taluka", "village", "town", "city", "state", "near", "opp", "opposite", "plot",
    "flat", "house", r"h\.no", "floor", "lane", "marg", "vihar", "enclave", "extension", "park",
    "ward", "area", "locality", "mohalla", "chowk", "bazaar", "bazar", "market", "circle",
    "cross", "layout", "scheme", "society", "apartment", "apt", "residency", "residences",
    "complex", "tower", "building", "bhawan", "gali", "bypass", "highway", "nh", "sh",
]
# --- end of fixed values --------------------------------------------------------------

_LOCALITY = UI + r"\b(?:" + "|".join(LOCALITY_WORDS) + r")\b"


def first(c: Column, pattern: str, flags: str = U, group: int = 1) -> Column:
    """First match of a pattern, NULL if there is none."""
    return blank_to_null(F.regexp_extract(c, flags + pattern, group))


def every(c: Column, pattern: str, flags: str = U) -> Column:
    return F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(1))


# --- names ---------------------------------------------------------------------------

def extract_name(c: Column) -> Column:
    """A name after its label, else one on the line before a date; each must look like a name."""
    found = []
    for pattern in (NAME_AFTER_LABEL, NAME_BEFORE_DATE):
        found.append(let(strip(first(c, pattern)), lambda name: F.when(valid_name(name), name)))
    return F.coalesce(*found)


def _name_ahead_of(c: Column, lead: str, mark: str) -> Column:
    """First title-case line that has the mark somewhere after it.

    Text after a later candidate is part of the text after the first, so only the first can
    decide. Taking it with its remainder keeps the search linear.
    """
    pattern = f"{U}{lead}({NAME_WORDS})\\s*\\n([\\s\\S]*)$"
    name = strip(F.regexp_extract(c, pattern, 1))
    rest = F.regexp_extract(c, pattern, 2)
    return F.when(rest.rlike(U + mark), name)


def extract_card_name(c: Column) -> Column:
    """ID-card variant: a line ahead of the birth date or number is tried first."""
    ahead = [
        let(_name_ahead_of(c, r"(?:^|\n)", BIRTH_MARK), lambda n: F.when(valid_name(n), n)),
        let(_name_ahead_of(c, "", NUMBER_MARK), lambda n: F.when(valid_name(n), n)),
    ]
    return F.coalesce(*ahead, extract_name(c))


# --- address -------------------------------------------------------------------------

def _looks_like_address(line: Column) -> Column:
    line = strip(line)
    return (F.length(line) >= 4) & (
        (line.rlike(r"(?U)\d") & line.rlike("[A-Za-z]")) | line.rlike(_LOCALITY))


def _labelled_address(c: Column) -> Column:
    after = F.regexp_extract(c, UI + ADDRESS_LABEL + r"([\s\S]*)$", 1)

    def collect(lines):
        ends = F.transform(lines, lambda ln, i: ln.rlike(UI + ADDRESS_STOP) | (
            (ln == "") & (i > 0) & (F.get(lines, i - 1) == "")))
        stop = F.array_position(ends, True).cast("int")
        kept = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(lines)
        return F.array_join(F.slice(F.filter(kept, lambda ln: ln != ""), 1, 6), ", ")

    cleaned = F.transform(split_lines(after), lambda ln: normalise_ws(ln))
    return F.when(after != "", blank_to_null(let(cleaned, collect)))


def _address_around_pincode(c: Column, lines: Column) -> Column:
    pin = first(c, PINCODE)

    def around(s):
        at = F.array_position(F.transform(s["lines"], lambda ln: F.contains(ln, s["pin"])), True).cast("int")
        begin = F.greatest(at - 4, F.lit(1))
        block = F.slice(s["lines"], begin, at + 3 - begin)
        kept = F.filter(F.transform(block, lambda ln: normalise_ws(ln)),
                        lambda ln: _looks_like_address(ln) | F.contains(ln, s["pin"]))
        return F.when(at > 0, let(kept, lambda k: F.when(F.size(k) >= 2, F.array_join(k, ", "))))

    return F.when(pin.isNotNull(), let(F.struct(lines.alias("lines"), pin.alias("pin")), around))


def _address_like_lines(lines: Column) -> Column:
    kept = F.transform(F.filter(lines, _looks_like_address), lambda ln: normalise_ws(ln))
    return let(kept, lambda k: F.when(F.size(k) >= 2, F.array_join(F.slice(k, 1, 6), ", ")))


def extract_address(c: Column) -> Column:
    """Lines after an address label, else around the pincode, else all that look like one."""
    return F.coalesce(
        _labelled_address(c),
        _address_around_pincode(c, split_lines(c)),
        _address_like_lines(split_lines(c)),
    )


# --- one parser per type ---------------------------------------------------------------

def parse_id_card(c: Column) -> dict:
    return {
        "aadhaar_number": F.regexp_replace(first(c, ID_NUMBER), r"(?U)[\s-]", ""),
        "dob": first(c, DATE),
        "gender": capitalise(first(c, GENDER, UI)),
        "pincode": first(c, PINCODE),
        "address": extract_address(c),
        "name": extract_card_name(c),
    }


def parse_tax_card(c: Column) -> dict:
    return {
        "pan_number": first(c, TAX_NUMBER),
        "dob": first(c, DATE),
        "name": extract_name(c),
        "father_name": title_case(strip(first(c, FATHER, UI))),
    }


def parse_passport(c: Column) -> dict:
    dates, mrz = every(c, DATE), every(c, MRZ)
    return {
        "passport_number": first(c, PASSPORT_NUMBER),
        "dob": F.get(dates, F.lit(0)),
        "expiry_date": F.when(F.size(dates) >= 2, F.try_element_at(dates, F.lit(-1))),
        "nationality": title_case(first(c, NATIONALITY, UI)),
        "mrz_line1": F.get(mrz, F.lit(0)),
        "mrz_line2": F.get(mrz, F.lit(1)),
        "surname": extract_name(c),
    }


def parse_resume(c: Column) -> dict:
    listed = F.transform(F.split(F.regexp_extract(c, UI + SKILLS, 1), SKILL_SEPARATORS), strip)
    return {
        # The address pattern is tried only where its one fixed character occurs at all.
        "email": F.when(F.contains(c, F.lit("@")), first(c, EMAIL, UI)),
        # A run of seven blanks counts as found but empty, which is not the same as absent.
        "phone": F.when(c.rlike(U + PHONE), strip(F.regexp_extract(c, U + PHONE, 1))),
        "skills": F.filter(listed, lambda s: s != ""),
        "name": extract_name(c),
    }


def _institution(c: Column) -> Column:
    """First line with a school word and a letter somewhere before it, from that line's first letter.

    Working line by line avoids a pattern that is quadratic in line length.
    """
    shape = UI + r"[A-Z][^\n]*(?:" + INSTITUTION_WORDS + ")"
    hits = F.filter(F.split(c, "\n"),
                    lambda ln: ln.rlike(f"(?i){INSTITUTION_WORDS}")
                    & ln.rlike(shape))
    return strip(first(F.get(hits, F.lit(0)), r"([A-Z][^\n]*)$", UI))


def parse_certificate(c: Column) -> dict:
    return {
        "year": first(c, YEAR),
        "percentage": first(c, PERCENTAGE),
        "roll_number": first(c, ROLL, UI),
        "student_name": extract_name(c),
        "institution": _institution(c),
    }


#: Extension point: document type -> parser.
PARSERS = {
    ID_CARD: parse_id_card,
    TAX_CARD: parse_tax_card,
    PASSPORT: parse_passport,
    RESUME: parse_resume,
    DEGREE: parse_certificate,
    MARKSHEET: parse_certificate,
}


def parse_fields(text: Column, doc_type: Column, parsers: dict = PARSERS) -> Column:
    """One struct with the fields of every type; a row fills only those of its own type."""
    by_parser = {}
    for kind, parser in parsers.items():
        by_parser.setdefault(parser, []).append(kind)
    branches = {}
    for parser, kinds in by_parser.items():
        for field, value in parser(text).items():
            branches.setdefault(field, []).append(F.when(doc_type.isin(*kinds), value))
    branches["raw_text"] = [text]
    return F.struct(*[
        (F.coalesce(*branches[f.name]) if f.name in branches else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in FIELDS
    ])
