"""Check digits: the Verhoeff scheme (dihedral group of order ten) and Luhn."""

from pyspark.sql import Column, functions as F

from .text import let


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group: 0-4 are rotations, 5-9 reflections."""
    ra, rb = a % 5, b % 5
    turn = ra + rb if a < 5 else ra - rb
    return turn % 5 + (5 if (a < 5) != (b < 5) else 0)


# Fixed value: the permutation applied once per position, to the power of the position.
_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]

PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
POWERS = [list(range(10))]
while len(POWERS) < 8:
    POWERS.append([_STEP[x] for x in POWERS[-1]])
INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]

VALID_REASON = "Verhoeff checksum passed — mathematically valid Aadhaar number"
INVALID_REASON = "Verhoeff checksum FAILED — this is NOT a valid Aadhaar number"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _fold(number: Column) -> Column:
    """Run the digits right to left through the permuted group product."""
    product, powers = _ints(PRODUCT), _ints([x for row in POWERS for x in row])
    reversed_digits = F.split(F.reverse(number), "")

    def step(state, pos_digit):
        permuted = F.get(powers, (pos_digit["pos"] % 8) * 10 + pos_digit["digit"])
        return F.get(product, state * 10 + permuted)

    placed = F.transform(reversed_digits, lambda d, i: F.struct(
        i.alias("pos"), F.coalesce(d.try_cast("int"), F.lit(0)).alias("digit")))
    return F.aggregate(placed, F.lit(0), step)


def verhoeff_check(c: Column) -> Column:
    """Struct (valid, clean_number, reason, penalty) for a 12-digit number."""
    def folded(clean):
        return F.struct(clean.alias("clean"), F.when((F.length(clean) == 12) & ~F.left(clean, F.lit(1)).isin("0", "1"),
                                                     _fold(clean) == 0).alias("passes"))

    def verdict(number):
        clean, passes = number["clean"], number["passes"]
        n, first = F.length(clean), F.left(clean, F.lit(1))
        wrong_length, wrong_first = n != 12, first.isin("0", "1")
        return F.struct(
            F.when(wrong_length | wrong_first, F.lit(False)).otherwise(passes).alias("valid"),
            clean.alias("clean_number"),
            F.when(wrong_length, F.concat(F.lit("Aadhaar must be 12 digits, got "), n.cast("string")))
             .when(wrong_first, F.concat(F.lit("Aadhaar cannot start with '"), first, F.lit("' (UIDAI rule)")))
             .when(passes, F.lit(VALID_REASON)).otherwise(F.lit(INVALID_REASON)).alias("reason"),
            F.when(wrong_length | wrong_first, F.lit(25))
             .when(passes, F.lit(0)).otherwise(F.lit(30)).alias("penalty"),
        )
    return F.when(c.isNotNull(), let(let(digits(c), folded), verdict))


def verhoeff_append(c: Column) -> Column:
    """The digit string with its check digit appended."""
    check = F.get(_ints(INVERSE), _fold(F.concat(c, F.lit("0"))))
    return F.concat(c, check.cast("string"))


def luhn_check(c: Column) -> Column:
    """Luhn mod 10 over the digits in the string."""
    placed = F.transform(F.filter(F.split(F.reverse(digits(c)), ""), lambda d: d != ""),
                         lambda d, i: F.struct(i.alias("pos"), d.cast("int").alias("d")))

    def add(total, p):
        doubled = p["d"] * 2
        return total + F.when(p["pos"] % 2 == 0, p["d"]).otherwise(
            F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(placed, F.lit(0), add) % 10 == 0
