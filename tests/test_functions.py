import datetime
import random

import pytest
from pyspark.sql import functions as F

from docproof.functions import bands as B, checksum as C, dates as D, text as X


def test_clean_text_order_and_confusions(apply):
    got = apply(X.clean_text, ["a\n\n\nb", "10l2", "DOB", "x|y", "  a   b \n", "\x1c z "])
    assert got == ["a\n\nb", "1012", "D0B", "x1y", "a b", "z"]
    assert apply(lambda c: X.clean_text(c, confuse_o=False), ["DOB"]) == ["DOB"]


def test_normalise_ws(apply):
    assert apply(lambda c: X.normalise_ws(c, lower=True), [" A\t\x0b b\x1d C "]) == ["a b c"]


def test_split_lines_knows_every_line_end(apply):
    assert apply(X.split_lines, ["a\r\nb\x0bc\x0cd\x1ce\x85f g\rh"]) == [list("abcdefgh")]


def test_title_case_breaks_on_any_non_letter(apply):
    assert apply(X.title_case, ["RAVI\nKUMAR o'neil", "likely_authentic x"]) == ["Ravi\nKumar O'Neil", "Likely_Authentic X"]


@pytest.mark.parametrize("name,strict,loose", [
    ("Asha Rao", True, True), ("Ash", False, False), ("Asha", False, False), ("A Rao", False, False),
    ("Asha R4o", False, False), ("Asha O'Neil", True, True), ("Asha Ra.", False, False),
    ("Asha Rao.", False, True), ("Aa Bb Cc Dd Ee Ff", False, True), ("Élodie Ünal", True, True),
    ("", False, False), (None, False, False),
])
def test_valid_name(apply, name, strict, loose):
    assert apply(X.valid_name, [name]) == [strict]
    assert apply(lambda c: X.valid_name(c, 6, 0.75), [name]) == [loose]


def test_token_match_is_symmetric_and_knows_subsets(apply):
    pairs = [("Asha Rao", "rao ASHA"), ("Asha", "Asha Rao"), ("a b c", "a b d"), ("a b c", "a b c d e f g"),
             ("", "a"), (None, "a"), ("a b c d", "a b c e"), ("a b c d e", "a b c d f")]
    want = [True, True, False, True, False, False, True, True]
    match = lambda a, b: X.token_match(a, b, 0.6)
    assert apply(match, pairs, "a string, b string") == want
    assert apply(match, [(b, a) for a, b in pairs], "a string, b string") == want


def test_trigram_similarity(apply):
    got = apply(X.trigram_similarity, [("abcd", "abcd"), ("ab", "ab"), ("ab", "abc"), ("", "abc"), ("abcd", "abce"), (None, "a")],
                "a string, b string")
    assert got == [1.0, 1.0, 0.0, 0.0, pytest.approx(1 / 3), 0.0]


def test_trigrams_are_by_character(apply):
    text = "ab\n😀cdcdcd é"
    (got,) = apply(X.trigrams, [text])
    assert sorted(got) == sorted({text[i:i + 3] for i in range(len(text) - 2)})


def test_verhoeff_known_values_and_messages(apply):
    got = apply(C.verhoeff_check, ["2363", "123456789012", "0123 4567 8901", None])
    assert got[0].penalty == 25 and got[0].reason == "Aadhaar must be 12 digits, got 4"
    assert got[1].reason == "Aadhaar cannot start with '1' (UIDAI rule)"
    assert got[2].clean_number == "012345678901" and got[2].penalty == 25
    assert got[3] is None
    assert apply(C.verhoeff_append, ["236", "12345"]) == ["2363", "123451"]


def test_verhoeff_append_passes_and_every_digit_change_fails(spark, apply):
    rng = random.Random(7)
    stems = [str(rng.randrange(20000000000, 99999999999)) for _ in range(100)]
    full = apply(C.verhoeff_append, stems)
    assert all(v.valid and v.penalty == 0 for v in apply(C.verhoeff_check, full))
    changed = []
    for number in full:
        at = rng.randrange(1, 12)
        changed.append(number[:at] + str((int(number[at]) + rng.randrange(1, 10)) % 10) + number[at + 1:])
    assert not any(v.valid for v in apply(C.verhoeff_check, changed))
    assert {v.penalty for v in apply(C.verhoeff_check, changed)} == {30}


def test_luhn(apply):
    assert apply(C.luhn_check, ["4539 1488 0343 6467", "8273 1232 7352 0569", ""]) == [True, False, True]


def test_mask(apply):
    assert apply(X.mask_id, ["123456789012", "12"]) == ["****9012", "****12"]


def test_parse_date(apply):
    day = datetime.date
    assert apply(D.parse_date, ["31/01/2000", "31-01-2000", "2000-01-31", "31/02/2000", "31/01-2000", " 01/02/2003 ", "", None, "001/02/2003"]) == [
        day(2000, 1, 31), day(2000, 1, 31), day(2000, 1, 31), None, None, day(2003, 2, 1), None, None, None]


@pytest.mark.parametrize("score,band", [(29.99, "clean"), (30.0, "suspicious"), (59.99, "suspicious"), (60.0, "tampered"), (None, "suspicious")])
def test_ela_edges(apply, score, band):
    assert apply(B.ela_band, [score], "a double") == [band]


@pytest.mark.parametrize("score,band", [(79.99, "blurry"), (80.0, "slightly_blurry"), (199.99, "slightly_blurry"), (200.0, "sharp"), (None, "slightly_blurry")])
def test_blur_edges(apply, score, band):
    assert apply(B.blur_band, [score], "a double") == [band]


def test_failed_measures_take_their_defaults(apply):
    assert apply(B.ela_value, [None, 12.345], "a double") == [50.0, 12.35 if round(12.345, 2) == 12.35 else 12.34]
    assert apply(B.blur_value, [None], "a double") == [0.0]


@pytest.mark.parametrize("score,status", [(29, "Likely Genuine"), (30, "Suspicious"), (59, "Suspicious"), (60, "Likely Fake / Tampered")])
def test_status_edges(apply, score, status):
    assert apply(B.status_band, [score], "a int") == [status]


def test_synthetic_vote_needs_two(apply):
    rows = [(0.36, 0.93, 0.1), (0.36, 0.5, 0.1), (0.1, 0.5, 0.41), (0.36, 0.5, 0.019), (None, None, None), (0.35, 0.92, 0.02)]
    assert apply(B.synthetic_vote, rows, "a double, b double, c double") == [
        "suspected", "not_detected", "not_detected", "suspected", "not_detected", "not_detected"]


def test_metadata_first_rule_wins(apply):
    rows = [(".PDF", "present", "Photoshop", "", ""), (".jpg", "absent", "GIMP", "", ""), (".jpg", "corrupt", "", "", ""),
            (".jpg", "present", "Adobe X", "a", "a"), (".jpg", "present", "", "a", "b"), (".jpg", "present", "", "", "b"),
            (".jpg", "present", None, None, "b"), (None, None, None, None, None)]
    assert apply(B.metadata_verdict, rows, "a string, b string, c string, d string, e string") == [
        "missing", "missing", "suspicious", "suspicious", "suspicious", "normal", "normal", "suspicious"]


def test_round_exact_uses_the_binary_value(apply):
    values = [0.65875, 0.03125, 2.675, 1234.5, 0.1 + 0.2, 1.015]
    assert apply(lambda c: X.round_exact(c, 2), values, "a double") == [round(v, 2) for v in values]
    assert apply(lambda c: X.round_exact(c, 4), values, "a double") == [round(v, 4) for v in values]


def test_font_verdict_levels(apply):
    rows = [(0.2, 0.2, False), (0.3, 0.2, False), (0.2, 0.9, False), (0.3, 0.2, True), (0.6, 0.4, True), (9.0, 9.0, False)]
    got = apply(lambda a, b, c: B.font_verdict(a, b, c), rows, "a double, b double, c boolean")
    assert [(g.status, g.penalty) for g in got] == [
        ("consistent", 0), ("suspicious", 10), ("inconsistent", 20), ("suspicious", 10), ("inconsistent", 20), ("inconsistent", 20)]
    assert got[-1].variance_ratio == 1.0
