"""Personal data whose neighbours make the longest candidate fail its check."""

import random
import time

import pytest

from huelake.llm import pii

KEY = b"k"
CARD = "4952 9359 0025 3052"
IBANS = ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "SE45 5000 0000 0583 9825 7466", "CZ65 0800 0000 1920 0014 5399"]


def found(text):
    return [(kind, text[a:b]) for kind, a, b in pii.detect(text)]


@pytest.mark.parametrize("before,after", [("", " 12/27"), ("", " 123"), ("2024 ", ""), ("123 ", ""), ("12 ", " 12/27"), ("", " 12 27 123"), ("7 - ", "-1"), ("", " 4"), ("", ", 12")])
@pytest.mark.parametrize("card", [CARD, CARD.replace(" ", "-"), CARD.replace(" ", ""), "3782 822463 10005"])
def test_card_beside_numbers(card, before, after):
    assert ("card", card) in found(f"{before}{card}{after}")
    assert card not in pii.replace(f"pay {before}{card}{after} now", KEY)[0]


def test_random_cards_beside_years():
    rng = random.Random(1)
    for _ in range(2000):
        digits = str(rng.choice([4, 51, 55, 6])) + "".join(rng.choice("0123456789") for _ in range(14))
        digits = digits[:15] + str(pii.luhn(digits[:15] + "0"))
        card = " ".join(digits[i : i + 4] for i in range(0, 16, 4))
        assert found(f"{rng.randrange(1900, 2030)} {card} x") == [("card", card)]
        covered = found(f"{card} {rng.randrange(1, 13):02d}/27")
        assert len(covered) == 1 and card in covered[0][1]


def test_phones_and_cards_in_a_row():
    assert found("555-123-4567 555-987-6543") == [("phone", "555-123-4567"), ("phone", "555-987-6543")]
    assert found("555-123-4567 2024") == [("phone", "555-123-4567")]
    assert found(f"555-123-4567 {CARD}") == [("phone", "555-123-4567"), ("card", CARD)]
    assert found(f"{CARD} 4111 1111 1111 1111 123-45-6789") == [("card", CARD), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789")]
    assert found("1234567 123-45-6789") == [("ssn", "123-45-6789")]


@pytest.mark.parametrize("iban", IBANS)
@pytest.mark.parametrize("after", [" BIC", " 7", " EUR 20", " BANKING", " I", ""])
def test_iban_before_capitals_and_digits(iban, after):
    assert found(f"to {iban}{after}.") == [("iban", iban)]
    assert found(f"AB13 {iban.replace(' ', '')}{after}.") == [("iban", iban.replace(" ", ""))]


def test_numbers_in_rows_stay_linear():
    start = time.monotonic()
    for text in ("1 " * 50_000, "4952-" * 20_000, "AB12 " * 20_000, "555-123-4567 " * 10_000):
        pii.detect(text)
    assert time.monotonic() - start < 20
