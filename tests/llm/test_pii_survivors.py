"""No detected entity survives, and equal entities stay equal over a corpus."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from huelake.llm import pii

KEY = b"k"
LETTERS = st.characters(categories=["Lu", "Ll", "Lo", "Nd", "Nl"])


@pytest.mark.parametrize("text", ["+14155551234", "+442079460958", "+1415 555 1234", "+1 (415) 555-1234", "+49-89-1234567", "+351912345678", "+35 1 23", "0170 1234567", "555 123 4567", "(555) 123-4567"])
def test_phone_numbers_change_behind_the_calling_code(text):
    made, spans = pii.replace(f"call {text} now", KEY)
    assert [s[0] for s in spans] == ["phone"] and len(made) == len(text) + 9 and text not in made
    digits = "".join(c for c in text if c.isdigit())
    new = "".join(c for c in made if c.isdigit())
    fixed = {"1": 1, "44": 2, "49": 2, "351": 3} if text[0] == "+" else {digits[0]: 1}
    code = next(c for c in sorted(fixed, key=len, reverse=True) if digits.startswith(c))
    assert new.startswith(code) and new[len(code) :] != digits[len(code) :]
    assert re.sub(r"\d", "0", made) == re.sub(r"\d", "0", f"call {text} now")


def test_spellings_of_one_number_share_digits():
    one, two = (pii.surrogate(KEY, "phone", t) for t in ("+14155551234", "+1 415 555-1234"))
    assert "".join(c for c in one if c.isdigit()) == "".join(c for c in two if c.isdigit())


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS, min_size=1, max_size=12), st.text(LETTERS, min_size=1, max_size=12))
def test_emails_of_every_script_change(local, domain):
    text = f"{local}@{domain}.com"
    found = [(a, b) for kind, a, b in pii.detect(text) if kind == "email"]
    for a, b in found:
        made = pii.surrogate(KEY, "email", text[a:b])
        assert made != text[a:b] and len(made) == b - a and made.endswith(".com")


@settings(max_examples=150, deadline=None)
@given(st.one_of(
    st.from_regex(r"\+[1-9][0-9]{6,13}", fullmatch=True).map(lambda t: ("phone", t)), st.from_regex(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", fullmatch=True).map(lambda t: ("ssn", t)),
    st.tuples(*[st.integers(0, 255)] * 4).map(lambda t: ("ip", ".".join(map(str, t)))), st.from_regex(r"[0-9a-f]{4}(?::[0-9a-f]{1,4}){7}", fullmatch=True).map(lambda t: ("ipv6", t)),
    st.from_regex(r"[A-Za-z0-9+/_!#-]{7,20}[a-z0-9]", fullmatch=True).map(lambda t: ("secret", t)), st.from_regex(r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿ]{0,9}", fullmatch=True).map(lambda t: ("person", t)),
))
def test_surrogates_differ_from_their_entities(item):
    assert pii.surrogate(KEY, *item) != item[1]


def test_an_entity_that_would_survive_is_an_error(monkeypatch):
    monkeypatch.setattr(pii, "_remembered", lambda key, kind, text: text)
    with pytest.raises(ValueError, match="itself"):
        pii.replace("write 555-123-4567", KEY)


@pytest.mark.parametrize("text,hidden", [("write to Xavier Dupont soon", "Dupont"), ("pwd=p@ssw0rd!x", "ssw0rd"), ("Dear Zorblax Quuxley, hi", "Zorblax"), ("secret: a1b2c3d4.", "a1b2c3d4")])
def test_wider_detection(text, hidden):
    assert hidden not in pii.replace(text, KEY)[0]


def test_rows_of_marks_are_no_secrets():
    assert pii.replace("password: -------- and token = ________", KEY)[1] == []


def test_coreference_and_distinctness_over_a_corpus(spark):
    rng = random.Random(3)
    phones = [f"+1 415 555 {i:04d}" for i in range(40)]
    mails = [f"{x}{i}@host{i % 5}.example.org" for i in range(30) for x in "ab"]
    people = [f"Mr. John Q{a}{b}rst" for a in "aeiou" for b in "xyz"]
    things = phones + mails + people
    texts = [" and then ".join(rng.choice(things) for _ in range(rng.randint(1, 6))) for _ in range(300)] + [None, "", "word " * 60000 + mails[0], mails[0]]
    docs = spark.createDataFrame([(i % 290, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii_spans int")  # ids repeat
    of, back = defaultdict(set), defaultdict(set)
    for row, text in zip(pii.replace_pii(docs.coalesce(1), KEY).collect(), texts):
        for kind, a, b, new in row.pii_spans if text else []:
            entity = (kind, text[a:b].lower())
            of[entity].add(new.lower())
            back[kind, new.lower()].add(entity)
            assert new != text[a:b]
    assert all(len(x) == 1 for x in of.values()) and all(len(x) == 1 for x in back.values())
    made = {r.kind: tuple(r)[1:] for r in pii.collisions(docs, KEY).collect()}
    for kind in {k for k, _ in of}:
        n = sum(k == kind for k, _ in of)
        assert made[kind] == (n, n, 0)
    twice = pii.replace_pii(docs.union(docs), KEY).groupBy("doc_id", "text").count()
    assert all(r["count"] % 2 == 0 for r in twice.collect())
