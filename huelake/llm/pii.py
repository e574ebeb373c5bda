"""Surrogates for personal data.

Detected entities get keyed replacements of the same type, script, gender and format.
A replacement is a keyed permutation of all strings of the entity's format (a Feistel
network over the format's characters, conjugating a shift), so without any shared state
equal entities stay equal across the whole corpus, distinct ones stay distinct, and none
maps to itself; `replace` raises if one ever did, so no detected entity stays in a text.
Given names are permuted within the list of their gender; other names are
permuted letter by letter, and a result that falls on a listed name is permuted again, so
the two ranges cannot collide. `collisions` checks distinctness over a corpus.

Defined results: null text stays null with no spans; text without entities comes back
unchanged; case variants of an entity are one entity and keep their own case; repeated
rows are replaced one by one and alike; of overlapping entities the one that starts first
counts, of two that start together the longer; columns named pii_spans are replaced;
everything else passes through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import give_back

# Given names by usual gender, and honorifics.
FEMALE = "Agnes Alice Amanda Amelia Andrea Angela Anja Anna Barbara Beatrice Birgit Brigitte Camille Carla Carmen Caroline Catherine Charlotte Chiara Christine Claire Clara Claudia Dagmar Diana Dorothy Elena Elisabeth Elizabeth Ella Emily Emma Esther Eva Fatima Florence Francesca Gabriela Giulia Greta Hannah Heidi Helen Helga Inge Ingrid Irene Isabel Isabella Jane Jennifer Jessica Joanna Juana Julia Julie Karen Katharina Katherine Laura Lena Leonie Linda Lucia Lucy Luisa Manon Margaret Maria Marie Marta Martha Martina Mary Mathilde Monica Monika Nadia Nancy Natalie Nicole Nina Olga Olivia Patricia Paula Petra Pilar Rachel Rebecca Renate Rosa Ruth Sandra Sarah Sophie Sofia Susan Susanne Sylvie Teresa Ursula Valentina Victoria".split()
MALE = "Adam Ahmed Alan Albert Alejandro Alessandro Alexander Andreas Andrew Antoine Antonio Anthony Arthur Benjamin Bernd Bernhard Brian Bruno Carlos Charles Christian Christopher Daniel David Dieter Diego Dmitri Edward Eric Ernst Felipe Fernando Francisco Frank Franz Frederick Friedrich Gabriel George Georg Gerhard Guillaume Hans Heinrich Helmut Henri Henry Hugo Ivan Jack Jacques James Javier Jean Johann Johannes John Jorge Joseph Juan Karl Kevin Klaus Kurt Laurent Lorenzo Louis Luca Luis Manuel Marco Mark Martin Matteo Matthew Michael Michel Miguel Mohammed Nicolas Oliver Oskar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Richard Robert Roberto Rudolf Samuel Sebastian Sergio Stefan Stephen Thomas Tobias Ulrich Vincent Walter William Wolfgang Xavier Yves".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mademoiselle Señor Señora Señorita".split()
# Words behind which two capitalised words are taken as a person, and calling codes of one and two digits (all others have three).
CUES = "Dear|[Cc]ontact|[Aa]ttn|[Aa]ttention|[Nn]ame is|[Nn]amed|[Ss]igned|[Ss]igned by|[Ww]rite to|[Ww]rote to|[Aa]sk for|[Ss]peak to|[Ss]incerely|[Rr]egards|Liebe|Lieber|Cher|Chère|Estimado|Estimada|Querido|Querida"
ONE_DIGIT = "1 7".split()
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

KINDS = "email ipv6 ip iban card ssn phone secret".split()
G, V4 = "[0-9A-Fa-f]{1,4}", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
PATTERNS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]++@[\w\-]+(?:\.[\w\-]+)+",
    "ipv6": rf"(?<![\w:])(?:(?:{G}:){{7}}{G}|(?:{G}:){{6}}{V4}|(?:{G}(?::{G}){{0,6}})?::(?:(?:{G}:){{0,5}}(?:{V4}|{G}))?)(?!\w|:[\w:]|\.\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w+])\d(?:[ \-]?\d){12,18}(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\w)|(?<![\w.\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?!\w)"
    # national numbers with spaces: 555 123 4567, then those that begin with 0: 030 1234567, 020 7946 0958, 02 9374 4000, 01 23 45 67 89
    r"|(?<![\w+.\-])\d{3} \d{3} \d{4}(?!\w)|(?<![\w+.\-])0(?:\d{2,4}[ \-](?:\d{5,8}|\d{3,4}[ \-]\d{3,4})|\d \d{4} \d{4}|\d(?: \d{2}){4})(?!\w)",
    "secret": r"(?i:(?<!\w)(?:[\w\-]*(?:token|secret|password|passwd|pwd|api[_\-]?key|access[_\-]?key))\"? ?[=:] ?)[\"']?(?P<value>[^\s\"'<>,;]{7,}[^\s\"'<>,;.:!?)\]}])[\"']?|(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?!\w)",
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
SINGLE = {k: re.compile(p) for k, p in PATTERNS.items()}
CARD = SINGLE["card"]
FORMS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
#: Digits and the mark behind them; the places where a rejected span is cut; numbers as issuers give them.
GROUP = re.compile(r"(\d+)(?!\w)(?:([ \-])(?=\d))?")
NEXT = re.compile(r"[ \-:]+(?=\w)")
ISSUED = re.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|(?:5[06-9]|6\d)\d{11,17}|2[2-7]\d{14,17}|3\d{13,18}")
MAYBE = re.compile(r"[\d@]|::|(?i:token|secret|passw|pwd|key)")
NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΡΣ-ΩА-Я][\w'’\-]*"
TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? ({NAME}(?: {NAME})?)")
CUED = re.compile(rf"(?<!\w)(?:{CUES}),?:? ({NAME} {NAME})")
PAIR = re.compile(rf"(?<!\w)([A-Z][a-z]+) ({NAME})")
GIVEN = {**{n.lower(): FEMALE for n in FEMALE}, **{n.lower(): MALE for n in MALE}}

NUMBERS = ("card", "iban", "ip", "phone", "ssn")
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñðþ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
HEX = "0123456789abcdef"
# First and last letter or digit of scripts that are permuted as a whole.
RANGES = ["את", "ءي", "٠٩", "۰۹", "०९", "अह", "กฮ", "ぁゖ", "ァヺ", "가힣", "一龥", "０９", "ａｚ"]
CLASS = {c: a for a in [*ALPHABETS, *("".join(map(chr, range(ord(r[0]), ord(r[1]) + 1))) for r in RANGES)] for c in a}


@lru_cache(maxsize=1 << 14)
def alphabet(c: str) -> str | None:
    """The characters that `c`, a folded letter or digit, is permuted among: those of its class, else of its kind in its part of Unicode."""
    if c in CLASS:
        return CLASS[c]
    if not c.isalnum():
        return None
    trait = lambda x: (unicodedata.category(x), x.lower() == x == x.upper().lower())
    for span in (1 << 6, 1 << 8, 1 << 12, 1 << 16):
        first = ord(c) // span * span
        made = "".join(x for x in map(chr, range(first, first + span)) if x not in CLASS and trait(x) == trait(c))
        if len(made) > 1:
            return made
    return None


def alphabets(text: str) -> list[str | None]:
    return [alphabet(c.lower()) if len(c.lower()) == 1 else None for c in text]


class Permutation:
    """A keyed permutation of range(n) without fixed points (n of 2 or more)."""

    def __init__(self, key: bytes, label: str, n: int) -> None:
        self.key, self.label, self.n = key, label.encode("utf-8", "surrogatepass"), n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.shift = 1 + int.from_bytes(self._hash(b"shift", 0, 0), "big") % max(1, n - 1)

    def _hash(self, what: bytes, i: int, x: int) -> bytes:
        return hashlib.blake2b(b"%b|%d|%d|%b" % (what, i, x, self.label), key=self.key, digest_size=max(8, self.half // 8 + 8) if self.half < 440 else 64).digest()

    def _round(self, i: int, x: int) -> int:
        made = b"".join(self._hash(b"round%d" % k, i, x) for k in range(1 + self.half // 440))
        return int.from_bytes(made, "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, rounds: range) -> int:
        mask = (1 << self.half) - 1
        while True:
            left, right = x >> self.half, x & mask
            for i in rounds:
                left, right = right, left ^ self._round(i, right)
            x = (right << self.half) | left  # the swap makes reversed rounds the inverse
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        y = (self._walk(x, range(8)) + self.shift) % self.n
        return self._walk(y, range(7, -1, -1))


def permute_text(key: bytes, kind: str, text: str, alphabets: list[str | None]) -> str:
    """Permutes the characters that have an alphabet; case is folded and put back."""
    folded = [c.lower() if len(c.lower()) == 1 else c for c in text]
    places = [(i, a) for i, (c, a) in enumerate(zip(folded, alphabets)) if a and c in a]
    value, n = 0, 1
    for i, a in places:
        value, n = value * len(a) + a.index(folded[i]), n * len(a)
    skeleton = "".join(f"\x01{len(a)}{a[0]}" if a and c in a else c for c, a in zip(folded, alphabets))
    value = Permutation(key, kind + skeleton, n)(value)
    out = folded[:]
    for i, a in reversed(places):
        value, k = divmod(value, len(a))
        out[i] = a[k]
    return "".join(o.upper() if c != f and len(o.upper()) == 1 else o for o, c, f in zip(out, text, folded))


def luhn(digits: str) -> int:
    """What the digits' check sum lacks to a multiple of ten; the last digit counts as check digit."""
    return -sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _digits(key: bytes, kind: str, text: str, fixed: int, make=None) -> str:
    """Permutes a number's digits after the first `fixed`, whatever the marks between them."""
    digits = "".join(c for c in text if c.isdigit())
    new = permute_text(key, kind, digits, [None] * fixed + ["0123456789"] * (len(digits) - fixed))
    it = iter(make(new) if make else new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _card(key: bytes, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    new = permute_text(key, "card", digits[:-1], [None] + ["0123456789"] * (len(digits) - 2))
    new += str(luhn(new + "0"))
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _ip(key: bytes, text: str) -> str:
    octets = list(map(int, text.split(".")))
    keep = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] else 0  # private ranges stay private
    value = 0
    for o in octets[keep:]:
        value = value * 256 + o
    value = Permutation(key, f"ip{octets[:keep]}", 256 ** (4 - keep))(value)
    return ".".join(map(str, octets[:keep] + [value >> 8 * i & 255 for i in reversed(range(4 - keep))]))


def _ipv6(key: bytes, text: str) -> str:
    """Permutes the digits; an IPv4 tail stays one, and the prefixes that only announce it stay."""
    head, tail = text[: text.rindex(":") + 1], text[text.rindex(":") + 1 :]
    if "." not in tail:
        return permute_text(key, "ipv6", text, [HEX if c != ":" else None for c in text])
    known = head.lower() in ("::", "::ffff:", "64:ff9b::")
    return (head if known else permute_text(key, "ipv6", head, [HEX if c != ":" else None for c in head])) + _ip(key, tail)


def _is_ipv6(text: str) -> bool:
    """Whether it is an address; a compressed one begins with a whole group, as all assigned to hosts do, unlike 1::2 or ::1."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return "::" not in text or "." in text or len(text.split(":")[0]) == 4


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    plain = text.replace(" ", "")
    body = permute_text(key, "iban" + plain[:2], plain[4:], ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" for c in plain[4:]])
    it = iter(plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(it) for c in text)


def _name(key: bytes, name: str) -> str:
    known = GIVEN.get(name.lower())
    if known:
        made = known[Permutation(key, "given" + known[0], len(known))([n.lower() for n in known].index(name.lower()))]
        return made.upper() if name.isupper() and len(name) > 1 else made
    made = name
    while True:
        made = permute_text(key, "name", made, alphabets(made))
        if made.lower() not in GIVEN:
            break
    return made if made != name else permute_text(key, "other name", name, alphabets(name))  # the names between led back to it


def calling_code(digits: str) -> int:
    """The digits of a full number that are its country's."""
    return 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3


def _scripted(key: bytes, kind: str, text: str) -> str:
    """The surrogate of a number with digits of other scripts: that of the plain number, in the same scripts."""
    zeros = [ord(c) - int(c) if c.isdecimal() else 0 for c in text]  # a script's ten digits follow each other
    made = surrogate(key, kind, "".join(str(int(c)) if z else c for c, z in zip(text, zeros)))
    if len(made) != len(text):  # octets of an address grow and shrink: the first digit's script
        zeros = [next(filter(None, zeros))] * len(made)
    return "".join(chr(z + int(c)) if z and c.isdecimal() else c for c, z in zip(made, zeros))


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The replacement of one entity."""
    if kind in NUMBERS and any(c.isdecimal() and not c.isascii() for c in text):
        return _scripted(key, kind, text)
    if kind == "email":
        at = text.rindex(".")
        made = permute_text(key, kind, text[:at], alphabets(text[:at]))
        if made == text[:at]:  # no letter and no digit in it
            made = permute_text(key, kind, made, ["_-" if c in "_-" else None for c in made])
        return made + text[at:]
    if kind == "ip":
        return _ip(key, text)
    if kind == "ipv6":
        return _ipv6(key, text)
    if kind == "card":
        return _card(key, text)
    if kind == "iban":
        return _iban(key, text)
    if kind == "ssn":
        return _digits(key, kind, text, 0)
    if kind == "phone":
        return _digits(key, kind, text, calling_code(_digits_of(text)) if text.startswith("+") else 1)
    if kind == "secret":
        hexes = re.fullmatch(r"(?=.*\d)(?:[0-9a-f]+|[0-9A-F]+)", text)
        return permute_text(key, kind, text, [HEX] * len(text) if hexes else alphabets(text))
    return _name(key, text)


@lru_cache(maxsize=1 << 14)
def _remembered(key: bytes, kind: str, text: str) -> str:
    """The surrogate of a short entity; a worker meets the same ones often."""
    return surrogate(key, kind, text)


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "ipv6":
        return _is_ipv6(text)
    if kind == "card":
        return luhn("".join(c for c in text if c.isdigit())) == 0
    if kind == "iban":
        return len(text.replace(" ", "")) >= 15 and _iban_rest(text.replace(" ", "")) == 1
    if kind == "secret":  # rows of marks hide nothing
        return any(c.isalnum() for c in text)
    return True


def _digits_of(text: str) -> str:
    return "".join(str(int(c)) for c in text if c.isdigit())


def _cards(text: str, start: int, end: int, usual: bool = True) -> list[tuple[tuple[bool, bool, int], int, int]]:
    """((known issuer, common form, digits), start, end) of the valid cards that begin at `start`, in the usual form or any."""
    out, lengths, mark, n, at = [], [], None, 0, start
    while m := GROUP.match(text, at, end):
        n += len(m[1])
        if n > 19:
            break
        lengths.append(len(m[1]))
        at = m.end(1)
        digits = _digits_of(text[start:at]) if n >= 13 else ""
        if digits and luhn(digits) == 0:
            known = bool(ISSUED.fullmatch(digits))
            if known or lengths == [4] * 4:  # 16 digits come before 19, whose last three are rather a code
                out.append(((known, lengths in FORMS or len(lengths) == 1, n), start, at))
        # groups before the last have four digits or more, and one kind of mark stands between them
        if not m[2] or (usual and (lengths[-1] < 4 or (mark and m[2] != mark))):
            break
        mark, at = m[2], m.end()
    return out


def _resolved(text: str, kind: str, start: int, end: int, stop: int) -> tuple[str, int, int] | None:
    """The entity at the start of a span of `kind`, which is a card or failed its check: a shorter one, or one of a later kind."""
    if kind == "iban":
        for b in sorted({start + m.start() for m in re.finditer(" ", text[start:end])}, reverse=True):
            if _valid(kind, text[start:b]):
                return kind, start, b
    if cards := _cards(text, start, stop) if CARD.match(text, start, stop) else []:
        best = max(cards, key=lambda c: c[0])
        for m in GROUP.finditer(text, start, best[2]):  # another may begin in this one: the year in '2024 4952 ...' is none of its digits
            if m.start() > start:
                best = max([best, *_cards(text, m.start(), stop)], key=lambda c: c[0])
        return "card", best[1], best[2]
    for other in list(PATTERNS)[list(PATTERNS).index(kind) + 1 :]:
        m = SINGLE[other].match(text, start, stop)
        if m and other != "card":
            a, b = m.span("value") if other == "secret" and m["value"] else m.span()
            if _valid(other, text[a:b]):
                return other, a, b
    m = CARD.match(text, start, stop)
    later = [c for g in GROUP.finditer(text, start, m.end()) if g.start() > start for c in _cards(text, g.start(), stop) if c[0][0]] if m else []
    if later:
        return "card", *max(later, key=lambda c: c[0])[1:]
    if m and _valid("card", m[0]):
        return "card", *m.span()
    odd = [c for c in _cards(text, start, stop, usual=False) if c[0][0]] if m else []
    return ("card", *max(odd)[1:]) if odd else None


def _found(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds but people. Behind a failed check the search goes on at the next group."""
    found, parts = [], [(0, len(text))]
    while parts:
        at, stop = parts.pop()
        while m := FINDER.search(text, at, stop):
            kind = next(k for k in KINDS if m[k] is not None)
            a, b = m.span("value") if kind == "secret" and m["value"] else m.span()
            if kind == "card" or not _valid(kind, text[a:b]):
                if not (span := _resolved(text, kind, a, b, stop)):
                    after = NEXT.search(text, a, b)
                    at = after.end() if after else b
                    continue
                if span[1] > a:
                    parts.append((a, span[1]))
                kind, a, b = span
                found.append(span)
                at = b
            else:
                found.append((kind, a, b))
                at = m.end()
    return found


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities, in order and without overlaps."""
    found = _found(text) if MAYBE.search(text) else []
    people = [m.span(1) for regex in (TITLED, CUED) for m in regex.finditer(text)] + [m.span() for m in PAIR.finditer(text) if m[1].lower() in GIVEN]
    if people:
        parts = {w for a, b in people for w in text[a:b].split(" ")}
        mention = re.compile(rf"(?<![\w'’\-])(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?![\w’\-])")
        found += [("person", *m.span()) for m in mention.finditer(text)]  # later mentions too
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, end, surrogate) with places in the original."""
    spans = [(kind, a, b, (_remembered if b - a <= 64 else surrogate)(key, kind, text[a:b])) for kind, a, b in detect(text)] if text else []
    if not spans:
        return text, []
    out, at = [], 0
    for kind, a, b, new in spans:
        if new == text[a:b]:
            raise ValueError(f"an entity of kind {kind} has no surrogate but itself")
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], spans


SPANS = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("surrogate", "string"))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def replace_pii(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """`docs` with surrogates in `text`, and pii_spans. One pass, no shuffle, no state."""
    plain = docs.drop("pii_spans")
    at = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [replace(t.as_py(), key) for t in batch.column(at)]
            columns = batch.columns
            columns[at] = pa.array([m[0] for m in made], pa.string())
            spans = [[dict(zip(("kind", "start", "end", "surrogate"), s)) for s in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, ARROW_SPANS)], [*batch.schema.names, "pii_spans"])
        give_back()

    schema = StructType([*plain.schema.fields, StructField("pii_spans", SPANS)])
    return plain.mapInArrow(run, schema)


def collisions(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """(kind, entities, surrogates, shared): distinct entities and surrogates of each kind, and surrogates
    that stand for two entities or more; none are expected. Entities leave their text as hashes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for t in batch.column(0):
                value = t.as_py()
                pairs.update((kind, hashlib.blake2b(value[a:b].lower().encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), new.lower()) for kind, a, b, new in replace(value, key)[1])
            made = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.string()) for k in range(3)], ["kind", "entity", "surrogate"])

    pairs = docs.select(F.col(text)).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    each = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities"))
    return each.groupBy("kind").agg(F.sum("entities").alias("entities"), F.count(F.lit(1)).alias("surrogates"), F.count_if(F.col("entities") > 1).alias("shared"))
