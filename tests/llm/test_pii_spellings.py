"""The usual spellings of IPv6 addresses and national phone numbers."""

import ipaddress

import pytest

from huelake.llm import pii

KEY = b"k"


def found(text):
    return [(kind, text[a:b]) for kind, a, b in pii.detect(text)]


@pytest.mark.parametrize("text", ["2001:db8::1", "fe80::1", "2001:DB8:0:1::", "2001:db8:1:2:3:4:5::", "dead::beef", "::ffff:192.0.2.33", "64:ff9b::8.8.4.4", "2001:db8::203.0.113.7", "2001:db8:1:2:3:4:8.8.4.4", "2001:0db8:0:0:0:0:0:1"])
def test_ipv6(text):
    for around in ("{}", "at {}, then", "[{}]:443", "host {}: up", "ends with {}."):
        given = around.format(text)
        assert found(given) == [("ipv6", text)]
        new, spans = pii.replace(given, KEY)
        made = spans[0][3]
        assert ipaddress.IPv6Address(made) and made != text and text not in new and found(new) == [("ipv6", made)]
        assert pii.surrogate(KEY, "ipv6", text.upper()).lower() == made.lower()


@pytest.mark.parametrize("text", ["x[1::2] and y[::3]", "std::cafe a::b ::1 ::", "at 12:30:45", "12:30::45", "Face::Book", "2001:db8:::1", "::ffff:999.1.1.1"])
def test_no_ipv6(text):
    assert not [x for x in found(text) if x[0] == "ipv6"]


@pytest.mark.parametrize("text", ["555 123 4567", "030 1234567", "020 7946 0958", "0161 496 0000", "02 9374 4000", "01 23 45 67 89", "0171-1234567", "555-123-4567"])
def test_national_phones(text):
    for around in ("{}", "call {}, now", "{} 2024", "2024 {}", "{0} {0}", "card 4952 9359 0025 3052 {}"):
        given = around.format(text)
        assert text not in pii.replace(given, KEY)[0] and any(text in x for _, x in found(given))
    assert found(text) == [("phone", text)]
    made = pii.surrogate(KEY, "phone", text)
    assert made != text and made[0] == text[0] and len(made) == len(text)


@pytest.mark.parametrize("text", ["2024-01-02 12:30", "0.5 100 200", "pages 100 200 300", "01-02-2024", "007 12 3"])
def test_no_phone(text):
    assert found(text) == []
