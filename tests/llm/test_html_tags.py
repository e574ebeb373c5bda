"""Tags with stray quotes end where a browser ends them; html.parser's tokens are the other opinion."""

import random
import time
from html.parser import HTMLParser

import pytest

from huelake.llm import htmltext


@pytest.mark.parametrize("html,text", [
    ('<a href="1"">One</a> <a href="2"">Two</a>', "One Two"), ("<a title='it's'>One</a> <b>Two</b>", "One Two"), ("<a title=it's>One</a> <i title=5\">Two</i>", "One Two"),
    ('<p ">One</p><p>"Two"', 'One\n\n"Two"'), ("<p \"a>b\">One", 'b">One'), ('<p title="a>b" \'>One', "One"), ("<p title = 'a>b'x=\"c>d\">One", "One"), ("<p title=>One", "One"), ("<p =\">One</p>\"", 'One\n\n"'),
    ("a<p hidden\">b</p>c", "a\n\nb\n\nc"), ("a<p hidden \">b</p>c", "ac"), ('</p title=">">One', "One"), ("<b>One</b \">Two", "OneTwo"), ("One<a href=\"2>Two", "One"), ("One<a href='2", "One"), ("<br/>One<br / >Two", "One\nTwo"),
])
def test_stray_quotes(html, text):
    assert htmltext.page_text(html).strip() == text


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_data(self, data):
        self.seen.append(data)


def test_random_tags_equal_the_standard_library():
    rng = random.Random(5)
    for _ in range(3000):
        tags = "".join("<b" + "".join(rng.choice([' a="1"', " a='2'", " a=3", ' "', " '", '"', "'", " a", "=", " /", " x=y'z", " ='"]) for _ in range(rng.randrange(4))) + f">w{i} " for i in range(4))
        html = tags + "<i a=\"'\">end</i><i a='\"'>.</i>"
        plain = Plain()
        plain.feed(html)
        plain.close()
        made = htmltext.page_text(html)
        assert made.split() == "".join(plain.seen).split(), html


def test_open_quotes_stay_linear():
    start = time.monotonic()
    for html in ('<a href="' * 50_001, "<a ' \" =" * 50_000, "<a" + " x" * 100_000, "<a x=" * 50_000):
        htmltext.page_text(html)
    assert time.monotonic() - start < 10
