"""Quality rules, mixing, packing, surrogates, HTML text, and the learnt classifiers."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from huelake.llm import htmltext, langid, mixing, packing, pii, quality, toxicity

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "x", "a b", "  nbsp word", "é" * 3000, "word " * 9000, "퟿\U0001f600 ok", "same line\nsame line\n\nsame line", "a b c d e f g h i " * 4]


def documents(spark, texts, sources=None, **more):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


# ---- quality rules ----


def slow_measure(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab#", "\n", "\t", "é"]), max_size=60).map(" ".join))
def test_measures_equal_brute_force(text):
    assert quality.measure(text) == slow_measure(text)


def test_quality_over_odd_rows(spark):
    made = {r.doc_id: r for r in quality.judge(documents(spark, ODD, n_words="clash", host=1)).collect()}
    for i, text in enumerate(ODD):
        assert tuple(made[i][m] for m in quality.MEASURES) == slow_measure(text)
    assert quality.judge(documents(spark, ODD).limit(0)).count() == 0
    twice = documents(spark, ODD).union(documents(spark, ODD))
    assert quality.judge(twice).count() == 2 * len(ODD)


def test_bad_host_takes_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [good] * 30 + ["short"] * 19 + [good] + ["short", good]
    sources = ["fine"] * 30 + ["bad"] * 20 + [None, None]
    made = {r.doc_id: r for r in quality.judge(documents(spark, texts, sources)).collect()}
    assert all(made[i].kept for i in range(30)) and not made[49].base_failed and not made[49].kept
    assert not made[50].kept and made[51].kept
    assert 0.5 < made[49].rate_too_short < 0.95  # shrunk below the plain rate


def test_salted_join_equals_broadcast(spark):
    from huelake.llm.common import attach

    left = spark.createDataFrame([(i, "ab"[i % 2] if i else None) for i in range(50)], "doc_id long, k string")
    table = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    assert sorted(attach(left, table, "k", "doc_id").collect(), key=str) == sorted(attach(left, table, "k", "doc_id", limit=0).select("k", "doc_id", "v").collect(), key=str)


# ---- mixing ----


def shares(sizes):
    whole = sum(sizes)
    return [s / whole for s in sizes]


def slow_exponent(sizes, entropy):
    lo, hi = 0.0, 1.0
    def h(t):
        w = [p**t for p in shares(sizes)]
        return -sum(x / sum(w) * np.log(x / sum(w)) for x in w)
    if h(1.0) >= entropy:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if h(mid) >= entropy else (lo, mid)
    return lo


def test_weights_meet_the_entropy(spark):
    sizes = {"a": 900, "b": 60, "c": 40}
    docs = documents(spark, ["w " * 10] * 100, [s for s, n in sizes.items() for _ in range(n // 10)], mix_tokens="clash")
    made = mixing.mix(docs, entropy_ratio=0.9, max_repeats=1000, block_tokens=100).toPandas()
    t = slow_exponent(sizes.values(), 0.9 * np.log(3))
    w = np.array([p**t for p in shares(sizes.values())])
    for source, weight in zip(sizes, w / w.sum()):
        assert made[made.source == source].mix_weight.iloc[0] == pytest.approx(weight, abs=1e-6)
    tokens = made.groupby("source").mix_tokens.sum()
    assert np.allclose(tokens / tokens.sum(), w / w.sum(), atol=0.02)
    assert set(made.doc_id) == set(range(100))  # the least budget that holds every document
    for _, block in made.groupby(["source", "mix_block", "mix_epoch"]):
        assert sorted(block.mix_position) == list(range(1, len(block) + 1)) and block.doc_id.is_unique


def test_repetition_limit_and_budget(spark):
    docs = documents(spark, ["w " * 10] * 100, ["a"] * 90 + ["b"] * 10)
    made = mixing.mix(docs, entropy_ratio=1.0, max_repeats=2.0).toPandas()
    assert made.groupby("doc_id").size().max() <= 2 and made.mix_rate.max() <= 2.0 + 1e-6
    half = mixing.mix(docs, entropy_ratio=0.0, budget=500, block_tokens=1 << 20).toPandas()
    assert abs(half.mix_tokens.sum() - 500) <= 20


def test_mixing_odd_rows(spark):
    made = mixing.mix(documents(spark, ODD, [None, *["s"] * (len(ODD) - 2), None]), entropy_ratio=0.5).toPandas()
    assert set(made.doc_id) >= {3, 4, 5, 6, 7, 8, 9, 10}
    assert mixing.mix(documents(spark, ODD).limit(0)).count() == 0
    assert mixing.mix(documents(spark, [None, "", " "])).count() == 0
    same = documents(spark, ["a b"] * 5)
    assert mixing.mix(same.union(same)).count() == 10


# ---- packing ----


def check_pieces(lengths, pieces, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert n > 0
        by_doc[d].append((start, n))
        by_sequence[s].append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc[d]):
            assert start == at
            at += k
        assert at == n
    for parts in by_sequence.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at == capacity or at & (at - 1) == 0  # nothing is padded


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=80))
def test_every_token_is_packed_once(lengths):
    check_pieces(lengths, packing.pack(np.array(lengths), 64), 64)


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 2000)
    spent = Counter()
    for _, _, n, s, _ in packing.pack(lengths):
        spent[s] += packing.cost(n)
    values = np.array(list(spent.values()))[: int(lengths.sum() // packing.CAPACITY)]
    assert values.std() / values.mean() < 0.15


def test_ids_equal_the_tokenizer(spark):
    path = public.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = [*ODD, "Don't. 3.5, é. İ. ΣΑΣ, <|endoftext|>x, a\x85b", "ABC abc, abc. Abc.. ,"]
    made = packing.WordTokenizer(path).encode(texts)
    for t, ids in zip(texts, made):
        assert ids.tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
    small = packing.WordTokenizer(path, memory=1)  # starts afresh with every call
    assert [small.encode([t])[0].tolist() for t in texts] == [m.tolist() for m in made]
    rows = packing.pack_documents(documents(spark, texts, length=1).union(documents(spark, texts, length=1)), path, group_tokens=5000).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == {i: 2 for i in range(len(texts))}
    for r in rows:
        piece = made[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(piece.astype("<u4").tobytes()) and r.doc_tokens == len(made[r.doc_id])
    for _, parts in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(documents(spark, texts).limit(0), path).count() == 0


# ---- personal data ----

KEY = b"k"


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutations(n):
    p = pii.Permutation(KEY, "x", n)
    made = [p(i) for i in range(n)]
    assert sorted(made) == list(range(n)) and all(i != m for i, m in enumerate(made))
    assert made != [pii.Permutation(b"other", "x", n)(i) for i in range(n)] or n == 2


@pytest.mark.parametrize("kind,text,shape", [
    ("email", "anna.19@mail5.example.com", r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com"), ("ip", "227.5.221.1", r"\d+\.\d+\.\d+\.\d+"), ("ip", "10.1.2.3", r"10\.\d+\.\d+\.\d+"),
    ("ipv6", "2001:0db8:0:0:0:0:0:1", r"[0-9a-f]{4}:[0-9a-f]{4}:.*"), ("card", "4952 9359 0025 3052", r"4\d{3} \d{4} \d{4} \d{4}"), ("ssn", "123-45-6789", r"\d{3}-\d{2}-\d{4}"),
    ("phone", "+1 (743) 555-3824", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("secret", "0cab398dc11d1a2a11dc6572c8df8bd228c864f3", r"[0-9a-f]{40}"), ("iban", "DE89 3704 0044 0532 0130 00", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
])
def test_surrogates_keep_type_and_format(kind, text, shape):
    prefix = "token = " if kind == "secret" else "see "
    made, spans = pii.replace(f"{prefix}{text}, and {text.upper()}!!" if kind == "email" else f"{prefix}{text}, and", KEY)
    assert [s[0] for s in spans][:1] == [kind] and text not in made
    new = spans[0][3]
    assert re.fullmatch(shape, new) and pii._valid(kind, new)
    if kind == "email":
        assert len(spans) == 2 and spans[1][3].lower() == new.lower()
    assert pii.replace(f"{prefix}{text}, and", KEY)[0] == pii.replace(f"{prefix}{text}, and", KEY)[0]


@pytest.mark.parametrize("text", ["+49 ٣٣ ٣٣٣٣", "١٠.2.٣.4", "٤111 1111 1111 1111", "١٢٣-٤٥-٦٧٨٩", "张伟@公司.cn", "ёж９@בית.ru", "한국1@例え.jp"])
def test_surrogates_of_other_scripts(text):
    plain = "".join(str(int(c)) if c.isdecimal() else c for c in text)
    (new, spans), (same, _) = pii.replace(f"a {text} b", b"k"), pii.replace(f"a {plain} b", b"k")
    made = new[2:-2]
    assert len(spans) == 1 and made != text and pii.detect(new) == [(spans[0][0], 2, 2 + len(made))]
    if "@" in text:  # every letter and digit is permuted within its script
        assert len(made) == len(text) and all(pii.CLASS.get(a) == pii.CLASS.get(b) for a, b in zip(text, made)) and all(c in pii.CLASS for c in text if c not in "@.")
    else:  # one number in two scripts is one entity
        assert "".join(str(int(c)) if c.isdecimal() else c for c in made) == same[2:-2] and any(not c.isascii() for c in made)


def test_people_keep_gender_and_coreference():
    made, spans = pii.replace("Mr. John Smithson met Mary Jonesby. Smithson left; JOHN stayed.", KEY)
    new = {made_: kind for kind, *_, made_ in spans}
    assert set(new.values()) == {"person"} and "Smithson" not in made and "Mary" not in made
    words = re.findall(r"\w+", made)
    assert words[1] in pii.MALE and words[4] in pii.FEMALE and words[2] == words[6]
    assert len({words[1], words[2], words[4], words[5]}) == 4


def test_clean_text_is_left_alone():
    for text in (None, "", "An 1234567890123456 order of 3.5, at 12:30 on 2024-01-02.", "The and Is that.", "version 1.2.3.4.5 and 999.1.1.1"):
        assert pii.replace(text, KEY) == (text, [])


def test_pii_over_rows(spark):
    rng = random.Random(4)
    texts = [f"mail u{i}.x@h{rng.randrange(9)}.example.com and {rng.randrange(256)}.7.8.{i}" for i in range(60)] + ODD
    docs = documents(spark, texts, pii_spans="clash")
    made = pii.replace_pii(docs, KEY)
    assert made.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") + ["pii_spans"]
    rows = {r.doc_id: r for r in made.collect()}
    assert [rows[60 + i].text for i in range(len(ODD))] == ODD
    assert all(len(rows[i].pii_spans) == 2 for i in range(60))
    assert all(r.entities == r.surrogates and r.shared == 0 for r in pii.collisions(docs, KEY).collect())
    assert pii.replace_pii(docs.limit(0), KEY).count() == 0


# ---- HTML ----


@pytest.mark.parametrize("html,text", [
    (None, None), ("", ""), ("plain &amp; <b>bold</b>\n text", "plain & bold text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"), ("<pre>\n a\n   b</pre>", " a\n   b"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name       Qty\nApple pie  3"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<style>p{}</style><script>var t='</p>'</script><p hidden>h</p><p style='display: none'>n</p><!-- c --><p>v", "v"),
    ("<title>t</title><body><div>a</div><div>b</div>", "a\nb"), ("<b>x<p>y</b>z", "x\n\nyz"), ("1 < 2 <", "1 < 2 <"), ("<dl><dt>T<dd>D</dl>", "T\n    D"), ("<table>out<tr><td>in</table>", "out\n\nin"),
])
def test_rendering(html, text):
    assert htmltext.page_text(html) == text


def test_deep_and_broken_pages(spark):
    assert htmltext.page_text("<div>" * 20000 + "deep") == "deep"
    assert htmltext.page_text("<table>" * 300 + "x").strip() == "x"
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r.page_id, r.text) for r in htmltext.extract(pages).collect()) == [(1, "a"), (1, "a"), (2, None)]
    assert htmltext.extract(pages.limit(0)).count() == 0


# ---- language ----


def all_cuts(word, prob, index):
    text = "▁" + word
    total = 0.0
    for mask in itertools.product((0, 1), repeat=len(text) - 1):
        parts, part = [], text[0]
        for c, cut in zip(text[1:], mask):
            parts, part = ([*parts, part], c) if cut else (parts, part + c)
        p = 1.0
        for x in [*parts, part]:
            p *= prob[index[x]] if x in index else prob[-1] if len(x) == 1 else 0.0
        total += p
    return total


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abb"])
    index = {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(1)
    prob = rng.random((len(pieces) + 1, 2))
    words = ["a", "abba", "bab", "xaby", "b"]
    made = np.exp(langid.Lattice(words, index, 3).totals(np.log(prob)))
    assert np.allclose(made, [[all_cuts(w, prob[:, k], index) for k in range(2)] for w in words])


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": "the of and thing other which".split(), "de": "der und nicht eine schön über".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(20)), g, "s", 0) for i, g in enumerate(["en", "de"] * 40)]
    odd = [(100 + i, t, None, None, None) for i, t in enumerate([*ODD, "12 34 !", "schön " * 30 + "ß" * 100])]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("clash"))
    path = public.path("piece_bpe_32k.model")
    made = {r.doc_id: r for r in langid.identify(docs, path, learn=F.col("doc_id") < 60).collect()}
    assert all(made[i].lang_pred == g and 0.9 < made[i].score <= 1 for i, _, g, *_ in rows)
    assert [made[100 + i].lang_pred for i in (0, 1, 2, len(ODD))] == ["und"] * 4 and made[100].score == 0
    assert made[100 + len(ODD) + 1].lang_pred == "de"
    assert {r.lang_pred for r in langid.identify(docs, path, learn=F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), path).count() == 0


# ---- toxicity ----


def test_toxicity(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["wretch", "goblinface", "zounderkite"]
    rows, labels = [], []
    for i in range(1600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    extra = [(1000, "well a goblinfase and a zounderkyte here", "en", "s", 0), (1001, None, None, None, None), (1002, "", "en", "s", 0), (1003, " ".join(rng.choice(plain) for _ in range(20000)), "en", "s", 0)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    made = {r.doc_id: r.score for r in toxicity.score(docs, marks, learn=F.col("doc_id") % 3 != 1).collect()}
    held = [i for i in range(1600) if i % 3 == 1]
    assert np.mean([made[i] >= 0.7 for i in held if i % 4 == 0]) > 0.9 and np.mean([made[i] >= 0.7 for i in held if i % 4]) < 0.05
    assert made[1000] > 0.7 and made[1001] == made[1002] == 0 and made[1003] < 0.7
    assert {r.score for r in toxicity.score(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_file_gives_its_own_ids(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path(name))
    texts = [*ODD, "Two  spaces, tabs\tand\nlines. 'quoted' don't", "UPPER lower nbsp"]
    tokenizer = packing.WordTokenizer(public.path(name))
    assert tokenizer.plain == (name == "byte_bpe_50k.json")
    made = tokenizer.encode(texts)
    assert [m.tolist() for m in made] == [[*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_rows_without_an_id_do_not_share_a_block(spark):
    docs = spark.createDataFrame([(None, f"word{i} " * 10, "en", "s", 0) for i in range(400)] + [(1, "a b c", "en", None, 0), (2, "a b", "en", "", 0), (3, "a", "en", "\x00", 0)], DOCS)
    made = mixing.mix(docs, entropy_ratio=0.0, block_tokens=400).toPandas()
    sizes = made[made.source == "s"].groupby("mix_block").size()
    assert len(sizes) == 10 and sizes.max() < 100
    weights = made[made.source != "s"].set_index("doc_id").mix_weight
    assert len(set(weights.round(9))) == 3  # null, empty and odd names are sources of their own
