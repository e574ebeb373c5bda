"""Long and rare words, numerals, ties and repeated rows in language identification."""

import random

import numpy as np
import pytest

from huelake.llm import langid

public = pytest.importorskip("public_tokenizers")
RARE = "ªăłſɯʿπм"


@pytest.fixture(scope="module")
def model():
    """Trained on as many letters as `max_chars` allows, so that the smallest piece probability is as small as it gets."""
    rng = random.Random(1)
    words = {"de": "der und nicht eine schön über".split(), "en": "the of and thing other which".split()}
    rows = [(g, " ".join(rng.choice(words[g]) for _ in range(4000))) for g in words for _ in range(60)]
    return langid.fit(rows, langid.load_pieces(public.path("piece_bpe_32k.model")))


@pytest.mark.parametrize("size", [1, 48, 49, 1000, 10_000])
def test_long_words_of_rare_letters_have_a_score(model, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice(RARE) for _ in range(size)), "the other thing of which " * 5 + "".join(rng.choice(RARE) for _ in range(size))]
    langs, score = model.predict(texts)
    assert np.isfinite(score).all() and ((score >= 0) & (score <= 1)).all() and all(g in ("de", "en") for g in langs)
    assert size > 100 or langs[1] == "en"


def test_fuzzed_texts_have_scores(model):
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(97, 123)])) for _ in range(rng.randrange(400))) for _ in range(300)]
    langs, score = model.predict(texts)
    for text, lang, x in zip(texts, langs, score):
        assert np.isfinite(x) and 0 <= x <= 1
        assert (lang == langid.UND) == (not any(c.isalpha() for c in text.lower()))


def test_numerals_are_no_letters(model):
    for text in ("½ ②", "² Ⅷ", "12 ٣", "_", "…"):
        assert model.predict([text])[0] == [langid.UND] and model.predict([text])[1][0] == 0
    assert langid.words_of("a²b ½c Ⅷd") == ["a", "b", "c", "d"] and all(w.isalpha() for w in langid.words_of("x① ㊀ ൰ ᛮ y"))


def test_a_word_is_not_cut(model):
    index = {p: i for i, p in enumerate(model.pieces)}
    word = "schönüberundnichtderundeine" * 5
    alone = langid.Lattice([word], index, max(map(len, index))).totals(np.log(model.prob))
    assert np.allclose(model.log_likelihoods([word])[0], alone)
    many = [word, "the", word, "x" * 70, "of"]
    assert np.allclose(model.log_likelihoods([" ".join(many)])[0][0], sum(model.log_likelihoods([w])[0][0] for w in many))


def test_ties_and_repeated_rows(spark, model):
    even = langid.Model(["aa", "bb"], model.pieces, np.repeat(model.prob[:, :1], 2, axis=1))
    langs, score = even.predict(["the thing", "the thing"])
    assert langs == ["aa", "aa"] and score.tolist() == [0.5, 0.5]
    rows = [(1, "the other thing", "en"), (2, "der und nicht", "de")] * 20 + [(9, "the und of", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = langid.identify(docs.repartition(3), public.path("piece_bpe_32k.model")).collect()
    assert len(made) == len(rows) and len({tuple(r) for r in made}) == 3
