"""Toxicity scores against a slow version, their calibration, and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from huelake.llm import toxicity

rng = np.random.default_rng(7)
MODEL = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS), -0.5)


def slow_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def slow_score(text, model=MODEL, width=16):
    words = slow_words(text)
    if not words:
        return 0.0
    shares = []
    for w in words:
        marked = f"<{w}>"
        grams = [marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))]
        shares.append(sum(model.weight[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams) / len(grams))
    for i in range(len(words) - 1, -1, -1):  # a word counts once among 16 neighbours: the first of a run of repeats
        last = [j for j in range(i) if words[j] == words[i]]
        kept = None
        for j in [*last, i]:
            if kept is None or j - kept >= width:
                kept = j
        if kept != i:
            shares[i] = 0.0
    n = min(width, len(words))
    top = max(sum(shares[i : i + n]) / n for i in range(len(words) - n + 1))
    return 1 / (1 + math.exp(-(top + model.bias)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "wretch", "wretched", "Ünrast", "_x_", "!", "1", "\n", "möwe"]), max_size=60).map(" ".join))
def test_scores_equal_the_slow_version(text):
    assert MODEL.scores([text, None])[0] == pytest.approx(slow_score(text), abs=1e-9) and MODEL.scores([None])[0] == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i % 3} wretch" for i in range(50)]
    whole = MODEL.scores(texts)
    monkeypatch.setattr(toxicity, "MEMORY", 3)
    assert np.allclose([MODEL.scores([t])[0] for t in texts], whole)


def test_scores_are_probabilities_at_even_odds():
    draw = random.Random(2)
    texts = [(y, " ".join(draw.choice(["stone", "tree", "sea", "wretch" if draw.random() < (0.5 if y else 0.02) else "moss"]) for _ in range(12))) for y in (0, 1) for _ in range(1500)]
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)
    for g in toxicity.subwords("wretch"):
        model.weight[g] = 5.0
    slope, intercept = toxicity.calibration(model, texts)
    fitted = toxicity.Model(slope * model.weight, slope * model.bias + intercept)
    p = fitted.scores([t for _, t in texts])
    y = np.array([label for label, _ in texts])
    assert slope > 0 and p.mean() == pytest.approx(0.5, abs=0.005)  # the curve meets the share of label 1
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1)):
        some = (p >= lo) & (p < hi)
        assert not some.any() or y[some].mean() == pytest.approx(p[some].mean(), abs=0.1)
    few = [texts[i] for i in (*range(300), *range(1500, 3000))]  # the mix of the sample changes nothing
    assert np.allclose(toxicity.calibration(model, few), (slope, intercept), rtol=0.3, atol=0.3)
    assert toxicity.calibration(model, texts[:100]) == (1.0, 0.0)  # one label alone


def test_odd_and_repeated_rows(spark):
    texts = [None, "", " _ ", "x", "wretch " * 20_000, "stone " * 20_000 + "wretch", "é" * 5000, "stone tree", "stone tree"]
    docs = spark.createDataFrame([(i % 8, t, 0.5, 1) for i, t in enumerate(texts)], "doc_id long, text string, score double, toxic int")
    train = spark.createDataFrame([(100 + i, " ".join(["stone tree sea"] * 5) + (" wretch" if i % 2 else " moss") + f" w{i}", 0.0, 0) for i in range(400)], docs.schema)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(400)] + [(0, None), (1, 7), (101, 1)], "doc_id long, toxic int")
    made = toxicity.score(docs.union(docs).unionByName(train), labels).where("doc_id < 100")
    rows = made.groupBy("doc_id").agg(F.collect_set("score").alias("s"), F.count("score").alias("n")).collect()
    by = {r.doc_id: r for r in rows}
    assert sum(r.n for r in rows) == 2 * len(texts)  # every row has its score
    assert all(by[i].s == [0.0] for i in (1, 2)) and 0.0 in by[0].s
    assert all(len(r.s) == 1 for i, r in by.items() if i) and by[4].s[0] > 0.5 and by[5].s[0] > by[7].s[0]
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
