"""Null and clashing doc_ids in the pipeline."""

import random

import pytest

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in pairs], DOCS)


def test_null_and_shared_ids(spark):
    a, b, c, d, e, f = map(words, range(6))
    given = docs(spark, [
        (None, a, "s"), (None, b, "s"), (None, "short", "s"), (None, None, "s"),  # clean rows without an id stay
        (1, c, "s"), (1, "short", "s"), (1, d, "s"),  # a text that failed does not ride along, and both clean ones stay
        (2, e, "s"), (3, e, "s"), (None, e, "t"), (2, e, "s"),  # copies: the smallest id, once
        (4, f, None), (None, f, None),
    ])
    good = cp.quality_stage(spark, given, "")
    assert rows_of(good) == sorted([(None, a), (None, b), (1, c), (1, d), (2, e), (3, e), (None, e), (2, e), (4, f), (None, f)], key=str)
    once = cp.near_dedup_stage(spark, good, "")
    assert once.columns == cp.COLUMNS
    assert rows_of(once) == sorted([(None, a), (None, b), (1, c), (1, d), (2, e), (4, f)], key=str)
    mixed = cp.mixing_stage(spark, cp.pii_stage(spark, once, ""), "")
    assert set(rows_of(mixed)) == set(rows_of(once))
    pytest.importorskip("public_tokenizers")
    assert {r.doc_id for r in cp.packing_stage(spark, mixed, "").collect()} == {None, 1, 2, 4}


def test_one_verdict_a_host_for_equal_rows(spark):
    a = words(9)
    given = docs(spark, [(7, a, "good"), (7, a, "bad"), *[(100 + i, "short", "bad") for i in range(40)], *[(200 + i, words(200 + i), "good") for i in range(40)]])
    assert [r.source for r in cp.quality_stage(spark, given, "").where("doc_id = 7").collect()] == ["good"]
