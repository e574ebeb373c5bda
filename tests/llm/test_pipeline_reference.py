"""Each stage of the pipeline, and the whole, against references: SQL, pairwise comparison, row by row, and the full tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from huelake.llm import pii, queries

public = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Unique ids: clean texts, copies and near copies, short and repetitive ones, personal data, a bad host, a host without a name."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    made = []
    for i in range(220):
        base = text(rng.randint(25, 140))
        made.append((base, "big" if i % 3 else rng.choice(["one", "two", "three"])))
        if i % 9 == 0:
            made.append((base, "two"))  # an exact copy
        if i % 11 == 0:
            made.append((base + " end", "three"))  # a near copy, perhaps
        if i % 13 == 0:
            made.append((f"{base} call +1415555{i:04d} or mail {words[i]}.{i}@host.example.org", "one"))
    made += [("too short", "bad")] * 12 + [(text(60), "bad") for _ in range(3)] + [("again and again " * 30, "two"), (None, "one"), ("", None), (text(50), None), (text(3000), "big")]
    rng.shuffle(made)
    return [(7 * i + 3, t, "en", s, len(t or "")) for i, (t, s) in enumerate(made)]


def sql(spark, tmp_path, df, query):
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/t/*.parquet'")
    return c.sql(query)


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def stages(spark, documents):
    """The result of each stage on its predecessor's."""
    out = [documents]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], "").cache())
    return out


def test_quality_rules_equal_sql(spark, tmp_path, documents, stages):
    kept = {r[0] for r in sql(spark, tmp_path, documents, f"SELECT doc_id FROM ({queries.ORACLES['op1_quality_rules']}) q WHERE kept").fetchall()}
    assert 0 < len(kept) < documents.count()
    assert rows(stages[1]) == sorted((tuple(r) for r in documents.collect() if r.doc_id in kept), key=str)
    assert not [r for r in stages[1].collect() if r.source == "bad"]  # the host takes its clean documents with it


def test_near_dedup_equals_pairwise_comparison(stages):
    given = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    prints = [fingerprint(r.text) for r in given]
    root = list(range(len(given)))
    for _ in given:
        for i in range(len(given)):
            for j in range(i):
                if root[i] != root[j] and bin(prints[i] ^ prints[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in range(len(given))):
            break
    expected = [tuple(r) for i, r in enumerate(given) if root[i] == i]
    assert len(expected) < len(given) and rows(stages[2]) == sorted(expected, key=str)


def test_surrogates_row_by_row(stages):
    expected = []
    changed = 0
    for r in stages[2].collect():
        text, spans = pii.replace(r.text, cp.PII_KEY)
        changed += bool(spans)
        assert bool(spans) == ("@host.example.org" in r.text) and "@host.example.org" not in text
        expected.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert changed and rows(stages[3]) == sorted(expected, key=str)


def test_mixing_equals_sql(spark, tmp_path, stages):
    made = sql(spark, tmp_path, stages[3], f"SELECT doc_id, count(*) FROM ({queries._mixing_oracle(cp.ENTROPY_RATIO, cp.MAX_REPEATS)}) q GROUP BY doc_id").fetchall()
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert copies == dict(made) and max(copies.values()) > 1
    assert {tuple(r) for r in stages[4].collect()} == {tuple(r) for r in stages[3].collect()}


def check_packing(given, pieces):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*plain.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4") for r in given}
    copies = Counter(r.doc_id for r in given)
    met, sequences = defaultdict(Counter), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        met[p.doc_id].update(range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(met) == set(copies)
    for d, n in copies.items():  # every token of every copy once
        assert met[d] == dict.fromkeys(range(len(ids[d])), n)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096 and (ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0)


def test_packing_equals_the_tokenizer(stages):
    check_packing(stages[4].collect(), stages[5].collect())


def test_run_is_the_chain_of_its_stages(spark, tmp_path, documents, stages):
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    check_packing(stages[4].collect(), cp.run(spark, str(tmp_path)).collect())
