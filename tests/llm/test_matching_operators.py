"""SimHash links, repeated strings, nearest neighbours, components, and the pipeline, against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from huelake.llm import graph, hnsw, rindex, simhash, suffixdedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def roots(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


# ---- SimHash ----


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    for t in (None, "", " \t", "A b", "A B c D e", "É A b C d É", "x " * 50, "one two three four five six"):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.array([center ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 9))))) for _ in range(150)], dtype=np.uint64)
    bucket = np.sort(rng.integers(0, 3, 150))
    rep = rng.permutation(150).astype(np.int64)
    u, v = simhash.link_buckets(bucket, bucket, fps, rep, radius)
    edges = [(int(rep[i]), int(rep[j])) for i in range(150) for j in range(i) if bucket[i] == bucket[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius]
    assert roots(150, edges) == roots(150, list(zip(u.tolist(), v.tolist())))


@pytest.mark.parametrize("part", [simhash.PART, 8])
def test_components_equal_brute_force(spark, part):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        for _ in range(5):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    edges = simhash.near_edges(spark.createDataFrame(signed, "fp long, rep long"), 4, len(fps), part)
    found = {r.node: r.root for r in graph.components(edges).collect()}
    expected = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert [found.get(i, i) for i in range(len(fps))] == expected


def test_more_blocks_lose_nothing():
    for n in (10, 1 << 25, 1 << 35):
        keys = simhash.blocks_for(n, 4)
        rng = random.Random(n)
        for _ in range(200):
            flipped = set(rng.sample(range(64), 4))
            assert any(not flipped & set(bits) for bits in keys)


def test_near_duplicates_over_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [None, "", " ", base, base.upper(), base + " end", "other text of its own", base]
    docs = documents(spark, texts).withColumn("fp", F.lit("clash"))
    made = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.union(docs)).collect()}
    assert [made[i] for i in range(len(texts))] == [0, 0, 0, 3, 3, 3, 6, 3]
    assert simhash.near_duplicates(docs.union(docs)).count() == 2 * len(texts)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(300, 301), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and found[301] == 300 and 7 in found


# ---- repeated strings ----


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        letters = rng.choice([1, 2, 3, 20])
        texts = [[rng.randint(1, letters) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 6))]
        patterns = [[rng.randint(1, letters + 1) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        index = rindex.RunLengthIndex(np.array(sum(texts, [])), np.array([len(t) for t in texts]))
        made = index.matching_statistics(np.array(sum(patterns, [])), np.array([len(p) for p in patterns]))
        expected = []
        for p in patterns:
            for i in range(len(p)):
                expected.append(max(n for n in range(len(p) - i + 1) if any(p[i : i + n] == t[j : j + n] for t in texts for j in range(len(t) - n + 1))))
        assert made.tolist() == expected


def test_index_is_run_compressed():
    passage = list(np.random.default_rng(0).integers(1, 200, 400))
    one, many = (rindex.RunLengthIndex(np.array(passage * k), np.array([400] * k)) for k in (1, 30))
    assert many.runs < 1.2 * one.runs


def slow_removal(texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(raw):
        for j in range(len(raw[i]) - 49):
            first.setdefault(raw[i][j : j + 50], i)
    out = {}
    for i, t in raw.items():
        on = np.zeros(len(t), dtype=bool)
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                on[j : j + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], on.astype(int)))) == 1))
        out[i] = (i, len(t), int(on.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(t, on) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [suffixdedup.CROWD, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcd éß\n") for _ in range(n))
    shared = [make(rng.randint(48, 160)) for _ in range(6)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 200, "ab" * 100, "ab" * 60]
    for _ in range(60):
        texts.append(make(rng.randint(0, 80)) + "".join(rng.choice(shared)[rng.randint(0, 3) :] + make(rng.randint(0, 30)) for _ in range(rng.randint(0, 4))))
    texts += [texts[20], texts[20] + "tail", make(5000)]
    long = make(3000)
    texts += [long, "head" + long]
    compare = suffixdedup._compare_hashes

    def small_crowd(blocks):  # workers import the module anew, so the limit goes with the function
        def run(rows):
            suffixdedup.CROWD = crowd
            return compare(blocks)(rows)

        return run

    monkeypatch.setattr(suffixdedup, "_compare_hashes", small_crowd)
    ids = list(range(3, 3 + 7 * len(texts), 7))
    rng.shuffle(ids)
    by_id = dict(zip(ids, texts))
    docs = spark.createDataFrame([(i, t) for i, t in by_id.items()], "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(3)
    made = {r.doc_id: tuple(r) for r in suffixdedup.remove_repeats(docs, part_bytes=2000).collect()}
    assert made == slow_removal(by_id)


def test_repeats_over_odd_tables(spark):
    docs = spark.createDataFrame([(2, "y" * 30 + "z" * 60), (1, "z" * 60), (2, "y" * 30 + "z" * 60), (None, "z" * 60)], "doc_id long, text string")
    rows = sorted(tuple(r)[:4] for r in suffixdedup.remove_repeats(docs).collect())
    assert rows == [(1, 60, 0, 0), (2, 90, 60, 1), (2, 90, 60, 1)]
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0


# ---- neighbours ----


def slow_nearest(rows, k, is_query):
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = []
    for q in sorted(good):
        if is_query(q):
            scored = sorted((-float(np.dot(good[q], v) / (np.linalg.norm(good[q]) * np.linalg.norm(v))), i) for i, v in good.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(40)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [1.0] * 3), (305, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    expected = slow_nearest([r for r in rows if r[0] < 300], 5, lambda i: i % 10 == 0)
    for shard_rows, block in ((4096, 1024), (40, 5)):
        made = sorted(tuple(r) for r in hnsw.nearest(df.union(df), F.col("vec_id") % 10 == 0, 5, shard_rows=shard_rows, query_block=block).collect())
        assert [m[:3] for m in made] == [e[:3] for e in expected]
        assert np.allclose([m[3] for m in made], [e[3] for e in expected], atol=1e-12)
    assert hnsw.nearest(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0, 5).count() == 1
    assert hnsw.nearest(df.limit(0), F.lit(True), 5).count() == 0


@pytest.mark.parametrize("clusters", [0, 20, 300])
def test_recall_against_brute_force(clusters):
    rng = np.random.default_rng(3)
    n = 12_000
    vectors = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, 32)) if clusters else rng.normal(size=(n, 32))
    u = hnsw.unit(vectors)
    graph = hnsw.Graph(u)
    graph.visited = 0
    made = graph.search(u[:200])[:, :6]
    assert not clusters or graph.visited / 200 < 0.05 * hnsw.SHARD_ROWS  # a walk sees a small share of a full shard; random vectors take 6 %
    exact = np.argsort(-(u[:200] @ u.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(made, exact)]) > 0.95
    for layer, k in enumerate(graph.count):  # flat arrays of known nodes, no node twice in a list
        lists = graph.neighbours[layer]
        assert lists.shape == (k, hnsw.places_of(layer) + hnsw.TREE) and lists.max(initial=-1) < k
        assert all(len(set(r)) == len(r) and i not in r for i, r in enumerate([x[x >= 0].tolist() for x in lists[:500, : -hnsw.TREE]]))
        reached = {0}
        for i in range(k):  # children come behind their parent, siblings before the one that names them
            reached.update(x for x in lists[i, -hnsw.TREE :].tolist() if x >= 0)
        assert reached == set(range(k))


def found(spark, rows, query=0, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [(r.vec_id, r.score) for r in hnsw.nearest(df, F.col("vec_id") == query, k).orderBy("rank").collect()]


def test_scaled_copies_tie_to_the_smaller_id(spark):
    v = np.random.default_rng(1).normal(size=16)
    scales = [1.0, *(2.0 ** np.arange(-6, 9)), *(4.0 ** np.arange(5, 19))][:30]
    assert [i for i, _ in found(spark, [(i, (s * v).tolist()) for i, s in enumerate(scales)])] == [1, 2, 3, 4, 5]
    whole = np.arange(1.0, 9.0)
    assert found(spark, [(i, (s * whole).tolist()) for i, s in enumerate(range(1, 31))]) == [(i, 1.0) for i in range(1, 6)]


@pytest.mark.parametrize("n", [60, 400])
def test_order_below_single_precision(spark, n):
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, 3e-5 * (1 + 1e-4 * (n - i)), 0.0]) for i in range(1, n + 1)]
    made = found(spark, rows)
    assert [i for i, _ in made] == list(range(n, n - 5, -1)) and all(s < 1 for _, s in made)


def test_orthogonal_and_opposite_vectors_keep_their_score(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 7.0]), (2, [-3.0, 0.0]), (3, [0.0, -1e300]), (4, [1e-300, 0.0]), (5, [5.0])]
    assert found(spark, rows) == [(4, 1.0), (1, 0.0), (3, 0.0), (2, -1.0)]


# ---- pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    keep = text()
    texts = [keep, keep, "too short", None, "", text() + " mail someone.1@host2.example.com", text(), text(3000), "again and " * 40]
    docs = documents(spark, texts).withColumn("mix_block", F.lit("clash"))
    docs = docs.union(docs.where("doc_id = 6"))
    columns = cp.COLUMNS
    one = cp.quality_stage(spark, docs, "")
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == [0, 1, 5, 6, 6, 7]
    two = cp.near_dedup_stage(spark, one, "")
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == [0, 5, 6, 7]
    three = cp.pii_stage(spark, two, "")
    rows = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and "someone.1@host2" not in rows[5].text and rows[6].text == texts[6] and all(len(r.text) == r.n_chars for r in rows.values())
    four = cp.mixing_stage(spark, three, "")
    assert four.columns == columns and {r.doc_id for r in four.collect()} == {0, 5, 6, 7}
    five = cp.packing_stage(spark, four, "")
    assert {r.doc_id for r in five.collect()} == {0, 5, 6, 7}
    for stage in (cp.quality_stage, cp.near_dedup_stage, cp.pii_stage, cp.mixing_stage, cp.packing_stage):
        assert stage(spark, docs.limit(0), "").count() == 0
    assert [name for name, _ in cp.STAGES] and cp.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries_run(spark):
    from huelake.llm import queries

    for name, run in queries.QUERIES.items():
        assert run(spark, SF).count() > 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_oracles(spark):
    import duckdb

    from huelake.llm import queries

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        r = c.sql(sql)
        at = [r.columns.index(x) for x in columns]
        assert sorted(map(str, ([x[i] for i in at] for x in r.fetchall()))) == sorted(map(str, ([x[k] for k in columns] for x in df.collect()))), name


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_source_mixing", "op9_suffix_dedup"])
@pytest.mark.parametrize("counts", [{"a": 300, "b": 20, None: 4}, {"a": 40, "b": 39, "c": 38}, {"a": 30}])
def test_oracles_on_skewed_sources(spark, tmp_path, name, counts):
    import duckdb

    from huelake.llm import queries

    rng = random.Random(len(counts))
    shared = " ".join(rng.choice(["möwe", "tree", "stone", "sea"]) for _ in range(30))
    rows = []
    for source, n in counts.items():
        for _ in range(n):
            words = " ".join("".join(rng.choice("abcdé") for _ in range(4)) for _ in range(rng.randrange(0, 60)))
            text = rng.choice([None, "", words, words, words + " " + shared, shared + "\n" + words + "\n" + shared])
            rows.append((len(rows), text, "en", source, len(text or "")))
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    r = c.sql(queries.ORACLES[name])
    at = [r.columns.index(x) for x in columns]
    made = sorted(map(str, ([x[k] for k in columns] for x in df.collect())))
    assert made and made == sorted(map(str, ([x[i] for i in at] for x in r.fetchall())))


def test_cut_texts_have_the_same_strings(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() for n in (10, 49, 50, 4000, 51, 2500)]

    def by_string():
        made = {}
        for e in suffixdedup._entries(list(range(len(texts))), texts)[0]:
            for k in range(int(e["more"]) + 1):
                at = (int(e["doc"]), int(e["start"]) + k)
                assert at not in made
                made[at] = int(e["key"])
        return made

    whole = by_string()
    assert set(whole) == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)}
    monkeypatch.setattr(suffixdedup, "CHUNK", 300)
    assert by_string() == whole


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000])
def test_packed_records_come_back(n):
    rng = np.random.default_rng(n)
    for dtype in (suffixdedup.ENTRY, suffixdedup.MARK):
        records = np.frombuffer(rng.integers(0, 256, n * dtype.itemsize, dtype=np.uint8).tobytes(), dtype=dtype)
        plain = np.zeros(n, dtype=dtype)
        plain["start"] = np.arange(n) * 17
        for x in (records, plain):
            assert (suffixdedup.unpack(suffixdedup.pack(x), dtype) == x).all()
