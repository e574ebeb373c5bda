"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import hnsw, htmltext, langid, mixing, packing, pii, quality, simhash, suffixdedup, toxicity
from .common import crc_mod

#: Key of the registered query's surrogates; a real run passes its own secret.
DEMO_KEY = b"registered query"


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.judge(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), entropy_ratio=0.95, max_repeats=4.0)
    return made.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_rate", "mix_epoch", "mix_block", "mix_position")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 0
    made = langid.identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), learn=~held_out)
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    made = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return made.withColumn("n_entities", F.size("pii_spans").cast("long"))


def pii_surrogate_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of op8's surrogates over all documents: entities and surrogates of each kind, and how many stand for two."""
    return pii.collisions(table(spark, sf_dir, "documents"), DEMO_KEY)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op4_hnsw": op4_hnsw,
    "op5_html_text": op5_html_text,
    "op6_toxicity": op6_toxicity,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_pii_surrogates": op8_pii_surrogates,
    "pii_surrogate_collisions": pii_surrogate_collisions,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
}

def _quality_oracle() -> str:
    """Quality rules in DuckDB SQL: measures, host rates, beta priors by moments, verdicts."""
    word = r"[^\x20\x09-\x0D]"
    rules = {
        "a": "n_words < 20", "b": "100 * n_repeat_words > 30 * n_words", "c": "10 * n_symbols > 3 * word_chars", "d": "10 * n_dup_lines > 5 * n_lines",
    }
    m = {x: f"least(greatest(cast(s.k_{x} AS DOUBLE) / s.n, 1e-6), 1 - 1e-6)" for x in rules}
    spread = {x: f"(s.q_{x} - 2 * {m[x]} * s.r_{x} + {m[x]} * {m[x]} - {m[x]} * (1 - {m[x]}) * s.inv)" for x in rules}
    strength = {x: f"least(greatest({m[x]} * (1 - {m[x]}) / greatest({spread[x]}, 1e-9) - 1, 2.0), 1e4)" for x in rules}
    rate = [f"round((h.k_{x} + {m[x]} * {strength[x]}) / (h.n + {strength[x]}), 9)" for x in rules]
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8) t),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) t WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT range AS k FROM range(0, 8)) k GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) t WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
d AS (SELECT w.doc_id, w.source, cast(len(ws) AS BIGINT) AS n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, cast(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines,
  cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS k_{x}" for x, e in rules.items())} FROM d WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(n) AS n, avg(1.0 / n) AS inv, {", ".join(f"sum(k_{x}) AS k_{x}, avg(cast(k_{x} AS DOUBLE) / n) AS r_{x}, avg(cast(k_{x} AS DOUBLE) / n * (cast(k_{x} AS DOUBLE) / n)) AS q_{x}" for x in rules)} FROM h),
v AS (SELECT h.source, greatest({", ".join(rate)}) <= 0.5 AS host_kept FROM h CROSS JOIN s)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({rules["a"]} OR {rules["b"]}) AS base_failed,
  NOT ({rules["a"]} OR {rules["b"]}) AND coalesce(v.host_kept, true) AS kept FROM d LEFT JOIN v ON v.source = d.source"""


def _mixing_oracle(entropy_ratio: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 20) -> str:
    """Source mixing in DuckDB SQL: two bisections of 30 steps over the list of shares, then the blocks' permutations."""
    z = lambda t: f"list_sum(list_transform(ps, lambda p: pow(p, {t})))"
    d = lambda t: f"list_sum(list_transform(ps, lambda p: pow(p, {t}) * ln(p)))"
    enough = lambda t: f"(ln({z(t)}) - {t} * {d(t)} / {z(t)} >= {entropy_ratio!r} * ln(len(ps)))"
    repeats = lambda t: f"(list_max(list_transform(ps, lambda p: pow(p, {t} - 1))) / list_min(list_transform(ps, lambda p: pow(p, {t} - 1))))"
    step = lambda table, good: f"SELECT k + 1, CASE WHEN {good} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {good} THEN hi ELSE (lo + hi) / 2 END, ps FROM {table} WHERE k < 30"
    drawn = lambda x: f"md5('0|' || {x} || '|' || ident)"
    return f"""
WITH RECURSIVE n AS (SELECT doc_id, source, coalesce(cast(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS ident, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS mix_tokens FROM documents),
s AS (SELECT source, sum(mix_tokens) AS tokens FROM n GROUP BY source HAVING sum(mix_tokens) > 0),
q AS (SELECT list(tokens / cast(grand AS DOUBLE) ORDER BY tokens) AS ps, any_value(grand) AS grand FROM s CROSS JOIN (SELECT sum(tokens) AS grand FROM s) g),
a AS (SELECT 0 AS k, cast(0 AS DOUBLE) AS lo, cast(1 AS DOUBLE) AS hi, ps FROM q UNION ALL {step("a", enough("((lo + hi) / 2)"))}),
b AS (SELECT 0 AS k, cast(0 AS DOUBLE) AS lo, cast(1 AS DOUBLE) AS hi, ps FROM q UNION ALL {step("b", f"{repeats('((lo + hi) / 2)')} > {max_repeats!r}")}),
t1 AS (SELECT q.ps, grand, CASE WHEN len(q.ps) < 2 OR {enough("1.0").replace("ps", "q.ps")} THEN 1.0 ELSE round(a.hi, 9) END AS t FROM q CROSS JOIN a WHERE a.k = 30),
t2 AS (SELECT t1.ps, grand, CASE WHEN {repeats("t").replace("ps", "t1.ps")} > {max_repeats!r} * (1 + 1e-9) THEN greatest(t, round(b.hi, 9)) ELSE t END AS t FROM t1 CROSS JOIN b WHERE b.k = 30),
e AS (SELECT grand, t, {z("t")} AS z, grand * {z("t")} / list_min(list_transform(ps, lambda p: pow(p, t - 1))) AS spend FROM t2),
v AS (SELECT source, tokens, spend, round(pow(tokens / cast(grand AS DOUBLE), t) / z, 12) AS mix_weight FROM s CROSS JOIN e),
r AS (SELECT source, mix_weight, round(mix_weight * spend / tokens, 9) AS mix_rate, cast(ceil(tokens / {float(block_tokens)}) AS BIGINT) AS blocks FROM v),
x AS (SELECT doc_id, n.source, ident, mix_tokens, mix_weight, mix_rate, cast(floor(mix_rate) AS BIGINT) AS base,
  cast('0x' || substr(md5('0|' || ident), 1, 15) AS BIGINT) % blocks AS mix_block FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY source, mix_block ORDER BY {drawn("base")}, ident, mix_tokens ROWS UNBOUNDED PRECEDING) - mix_tokens / 2.0 AS before,
  sum(mix_tokens) OVER (PARTITION BY source, mix_block) AS held FROM x),
m AS (SELECT *, unnest(range(0, base + CASE WHEN before < (mix_rate - base) * held THEN 1 ELSE 0 END)) AS mix_epoch FROM c)
SELECT doc_id, source, mix_tokens, mix_weight, mix_rate, cast(mix_epoch AS BIGINT) AS mix_epoch, mix_block,
  cast(row_number() OVER (PARTITION BY source, mix_block, mix_epoch ORDER BY {drawn("mix_epoch")}, ident, mix_tokens) AS INTEGER) AS mix_position FROM m"""


#: Suffix dedup in DuckDB SQL: windows of 50 bytes, the least document of each, runs of covered bytes.
SUFFIX_ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50) t),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.s = w.s WHERE f.least < w.doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS head FROM h),
g AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY doc_id, run),
n AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT n.doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS final, string_agg(hex(array_slice(d.b, before + 1, a - 1)), '' ORDER BY a) AS parts
  FROM n JOIN d ON d.doc_id = n.doc_id GROUP BY n.doc_id)
SELECT d.doc_id, cast(octet_length(b) AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN k.doc_id IS NULL THEN b ELSE unhex(parts || hex(array_slice(b, final + 1, octet_length(b)))) END) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


ORACLES: dict[str, str] = {"op1_quality_rules": _quality_oracle(), "op2_source_mixing": _mixing_oracle(), "op9_suffix_dedup": SUFFIX_ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
