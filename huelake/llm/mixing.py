"""Temperature mixing of sources, in DataFrame operations only.

Source token shares p are raised to an exponent t in [0, 1] and normalised to weights.
t is bisected to the largest value whose entropy reaches the target; where a source
would then repeat more often than `max_repeats`, t is raised until none does. The
weights are realised in blocks: documents are dealt by hash to blocks of about
`block_tokens` tokens of their source, each block passes whole permutations of itself
as often as its budget allows and ends with the prefix of one more permutation.

Defined results: a null source is a source of its own; null or word-less text counts
zero tokens, and a source without tokens has weight zero and yields no rows; repeated
rows (same doc_id and text) are separate rows that share a block, rows of one doc_id or
without one are dealt by their texts; an empty table gives an empty result;
columns whose names start with mix_ are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import attach, durable

#: Exponents that one pass over the source table evaluates: five levels of bisection.
POINTS = 31


def drawn(*parts: Column) -> Column:
    """MD5 of the parts, as hex: an order that any SQL engine finds again."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def word_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """mix_source, tokens and docs; a hot source is summed before the shuffle."""
    return docs.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _evaluate(totals: DataFrame, grand: int, points: list[float]) -> list[tuple[float, float, float]]:
    """(entropy, largest repetition for a budget of one token in all, its cover budget) at each exponent."""
    p = F.col("tokens") / F.lit(float(grand))
    parts = []
    for i, t in enumerate(points):
        parts += [F.sum(F.pow(p, F.lit(t))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(t)) * F.log(p)).alias(f"d{i}"), F.max(F.pow(p, F.lit(t - 1))).alias(f"r{i}"), F.min(F.pow(p, F.lit(t - 1))).alias(f"c{i}")]
    row = totals.agg(*parts).first()
    out = []
    for i, t in enumerate(points):
        z = row[f"z{i}"]
        out.append((math.log(z) - t * row[f"d{i}"] / z, row[f"r{i}"] / z / grand, grand * z / row[f"c{i}"]))
    return out


def find_exponent(totals: DataFrame, grand: int, entropy: float, max_repeats: float, budget: int | None, digits: int = 9) -> tuple[float, float]:
    """The exponent and the token budget; `budget` None means each document at least once."""

    def last(good) -> float:
        """Bisects for the end of the range of t, from 0 up, in which good holds."""
        lo, hi = 0.0, 1.0
        while hi - lo > 10.0**-digits:
            points = [lo + (hi - lo) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            ok = [good(*x) for x in _evaluate(totals, grand, points)]
            edge = ok.index(False) if False in ok else POINTS
            lo, hi = ([lo] + points)[edge], (points + [hi])[edge]
        return round(hi, digits)

    at_one = _evaluate(totals, grand, [1.0])[0]
    t = 1.0 if at_one[0] >= entropy else last(lambda h, *_: h >= entropy)
    spend = lambda x: float(budget) if budget is not None else x[2]
    if max_repeats * (1 + 1e-9) < _evaluate(totals, grand, [t])[0][1] * spend(_evaluate(totals, grand, [t])[0]):
        t = max(t, last(lambda h, r, c: r * spend((h, r, c)) > max_repeats))
    return t, spend(_evaluate(totals, grand, [t])[0])


def mix(docs: DataFrame, *, entropy_ratio: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, seed: int = 0, block_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokens: str | None = None) -> DataFrame:
    """Rows of `docs`, each as often as its source's weight asks, with the mix_ columns.

    `entropy_ratio` is the target entropy over that of equal weights. `tokens` may name a
    column of token counts; otherwise words are counted. Two passes read the text; only
    the second shuffles, by (source, block), so that no group exceeds a block.
    """
    counted = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else word_tokens(text)
    plain = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    named = plain.withColumn("mix_source", key).withColumn("mix_tokens", counted)
    totals = durable(source_totals(named).where("tokens > 0"))
    whole = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    grand, n = int(whole["t"] or 0), int(whole["n"])
    exponent, spend = find_exponent(totals, grand, entropy_ratio * math.log(n), max_repeats, budget) if grand and n > 1 else (1.0, float(budget if budget is not None else grand))
    power = F.pow(F.col("tokens") / F.lit(float(max(grand, 1))), F.lit(exponent))
    norm = (totals.agg(F.sum(power)).first()[0] or 1.0) if n else 1.0
    weight = F.round(power / F.lit(norm), 12)
    table = totals.select(
        "mix_source", weight.alias("mix_weight"), F.round(weight * spend / F.col("tokens"), 9).alias("mix_rate"),
        F.ceil(F.col("tokens") / block_tokens).alias("__blocks"),
    )
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), *([F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))] if text in docs.columns else [])]
    named = named.withColumn("__ident", F.concat_ws("|", *parts))
    ident = F.col("__ident")
    dealt = attach(named, durable(table), "mix_source", doc_id).where("mix_weight is not null")
    number = F.conv(F.substring(drawn(F.lit(seed), ident), 1, 15), 16, 10).cast("long")
    dealt = dealt.withColumn("mix_block", number % F.col("__blocks")).withColumn("__base", F.floor("mix_rate"))
    group = Window.partitionBy("mix_source", "mix_block")
    last = group.orderBy(drawn(F.lit(seed), F.col("__base"), ident), ident, "mix_tokens")
    before = F.sum("mix_tokens").over(last.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_tokens") / 2
    extra = (before < (F.col("mix_rate") - F.col("__base")) * F.sum("mix_tokens").over(group)).cast("long")
    times = dealt.withColumn("__times", F.col("__base") + extra).where("__times > 0")
    copies = times.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    order = Window.partitionBy("mix_source", "mix_block", "mix_epoch").orderBy(drawn(F.lit(seed), F.col("mix_epoch"), ident), ident, "mix_tokens")
    return copies.withColumn("mix_position", F.row_number().over(order)).drop("__blocks", "__base", "__times", "__ident")
