"""Quality rules with host verdicts.

Every document is measured once, its rule failures are summed by host (`source`), the
hosts' failure rates are shrunk with a beta prior fitted to all hosts, and a host whose
shrunken rate of any rule passes `max_rate` takes all of its documents with it.

Defined results: null or word-less text has zero words and fails; a null host forms no
group, so only the document's own rules count; repeated rows are measured one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import attach, durable, give_back

WINDOW = 8
SEPARATORS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words inside a window of `width` words that the list holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolled = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0x100000001B3) + mixed[k : n - width + 1 + k]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():  # equal windows have equal hashes
        return 0
    ranks, have = ids, 1
    while have < width:  # exact ranks of runs of 2, 4, 8 ... words, then of `width`
        step = min(have, width - have)
        base = int(ranks.max()) + 1
        ranks = np.unique(ranks[: len(ranks) - step] * base + ranks[step:], return_inverse=True)[1]
        have += step
    again = (np.bincount(ranks)[ranks] > 1).astype(np.int64)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: n - width + 1] += again
    edge[width:] -= again
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly \x20 and \x09-\x0D
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column(2)]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *MEASURES])
    give_back()


def document_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and MEASURES of each row."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return narrow.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def default_rules() -> dict[str, Column]:
    """Rule name to its failure condition. The first two also reject a document by themselves."""
    c = F.col
    return {
        "too_short": c("n_words") < 20,
        "repetitive": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbol_heavy": 10 * c("n_symbols") > 3 * c("word_chars"),
        "repeated_lines": 10 * c("n_dup_lines") > 5 * c("n_lines"),
    }


def beta_prior(k: float, n: float, mean_rate: float, mean_square: float, mean_inverse: float) -> tuple[float, float]:
    """Alpha and beta by moments: the spread of host rates less what binomial noise explains."""
    m = k / n if n else 0.0
    m = min(max(m, 1e-6), 1 - 1e-6)
    spread = mean_square - 2 * m * mean_rate + m * m - m * (1 - m) * mean_inverse
    strength = min(max(m * (1 - m) / max(spread, 1e-9) - 1, 2.0), 1e4)
    return m * strength, (1 - m) * strength


def host_verdicts(stats: DataFrame, rules: dict[str, Column], max_rate: float) -> DataFrame:
    """One row per host: documents, shrunken failure rate of each rule, host_kept."""
    fails = [F.sum(cond.cast("long")).alias(f"k_{name}") for name, cond in rules.items()]
    hosts = durable(stats.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *fails))
    n = F.col("host_docs")
    parts = [F.sum(n).alias("n"), F.avg(1 / n).alias("inv")]
    for name in rules:
        rate = F.col(f"k_{name}") / n
        parts += [F.sum(f"k_{name}").alias(f"k_{name}"), F.avg(rate).alias(f"m_{name}"), F.avg(rate * rate).alias(f"s_{name}")]
    one = hosts.agg(*parts).first()
    rates = []
    for name in rules:
        a, b = beta_prior(*((one[x] or 0.0) for x in (f"k_{name}", "n", f"m_{name}", f"s_{name}", "inv")))
        rates.append(F.round((F.col(f"k_{name}") + a) / (n + a + b), 9).alias(f"rate_{name}"))
    kept = F.greatest(*(F.col(f"rate_{name}") for name in rules)) <= max_rate
    return hosts.select("host", "host_docs", *rates).withColumn("host_kept", kept)


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5, rules: dict[str, Column] | None = None) -> DataFrame:
    """Per row of `docs`: the measures, base_failed, the host's shrunken rates and kept.

    The measures are checkpointed, as both the host sums and the join back read them;
    the text is read once and never shuffled.
    """
    rules = rules or default_rules()
    stats = durable(document_stats(docs, doc_id, text, host))
    verdicts = durable(host_verdicts(stats, rules, max_rate))
    base = default_rules()
    joined = attach(stats, verdicts, "host", "doc_id")
    failed = base["too_short"] | base["repetitive"]
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce("host_kept", F.lit(True)))
