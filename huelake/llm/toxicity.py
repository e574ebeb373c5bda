"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and of itself; a bag's vector is the
mean of its embeddings, a passage's the sum over its distinct words by its length, and a
softmax over two classes reads it. A document is scored
by its most toxic passage of `WINDOW` words, over all passages of the whole text, since
an average over a long text would drown a few words; training picks each document's
highest passage likewise, after a start on words drawn from the whole text.

The score is a probability at even odds: a part of the sample that is kept apart from
training fits a logistic curve over the softmax's logits (slope and intercept, by maximum
likelihood with smoothed targets), in which both classes weigh the same, as the share of
toxic rows among the labels need not be that of the documents.

Labels are learnt from a bounded sample (`per_class` rows a class, texts up to
`max_chars`). After training a word's whole share in the logit is one number, which
workers remember for words they have met.

Defined results: null or word-less texts have score 0; without both labels to learn from
every score is 0; of passages that tie the first counts; repeated rows of a document are
scored alike, and repeated labels count once each; labels other than 0 and 1 are not
learnt from; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back

WORDS = re.compile(r"[^\W_]+")
WINDOW = 16
#: Words of a text that training starts from.
START = 64
#: Part of the sample that only makes logits probabilities.
CALIBRATE = 0.2
BUCKETS = 1 << 17
DIMS = 8
SIZES = (3, 4, 5)
MEMORY = 600_000


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def subwords(word: str) -> list[int]:
    """Buckets of the word and its n-grams; a long word gives the n-grams of all its parts."""
    marked = f"<{word}>"
    raw = marked.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(raw) % BUCKETS]
    if len(raw) == len(marked):
        return out + [zlib.crc32(raw[i : i + n]) % BUCKETS for n in SIZES for i in range(len(raw) - n + 1)]
    return out + [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for i in range(len(marked) - n + 1)]


class Bags:
    """The subwords of many words in flat arrays."""

    def __init__(self, words: Iterable[str]) -> None:
        flat, size = array("i"), array("i")
        for word in words:
            before = len(flat)
            flat.extend(subwords(word))
            size.append(len(flat) - before)
        self.flat, self.size = np.frombuffer(flat, dtype=np.int32), np.array(size, dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of some words, and their sizes."""
        size = self.size[words]
        shift = np.repeat(self.first[words] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(int(size.sum()))], size


def mean_bags(values: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[flat], np.cumsum(size) - size) / size.reshape(-1, *[1] * (values.ndim - 1))


class Model:
    """`weight`: a subword's share in the logit; `bias`: the logit of no evidence."""

    def __init__(self, weight: np.ndarray | None, bias: float) -> None:
        self.weight, self.bias = weight, bias
        self._at: dict[str, float] = {}

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias}

    def __setstate__(self, state) -> None:
        self.__init__(**state)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; 0 for texts without words."""
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-self.logits(texts)))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of each text's highest passage; minus infinity for texts without words."""
        out = np.full(len(texts), -np.inf)
        if self.weight is None:
            return out
        if len(self._at) > MEMORY:
            self._at = {}
        parts = [words_of(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in parts:
            new.update(words)
        new.difference_update(self._at)
        if new:
            fresh = sorted(new)
            for i in range(0, len(fresh), 8192):
                bags = Bags(fresh[i : i + 8192])
                self._at.update(zip(fresh[i : i + 8192], mean_bags(self.weight, bags.flat, bags.size).tolist()))
        for i, words in enumerate(parts):
            if words:
                shares = np.fromiter(map(self._at.__getitem__, words), dtype=float, count=len(words))
                out[i] = best_window(once(shares, words))[0] + self.bias
        return out


def once(shares: np.ndarray, words: list, width: int = WINDOW) -> np.ndarray:
    """The shares, with zero for a word met already among the last `width`."""
    last: dict = {}
    for i, w in enumerate(words):
        if i - last.get(w, -width) < width:
            shares[i] = 0.0
        else:
            last[w] = i
    return shares


def best_window(shares: np.ndarray, width: int = WINDOW) -> tuple[float, int]:
    """The largest mean over `width` neighbours (all, if fewer) and where it starts."""
    width = min(width, len(shares))
    sums = np.concatenate(([0.0], np.cumsum(shares)))
    means = (sums[width:] - sums[:-width]) / width
    at = int(means.argmax())
    return float(means[at]), at


def fit(rows: list[tuple[int, str]], *, start_rounds: int = 15, rounds: int = 80, rate: float = 0.05, decay: float = 1e-5, seed: int = 1) -> Model:
    """rows: (label, text). Adam over all rows at once; the passages are chosen anew every fifth round."""
    kept_apart = [(y, t) for y, t in rows if zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 100 < 100 * CALIBRATE]
    vocab: dict[str, int] = {}
    docs, labels = [], []
    for label, text in rows:
        if zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % 100 >= 100 * CALIBRATE and (words := words_of(text or "")):
            docs.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), dtype=np.int32, count=len(words)))
            labels.append(label)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(None, 0.0)
    bags = Bags(vocab)
    del vocab
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) / len(y)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.01, (BUCKETS, DIMS)), rng.normal(0, 1.0, (DIMS, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    chosen = [rng.choice(d, START, replace=False) if len(d) > START else d for d in docs]
    sizes = np.array([len(c) for c in chosen])
    for step in range(1, start_rounds + rounds + 1):
        emb, soft, bias = params
        if step > start_rounds and (step - start_rounds) % 5 == 1:
            shares = mean_bags(emb @ (soft[:, 1] - soft[:, 0]), bags.flat, bags.size)
            picked = [d[at : at + WINDOW] for d in docs for at in [best_window(once(shares[d], d.tolist()))[1]]]
            chosen, sizes = [np.unique(c) for c in picked], np.array([len(c) for c in picked])
        if step == 1 or (step > start_rounds and (step - start_rounds) % 5 == 1):
            flat_words = np.concatenate(chosen)
            many = np.array([len(c) for c in chosen])
            used, place = np.unique(flat_words, return_inverse=True)
            flat, size = bags.take(used)
            owner = np.repeat(np.arange(len(chosen)), many)
            heads = np.cumsum(many) - many
        vectors = mean_bags(emb, flat, size)
        hidden = np.add.reduceat(vectors[place], heads) / sizes[:, None]
        logit = hidden @ soft + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        back = (p @ soft.T / sizes[:, None])[owner]
        grad_words = np.stack([np.bincount(place, weights=back[:, k], minlength=len(used)) for k in range(DIMS)], axis=1) / size[:, None]
        wide = np.repeat(grad_words, size, axis=0)
        grads = [np.stack([np.bincount(flat, weights=wide[:, k], minlength=BUCKETS) for k in range(DIMS)], axis=1) + decay * emb, hidden.T @ p, p.sum(axis=0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    emb, soft, bias = params
    model = Model(emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))
    slope, intercept = calibration(model, kept_apart)
    return Model(slope * model.weight, slope * model.bias + intercept)


def calibration(model: Model, rows: list[tuple[int, str]], rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept that turn the model's logits into log odds, by Newton's steps on rows kept apart."""
    y = np.array([label for label, _ in rows])
    many = np.bincount(y, minlength=2)[:2] if len(y) else np.zeros(2)
    if not many.all():
        return 1.0, 0.0
    z = model.logits([t for _, t in rows])
    y, z = y[np.isfinite(z)], z[np.isfinite(z)]
    weight = (0.5 / many)[y]
    target = np.where(y == 1, (many[1] + 1) / (many[1] + 2), 1 / (many[0] + 2))
    x = np.stack((z, np.ones(len(z))), axis=1)

    def loss(w: np.ndarray) -> float:
        t = x @ w
        return float((weight * (np.logaddexp(0, t) - target * t)).sum())

    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (p - target)))
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int, max_chars: int) -> list[tuple[int, str]]:
    """(label, text) of about `per_class` rows of each label at most, chosen by the hash of doc_id.

    The chosen ids are bounded by the parameter, so they are broadcast to find their texts.
    """
    fair = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    sizes = {r[0]: r[1] for r in fair.groupBy("__label").agg(F.count(F.lit(1))).collect()}
    share: Column = F.lit(0)
    for y, n in sizes.items():
        share = F.when(F.col("__label") == y, F.lit(int(min(1.0, per_class / n) * (1 << 30)))).otherwise(share)
    some = fair.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) < share).limit(4 * per_class)
    texts = docs.where(F.char_length(text) <= max_chars).join(F.broadcast(some), F.col(doc_id) == F.col("__id")).select("__label", text)
    return sorted((r[0], r[1]) for r in texts.limit(4 * per_class).collect())


def score(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000, max_chars: int = 20_000) -> DataFrame:
    """doc_id and score of each row of `docs`. `learn` says which rows of `labels` may be learnt from."""
    rows = sample(docs, labels if learn is None else labels.where(learn), doc_id, text, label, per_class, max_chars)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                made = model.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])
        give_back()

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")
