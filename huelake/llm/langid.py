"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
likelihood is the sum over all ways to cut it into pieces, found by a forward pass in
logarithms, so that no length underflows; the
probabilities are fitted by expectation-maximisation over the same sums. A text's score
is the sum over its words, with equal prior odds of the languages.

Fitting reads a bounded sample (`per_lang` rows of each language, texts up to
`max_chars`) on the driver; scoring is one pass over whole texts, where a worker
remembers the sums of words it has met (a memory, not a limit: others are summed anew).

Defined results: null text or text without a letter is `und` with score 0 (numerals such
as half signs or numbers in circles are no letters); so is every
text if there is nothing to learn from; ties go to the language that sorts first; equal
rows have equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back

#: Runs of letters, and of the numerals that a pattern's \w takes as well.
LETTERS = re.compile(r"[^\W\d_]+")
#: Longest word, in letters, that a worker remembers.
REMEMBERED = 48
#: Words times letters of a lattice; bounds a task's memory.
CELLS = 1 << 17
#: Probability of a letter outside the vocabulary, in every language.
UNKNOWN = 1e-6
MEMORY = 600_000
UND = "und"


def words_of(text: str) -> list[str]:
    """Lower-case letter runs."""
    words = LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def portions(words: list[str]) -> Iterator[list[str]]:
    """The words by length, in groups of about CELLS letters when padded to the longest."""
    group: list[str] = []
    for word in sorted(words, key=len):
        if group and (len(group) + 1) * (len(word) + 1) > CELLS:
            yield group
            group = []
        group.append(word)
    if group:
        yield group


def load_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces in lower case letters, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)])
    return sorted({p for p in keep if p.lower() == p and p.lstrip("▁").isalpha()} | {"▁"})


class Lattice:
    """All cuts of many words into pieces, as arcs grouped by where they end."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int) -> None:
        unknown = len(pieces)
        word, start, end, piece = [], [], [], []
        get = pieces.get
        for w, text in enumerate(words):
            text = "▁" + text
            n = len(text)
            for s in range(n):
                single = False
                for e in range(s + 1, min(n, s + longest) + 1):
                    p = get(text[s:e])
                    if p is not None:
                        word.append(w)
                        start.append(s)
                        end.append(e)
                        piece.append(p)
                        single = single or e == s + 1
                if not single:
                    word.append(w)
                    start.append(s)
                    end.append(s + 1)
                    piece.append(unknown)
        self.n = len(words)
        self.length = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=self.n)
        self.word, self.start, self.end, self.piece = (np.array(x, dtype=np.int64) for x in (word, start, end, piece))

    def _slices(self, at: np.ndarray):
        order = np.lexsort((self.word, at))
        cuts = np.searchsorted(at[order], np.arange(int(self.length.max(initial=0)) + 2))
        for k in range(len(cuts) - 1):
            arcs = order[cuts[k] : cuts[k + 1]]
            if len(arcs):
                w = self.word[arcs]
                heads = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                yield k, arcs, w[heads], heads

    def forward(self, log_prob: np.ndarray) -> np.ndarray:
        """(words, positions, languages): the logarithm of the summed probability of all cuts up to a position."""
        alpha = np.full((self.n, int(self.length.max(initial=0)) + 1, log_prob.shape[1]), -np.inf)
        alpha[:, 0] = 0.0
        for k, arcs, w, heads in self._slices(self.end):
            alpha[w, k] = summed(alpha[self.word[arcs], self.start[arcs]] + log_prob[self.piece[arcs]], heads)
        return alpha

    def totals(self, log_prob: np.ndarray) -> np.ndarray:
        """(words, languages): log likelihood of each word."""
        return self.forward(log_prob)[np.arange(self.n), self.length]

    def expected(self, log_prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(pieces, languages): how often each piece is expected in words met `counts` times."""
        alpha = self.forward(log_prob)
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(self.n), self.length] = 0.0
        whole = alpha[np.arange(self.n), self.length]
        for k, arcs, w, heads in reversed(list(self._slices(self.start))):
            beta[w, k] = summed(beta[self.word[arcs], self.end[arcs]] + log_prob[self.piece[arcs]], heads)
        share = np.exp(alpha[self.word, self.start] + log_prob[self.piece] + beta[self.word, self.end] - whole[self.word]) * counts[self.word]
        out = np.empty_like(log_prob)
        for lang in range(log_prob.shape[1]):
            out[:, lang] = np.bincount(self.piece, weights=share[:, lang], minlength=len(log_prob))
        return out


def summed(logs: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over the runs of rows that begin at `heads`."""
    most = np.maximum.reduceat(logs, heads)
    runs = np.diff(np.append(heads, len(logs)))
    return most + np.log(np.add.reduceat(np.exp(logs - np.repeat(most, runs, axis=0)), heads))


class Model:
    """Languages with their piece probabilities (the last row is the unknown letter)."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray) -> None:
        self.langs, self.pieces, self.prob = langs, pieces, prob

    def __getstate__(self):
        return {"langs": self.langs, "pieces": self.pieces, "prob": self.prob}

    def __setstate__(self, state) -> None:
        self.__init__(**state)

    @property
    def index(self) -> dict[str, int]:
        if "_index" not in self.__dict__:
            self._index = {p: i for i, p in enumerate(self.pieces)}
            self._longest = max(map(len, self.pieces), default=1)
            self._at: dict[str, int] = {}
            self._sums = np.zeros((0, len(self.langs)))
            self._log = np.log(self.prob)
        return self._index

    def _learn(self, words: list[str]) -> None:
        index = self.index
        used = len(self._at)
        need = used + len(words)
        if need > len(self._sums):
            self._sums = np.concatenate((self._sums[:used], np.zeros((2 * need - used, len(self.langs)))))
        for group in portions(words):
            self._at.update(zip(group, range(used, used + len(group))))
            self._sums[used : used + len(group)] = Lattice(group, index, self._longest).totals(self._log)
            used += len(group)

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) summed over the words, and the number of words."""
        _ = self.index
        if len(self._at) > MEMORY:
            self._at, self._sums = {}, np.zeros((0, len(self.langs)))
        out = np.zeros((len(texts), len(self.langs)))
        parts = [words_of(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in parts:
            new.update(words)
        new.difference_update(self._at)
        long = {w for w in new if len(w) > REMEMBERED}
        if new > long:
            self._learn(sorted(new - long))
        sums = {w: x for group in portions(sorted(long)) for w, x in zip(group, Lattice(group, self.index, self._longest).totals(self._log))}
        for i, every in enumerate(parts):
            words = [w for w in every if w not in sums] if sums else every
            if len(words) < len(every):
                out[i] = sum(sums[w] for w in every if w in sums)
            if words:
                out[i] += self._sums[np.fromiter(map(self._at.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return out, np.array([len(w) for w in parts], dtype=np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        sums, n = self.log_likelihoods(texts)
        shares = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = sums.argmax(axis=1)
        score = np.where(n > 0, 1.0 / shares.sum(axis=1), 0.0)
        return [self.langs[b] if k else UND for b, k in zip(best, n)], score


def fit(rows: list[tuple[str, str]], pieces: list[str], rounds: int = 4, smoothing: float = 0.1) -> Model:
    """rows: (language, text)."""
    langs = sorted({lang for lang, _ in rows})
    counters = {lang: Counter() for lang in langs}
    for lang, text in rows:
        counters[lang].update(words_of(text or ""))
    words = sorted(set().union(*counters.values())) if langs else []
    if not words:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    index = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))
    parts = [(Lattice(group, index, longest), np.array([[counters[g][w] for g in langs] for w in group], dtype=float)) for group in portions(words)]
    prob = np.full((len(pieces) + 1, len(langs)), 1.0 / len(pieces))
    prob[-1] = UNKNOWN
    for _ in range(rounds):
        seen = sum(lattice.expected(np.log(prob), counts) for lattice, counts in parts)[:-1] + smoothing
        prob = np.vstack((seen / seen.sum(axis=0) * (1 - UNKNOWN), np.full(len(langs), UNKNOWN)))
    return Model(langs, pieces, prob)


def sample(docs: DataFrame, lang: str, text: str, doc_id: str, per_lang: int, max_chars: int) -> list[tuple[str, str]]:
    """At most about `per_lang` rows of each language, chosen by the hash of doc_id."""
    fair = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.char_length(text) <= max_chars))
    sizes = {r[0]: r[1] for r in fair.groupBy(F.col(lang)).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return []
    share: Column = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(int(min(1.0, per_lang / n) * (1 << 30)))).otherwise(share)
    some = fair.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) < share)
    return [(r[0], r[1]) for r in some.select(lang, text).limit(2 * per_lang * len(sizes)).collect()]


def identify(docs: DataFrame, vocabulary: str, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, max_chars: int = 20_000) -> DataFrame:
    """doc_id, lang_pred and score of each row. `learn` says which rows may be learnt from."""
    rows = sample(docs if learn is None else docs.where(learn), lang, text, doc_id, per_lang, max_chars)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, load_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                langs, score = model.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
        give_back()

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
