"""Cost-balanced packing of token sequences.

Each task tokenises its documents and packs them in groups of `group_tokens` tokens.
A document's cost is linear plus quadratic in its length; documents in descending cost
go to the sequence of least cost among those with room. What fits nowhere whole is cut
over the sequences with the most room, and a group's end is made of sequences
whose lengths are powers of two, which need no padding. Documents
longer than a sequence first fill whole sequences. Nothing is shuffled: a group is a run
of rows of one input partition, so its size is bounded and a lost task repeats alone.

Defined results: null and empty texts have the closing token alone; equal rows are
packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import give_back

CAPACITY = 4096
END_ID = 2
GROUP_TOKENS = 1 << 22
#: Words that a worker remembers the ids of; beyond that it starts afresh.
MEMORY = 700_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        k = len(self.words)
        self[word] = k
        self.words.append(word)
        return k


# The normaliser and the word pattern of a tokenizer file that words can be taken from one by one.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(spec: dict) -> bool:
    """Whether a tokenizer's pieces never cross spaces, as its file says."""
    normal, cuts, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    split, level = [*(cuts.get("pretokenizers") or []), {}, {}][:2]
    return (
        normal.get("normalizers") == NORMALISERS
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex") and len(cuts.get("pretokenizers") or []) == 2
        and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not any(c.isspace() for t in spec.get("added_tokens") or [] for c in t.get("content", ""))
    )


class WordTokenizer:
    """Ids of a tokenizer whose pieces never cross spaces or line ends, with a memory of words.

    A word is numbered when met and its ids are found once. Words of Latin letters go
    straight to the vocabulary's merges, past the normaliser, which only lowers them; a
    trailing full stop or comma after a letter is a piece of its own. Anything else goes
    through the whole tokenizer. A file with another normaliser, another way of cutting
    words or another model than these short cuts hold for encodes whole texts instead.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.merges = self.encoder.model
        self.plain = not cuts_words(json.loads(Path(path).read_text(encoding="utf-8")))
        self.symbols = dict(enumerate(byte_symbols()))
        self.tails = {c: self.encoder.encode(c, add_special_tokens=False).ids for c in ".,"}
        self.memory = memory
        self._reset()

    def _reset(self) -> None:
        self.at = _Numbers()
        self.known = 0
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 18, dtype=np.int64)
        self.lens = np.zeros(1 << 18, dtype=np.int64)
        self.used = 0

    def _letters(self, word: str) -> list[int] | None:
        """Ids of a lower-case word of Latin letters; None for other words."""
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) > "\xff":
                return None
            word = word.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.merges.tokenize(word)]

    def _learn(self) -> None:
        words = self.at.words
        parts: list[tuple[int, str] | None] = []  # (number of the bare word, tail) of words that have one
        k = self.known
        while k < len(words):  # bare words join the end of the list
            word = words[k]
            tail = word[-1:] if len(word) > 1 and word[-1] in self.tails and word[-2].isalpha() and word[-2] <= "\xff" else ""
            bare = word[: len(word) - len(tail)]
            bare = bare.lower() if bare.isalpha() and max(bare) <= "\xff" else bare
            parts.append((self.at[bare], tail) if bare != word else None)
            k += 1
        made = [self._letters(w) if p is None else None for w, p in zip(words[self.known :], parts)]
        odd = [i for i, (ids, p) in enumerate(zip(made, parts)) if ids is None and p is None]
        for i in range(0, len(odd), 4096):
            some = [words[self.known + j] for j in odd[i : i + 4096]]
            for j, x in zip(odd[i : i + 4096], self.encoder.encode_batch_fast(some, add_special_tokens=False)):
                made[j] = x.ids
        first = self.known
        for i, p in enumerate(parts):
            if p is not None:
                b, tail = p
                bare = made[b - first] if b >= first else self.ids[self.starts[b] : self.starts[b] + self.lens[b]].tolist()
                made[i] = bare + self.tails[tail] if tail else bare
        n = len(made)
        lens = np.fromiter(map(len, made), dtype=np.int64, count=n)
        while first + n > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        total = int(lens.sum())
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=total)
        self.starts[first : first + n], self.lens[first : first + n] = self.used + np.cumsum(lens) - lens, lens
        self.used += total
        self.known = first + n

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text, with the closing id."""
        if self.plain:
            return [np.array([*x.ids, END_ID], dtype=np.uint32) for x in self.encoder.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.at) > self.memory:
            self._reset()
        number = self.at.__getitem__
        numbered = []
        for text in texts:
            words = text.replace("\n", " ").split(" ") if text else []
            numbered.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
        if self.known < len(self.at):
            self._learn()
        out = []
        for k in numbered:
            lens = self.lens[k]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            made = np.empty(total + 1, dtype=np.uint32)
            made[:total] = self.ids[np.repeat(self.starts[k] - (ends - lens), lens) + np.arange(total)]
            made[total] = END_ID
            out.append(made)
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def shared_tokenizer(path: str, memory: int = MEMORY) -> WordTokenizer:
    """This process's tokenizer: later tasks of a worker find its memory filled."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path, memory)
    _TOKENIZERS[path].memory = memory
    return _TOKENIZERS[path]


def cost(n, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY):
    return linear * n + quadratic * n * n


def tail_sizes(rest: int) -> list[int]:
    """Lengths of the sequences for a group's last `rest` tokens: the powers of two that make it up."""
    return [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; covers every token once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest = np.array(lengths, dtype=np.int64)
    begin = np.zeros(len(rest), dtype=np.int64)
    for d in np.flatnonzero(rest >= capacity).tolist():
        while rest[d] >= capacity:
            pieces.append((d, int(begin[d]), capacity, sequence, 0))
            begin[d] += capacity
            rest[d] -= capacity
            sequence += 1
    total = int(rest.sum())
    room = np.array([capacity] * (total // capacity) + tail_sizes(total % capacity), dtype=np.int64)
    spent, filled = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)

    def put(d: int, s: int, n: int) -> None:
        pieces.append((d, int(begin[d]), n, sequence + s, int(filled[s])))
        begin[d] += n
        rest[d] -= n
        room[s] -= n
        filled[s] += n
        spent[s] += cost(n)

    loose = []
    for d in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[d])
        if not n:
            break
        s = int(np.where(room >= n, spent, np.inf).argmin())
        if room[s] >= n:
            put(d, s, n)
        else:
            loose.append(d)
    for d in loose:
        while rest[d]:
            s = int(room.argmax())
            put(d, s, int(min(rest[d], room[s])))
    return pieces


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, capacity: int, group_tokens: int, memory: int):
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_tokenizer(path, memory)
        next_id = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        docs: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, held, next_id
            pieces = pack(np.array([len(x) for x in ids]), capacity)
            rows = [(docs[d], a, n, zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()), len(ids[d]), next_id + s, o) for d, a, n, s, o in pieces]
            next_id += 1 + max(p[3] for p in pieces)
            ids, docs, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for d, made in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids.append(made)
                    docs.append(d)
                    held += len(made)
                    if held >= group_tokens:
                        yield flush()
        if ids:
            yield flush()
        give_back()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, memory: int = MEMORY) -> DataFrame:
    """One row for each piece, in COLUMNS. `tokenizer` is the path of its file on every executor; `memory` bounds the words that a worker remembers."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_packed(tokenizer, capacity, group_tokens, memory), COLUMNS)
