"""A run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Texts are rows of integers (symbols from 1 up); several short texts share one index.
`matching_statistics` streams patterns from their ends: while a pattern's next symbol
equals its row's run, the row steps on; otherwise it jumps to the nearer-matching end of
the symbol's next run above or below, whose text position is one of the samples.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The dense rank of each key from 1, and the number of ranks."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([1], (sorted_[1:] != sorted_[:-1]).astype(np.int64))))
    return rank, int(rank[order[-1]])


def suffix_order(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes in order, each read up to its text's end (a zero at end[i]); ties by place. Prefix doubling."""
    n = len(text)
    place = np.arange(n)
    longest = int((end - place).max()) + 1
    bits = max(1, int(text.max()).bit_length())
    have = max(1, min(62 // bits, longest))
    first = np.zeros(n, dtype=np.int64)
    for k in range(have):  # as many symbols as one number holds
        first = (first << bits) | np.where(place + k <= end, text[np.minimum(place + k, n - 1)], 0)
    rank, top = _ranks(first)
    while have < longest and top < n:
        ahead = place + have
        rank, top = _ranks(rank * (top + 1) + np.where(ahead <= end, rank[np.minimum(ahead, n - 1)], 0))
        have *= 2
    return np.argsort(rank * n + place)


class RunLengthIndex:
    """texts: (symbols, lengths) of all texts one after another."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        place = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(symbols) + len(lengths), dtype=np.int64)
        text[place] = symbols
        stops = np.cumsum(lengths + 1) - 1
        order = suffix_order(text, np.repeat(stops, lengths + 1))
        bwt = text[order - 1]
        bwt[order == 0] = 0
        first = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.text, self.n = text, len(text)
        self.run_start, self.run_char = first, bwt[first]
        last = np.append(first[1:], self.n) - 1
        self.sample_first, self.sample_last, self.run_last = order[first], order[last], last
        sizes = last - first + 1
        self.by_char = np.argsort(self.run_char, kind="stable")
        chars = self.run_char[self.by_char]
        before = np.cumsum(sizes[self.by_char]) - sizes[self.by_char]
        # rows whose suffix starts with a symbol are as many as rows it precedes, in the same order
        self.lf_start = np.empty(len(first), dtype=np.int64)
        self.lf_start[self.by_char] = before
        self.runs = len(first)
        self.run_of = np.repeat(np.arange(self.runs, dtype=np.int32), sizes)  # in place of a search for each row's run
        self.keys = chars * self.runs + self.by_char

    def _common(self, a: np.ndarray, b: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at a and b, up to `upto`."""
        out = np.zeros(len(a), dtype=np.int64)
        alive = np.flatnonzero(upto > 0)
        step = 0
        while len(alive):
            k = step + np.arange(8)
            x = self.text[np.minimum(a[alive, None] + k, self.n - 1)]
            y = self.text[np.minimum(b[alive, None] + k, self.n - 1)]
            same = np.cumprod(x == y, axis=1).sum(axis=1)
            out[alive] += same
            step += 8
            alive = alive[(same == 8) & (upto[alive] > step)]
        return np.minimum(out, upto)

    def matching_statistics(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of each pattern, the length of the longest start of its rest that occurs in a text."""
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(len(symbols), dtype=np.int64)
        m = len(lengths)
        row = np.zeros(m, dtype=np.int64)
        at = np.full(m, self.sample_first[0], dtype=np.int64)
        size = np.zeros(m, dtype=np.int64)
        who = np.argsort(-lengths, kind="stable")
        falling = -lengths[who]
        for t in range(int(lengths.max(initial=0))):
            now = who[: int(np.searchsorted(falling, -t, side="left"))]  # patterns longer than t
            place = starts[now] + lengths[now] - 1 - t
            c = symbols[place]
            run = self.run_of[row[now]].astype(np.int64)
            off = np.flatnonzero(self.run_char[run] != c)
            if len(off):
                o, co = now[off], c[off]
                pos = np.searchsorted(self.keys, co * self.runs + run[off])
                below, above = np.minimum(pos, self.runs - 1), np.maximum(pos - 1, 0)
                has_b = (pos < self.runs) & (self.run_char[self.by_char[below]] == co)
                has_a = (pos > 0) & (self.run_char[self.by_char[above]] == co)
                run_b, run_a = self.by_char[below], self.by_char[above]
                fit_b = np.where(has_b, self._common(at[o], self.sample_first[run_b], np.where(has_b, size[o], 0)), -1)
                fit_a = np.where(has_a, self._common(at[o], self.sample_last[run_a], np.where(has_a, size[o], 0)), -1)
                use_b = fit_b >= fit_a
                run[off] = np.where(use_b, run_b, run_a)
                row[o] = np.where(use_b, self.run_start[run_b], self.run_last[run_a])
                at[o] = np.where(use_b, self.sample_first[run_b], self.sample_last[run_a])
                size[o] = np.maximum(fit_b, fit_a)  # -1: the symbol is in no text
            known = size[now] >= 0
            k = now[known]
            row[k] = self.lf_start[run[known]] + row[k] - self.run_start[run[known]]
            at[k] -= 1
            size[k] += 1
            lost = now[~known]
            row[lost], at[lost], size[lost] = 0, self.sample_first[0], 0
            out[place] = size[now]
        return out
