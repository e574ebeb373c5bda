"""Shards of long tables: their number, their hashes in turns, and their strings against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from huelake.llm import rindex, suffixdedup as sd


def test_blobs_grow_with_the_text_and_not_with_its_square():
    blobs = [sd.number_of_parts(gb << 30) ** 2 for gb in (1, 4, 16)]
    assert blobs[1] < 5 * blobs[0] and blobs[2] < 20 * blobs[0]
    assert sd.number_of_parts(0) == 1 and sd.number_of_parts(5000, 2000) == 3


def test_hashes_in_turns_find_the_same_candidates(monkeypatch):
    rng = random.Random(3)
    make = lambda n: bytes(rng.choice(b"abcd ") for _ in range(n))
    shared = [make(rng.randint(60, 200)) for _ in range(5)]
    texts = [make(rng.randint(0, 40)) + rng.choice(shared) + make(rng.randint(0, 40)) + rng.choice(shared) for _ in range(80)]
    entries, _ = sd._entries(list(range(80)), texts)
    frame = pd.DataFrame({"blob": [sd.pack(entries)]})

    def found():
        rows = sd._compare_hashes(3)(frame)
        return sorted((part, kind, *map(int, m)) for part, kind, blob in rows.itertuples(index=False) for m in sd.unpack(blob, sd.MARK))

    whole, most = found(), []
    candidates = sd._candidates
    monkeypatch.setattr(sd, "_candidates", lambda e: most.append(len(e)) or candidates(e))
    monkeypatch.setattr(sd, "ENTRIES", 300)
    assert found() == whole and len(whole) > 100
    assert len(most) > 3 and max(most) < len(entries) / 2 and sum(most) == len(entries)


@pytest.mark.parametrize("seed", range(4))
def test_strings_of_earlier_documents_equal_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(4)]
    rows = []
    for _ in range(200):
        at = rng.randint(0, 8)
        rows.append((0, rng.randint(0, 40), rng.choice(base)[at : at + rng.randint(10, 22)].encode()))
    key, doc, texts = (np.array(x) if n < 2 else x for n, x in enumerate(map(list, zip(*rows))))
    first, want = {}, []
    for k, d, t in rows:
        for i in range(len(t) - 9):
            x = k, t[i : i + 10]
            first[x] = min(first.get(x, d), d)
    for k, d, t in rows:
        want += [i + 10 <= len(t) and first[k, t[i : i + 10]] < d for i in range(len(t))]
    indexed = []
    plain = rindex.RunLengthIndex
    monkeypatch.setattr(sd, "RunLengthIndex", lambda symbols, n: indexed.append(len(n)) or plain(symbols, n))
    made = sd.mark_strings(key, doc, np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), dtype=np.uint8), 10)
    assert made.tolist() == want
    assert indexed[-1] < indexed[0]  # stretches found as a whole are indexed no more
