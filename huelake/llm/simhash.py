"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints are dealt to the buckets of every choice of bit blocks that two
fingerprints within the radius must share. Inside a bucket the fingerprints lie in
vertical bit planes, 64 to a word; one query's distances to 64 of them grow together in
carry-save counters, and a word is abandoned once all of its lanes exceed the radius.
Each bucket passes on a star per local component, and the stars are joined to global
components. Any two fingerprints within the radius share a bucket, so no link is lost.

Defined results: null, empty or word-less text has fingerprint zero and links like any
other; equal rows get the same component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import durable, give_back
from .graph import components

BITS = 64
#: Fingerprints of one bucket that are compared as one group; larger buckets are split into pairs of parts.
PART = 8192
#: (query, word) pairs that are compared at once; bounds a task's memory.
PAIRS = 1 << 17


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), 1 << 14):
        part = values[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprinted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])
        give_back()

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprinted(width), "doc_id long, fp long")


def blocks_for(n: int, radius: int) -> list[tuple[int, ...]]:
    """The keys' bit positions. The bits are cut into m blocks; two fingerprints within the
    radius agree in m - radius of them at least. More blocks make longer keys for larger n."""
    m = radius + 1 if n <= 1 << 22 else radius + 2 if n <= 1 << 30 else radius + 3
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    blocks = [tuple(range(cuts[i], cuts[i + 1])) for i in range(m)]
    return [sum((blocks[i] for i in chosen), ()) for chosen in combinations(range(m), m - radius)]


def _keys(prints: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    """A row for each fingerprint and key: the masked bits and the key's number."""
    masks = [sum(1 << b for b in bits) for bits in keys]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    each = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(x).cast("long")).alias("bits")) for i, x in enumerate(signed)])
    return prints.select("fp", "rep", F.explode(each).alias("key")).select("key.k", "key.bits", "fp", "rep")


class Links:
    """Union by smallest label over numbered nodes, fed with arrays of edges."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def within_radius(planes: np.ndarray, lanes: np.ndarray, words: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit-sliced distances of queries[i] to the 64 lanes of word words[i].

    planes: (64, words) vertical bits; lanes: used lanes of each word. Returns the pairs
    that survive with the bits of their lanes within the radius.
    """
    width = radius.bit_length()
    bit = [bool((radius >> i) & 1) for i in range(width)]
    alive = np.arange(len(words))
    counters = [np.zeros(len(words), dtype=np.uint64) for _ in range(width)]
    over = ~lanes[words]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(BITS):
        ask = (np.uint64(0) - ((queries[alive] >> np.uint64(j)) & np.uint64(1)))
        carry = planes[j][words[alive]] ^ ask
        for i in range(width):  # carry-save: add one bit to 64 counters
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if j % 4 == 3:
            above = np.zeros(len(alive), dtype=np.uint64)  # lanes whose counter exceeds the radius
            equal = np.full(len(alive), full)
            for i in reversed(range(width)):
                if bit[i]:
                    equal &= counters[i]
                else:
                    above |= equal & counters[i]
                    equal &= ~counters[i]
            over = over | above
            keep = over != full
            if not keep.all():  # abandon words in which every lane is too far
                alive, over, counters = alive[keep], over[keep], [c[keep] for c in counters]
    return words[alive], alive, ~over


def link_buckets(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (rep, smallest rep of its local component) over rows sorted by bucket."""
    n = len(fp)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, n))
    per = -(-sizes // 64)
    first_word = np.concatenate(([0], np.cumsum(per)[:-1]))
    group = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(n) - starts[group]
    word, lane = first_word[group] + inside // 64, (inside % 64).astype(np.uint64)
    node_of = np.full(int(per.sum()) * 64, -1, dtype=np.int64)
    node_of[word * 64 + lane.astype(np.int64)] = np.arange(n)
    lanes = np.zeros(int(per.sum()), dtype=np.uint64)
    np.bitwise_or.at(lanes, word, np.uint64(1) << lane)
    planes = np.zeros((BITS, int(per.sum())), dtype=np.uint64)
    for j in range(BITS):
        np.bitwise_or.at(planes[j], word, ((fp >> np.uint64(j)) & np.uint64(1)) << lane)
    links = Links(n)
    # a query meets the words from its own on: each pair of rows is compared once
    asks = per[group] - inside // 64
    done = 0
    total = np.cumsum(asks)
    while done < n:
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, side="right")))
        count = asks[done:upto]
        who = np.repeat(np.arange(done, upto), count)
        step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        words, picked, near = within_radius(planes, lanes, word[who] + step, fp[who], radius)
        who = who[picked]
        for k in range(64):
            hit = ((near >> np.uint64(k)) & np.uint64(1)).astype(bool)
            if hit.any():
                links.add(who[hit], node_of[words[hit] * 64 + k])
        done = upto
    order = np.lexsort((rep, links.label))  # name each component by its smallest rep
    label = links.label[order]
    head = np.concatenate(([True], label[1:] != label[:-1]))
    least = rep[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    moved = least != rep[order]
    return rep[order][moved], least[moved]


def _linked(radius: int):
    out = ["u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(upto: int | None):
            nonlocal held, rows
            k, bits, a, b, fp, rep = (np.concatenate(x) for x in zip(*held))
            cut = len(fp) if upto is None else upto
            held, rows = [tuple(x[cut:] for x in (k, bits, a, b, fp, rep))], len(fp) - cut
            if not cut:
                return None
            parts = np.stack([x[:cut] for x in (k, bits, a, b)])
            bucket = np.concatenate(([0], np.cumsum((parts[:, 1:] != parts[:, :-1]).any(axis=0))))
            u, v = link_buckets(bucket, a[:cut], fp[:cut].view(np.uint64), rep[:cut], radius)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], out)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.asarray(batch.column(i)).astype(np.int64) for i in range(6)))
            rows += batch.num_rows
            if rows >= 1 << 16:
                k, bits, a, b = (np.concatenate([h[i] for h in held]) for i in range(4))
                same = (k == k[-1]) & (bits == bits[-1]) & (a == a[-1]) & (b == b[-1])
                if (made := flush(int(np.argmax(same)))) is not None:  # the last bucket may go on
                    yield made
        if rows and (made := flush(None)) is not None:
            yield made

    return run


def near_edges(prints: DataFrame, radius: int, n: int, part: int = PART) -> DataFrame:
    """Edges (u, v) between `rep`s that join all fingerprints within `radius`. prints: distinct fp with rep."""
    keyed = _keys(prints, blocks_for(n, radius))
    large = durable(keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > part))
    zero = F.lit(0).cast("int")
    tasks = keyed.withColumn("a", zero).withColumn("b", zero)
    if large.limit(1).count():  # too large for one group: every pair of its parts is a group
        sized = keyed.join(large, ["k", "bits"], "left")
        count = F.ceil(F.coalesce("size", F.lit(1)) / part).cast("int")
        own = F.pmod(F.xxhash64("fp"), count).cast("int")
        pairs = F.transform(F.sequence(zero, count - 1), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b")))
        tasks = sized.withColumn("pair", F.explode(pairs)).select("k", "bits", "fp", "rep", "pair.a", "pair.b")
    by = ["k", "bits", "a", "b"]
    sorted_ = tasks.select(F.col("k").cast("long").alias("k"), "bits", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "fp", "rep").repartition(*by).sortWithinPartitions(*by)
    return sorted_.mapInArrow(_linked(radius), "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id that links reach."""
    prints = durable(fingerprints(docs, doc_id, text, width))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_edges(distinct, radius, distinct.count()))
    found = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    # one fingerprint may hold a third of the rows: after the checkpoint both sides are plain exchanges, which adaptive execution splits
    return prints.join(durable(found), "fp").select("doc_id", "fp", "component_id")
