"""Removal of long byte strings that already occur in an earlier document.

Every string of `length` bytes has an anchor: the 16 bytes of smallest hash in it. Equal
strings have equal anchors, so only places of one anchor can match. Neighbouring strings
of one anchor are held together as a stretch.
1) Candidates. Stretches go to shards by anchor as short hashes in packed arrays, which
decide nothing: they tell which stretches can match one of another document. Two places of
one anchor can only share a string if they also share the 17 bytes before the anchor or the
17 after it. Stretches that look equal form a group, led by its smallest document.
2) Index. The candidates go to shards as bytes. Groups: their leaders' strings make a
run-length index, against which the others are streamed. Differing stretches of one
anchor: they are halved by document again and again; the earlier halves make a run-length
index and the later ones are streamed against it. A matching statistic of `length` or more
marks a string.
3) Marks return to the documents, which drop what they cover.

Before anything is shuffled, equal stretches of a batch or block are joined, by comparing
their bytes: the smallest document's goes on for all, and the others are marked. A large
group is dealt to several shards, each with its leader. An anchor with very many differing
stretches, as at the ends of a passage of a third of all documents, is split into its
single strings, which go to shards by string; they are indexed there like the others.

Defined results: null text counts as empty; texts under `length` bytes lose nothing;
equal rows have equal results; rows without doc_id take no part; strings repeated in one
document only stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import durable, give_back, slots
from .rindex import RunLengthIndex

LENGTH = 50
ANCHOR = 16
#: Bytes that are hashed at once; so few that their arrays stay in a core's cache.
CHUNK = 1 << 17
#: Entries of a shard whose hashes are compared at once.
ENTRIES = 1 << 19
#: Bytes of text whose stretches are joined at once.
PORTION = 1 << 23
#: Bytes of text in a shard or block. Shards times blocks is the number of blobs, so beyond EVEN bytes
#: of text parts grow with its square root, up to GROWN times, and blobs with the text.
PART_BYTES, EVEN, GROWN = 1 << 23, 1 << 30, 4
MOST_PARTS = 1 << 18
#: Stretches that a scan task holds before it packs them, so that a shard's share stays longer than its framing.
HELD, EACH = 1 << 22, 16
COVERED, ASKED, CROWDED, COPIED, LEADING = range(5)
#: Stretches of one anchor, or of one group, that go to one shard together; more are split.
CROWD = 8192
#: Records from which each byte of them is compressed by itself.
SEVERAL = 64
#: Stretches that are compared byte by byte at once.
COMPARED = 1 << 15
#: Bytes beside the anchor on the one side or the other that every string holds.
SIDE = (LENGTH - ANCHOR) // 2
#: Bytes that one index is made of at a time, where anchors allow.
INDEX_BYTES = 1 << 20
ENTRY = np.dtype([("key", "<u8"), ("hash", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1")])
MARK = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1")])
#: Kept, as making one takes longer than a short blob's compression.
_QUICK, _TIGHT, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def pack(entries: np.ndarray) -> bytes:
    """Bytes of a record array, like bytes side by side and compressed by themselves; documents and starts as steps, which are short in their order."""
    steps = entries.copy()
    for name in ("doc", "start"):
        steps[name][1:] -= entries[name][:-1]
    n, planes = len(steps), steps.view(np.uint8).reshape(len(steps), steps.dtype.itemsize).T
    used = [i for i, p in enumerate(planes) if p.any()] if n >= SEVERAL else []
    out = [n.to_bytes(8, "little"), sum(1 << i for i in used).to_bytes(8, "little")]
    for i in used:
        raw = planes[i].tobytes()
        small = _TIGHT.compress(raw)
        out += [min(len(small), n).to_bytes(4, "little"), small if len(small) < n else raw]
    return b"".join(out if n >= SEVERAL else [*out, _QUICK.compress(planes.tobytes())])


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n, used = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    if n < SEVERAL:
        planes = np.frombuffer(_OPEN.decompress(blob[16:]), dtype=np.uint8).reshape(dtype.itemsize, n)
    else:
        planes, at = np.zeros((dtype.itemsize, n), dtype=np.uint8), 16
        for i in (k for k in range(dtype.itemsize) if used >> k & 1):
            size = int.from_bytes(blob[at : at + 4], "little")
            raw = blob[at + 4 : at + 4 + size]
            planes[i] = np.frombuffer(raw if size == n else _OPEN.decompress(raw), dtype=np.uint8)
            at += 4 + size
    out = planes.T.copy().reshape(-1).view(dtype)
    for name in ("doc", "start"):
        out[name] = np.cumsum(out[name], dtype=dtype[name])
    return out


def unpack_all(blobs, dtype: np.dtype) -> np.ndarray:
    """The records of all blobs, filled into one array."""
    sizes = [int.from_bytes(b[:8], "little") for b in blobs]
    out, at = np.empty(sum(sizes), dtype=dtype), 0
    for blob, n in zip(blobs, sizes):
        out[at : at + n] = unpack(blob, dtype)
        at += n
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[: len(x) - step] | (x[step:] << np.uint64(8 * step))
    return x


def stretches(data: np.ndarray, first: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(start, more, key, hash, left, right) of the stretches in `data`, which holds pieces that begin at `first`.

    A stretch is the strings that start in [start, start + more] and share their anchor. left and
    right are hashes of the SIDE bytes beside it with 16 bits, or zero where the stretch has fewer.
    """
    if len(data) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    with np.errstate(over="ignore"):
        eight = _eights(data)
        mixed = _mix(eight * _A)
        n = len(data) - anchor + 1
        key = _mix(mixed[:n] + _B * mixed[anchor - 8 : anchor - 8 + n])
        low = (key & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)  # smallest hash, leftmost first
        width = length - anchor + 1
        have = 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        whole = np.ones(len(low), dtype=bool)  # strings that cross from one piece to the next are none
        for b in first[1:].tolist():
            whole[max(0, b - length + 1) : b] = False
        at = np.flatnonzero(whole)
        place = (low[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else at
        start = at[head]
        stop = at[np.append(head[1:], len(at)) - 1] if len(at) else at
        power = np.cumprod(np.full(len(mixed) + 1, _A | np.uint64(1), dtype=np.uint64))
        inverse = np.uint64(pow(int(_A | np.uint64(1)), -1, 1 << 64))
        back = np.cumprod(np.full(len(mixed) + 1, inverse, dtype=np.uint64))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed * power[: len(mixed)])))
        hashed = _mix((sums[stop + length - 7] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
        spot = place[head]
        top = len(mixed) - 1

        def beside(at: np.ndarray, valid: np.ndarray) -> np.ndarray:
            """Hash of the SIDE bytes from `at`, of overlapping eights."""
            made = key[spot]
            for shift in (*range(0, SIDE - 7, 8), SIDE - 8):
                made = _mix(made + mixed[np.clip(at + shift, 0, top)] * _C)
            return np.where(valid, (made >> np.uint64(48)) | np.uint64(1), np.uint64(0)).astype(np.uint16)

        left = beside(spot - SIDE, spot - SIDE >= start)
        right = beside(spot + anchor, spot + anchor + SIDE <= stop + length)
    # 40 bits of the anchor go on, 40 of the bytes and 16 of each side
    return start, stop - start, key[spot] >> np.uint64(24), hashed >> np.uint64(24), left, right


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about CHUNK bytes; long texts overlap where they are cut."""
    group, size = [], 0
    for i, raw in enumerate(texts):
        for offset in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
            piece = raw[offset : offset + CHUNK + LENGTH - 1]
            if len(piece) >= LENGTH:
                group.append((i, offset, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _entries(ids: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of all texts, and where each begins in the joined texts."""
    parts, places = [np.zeros(0, dtype=ENTRY)], [np.zeros(0, dtype=np.int64)]
    begin = np.cumsum([0, *map(len, texts)])
    for group in _pieces(texts):
        sizes = np.array([len(p) for _, _, p in group])
        first = np.cumsum(sizes) - sizes
        start, more, key, hashed, left, right = stretches(np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8), first)
        owner = np.searchsorted(first, start, side="right") - 1
        made = np.zeros(len(start), dtype=ENTRY)
        made["key"], made["hash"], made["more"], made["left"], made["right"] = key, hashed, more, left, right
        made["doc"] = np.array([ids[i] for i, _, _ in group], dtype=np.int64)[owner]
        made["start"] = start - first[owner] + np.array([o for _, o, _ in group], dtype=np.int64)[owner]
        parts.append(made)
        places.append(begin[np.array([i for i, _, _ in group], dtype=np.int64)[owner]] + made["start"])
    return np.concatenate(parts), np.concatenate(places)


def shared(entries: np.ndarray, side: str) -> np.ndarray:
    """Which entries have the same hash on a side of their anchor as one of another document."""
    order = np.lexsort((entries["doc"], entries[side], entries["key"]))
    key, part, doc = entries["key"][order], entries[side][order], entries["doc"][order]
    heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    sizes = np.diff(np.append(heads, len(order)))
    out = np.empty(len(order), dtype=bool)
    out[order] = np.repeat(doc[heads] < doc[heads + sizes - 1], sizes) & (part > 0)
    return out


def grouped(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, leader): the entries whose anchor is not alone, by anchor, hashes and document; and for each
    place in that order the place of its group's first."""
    order = np.argsort(entries["key"], kind="stable")
    key = entries["key"][order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(key) else order
    some = entries[order]
    by = np.lexsort((some["start"], some["doc"], some["more"], some["hash"], some["right"], some["left"], some["key"]))
    order, some = order[by], some[by]
    new = np.ones(len(some), dtype=bool)
    for name in ("key", "left", "right", "hash", "more"):
        if name == "key":
            new[1:] = some[name][1:] != some[name][:-1]
        else:
            new[1:] |= some[name][1:] != some[name][:-1]
    heads = np.flatnonzero(new)
    return order, heads[np.cumsum(new) - 1] if len(some) else heads


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a and from b are equal."""
    out = np.ones(len(a), dtype=bool)
    for i in range(0, len(a), COMPARED):
        n = size[i : i + COMPARED]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(a[i : i + COMPARED], n) + step] == data[np.repeat(b[i : i + COMPARED], n) + step]
        out[i : i + COMPARED] = np.logical_and.reduceat(equal, first)
    return out


def joined(entries: np.ndarray, places: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which entries equal, byte by byte, one of an earlier document among them."""
    order, leader = grouped(entries)
    later = np.flatnonzero(entries["doc"][order] > entries["doc"][order[leader]]) if len(order) else leader
    mine, first = order[later], order[leader[later]]
    out = np.zeros(len(entries), dtype=bool)
    if len(mine):
        out[mine] = same_bytes(data, places[mine], places[first], entries["more"][mine].astype(np.int64) + LENGTH)
    return out


def _rows(part: np.ndarray, kind: int, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Records packed by their part's number. Marks of covered strings need no anchor any more."""
    if kind == COVERED and len(values):
        values["key"] = 0
    return [(k, kind, pack(values[some])) for k, some in _by_part(part)]


def _by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, indexes) of each part that occurs."""
    if not len(part):
        return []
    order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")  # 16 bits: radix
    sorted_ = part[order]
    cuts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return [(int(sorted_[a]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(part)])]


def _block(doc: np.ndarray, n: int) -> np.ndarray:
    """The block of each document; `block_column` is the same in SQL."""
    return np.mod(doc ^ (doc.view(np.uint64) >> np.uint64(15)).view(np.int64), n)


def block_column(n: int):
    return F.pmod(F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 15)), F.lit(n).cast("long"))


def _marks(entries: np.ndarray, keep: np.ndarray) -> np.ndarray:
    some = entries[keep]
    made = np.zeros(len(some), dtype=MARK)
    for name in MARK.names:
        made[name] = some[name]
    return made


SCHEMA = "part long, kind int, blob binary"


def _frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "blob"]).astype({"part": "int64", "kind": "int32"})


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """The batch's rows in groups of about PORTION bytes, which bounds a task's arrays."""
    ids, texts, size = [], [], 0
    for i in range(batch.num_rows):
        text = batch.column(1)[i].as_py()
        ids.append(batch.column(0)[i].as_py())
        texts.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(texts[-1])
        if size >= PORTION:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key % np.uint64(shards)).astype(np.int64)


def _scan(shards: int, blocks: int):
    """Shard entries (kind ASKED, part = shard) and marks found at once (kind COVERED, part = block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            entries, marks = (np.concatenate(x) for x in zip(*held))
            held.clear()
            rows = _rows(_block(marks["doc"], blocks), COVERED, marks) + _rows(_shard(entries["key"], shards), ASKED, entries)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"])

        for batch in batches:
            for ids, texts in _portions(batch):
                entries, places = _entries(ids, texts)
                twin = joined(entries, places, np.frombuffer(b"".join(texts), dtype=np.uint8))
                marks, entries = _marks(entries, twin), entries[~twin]
                held.append((entries, marks))
                if sum(len(e) for e, _ in held) >= min(HELD, EACH * shards):
                    yield packed()
        if held:
            yield packed()
        give_back()

    return run


def _candidates(entries: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(kind, marks) of the candidates among stretches, which hold all of their anchors."""
    order, leader = grouped(entries)
    some = entries[order]
    copy = some["doc"] > some["doc"][leader]
    # groups: the copies, and for each share of CROWD copies the leader again, under a key of the share
    rank = np.cumsum(copy) - 1
    share = (rank - rank[leader]) // CROWD if len(some) else rank
    with np.errstate(over="ignore"):
        mixed = _mix(some["key"] * _A + some["hash"] * _B + some["left"].astype(np.uint64) * _C)
        mixed = _mix(mixed + some["right"].astype(np.uint64) * _A + some["more"].astype(np.uint64) * _B + share.astype(np.uint64) * _C) >> np.uint64(16)  # 48 bits
    at = np.flatnonzero(copy)
    shares, index = np.unique(mixed[at], return_index=True)
    copied, leading = _marks(some, at), _marks(some, leader[at[index]])
    copied["key"], leading["key"] = mixed[at], shares
    # differing stretches of one anchor: those that share a side with one of another document
    first = some[~copy]
    asked = (shared(first, "left") | shared(first, "right")) if len(first) else np.zeros(0, dtype=bool)
    _, of, times = np.unique(first["key"][asked], return_inverse=True, return_counts=True)
    crowded = asked.copy()
    crowded[asked] = times[of] > CROWD if len(times) else False
    return [(COPIED, copied), (LEADING, leading), (ASKED, _marks(first, asked & ~crowded)), (CROWDED, _marks(first, crowded))]


def _compare_hashes(blocks: int):
    """The candidates among a shard's stretches, as marks to their blocks; of a large shard, some anchors at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        entries = unpack_all(rows["blob"], ENTRY)
        turns = -(-len(entries) // ENTRIES)
        turn = (_mix(entries["key"]) % np.uint64(max(1, turns))).astype(np.uint8)
        found = [_candidates(entries[turn == i]) for i in range(turns)]
        del entries
        out = []
        for made in zip(*found):
            marks = np.concatenate([m for _, m in made])
            marks = marks[np.lexsort((marks["start"], marks["doc"]))]
            out += _rows(_block(marks["doc"], blocks), made[0][0], marks)
        return _frame(out)

    return run


def _strings(marks: np.ndarray, where: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every string of the stretches as a stretch of its own, under a key of its own; and where each begins."""
    n = marks["more"].astype(np.int64) + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    made = np.repeat(marks, n)
    made["start"] += step.astype(np.uint32)
    made["more"] = 0
    places = np.repeat(where, n) + step
    made["key"] = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + LENGTH]) for a in places.tolist()), dtype=np.uint64, count=len(places)) >> np.uint64(16)
    return made, places


def spanning(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Intervals (by start, none inside another) that cover what all of them cover: from each, the last that it reaches."""
    starts, ends, i, out = start.tolist(), end.tolist(), 0, []
    while i < len(starts):
        out.append(i)
        i = max(i + 1, bisect_right(starts, ends[i], i + 1) - 1)
    return out


def _fetch(shards: int, blocks: int):
    """Bytes of the candidates, to their shards. A blob is packed marks and, after them, the bytes.

    Of a block's equal stretches the smallest document's goes on, and the others are marked.
    Copies whose bytes other copies of their document cover add nothing, and stay behind.
    """

    def run(key: tuple, docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(docs):
            return _frame([])
        ids, texts = docs["doc_id"].to_numpy(), [t.encode("utf-8", "surrogatepass") if t else b"" for t in docs["text"]]
        begin = np.cumsum([0, *map(len, texts)])
        data = b"".join(texts)
        del texts
        plain = np.frombuffer(data, dtype=np.uint8)
        by_id = np.argsort(ids, kind="stable")
        rows: list[tuple[int, int, bytes]] = []
        for kind in (ASKED, COPIED, CROWDED):
            marks = unpack_all(asked["blob"][asked["kind"] == kind], MARK)
            where = begin[by_id[np.searchsorted(ids, marks["doc"], sorter=by_id)]] + marks["start"] if len(marks) else np.zeros(0, dtype=np.int64)
            if kind == CROWDED:
                marks, where = _strings(marks, where, data)
            if kind == COPIED:
                by = np.argsort(where, kind="stable")
                by = by[spanning(where[by], where[by] + marks["more"][by] + LENGTH)]
                leading = unpack_all(asked["blob"][asked["kind"] == LEADING], MARK)
                lead = begin[by_id[np.searchsorted(ids, leading["doc"], sorter=by_id)]] + leading["start"] if len(leading) else where[:0]
                marks, where = np.concatenate((marks[by], leading)), np.concatenate((where[by], lead))
            if not len(marks):
                continue
            entries = np.zeros(len(marks), dtype=ENTRY)
            for name in MARK.names:
                entries[name] = marks[name]
            size = marks["more"].astype(np.int64) + LENGTH
            if kind != COPIED:  # the key of a copy tells its bytes already
                spots = where, where + size - 8
                ends = [sum(plain[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8)) for at in spots]
                with np.errstate(over="ignore"):
                    entries["hash"] = _mix(ends[0] * _A + ends[1] * _B)
            twin = joined(entries, where, plain)
            found = marks[twin]
            rows += _rows(_block(found["doc"], blocks), COVERED, found)
            marks, where, size = marks[~twin], where[~twin], size[~twin]
            to = kind if kind == COPIED else ASKED
            by = np.argsort(where)
            marks, where, size = marks[by], where[by], size[by]
            for part, some in _by_part(_shard(marks["key"], shards)):
                head = pack(marks[some])
                raw = b"".join(data[a : a + n] for a, n in zip(where[some].tolist(), size[some].tolist()))
                rows.append((part, to, len(head).to_bytes(8, "little") + head + _TIGHT.compress(raw)))
        give_back()
        return _frame(rows)

    return run


def _opened(blobs) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Marks, sizes and joined bytes of blobs that `_fetch` made."""
    marks, raw = [np.zeros(0, dtype=MARK)], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        marks.append(unpack(blob[8 : 8 + n], MARK))
        raw.append(_OPEN.decompress(blob[8 + n :]))
    every = np.concatenate(marks)
    return every, every["more"].astype(np.int64) + LENGTH, b"".join(raw)


def _taken(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the bytes of some stretches."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def mark_strings(key: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each byte of the stretches: does a string that starts there occur in a smaller document's stretch of the same key?

    Halves the stretches of each key by document; all keys' halves of one level share one index.
    A string's first occurrence is never found, so stretches of which every string is found are
    needed no more: what still matches them matches the first as well.
    """
    start = np.cumsum(size) - size
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    step = (~new & np.concatenate(([False], d[1:] != d[:-1]))).astype(np.int64)
    total = np.cumsum(step)
    heads = np.flatnonzero(new)
    rank = np.empty(len(order), dtype=np.int64)  # number of the document among its key's
    rank[order] = total - total[heads][np.cumsum(new) - 1]
    found = np.zeros(len(data), dtype=bool)
    level = 0
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    highest = np.zeros(len(heads), dtype=np.int64)
    np.maximum.at(highest, group, rank)
    strings = size - length + 1
    left = strings > 0
    while (1 << level) <= int(rank.max(initial=0)):
        half = rank >> level
        later = (half % 2 == 1) & left
        earlier = (half % 2 == 0) & left & (highest[group] >> level > half)
        # symbols of different pairs of halves differ, so that no later document is matched
        symbols = (half >> 1)[:, None]
        if later.any() and earlier.any():
            def take(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                n = size[which]
                spots = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                return data[spots].astype(np.int64) + 1 + 257 * np.repeat(symbols[which, 0], n), n, spots

            texts, n, _ = take(np.flatnonzero(earlier))
            index = RunLengthIndex(texts, n)
            patterns, n, spots = take(np.flatnonzero(later))
            found[spots[index.matching_statistics(patterns, n) >= length]] = True
            sums = np.concatenate(([0], np.cumsum(found)))
            left &= sums[start + size] - sums[start] < strings
        level += 1
    return found


def mark_copies(key: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each byte of the stretches: does a string that starts there occur in the stretch of its key's smallest document?

    Those stretches make an index, and the others are streamed against it.
    """
    start = np.cumsum(size) - size
    follows = followers(key, doc)
    others = np.flatnonzero(follows)
    leads = np.flatnonzero(~follows & np.isin(key, key[others]))
    found = np.zeros(len(data), dtype=bool)
    if len(others):
        index = RunLengthIndex(data[_taken(data, start[leads], size[leads])].astype(np.int64) + 1, size[leads])
        spots = _taken(data, start[others], size[others])
        found[spots] = index.matching_statistics(data[spots].astype(np.int64) + 1, size[others]) >= length
    return found


def followers(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """False for the smallest document of each key, True for the others."""
    order = np.lexsort((doc, key))
    heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    least = np.repeat(doc[order][heads], np.diff(np.append(heads, len(order))))
    out = np.empty(len(order), dtype=bool)
    out[order] = doc[order] > least
    return out


def _decided(blobs, mark, blocks: int, alike: bool = False) -> list[tuple[int, int, bytes]]:
    """Marks of the strings that `mark` finds in the stretches of some blobs, whole keys at a time.

    `alike`: a key's stretches are told apart by their bytes, and all but the smallest document's have one result.
    """
    every, sizes, whole = _opened(blobs)
    if not len(every):
        return []
    ends = np.cumsum(sizes)
    raw = [whole[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist())]
    key, who = every["key"], every["doc"]
    if alike:
        groups: dict[tuple, int] = {}
        key = np.array([groups.setdefault(x, len(groups)) for x in zip(key.tolist(), raw)], dtype=np.int64)
        who = followers(key, every["doc"])
    numbers: dict[tuple, int] = {}  # equal stretches that have one result are compared once
    copy_of = np.array([numbers.setdefault(x, len(numbers)) for x in zip(key.tolist(), who.tolist(), raw)])
    once = np.unique(copy_of, return_index=True)[1]
    data = np.frombuffer(b"".join(x for _, _, x in numbers), dtype=np.uint8)
    del numbers, whole, raw
    keys, marks, size = key[once], every[once], sizes[once]
    start = np.cumsum(size) - size
    found = np.zeros(len(data), dtype=bool)
    order = np.argsort(keys, kind="stable")
    key, at = keys[order], 0
    filled = np.cumsum(size[order])
    while at < len(order):  # INDEX_BYTES at a time
        upto = int(np.searchsorted(filled, (filled[at - 1] if at else 0) + INDEX_BYTES, side="right"))
        upto = int(np.searchsorted(key, key[min(max(upto, at + 1), len(order)) - 1], side="right"))
        some = order[at:upto]
        spots = _taken(data, start[some], size[some])
        found[spots] = mark(keys[some], marks["doc"][some], size[some], data[spots])
        at = upto
    owner = np.repeat(np.arange(len(size)), size)
    hit = np.flatnonzero(found)
    if not len(hit):
        return []
    head = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))))
    first, last = hit[head], hit[np.append(head[1:], len(hit)) - 1]
    # back to every copy: the runs of its stretch
    owned = owner[first]
    runs = np.bincount(owned, minlength=len(size))
    at_run = np.cumsum(runs) - runs
    times = runs[copy_of]
    back = np.repeat(np.arange(len(every)), times)
    run = np.repeat(at_run[copy_of] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    made = np.zeros(len(back), dtype=MARK)
    made["doc"], made["start"], made["more"] = every["doc"][back], every["start"][back] + first[run] - start[owned[run]], (last - first)[run]
    return _rows(_block(made["doc"], blocks), COVERED, made)


def _compare_bytes(blocks: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [rows[rows["kind"] == COVERED]]
        for kind, mark in ((ASKED, mark_strings), (COPIED, mark_copies)):
            out.append(_frame(_decided(rows["blob"][rows["kind"] == kind], mark, blocks, alike=kind == COPIED)))
        return pd.concat(out)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered_runs(n: int, start: np.ndarray, more: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of the bytes under the marked strings."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + more + length, n), -1)
    on = np.concatenate(([False], np.cumsum(edge[:n]) > 0, [False]))
    turns = np.flatnonzero(on[1:] != on[:-1])
    return turns[::2], turns[1::2]


def _finish(key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    found = unpack_all(marks["blob"], MARK)
    found = found[np.argsort(found["doc"], kind="stable")]
    ids, cuts = np.unique(found["doc"], return_index=True)
    where = {int(d): (int(a), int(b)) for d, a, b in zip(ids, cuts, [*cuts[1:], len(found)])}
    rows = []
    for doc, text in zip(docs["doc_id"].tolist(), docs["text"].tolist()):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        removed, spans = 0, 0
        kept = raw
        if doc in where:
            part = found[slice(*where[doc])]
            a, b = covered_runs(len(raw), part["start"].astype(np.int64), part["more"].astype(np.int64))
            removed, spans = int((b - a).sum()), len(a)
            kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
        rows.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def number_of_parts(total: int, part_bytes: int = PART_BYTES) -> int:
    grown = int(part_bytes * min(max(1.0, (total / EVEN) ** 0.5), GROWN))
    return min(max(1, -(-total // grown)), MOST_PARTS) | 1


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """RESULT of each document. The text is read twice and shuffled once, by block of documents.

    `part_bytes` is the text of a shard or block; beyond EVEN bytes of text and MOST_PARTS of them they grow.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = number_of_parts(total, part_bytes)
    slot = slots(spark, parts)

    def dealt(df: DataFrame) -> DataFrame:
        """One partition for each shard or block."""
        return df.withColumn("slot", slot(F.col("part"))).repartition(parts, "slot")

    def first_round(rows: pd.DataFrame) -> pd.DataFrame:
        made = [rows[rows["kind"] == COVERED][["part", "kind", "blob"]]]
        rows = rows[rows["kind"] == ASKED]
        if len(rows):
            made.append(_compare_hashes(parts)(rows))
        give_back()
        return pd.concat(made)

    def second_round(rows: pd.DataFrame) -> pd.DataFrame:
        made = _compare_bytes(parts)(rows[["part", "kind", "blob"]])
        give_back()
        return made

    def fetch(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _fetch(parts, parts)(key, left, right)

    known = durable(dealt(plain.mapInArrow(_scan(parts, parts), SCHEMA)).groupBy("slot").applyInPandas(first_round, SCHEMA))
    blocks = dealt(plain.withColumn("part", block_column(parts)))
    candidates = dealt(known.where(F.col("kind") != COVERED))
    bytes_ = blocks.groupBy("slot").cogroup(candidates.groupBy("slot")).applyInPandas(fetch, SCHEMA)
    more = dealt(bytes_).groupBy("slot").applyInPandas(second_round, SCHEMA)
    marks = dealt(known.where(F.col("kind") == COVERED).union(more))
    return blocks.groupBy("slot").cogroup(marks.groupBy("slot")).applyInPandas(_finish, RESULT)
