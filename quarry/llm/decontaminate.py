"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII bytes. A window has as many words as the items it is held
against (a shorter document is one window). Windows and items get a 128-bit SimHash of their weighted
shingles of five words. Items of one length have an index of their fingerprints by 16 blocks of 8 bits: a fingerprint within RADIUS bits
differs in RADIUS // 16 bits at most in one block at least, so looking up each block
with that many flipped bits misses none within the radius. Each window's blocks are looked up; the items that the index names and that are within the radius are verified exactly:
weighted Jaccard similarity of shingle sets of at least ``threshold``.

A window without any shingle of any item can't be similar to one, so only the others are fingerprinted; which items a window may hold, the index alone
says. At a similarity of 0.8 the expected distance is 19 of 128 bits
with a deviation of 4; RADIUS is over 4.5 deviations beyond.

Weights: the logarithm of (1 + items) / (items with the shingle), so that phrases common to many items
count less; a shingle of no item counts like one of a single item.

Items are taken in passes of at most ``pass_items`` items and PASS_BYTES of text (or of one longer item), each a search over all rows. Weights are those of the whole benchmark in each pass; the
counts of shingles that several items share are broadcast with it, all others are 1. An item of
fewer than five words is one shingle of all its words.

Defined cases: null or empty texts and items, and items with a null item_id, match nothing; a document's best window for each item is reported, the first of equals; repeated rows
are reported each; an empty table of either kind gives no rows; other columns are ignored; long texts are read whole, in blocks of CHUNK windows.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrays import blocks, column, mix, segments, window_hashes, word_hashes
from quarry.llm.licenses import FOLD, GAP

SHINGLE = 5
BITS = 128
RADIUS = 38
BLOCKS = 16
PASS_ITEMS, PASS_BYTES = 2048, 16 << 20
#: Windows fingerprinted at once.
CHUNK = 2048
#: Bits of a shingle's hash in the bitmap that is looked up first.
MAP_BITS = 22

SCHEMA = "row long, doc_id long, item_id long, first_word long, n_words long, hamming int, similarity double"


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of the two hashes of each shingle."""
    two = np.stack([mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], 1)
    bits = np.unpackbits(two.view(np.uint8).reshape(len(shingles), -1), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _block_masks(errors: int) -> list[int]:
    return [m for m in range(256) if bin(m).count("1") <= errors]


@dataclass
class Group:
    """Items with one number ``n`` of shingles: their places in the pass, fingerprints, and the block index."""

    n: int
    items: np.ndarray
    prints: np.ndarray
    #: For each block and value: a mask of the items whose block is within the errors that one block must have at most.
    index: np.ndarray


@dataclass
class Items:
    """Items of one pass: their sets; for each shingle size a bitmap, all shingles (sorted) and the groups; weights of shingles (sorted)."""

    ids: list[int]
    lengths: list[int]
    radius: int
    sizes: dict[int, tuple[np.ndarray, np.ndarray, list[Group]]] = field(default_factory=dict)
    sets: list[set[int]] = field(default_factory=list)
    weight: dict[int, float] = field(default_factory=dict)
    known: np.ndarray | None = None
    known_weight: np.ndarray | None = None
    default: float = 1.0

    def weights(self, s: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(s), self.default)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, self.known_weight[at], self.default)


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words, word offsets of the rows) of blocks of rows."""
    for i, _, data, off in blocks(texts):
        data = FOLD[data]
        starts, _, words = segments(data, off, GAP)
        yield i, word_hashes(data, starts, 0, GAP), words


def prepare(rows: list[tuple[int, str]], radius: int = RADIUS, total: int | None = None, shared: dict[int, int] | None = None) -> Items:
    """Of one pass; ``total`` items and the counts of shingles ``shared`` by several of them, where there are more passes."""
    hashed: list[np.ndarray] = []
    for _, h, words in _words(pa.array([t or "" for _, t in rows], pa.large_string())):
        hashed += [h[a:b] for a, b in zip(words[:-1], words[1:], strict=True)]
    keep = [k for k, h in enumerate(hashed) if len(h)]
    out = Items([rows[k][0] for k in keep], [len(hashed[k]) for k in keep], radius)
    shingles = [window_hashes(hashed[k], min(SHINGLE, len(hashed[k]))) for k in keep]
    n = len(keep)
    counts: dict[int, int] = defaultdict(int)
    for s in shingles:
        out.sets.append(set(s.tolist()))
        for x in out.sets[-1]:
            counts[x] += 1
    most = n if total is None else total
    out.default = float(np.log(1 + most)) if n else 1.0
    if shared is not None:
        counts = dict.fromkeys(counts, 1) | shared
    out.weight = {x: float(np.log((1 + most) / c)) for x, c in counts.items()}
    out.known = np.array(sorted(out.weight), np.uint64)
    out.known_weight = np.array([out.weight[x] for x in out.known.tolist()])
    prints = np.zeros((n, BITS // 8), np.uint8)
    for k, s in enumerate(shingles):
        u = np.unique(s)
        prints[k] = _fingerprint((_signs(u) * out.weights(u)[:, None]).sum(0))
    for size in {min(SHINGLE, x) for x in out.lengths}:
        mine = [k for k in range(n) if min(SHINGLE, out.lengths[k]) == size]
        every = np.unique(np.concatenate([shingles[k] for k in mine]))
        bitmap = np.zeros(1 << MAP_BITS, bool)
        bitmap[every >> np.uint64(64 - MAP_BITS)] = True
        groups = []
        for m in sorted({out.lengths[k] - size + 1 for k in mine}):
            at = np.array([k for k in mine if out.lengths[k] - size + 1 == m])
            index = np.zeros((BLOCKS, 256, (len(at) + 7) // 8), np.uint8)
            for flip in _block_masks(radius // BLOCKS):
                for i, k in enumerate(at):
                    index[np.arange(BLOCKS), prints[k] ^ flip, i // 8] |= 128 >> i % 8
            groups.append(Group(m, at, prints[at], index))
        out.sizes[size] = bitmap, every, groups
    return out


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    # sums of the same numbers in another order may differ in the last place; equal texts must not
    return np.packbits(np.round(sums, 6) > 0, axis=-1)


def _windows(part: np.ndarray, total: np.ndarray, signs: np.ndarray, last: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of ``n`` shingles of ``part`` that begin at ``begins``; each distinct shingle counts once. ``total`` has the running sums of ``signs``
    (of all before a place), ``last`` the place of a shingle's last occurrence before (-1: none)."""
    sums = total[begins + n] - total[begins]
    again = np.flatnonzero(last >= 0)
    if len(again):
        # a shingle that occurs again in a window is taken out there: in windows that begin in (place - n, last]
        low, high = np.maximum(again - n + 1, 0), last[again]
        ok = low <= high
        again, first, stop = again[ok], np.searchsorted(begins, low[ok]), np.searchsorted(begins, high[ok], side="right")
        for p, a, b in zip(again.tolist(), first.tolist(), stop.tolist(), strict=True):
            if a < b:
                sums[a:b] -= signs[p]
    return _fingerprint(sums)


def similarity(a: set[int], b: set[int], items: Items) -> float:
    w = items.weight
    common = sum(w.get(x, items.default) for x in a & b)
    total = sum(w.get(x, items.default) for x in a | b)
    return common / total if total > 0 else 1.0 if a and a == b else 0.0


def _before(s: np.ndarray) -> np.ndarray:
    """The place of each value's last occurrence before; -1 where there is none."""
    order = np.argsort(s, kind="stable")
    same = np.concatenate([[False], s[order][1:] == s[order][:-1]])
    out = np.full(len(s), -1, np.int64)
    out[order[same]] = order[np.flatnonzero(same) - 1]
    return out


def proposals(part: np.ndarray, upto: np.ndarray, contents: np.ndarray, starts: int, group: Group, n: int, items: Items, held: tuple) -> Iterator[tuple[int, int, int]]:
    """(place, item, distance) of windows of ``n`` shingles that the group's index and the radius propose, among those of the first ``starts`` places of ``part`` with a shingle of any item.
    ``upto`` counts these shingles; of windows of the same ``contents`` the first is taken."""
    begins = np.flatnonzero(upto[n : n + starts] > upto[:starts])
    begins = begins[np.sort(np.unique(contents[begins], return_index=True)[1])]
    if not len(begins):
        return
    prints = _windows(part, *held, begins, n)
    named = group.index[0][prints[:, 0]]
    for b in range(1, BLOCKS):
        named |= group.index[b][prints[:, b]]
    window, item = np.nonzero(np.unpackbits(named, axis=1)[:, : len(group.items)])
    distance = np.bitwise_count(prints[window] ^ group.prints[item]).sum(1)
    for k in np.flatnonzero(distance <= items.radius).tolist():
        yield int(begins[window[k]]), int(group.items[item[k]]), int(distance[k])


def matches(h: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(item, first word, words, distance, similarity) of the best window of one document for each item."""
    best: dict[int, tuple[int, int, int, float]] = {}
    for size, (bitmap, every, groups) in items.sizes.items():
        s = window_hashes(h, size)
        hit = bitmap[s >> np.uint64(64 - MAP_BITS)]
        at = np.flatnonzero(hit)
        hit[at] = every[np.minimum(np.searchsorted(every, s[at]), len(every) - 1)] == s[at]
        if not hit.any():
            continue
        upto = np.concatenate([[0], np.cumsum(hit)])
        contents = {n: window_hashes(h, n + size - 1) for n in {min(g.n, len(s)) for g in groups}}
        most = max(contents)
        for a in range(0, len(s), CHUNK):
            b = min(len(s), a + CHUNK + most)
            if upto[b] == upto[a]:
                continue
            part = s[a:b]
            signs = _signs(part) * items.weights(part)[:, None]
            held = np.concatenate([np.zeros((1, BITS)), np.cumsum(signs, 0)]), signs, _before(part)
            for g in groups:
                n = min(g.n, len(s))
                starts = min(CHUNK, len(s) - n + 1 - a)
                if starts <= 0:
                    continue
                for place, k, d in proposals(part, upto[a : b + 1], contents[n][a : a + starts], starts, g, n, items, held):
                    x = similarity(items.sets[k], set(part[place : place + n].tolist()), items)
                    if x >= threshold and (k not in best or x > best[k][3]):
                        best[k] = a + place, n + size - 1, d, x
    return sorted((k, *v) for k, v in best.items())


def _search(batches: Iterator[pa.RecordBatch], held, threshold: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    items: Items = held.value
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 36
    for batch in batches:
        texts, ids = column(batch, "text"), batch.column(0).to_pylist()
        out: list[tuple] = []
        for i, h, words in _words(texts):
            hit = np.zeros(len(words) - 1, bool)
            for size, (bitmap, _, _) in items.sizes.items():
                at = np.flatnonzero(bitmap[window_hashes(h, size) >> np.uint64(64 - MAP_BITS)])
                doc = np.searchsorted(words, at, side="right") - 1
                hit[doc[at + size <= words[doc + 1]]] = True
            for d in np.flatnonzero(hit).tolist():
                for k, first, n, distance, x in matches(h[words[d] : words[d + 1]], items, threshold):
                    out.append((row + i + d, ids[i + d], items.ids[k], first, n, distance, x))
        row += len(ids)
        if out:
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if held and (len(held) == most or size + len(r[1]) > PASS_BYTES // 4):  # a character has four bytes at most
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each item, and a null for the item itself."""
    for batch in batches:
        for _, h, words in _words(column(batch, "text")):
            for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
                if b > a:
                    s = np.unique(window_hashes(h[a:b], min(SHINGLE, b - a)))
                    yield pa.record_batch([pa.array([*s.view(np.int64).tolist(), None], pa.int64())], names=["shingle"])


def _prepared(benchmark: DataFrame, most: int, radius: int) -> Iterator[Items]:
    """The items of each pass, with weights from the whole benchmark."""
    passes = _passes(benchmark, most)
    held = [x for x in (next(passes, None), next(passes, None)) if x]
    if len(held) < 2:
        yield from (prepare(x, radius) for x in held)
        return
    texts = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_item_shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 OR shingle IS NULL").collect()
    total = sum(r.n for r in counts if r.shingle is None)
    shared = {r.shingle % (1 << 64): r.n for r in counts if r.shingle is not None}
    for x in chain(held, passes):
        yield prepare(x, radius, total, shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, pass_items: int = PASS_ITEMS) -> DataFrame:
    """Matches of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text), one row for a document's best window for an item."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    out = None
    for items in _prepared(benchmark, pass_items, radius):
        held = spark.sparkContext.broadcast(items)
        part = rows.mapInArrow(functools.partial(_search, held=held, threshold=threshold), SCHEMA)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], SCHEMA)
    return out.drop("row")


def _clean(batches: Iterator[pa.RecordBatch], held, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        plain = pa.record_batch([pa.array(np.arange(len(keep))), column(batch, "text")], names=["doc_id", "text"])
        for found in _search(iter([plain]), held, threshold):
            keep[found.column(1).to_numpy()] = False
        yield batch.filter(pa.array(keep))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, pass_items: int = PASS_ITEMS) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns, texts unchanged. A narrow stage for each pass."""
    for items in _prepared(benchmark, pass_items, radius):
        held = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(functools.partial(_clean, held=held, threshold=threshold), docs.schema)
    return docs
