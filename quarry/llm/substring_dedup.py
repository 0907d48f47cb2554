"""Removal of repeated passages by recompression.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is ``size`` consecutive words of a document; the words of each window whose word sequence also starts
earlier (in a smaller doc_id, or before it in the same document) are removed, all judged on the input.

Recompression: rounds replace runs of one symbol and pairs of a left and a right symbol (the side is a bit of the
symbol's hash in that round) by symbols named after their contents. A name is a 64-bit hash of what it stands for, so it is global without a table of
names, and the rounds need no shuffle of their own; Spark brings equal names together after the last. Which words decide that a symbol stands where it does is tracked; equal
windows therefore hold the same interior symbols at the same places, whatever surrounds them. A window's anchor is, of its interior symbols of the highest
level that has any, the one of the smallest name; it is known by that name together with the words that decide it. Neighbouring windows mostly share it, so
one row stands for several words. Levels are few, as the words that decide a symbol grow with its level and must fit into a window with room to spare.

Spark then keeps anchors that occur twice. Of these, stretches (the words of all windows with one anchor) that equal each other as
a whole are settled at once, by an independent hash of their words: all but the first go. Only where one anchor stands in
different stretches (at the edges of repeated passages) are the windows of each stretch's first occurrence compared one by one, by 128 bits of hash. Windows without interior symbols
(runs of one word) are their own anchors.

Texts stay where they are: only those with windows to be compared, and those that lose words, are fetched, by a Bloom filter of their keys.

A document is known by doc_id and 64 bits of hash of id and text, and comes before others of its id in the order of these: repeated rows are one document. Null doc_ids come
last. Null, empty and short texts lose nothing; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrays import WORD_BASE, blocks, column, inverse, mix, powers, segments, spans, window_hashes, word_hashes
from quarry.llm._shared import bloom, look_up, release, row_keys, texts_of, written

WINDOW = 20
#: Rounds of pair naming, and those that name runs first: more of either would widen the words that decide a symbol.
ROUNDS = 3
RUN_ROUNDS = (0,)
#: Low bits of a rank that hold a symbol's place.
PLACE_BITS = 31

STRETCHES = "anchor long, print long, doc_id long, key long, at int, n int"
WINDOWS = "w1 long, w2 long, doc_id long, key long, at int"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

_RUN, _LEFT, _RIGHT, _SIDE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A63), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def recompress(h: np.ndarray, off: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: names, first words, and the words [low, high) that decide that the symbol stands there.

    At a document's ends these reach beyond it, so no window holds them.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    sym, start, low, high = h, np.arange(n), np.arange(n), np.arange(1, n + 1)
    out = []
    for r in range(rounds):
        for step in ("runs", "pairs") if r in RUN_ROUNDS else ("pairs",):
            if not len(sym):
                break
            m = len(sym)
            edge = doc[1:] != doc[:-1]
            prev_low = np.concatenate([[0], low[:-1]])
            prev_low[np.concatenate([[True], edge])] = off[doc[np.concatenate([[True], edge])]] - 1
            next_high = np.concatenate([high[1:], [0]])
            next_high[np.concatenate([edge, [True]])] = off[doc[np.concatenate([edge, [True]])] + 1] + 1
            if step == "runs":
                first = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | edge]))
                k = np.diff(np.append(first, m))
                low, high = prev_low[first], next_high[first + k - 1]
                sym = np.where(k > 1, mix(sym[first] ^ (k.astype(np.uint64) * _RUN)), sym[first])
            else:
                left = (mix(sym + _SIDE * np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
                pair = np.zeros(m, bool)
                pair[:-1] = left[:-1] & ~left[1:] & ~edge
                second = np.concatenate([[False], pair[:-1]])
                first = np.flatnonzero(~second)
                p = pair[first]
                after = np.minimum(first + 1, m - 1)
                low = np.where(p | left[first], low[first], prev_low[first])
                high = np.where(p, high[after], np.where(left[first], next_high[first], high[first]))
                sym = np.where(p, mix(sym[first] * _LEFT + mix(sym[after] * _RIGHT)), sym[first])
            start, doc = start[first], doc[first]
        out.append((sym, start, low, high))
    return out


def anchors(h: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its first word, its anchor's name, the anchor's first word, and a number that is one anchor's alone."""
    n = len(h)
    count = np.maximum(np.diff(off) - size + 1, 0)
    at = np.repeat(off[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    name, spot, own = np.zeros(len(at), np.uint64), at.copy(), np.full(len(at), -1, np.int64)
    todo = np.arange(len(at))
    levels, prefix = recompress(h, off), _prefix(h, 0)
    for level in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        sym, start, low, high = levels[level]
        begin = np.cumsum(np.bincount(low + 1, minlength=n + 2))  # symbols whose low is before a word
        end = np.cumsum(np.bincount(high, minlength=n + size + 2))
        a, b = begin[at[todo]], end[at[todo] + size]
        some = a < b
        a, b, chosen = a[some], b[some], todo[some]
        if len(chosen):
            rank = mix(sym ^ _SIDE) & ~np.uint64((1 << PLACE_BITS) - 1) | np.arange(len(sym), dtype=np.uint64)
            width = b - a
            best = np.empty(len(a), np.uint64)
            k = 0
            while True:  # the smallest rank of each range, from two ranges of a power of two
                fits = (width >> k) == 1
                best[fits] = np.minimum(rank[a[fits]], rank[b[fits] - (1 << k)])
                if int(width.max()) >> (k + 1) == 0:
                    break
                rank = np.minimum(rank, np.append(rank[1 << k :], np.full(min(1 << k, len(rank)), np.uint64(2**64 - 1)))[: len(rank)])
                k += 1
            x = (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            name[chosen] = mix(sym[x] + _hash_of(prefix, low[x], high[x], 0))
            spot[chosen] = start[x]
            own[chosen] = x * (ROUNDS + 1) + level
        todo = todo[~some]
    if len(todo):
        name[todo] = window_hashes(h, size)[at[todo]]
        own[todo] = -1 - at[todo]
    return at, name, spot, own


def _hash_of(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    return mix((prefix[b] - prefix[a]) * powers(inverse(WORD_BASE[which]), len(prefix))[a])


def _prefix(h: np.ndarray, which: int) -> np.ndarray:
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(which)) * powers(WORD_BASE[which], len(h)), out=s[1:])
    return s


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0), batch.column(2)
        for i, _, data, off in blocks(column(batch, "text")):
            starts, _, words = segments(data, off)
            if not len(starts) or int(np.diff(words).max()) < size:
                continue
            h = word_hashes(data, starts)
            at, name, spot, own = anchors(h, words, size)
            doc = np.searchsorted(words, at, side="right") - 1
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
            last = np.append(first[1:], len(at)) - 1
            a, b, d = at[first], at[last] + size, doc[first]
            n = b - a
            # the stretch's words and its anchor's place in it
            seal = mix(_hash_of(_prefix(h, 1), a, b, 1) + (n * 65_537 + spot[first] - a).astype(np.uint64))
            row = pa.array(i + d)
            yield pa.record_batch(
                [pa.array(name[first].view(np.int64)), pa.array(seal.view(np.int64)), ids.take(row), keys.take(row), pa.array((a - words[d]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "print", "doc_id", "key", "at", "n"]
            )


def _lists(a: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a list<struct> column; null is an empty list."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    flat = a.flatten()
    n = np.array([0 if x is None else x for x in pa.compute.list_value_length(a).to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(n)]), [flat.field(k).to_numpy(zero_copy_only=False) for k in names]


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that each document (doc_id, key, asked, text) is asked for."""
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        offset, (at, n) = _lists(batch.column(2), ("at", "n"))
        for i, j, data, off in blocks(column(batch, "text")):
            starts, _, words = segments(data, off)
            h = word_hashes(data, starts)
            one, two = window_hashes(h, size, 0), window_hashes(h, size, 1)
            row = np.repeat(np.arange(j - i), np.diff(offset[i : j + 1]))
            p, m = at[offset[i] : offset[j]].astype(np.int64), n[offset[i] : offset[j]].astype(np.int64)
            run, place = spans(m - size + 1)
            place = p[run] + place
            w, d = place + words[row[run]], pa.array(i + row[run])
            yield pa.record_batch([pa.array(one[w].view(np.int64)), pa.array(two[w].view(np.int64)), ids.take(d), keys.take(d), pa.array(place.astype(np.int32))], names=["w1", "w2", "doc_id", "key", "at"])


def _kept(data: np.ndarray, off: np.ndarray, first: np.ndarray, n: np.ndarray, row: np.ndarray, texts_too: bool) -> list[pa.Array]:
    """The columns of KEPT but doc_id of a block, without the stretches of ``n`` words from ``first`` of the documents ``row``."""
    starts, ends, words = segments(data, off)
    a = first + words[row]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, a, 1)
    np.add.at(cover, a + n, -1)
    kept = np.cumsum(cover)[:-1] == 0
    s, length = starts[kept], (ends - starts)[kept]
    begin = np.cumsum(length + 1) - length - 1
    joined = np.full(int(length.sum()) + len(s), 32, np.uint8)
    shift = np.repeat(s - begin, length)
    to = np.arange(len(shift)) + np.repeat(np.arange(len(s)), length)
    joined[to] = data[to + shift]
    buffer = joined.tobytes()
    upto = np.concatenate([[0], np.cumsum(kept)])[words]
    edge = np.append(begin, len(buffer))
    parts = [buffer[edge[x] : max(edge[x], edge[y] - 1)] for x, y in zip(upto[:-1], upto[1:], strict=True)]
    total = np.diff(words)
    return [pa.array(total), pa.array(total - np.diff(upto)), pa.array([hashlib.sha256(x).hexdigest() for x in parts]), pa.array([x.decode() if texts_too else None for x in parts], pa.string())]


_NAMES = ["n_words", "n_removed", "kept_sha256", "kept"]
_NONE = np.zeros(0, np.int64)


def _whole(batches: Iterator[pa.RecordBatch], held, texts_too: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, k1, k2, text): what stays where nothing is removed, and whether something may be."""
    for batch in batches:
        hit = pa.array(held.value.has(batch.column(1).to_numpy()))
        for i, j, data, off in blocks(column(batch, "text")):
            own = [batch.column(k).slice(i, j - i) for k in range(3)]
            yield pa.record_batch([*own, hit.slice(i, j - i), *_kept(data, off, _NONE, _NONE, _NONE, texts_too)], names=["doc_id", "k1", "k2", "hit", *_NAMES])


def _less(batches: Iterator[pa.RecordBatch], texts_too: bool) -> Iterator[pa.RecordBatch]:
    """Of documents (k1, k2, gone, text): what stays without the stretches ``gone``."""
    for batch in batches:
        offset, (at, n) = _lists(batch.column(2), ("at", "n"))
        for i, j, data, off in blocks(column(batch, "text")):
            row = np.repeat(np.arange(j - i), np.diff(offset[i : j + 1]))
            some = slice(offset[i], offset[j])
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *_kept(data, off, at[some].astype(np.int64), n[some].astype(np.int64), row, texts_too)], names=["k1", "k2", *_NAMES])


def _order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")


def _later() -> F.Column:
    return ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("at") == F.col("first.at")))


def _keys(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """A hash of id and text, and the id itself (0 for null, which the hash tells apart)."""
    return row_keys(docs)[0], F.coalesce(docs["doc_id"].cast("long"), F.lit(0))


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, at, n): stretches of words to remove."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _keys(docs)[0].alias("key"))
    every = written(rows.mapInArrow(functools.partial(_stretches, size=size), STRETCHES), "stretches")
    total = every.count()
    twice = written(every.groupBy("anchor").agg(F.count("*").alias("uses")).where("uses > 1"), "anchors")
    some = written(look_up(every, twice, ["anchor"], "uses", total, "inner").drop("uses"), "shared")
    release(every, twice)
    groups = written(some.groupBy("anchor", "print", "n").agg(F.count("*").alias("uses"), F.min(_order()).alias("first")), "groups")
    copies = look_up(some, groups.where("uses > 1"), ["anchor", "print", "n"], "uses", total, "inner").where(_later()).select("doc_id", "key", "at", "n")
    mixed = written(groups.groupBy("anchor").agg(F.count("*").alias("prints")).where("prints > 1"), "mixed")
    asked = look_up(groups, mixed, ["anchor"], "prints", total, "inner").select("first.doc_id", "first.key", "first.at", "n")
    id_of = F.coalesce("doc_id", F.lit(0)).alias("k2")
    asked = written(asked.groupBy(F.col("key").alias("k1"), id_of).agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "n")).alias("asked")), "asked")
    texts = texts_of(docs, asked, _keys(docs)).select("doc_id", F.col("k1").alias("key"), "asked", "text")
    single = written(texts.mapInArrow(functools.partial(_windows, size=size), WINDOWS), "windows")
    known = single.groupBy("w1", "w2").agg(F.count("*").alias("uses"), F.min(_order()).alias("first")).where("uses > 1")
    windows = look_up(single, written(known, "known"), ["w1", "w2"], "uses", total, "inner").where(_later()).select("doc_id", "key", "at", F.lit(size).alias("n"))
    return copies.unionByName(windows)


def remove_repeats(docs: DataFrame, size: int = WINDOW, texts_too: bool = True) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): KEPT, where ``kept`` is the text that is left (null unless ``texts_too``)."""
    gone = repeats(docs, size).groupBy(F.col("key").alias("k1"), F.coalesce("doc_id", F.lit(0)).alias("k2")).agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    gone = written(gone, "gone")
    held = docs.sparkSession.sparkContext.broadcast(bloom(gone, "k1"))
    k1, k2 = _keys(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), docs["text"].cast("string").alias("text"))
    names = "n_words long, n_removed long, kept_sha256 string, kept string"
    whole = written(rows.mapInArrow(functools.partial(_whole, held=held, texts_too=texts_too), f"doc_id long, k1 long, k2 long, hit boolean, {names}"), "whole")
    less = texts_of(docs, gone, (k1, k2)).select("k1", "k2", "gone", "text").mapInArrow(functools.partial(_less, texts_too=texts_too), f"k1 long, k2 long, {names}")
    uses = whole.where("hit").groupBy("k1", "k2").agg(F.count("*").alias("uses"))
    less = less.select("k1", "k2", F.struct(*_NAMES).alias("less")).join(uses.hint("merge"), ["k1", "k2"])
    hit = look_up(whole.where("hit"), written(less, "less"), ["k1", "k2"], "uses", whole.count())
    hit = hit.select("doc_id", *[F.coalesce(f"less.{c}", c).alias(c) for c in _NAMES])
    return whole.where("NOT hit").select("doc_id", *_NAMES).unionByName(hit)
