"""Jaccard join of documents on word shingles, with Bayesian pruning of candidates.

Words are [^\\x20\\x09-\\x0D]+, unchanged; a document's set has the hashes of its shingles of five words (of all its words, if fewer).
Documents with the same set are one class from the start. Candidates are pairs of classes that share a band of MinHash values
(BANDS bands of ROWS values: a pair at 0.8 shares none with probability 3e-6); a pair is taken at the first band that it shares, so once. MinHash values of candidates are compared
a few at a time; with a uniform prior, the posterior probability that the similarity reaches the
threshold after m matches of n is P(Binomial(n + 1, threshold) <= m), and pairs below TOLERANCE are dropped. The rest are verified exactly
on the sets.

No pairs are emitted: a task takes the members of its buckets and returns a count of links for
each class and a spanning forest. Chains of buckets (families) of up to FAMILY_BYTES are dealt as a whole, for all bands at once. Members of larger ones are
dealt bucket by bucket, so a family that chance bands hold together costs no more than its buckets; of buckets with the same members just the
first counts. A family or bucket of over BLOCK_BYTES is dealt by pairs of blocks of members, so a task holds at most two
blocks. The number of comparisons is quadratic in the number of *different* sets of one bucket, as
every link counts; copies are one class, whatever their number.

Result: one row for each document: doc_id, class_id (the smallest doc_id of all documents that chains of links connect), n_links (documents with a
similarity of at least the threshold, itself not counted), copy_id (smallest doc_id with the same set).

Defined cases: a null, empty or blank text has no set and no links and is a class by itself; null doc_ids come last as class_id; rows are told apart by id and text, so
rows of one id with different texts are judged each; repeated rows link to each other; an
empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrays import blocks, column, mix, segments, spans, window_hashes, word_hashes
from quarry.llm._shared import drop_rows, look_up, release, row_keys, texts_of, written
from quarry.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
#: MinHash values compared before each pruning.
STEPS = (16, 32, 64, VALUES)
TOLERANCE = 1e-6
#: Bytes of signatures and sets: of a task of small families or buckets on average, of the largest family whose members aren't dealt bucket by bucket, and of a block of a family or bucket.
TASK_BYTES, FAMILY_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20, 2 << 20
#: Pairs compared at once.
PAIRS = 1 << 16

_rng = np.random.default_rng(1_234_577)
#: Fixed random parameters of the MinHash functions.
MULT = _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)

SETS = "row long, doc_id long, k1 long, k2 long, f1 long, f2 long, size int, bands array<long>"
DEALS = "array<struct<job:long,band:int,side:int>>"
MEMBERS = f"cid long, weight long, deals {DEALS}, sig binary, items binary"
FOUND = "cid long, root long, links long"


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of blocks of rows."""
    for i, j, data, off in blocks(texts):
        starts, _, words = segments(data, off)
        h = word_hashes(data, starts)
        s = window_hashes(h, SHINGLE)
        out = []
        for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            out.append(np.unique(s[a : b - SHINGLE + 1] if b - a >= SHINGLE else window_hashes(h[a:b], b - a) if b > a else s[:0]))
        yield i, out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets, VALUES) of sets, none of them empty."""
    n = np.array([len(s) for s in sets])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum(n) - n
    out = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(x * MULT[k] + ADD[k], begin)
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two longs."""
    return np.array([[np.sum(mix(s), dtype=np.uint64), np.sum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(s))] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of ``n`` values with which the posterior probability is at least ``tolerance``."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 36
    for batch in batches:
        ids = batch.column(0)
        for i, sets in shingle_sets(column(batch, "text")):
            n = len(sets)
            full = [k for k, s in enumerate(sets) if len(s)]
            f = np.zeros((n, 2), np.int64)
            bands: list = [None] * n
            if full:
                some = [sets[k] for k in full]
                f[full] = fingerprints(some)
                for k, b in zip(full, band_keys(signatures(some)), strict=True):
                    bands[k] = b
            keys = (batch.column(k).slice(i, n) for k in (2, 3))
            yield pa.record_batch(
                [pa.array(np.arange(row, row + n)), ids.slice(i, n), *keys, pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([len(x) for x in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=["row", "doc_id", "k1", "k2", "f1", "f2", "size", "bands"],
            )
            row += n


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and set of the texts that classes stand for."""
    for batch in batches:
        for i, sets in shingle_sets(column(batch, "text")):
            n = len(sets)
            yield pa.record_batch([*(batch.column(k).slice(i, n) for k in range(3)), pa.array([x.tobytes() for x in signatures(sets)], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cid", "weight", "deals", "sig", "items"])


def linked(i: np.ndarray, j: np.ndarray, keys: np.ndarray, sig: np.ndarray, items: list[np.ndarray], band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs ``i``, ``j`` that share ``band``: those that share none before it and have at least ``threshold``."""
    n = np.array([len(x) for x in items], np.int64)
    keep = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
    i, j = i[keep], j[keep]
    new = ~(keys[i, :band] == keys[j, :band]).any(1)
    i, j = i[new], j[new]
    m, done = np.zeros(len(i), np.int32), 0
    for step in STEPS:
        m += np.count_nonzero(sig[i, done:step] == sig[j, done:step], axis=1).astype(np.int32)
        keep = m >= least_matches(step, threshold)
        i, j, m, done = i[keep], j[keep], m[keep], step
    ok = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else ():
        a = items[i[rows[0]]]
        for part in np.array_split(rows, max(1, int(n[j[rows]].sum()) >> 20)):
            if not len(part):
                continue
            other = np.concatenate([items[k] for k in j[part]])
            place = np.minimum(np.searchsorted(a, other), len(a) - 1)
            begin = np.cumsum(n[j[part]]) - n[j[part]]
            common = np.add.reduceat((a[place] == other).astype(np.int64), begin)
            ok[part] = common >= threshold * (len(a) + n[j[part]] - common) - 1e-9
    return i[ok], j[ok]


def _chunks(left: np.ndarray, first: np.ndarray, last: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of ``left`` with ``right[first:last]``, about PAIRS at a time."""
    count = np.maximum(last - first, 0)
    upto = np.cumsum(count)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        run, place = spans(count[a:b])
        if len(run):
            yield left[a + run], right[first[a + run] + place]
        a = b


def candidates(keys: np.ndarray, band: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, i, j) of all pairs of members that share a band: ``band`` is -1 for members of whole families, else the one band that they are here for.
    Members of one block pair each other; of two blocks, those of side 0 pair those of side 1."""
    two = bool((side == 1).any())
    for b in range(keys.shape[1]):
        rows = np.flatnonzero((band == b) | (band == -1))
        if len(rows) < 2:
            continue
        order = rows[np.argsort(keys[rows, b], kind="stable")]
        k = keys[order, b]
        if two:
            left, right = order[side[order] == 0], order[side[order] == 1]
            other = keys[right, b]
            pairs = _chunks(left, np.searchsorted(other, keys[left, b], "left"), np.searchsorted(other, keys[left, b], "right"), right)
        else:
            pairs = _chunks(order, np.arange(1, len(order) + 1), np.searchsorted(k, k, "right"), order)
        for i, j in pairs:
            yield b, i, j


def _compare(t: pa.Table, threshold: float) -> pa.Table:
    band, side = t["band"].to_numpy(), t["side"].to_numpy()
    cid, row = np.unique(t["cid"].to_numpy(), return_inverse=True)
    weight = t["weight"].to_numpy()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
    items = [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]
    keys = band_keys(sig)
    links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b, i, j in candidates(keys, band, side):
        i, j = linked(i, j, keys, sig, items, b, threshold)
        np.add.at(links, row[i], weight[j])
        np.add.at(links, row[j], weight[i])
        for u, v in zip(row[i].tolist(), row[j].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    top = np.array([find(k) for k in range(len(cid))], np.int64)
    keep = (links > 0) | (top != np.arange(len(cid)))
    return pa.table({"cid": pa.array(cid[keep], pa.int64()), "root": pa.array(cid[top][keep], pa.int64()), "links": pa.array(links[keep], pa.int64())})


def near_join(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, class_id, n_links, copy_id."""
    return _numbered(docs, threshold).select("doc_id", "class_id", "n_links", "copy_id")


def _blocks(members: DataFrame, group: str, total: int, base: int) -> DataFrame:
    """(cid, job, band, side) of ``members`` (cid, ``group``, held: the group's bytes, band): groups of one block share jobs, others have one for each pair of blocks."""
    members = members.withColumn("blocks", F.ceil(F.col("held") / BLOCK_BYTES).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid", group), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    job = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(total // TASK_BYTES + 1)) + base).otherwise(F.xxhash64(group, low, high))
    return members.select("cid", job.alias("job"), "band", F.when(F.col("block") == low, 0).otherwise(1).alias("side"))


def _dealt(classes: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, cid, weight, deals) of all classes that share a band with another, and the tables to release later. A deal is a job, a band (-1: all) and a side."""
    keys = classes.select("cid", F.posexplode("bands").alias("band", "key"), "bytes")
    grouped = keys.groupBy("key").agg(F.first("band").alias("band"), F.count("*").alias("n"), F.min("cid").alias("least"), F.sum("bytes").alias("held"), F.sum(F.shiftright(F.xxhash64("cid"), 20)).alias("members"))
    shared = written(grouped.where("n > 1"), "shared")
    stars = look_up(keys.drop("bytes", "band"), shared.select("key", "n", "least"), ["key"], "n", total, "inner").where("least < cid").select(F.col("cid").alias("u"), F.col("least").alias("v"))
    family = written(components(stars).withColumnRenamed("node", "cid"), "families")
    sized = family.join(classes.select("cid", "bytes"), "cid")
    sizes = written(sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("held")), "sizes")
    family = look_up(family, sizes, ["root"], "size", total)
    small = sizes.where(F.col("held") <= FAMILY_BYTES).agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    whole = _blocks(family.where(F.col("held") <= FAMILY_BYTES).withColumn("band", F.lit(-1)), "root", small, 0)
    # buckets of large families; of those with the same members the one of the first band
    large = classes.select("cid", "bytes", "bands").join(family.where(F.col("held") > FAMILY_BYTES).select("cid"), "cid")
    large = written(large.select("cid", F.explode("bands").alias("key")), "large")
    distinct = shared.groupBy("n", "members").agg(F.min_by(F.struct("key", "held"), F.struct("band", "key")).alias("one"), F.min("band").alias("band")).select("one.*", "band", "n")
    distinct = written(distinct, "buckets")
    single = distinct.where(F.col("held") <= BLOCK_BYTES).agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    parts = _blocks(look_up(large, distinct, ["key"], "n", total, "inner"), "key", single, 1 << 40)
    deals = whole.unionByName(parts).groupBy("cid").agg(F.collect_list(F.struct("job", "band", "side")).alias("deals"))
    return written(deals.join(classes.select("cid", "k1", "k2", "weight"), "cid"), "dealt"), [shared, sizes, large, distinct]


def _numbered(docs: DataFrame, threshold: float) -> DataFrame:
    k1, k2 = row_keys(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    sets = written(rows.mapInArrow(_sketch, SETS), "sets")
    total = sets.count()
    full = sets.where("bands IS NOT NULL")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "row"))
    classes = full.groupBy("f1", "f2").agg(F.count("*").alias("weight"), best.alias("best"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # what a member takes in a task: its set, its signature and what Python adds
    held = (F.col("size").cast("long") * 8 + 4 * VALUES + 256).alias("bytes")
    classes = written(classes.select("f1", "f2", "weight", F.col("best.doc_id").alias("copy_id"), F.col("best.row").alias("cid"), F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"), held, "bands"), "classes")
    dealt, used = _dealt(classes, total)
    members = texts_of(docs, dealt).select("cid", "weight", "deals", "text").mapInArrow(_members, MEMBERS)
    members = members.select("cid", "weight", F.explode("deals").alias("d"), "sig", "items").select("d.job", "d.band", "d.side", "cid", "weight", "sig", "items")
    found = written(members.groupBy("job").applyInArrow(lambda t: _compare(t, threshold), FOUND), "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    # the forests of several tasks meet
    groups = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    labelled = written(classes.drop("bands", "bytes", "k1", "k2").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "labelled")
    release(*used, classes, dealt, found)
    tops = labelled.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull(), "copy_id")).alias("top"), F.count("*").alias("n"))
    named = look_up(labelled, tops, ["root"], "n", total).select("f1", "f2", "weight", "copy_id", F.col("top.copy_id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root")
    own = ["doc_id", "k1", "k2"]
    known = look_up(full.select(*own, "f1", "f2"), written(named, "named"), ["f1", "f2"], "weight", total).select(*own, "class_id", "n_links", "copy_id", "root")
    blank = sets.where("bands IS NULL").select(*own, F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.lit(None).cast("long").alias("root"))
    return known.unionByName(blank)


def drop_near(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: of the smallest doc_id (nulls last), then of the smallest row key; all columns, texts unchanged. Blank texts all stay."""
    keys = written(_numbered(docs, threshold).where("root IS NOT NULL").groupBy("root", "k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")), "keys")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    tops = keys.groupBy("root").agg(best.alias("best"), F.count("*").alias("uses"))
    kept = (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    gone = look_up(keys, written(tops, "tops"), ["root"], "uses", keys.count()).withColumn("keep", kept).where("NOT keep OR n > 1")
    blank = ~F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return drop_rows(docs, written(gone.select("k1", "k2", "keep"), "gone"), blank)
