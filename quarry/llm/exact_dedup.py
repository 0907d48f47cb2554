"""Exact deduplication by recipes of content-defined chunks.

Texts are equal when they are the same without the characters [\\x20\\x09-\\x0D]. A text never moves:
each task cuts its normalised texts where a rolling hash of the last 16 bytes says so, and sends names
of chunks only. Chunks of one name, length and SHA-256 digest get one identifier, so
an identifier is verified by three independent values; a document becomes the ordered list of its chunks'
identifiers, and documents are equal when these lists are.

Of equal texts the row with the most code points in the original text stays, then the smallest doc_id (null last),
then the first row.

Defined cases: null counts as the empty text, an empty text is a list of no chunks (all those are one group); repeated rows are
rows of one group, of which one stays; an empty table gives no rows; other columns are ignored; long texts are
cut every MOST_BYTES at the latest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrays import SPACE, blocks, column
from quarry.llm._shared import drop_rows, look_up, release, row_keys, written

#: A cut after every byte at which this many high bits of the rolling hash are zero: 2,048 bytes on average.
CUT_BITS = 11
#: No cut before so many bytes of a document, so that the hash never sees another document.
LEAST_BYTES = 64
#: A cut every so many bytes from a document's start, whatever the hash.
MOST_BYTES = 16_384

_GEAR = np.random.default_rng(7_919).integers(0, 1 << 32, 256, dtype=np.uint32)

DIGESTS = "row long, doc_id long, k1 long, k2 long, points long, text_sha256 string, chunks array<struct<name:long,length:int,sha:binary>>"


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of all chunks, of each document its own end among them."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    doc = np.searchsorted(off, at, side="right") - 1
    at = at[(doc < len(off) - 1) & (at - off[np.minimum(doc, len(off) - 2)] >= LEAST_BYTES)]
    regular = [np.arange(a + MOST_BYTES, b, MOST_BYTES) for a, b in zip(off[:-1], off[1:], strict=True) if b - a > MOST_BYTES]
    return np.unique(np.concatenate([at, off[1:], *regular]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 36
    kind = pa.list_(pa.struct([("name", pa.int64()), ("length", pa.int32()), ("sha", pa.binary())]))
    for batch in batches:
        texts, ids = column(batch, "text"), batch.column(0)
        for i, j, data, off in blocks(texts):
            keep = ~SPACE[data]
            points = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off])
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            data = data[keep]
            raw, ends = data.tobytes(), cuts(data, off)
            first = np.searchsorted(ends, off[:-1], side="right")
            last = np.searchsorted(ends, off[1:], side="right")
            sha, lists = [], []
            for d in range(j - i):
                a, b = int(off[d]), int(off[d + 1])
                sha.append(hashlib.sha256(raw[a:b]).hexdigest())
                chunks = []
                for e in ends[first[d] : last[d]].tolist() if b > a else ():
                    c = raw[a:e]
                    chunks.append({"name": xxhash.xxh3_64_intdigest(c) - (1 << 63), "length": e - a, "sha": hashlib.sha256(c).digest()})
                    a = e
                lists.append(chunks)
            keys = (batch.column(k).slice(i, j - i) for k in (2, 3))
            yield pa.record_batch([pa.array(np.arange(row, row + j - i)), ids.slice(i, j - i), *keys, pa.array(points), pa.array(sha), pa.array(lists, kind)], names=["row", "doc_id", "k1", "k2", "points", "text_sha256", "chunks"])
            row += j - i


def _groups(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (doc_id, text), one row each: row keys, and the columns of ``exact_groups``."""
    k1, k2 = row_keys(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    digests = written(rows.mapInArrow(_digests, DIGESTS), "digests")
    total = digests.count()
    chunks = digests.select("row", F.posexplode("chunks").alias("place", "chunk")).select("row", "place", "chunk.name", "chunk.length", "chunk.sha")
    store = written(chunks.groupBy("name", "length", "sha").agg(F.count("*").alias("uses")).withColumn("chunk_id", F.monotonically_increasing_id()), "chunks")
    named = look_up(chunks, store, ["name", "length", "sha"], "uses", total)
    lists = named.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("recipe"))
    recipes = written(digests.drop("chunks").join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<long>"))), "recipes")
    release(digests, store)
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best"))
    found = look_up(recipes, groups, ["recipe"], "group_size", total)
    return found.select("k1", "k2", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (doc_id, text), one row each: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    return _groups(docs).drop("k1", "k2")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of each group that don't stay; all columns, texts unchanged. Of rows of one doc_id and text the one stays that ``drop_rows`` keeps."""
    copies = _groups(docs).where("group_size > 1")
    gone = copies.groupBy("k1", "k2").agg(F.bool_or("kept").alias("keep"), F.bool_and("kept").alias("all")).where("NOT all")
    return drop_rows(docs, written(gone.select("k1", "k2", "keep"), "gone"))
