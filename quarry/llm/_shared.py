"""Shared folders, materialised tables, skew-safe look-ups, and rows found again or dropped without moving the texts of all others."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one is set in local mode (tests), and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later action reads."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key counts as hot when it holds over one row in HOT_SHARE, so there are fewer hot keys than that.
HOT_SHARE = 8192
#: No key with fewer rows than this is hot.
HOT_LEAST = 200


def look_up(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """Join (``left`` or ``inner``) of ``left`` to ``right``, which has one row for each key with ``count`` rows of ``left``.

    Keys with over 1/HOT_SHARE of the ``total`` rows are joined by broadcast: there can be
    HOT_SHARE of them at most, whatever the size of the tables. All other keys
    are shuffled; partitions that are large for one of them are split by the adaptive skew join. ``left`` should be a written table, as it is read twice.
    """
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(count) > limit))
    rest = right.where(F.col(count) <= limit)
    first = left.join(hot, keys, "inner")
    second = left.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how)
    return first.unionByName(second)


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of each row's doc_id and text, as two longs: what tells rows apart whatever their ids; rows of one id and text are the same."""
    i, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return F.xxhash64(i, text), F.xxhash64(F.lit(1), i, text)


def fresh(docs: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``docs`` has."""
    taken, out, k = {c.lower() for c in docs.columns}, [], 0
    while len(out) < n:
        if f"q{k}" not in taken:
            out.append(f"q{k}")
        k += 1
    return out


def columns_of(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


#: Bits of a Bloom filter: ten for each key between these bounds, so a broadcast has 4 MB at most; a fuller filter lets more rows through, and loses none.
LEAST_BITS, MOST_BITS = 16, 25


class Bloom:
    """A set of 64-bit hashes, without false negatives."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, (len(words) * 64).bit_length() - 1

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        k, out = keys.view(np.uint64), np.ones(len(keys), bool)
        for shift in (0, 19, 39):
            at = (k >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(keys: DataFrame, key: str) -> Bloom:
    """The filter of a column of hashes; the driver gets its words, 8 MB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (10 * keys.count()).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (0, 19, 39)]))
    spots = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = spots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bloom(words)


def _fetch(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text) that may be asked for, each key once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        batch = batch.filter(pa.array(held.value.has(batch.column(0).to_numpy())))
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        if any(keep):
            yield batch.filter(pa.array(keep))


def texts_of(docs: DataFrame, asked: DataFrame, keys: tuple[Column, Column] | None = None) -> DataFrame:
    """``asked`` (k1, k2, ...; one row for each key, a written table) with the ``text`` of its rows of ``docs``, whose keys are ``row_keys`` or ``keys``.
    Only rows that a Bloom filter lets through are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(asked, "k1"))
    k1, k2 = keys or row_keys(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), docs["text"].cast("string").alias("text"))
    hits = rows.mapInArrow(functools.partial(_fetch, held=held), "k1 long, k2 long, text string")
    once = hits.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    # always a merge join: a broadcast would hold for small inputs only
    return asked.hint("merge").join(once, ["k1", "k2"])


def _sift(batches: Iterator[pa.RecordBatch], held, doubtful: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose key (next to last column) the filter may hold and which aren't exempt (last column), or all others."""
    for batch in batches:
        n = batch.num_columns
        hit = held.value.has(batch.column(n - 2).to_numpy()) & ~batch.column(n - 1).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(hit if doubtful else ~hit))


def drop_rows(docs: DataFrame, gone: DataFrame, exempt: Column | None = None) -> DataFrame:
    """``docs`` without rows to be dropped; all columns, texts unchanged.

    ``gone`` (k1, k2, keep; a written table) has the keys of all rows of which any goes, and whether one row of the key stays: of rows of one key the one whose columns
    have the smallest hash, so that a task that runs again keeps the same. ``exempt`` rows stay. Rows that a Bloom filter of ``gone`` clears stay where they are; only the others are shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(bloom(gone, "k1"))
    a, b, c, place, g1, g2, keep = fresh(docs, 7)
    k1, k2 = row_keys(docs)
    marked = docs.withColumns({b: k2, a: k1, c: F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))})
    marked = marked.select(*columns_of(docs, docs.columns), b, a, c)
    sure = marked.mapInArrow(functools.partial(_sift, held=held, doubtful=False), marked.schema)
    maybe = marked.mapInArrow(functools.partial(_sift, held=held, doubtful=True), marked.schema)
    plain = columns_of(docs, [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])
    first = F.row_number().over(Window.partitionBy(a, b).orderBy(F.xxhash64(*plain)))
    once = maybe.withColumn(place, first).where(F.col(place) == 1)
    known = gone.select(F.col("k1").alias(g1), F.col("k2").alias(g2), F.col("keep").alias(keep)).hint("merge")
    left = once.join(known, (F.col(a) == F.col(g1)) & (F.col(b) == F.col(g2)), "left").where(F.coalesce(keep, F.lit(True)))
    names = columns_of(docs, docs.columns)
    return sure.select(*names).unionByName(left.select(*names))
