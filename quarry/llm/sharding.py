"""Sharding by a permutation-filled look-up table.

Each shard has its own order of preference over the slots of a table of prime size (an offset and a step, both from hashes of its
name, give a permutation). Shards take turns claiming their next free slot until the table is full, so that shards hold
equal numbers of slots to within one (or in proportion to their weights) and few slots change hands when a shard comes or goes. The table has
a fixed size (a parameter), is broadcast, and places a document by one hash and one look-up.

The key is the document's id and text together, so that a hot id doesn't fill one shard; a hot source doesn't matter at all.

Defined cases: null id or text counts as a value of its own; empty and long texts hash like any others; repeated rows go to the same
shard; an empty table gives no rows; other columns are kept by ``place`` and may have any names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import columns_of, fresh

#: The default number of slots, a prime; over a hundred for each shard keeps the shares even.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The index of the shard of each slot. In each round a shard takes as many turns as its weight (1)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not below the number of shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    offset = [xxhash.xxh3_64_intdigest(s.encode(), seed=1) % slots for s in shards]
    step = [xxhash.xxh3_64_intdigest(s.encode(), seed=2) % (slots - 1) + 1 for s in shards]
    table, at, free = np.full(slots, -1, np.int32), list(offset), slots
    while True:
        for k, turns in enumerate(weights):
            for _ in range(turns):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                table[at[k]] = k
                free -= 1
                if not free:
                    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(key, F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], key: Column, slots: int = SLOTS, weights: list[int] | None = None, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """``docs`` with the slot of ``key`` (long) and its shard, under ``names`` (columns of these names are replaced). The broadcast table has ``slots`` rows."""
    spark = docs.sparkSession
    table = fill(shards, slots, weights)
    # one short string for the whole table: slots are its places, so the plan holds no list of rows
    at, place, k = fresh(docs, 3)
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table.tolist()))), ",")).alias(place, k))
    shard = F.element_at(F.array(*map(F.lit, shards)), F.col(k).cast("int") + 1)
    joined = docs.withColumn(at, slot(key, slots)).join(F.broadcast(rows), F.col(at) == F.col(place), "left")
    kept = columns_of(docs, [c for c in docs.columns if c.lower() not in {x.lower() for x in names}])
    return joined.select(*kept, F.col(at).alias(names[0]), shard.alias(names[1]))


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard; tasks write their own rows, so that no shard passes through one task."""
    placed.write.partitionBy(shard).parquet(path)
