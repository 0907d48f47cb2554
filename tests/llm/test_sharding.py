import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import sharding


def brute(shards, slots):
    """Each shard's whole permutation, then turns."""
    perm = []
    for s in shards:
        o, k = xxhash.xxh3_64_intdigest(s.encode(), seed=1) % slots, xxhash.xxh3_64_intdigest(s.encode(), seed=2) % (slots - 1) + 1
        perm.append([(o + j * k) % slots for j in range(slots)])
        assert sorted(perm[-1]) == list(range(slots))
    table = [None] * slots
    while None in table:
        for k, p in enumerate(perm):
            if None in table:
                table[next(x for x in p if table[x] is None)] = k
    return table


def test_table_is_the_brute_force_one():
    shards = [f"s{k}" for k in range(7)]
    assert sharding.fill(shards, 211).tolist() == brute(shards, 211)


def test_shares_and_moves():
    shards = [f"s{k}" for k in range(20)]
    table = sharding.fill(shards, 4099)
    n = np.bincount(table)
    assert n.max() - n.min() <= 1
    fewer = sharding.fill(shards[:-1], 4099)
    stay = table < 19
    assert (table[stay] != fewer[stay]).mean() < 0.05
    w = np.bincount(sharding.fill(shards[:2], 4099, [1, 3]))
    assert abs(w[1] / w[0] - 3) < 0.01


def test_bad_parameters():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(shards, slots)


def test_place(odd, nothing, spark, tmp_path):
    shards = ["a", "b", "c"]
    placed = sharding.place(odd, shards, F.xxhash64("doc_id", "text"), 211)
    table = sharding.fill(shards, 211)
    rows = placed.withColumn("h", F.xxhash64("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.slot == r.h % 211 and r.shard == shards[table[r.slot]]
    assert placed.columns == [*odd.columns, "slot", "shard"]
    assert sharding.place(nothing, shards, F.xxhash64("doc_id"), 211).count() == 0
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, 2, 3, 4, "x")], "q0 int, _at int, _slot int, Slot int, `a.b` string")
    out = sharding.place(docs, ["a", "b"], F.xxhash64("q0"), 11)
    assert out.columns == ["q0", "_at", "_slot", "a.b", "slot", "shard"] and out.first()[:4] == (1, 2, 3, "x")
