import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_only_training_text_and_lang_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    one = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    two = {r.doc_id: r.lang_pred for r in language.identify(docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.col("lang"))).collect()}
    assert one == two


def test_odd_rows(odd, nothing, make):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[7].lang_pred == "en" and not got[None].held_out
    assert language.identify(nothing).count() == 0
    none = language.identify(make([(1, "abc", None), (2, "12", None)])).collect()
    assert {r.lang_pred for r in none} == {"und"}


def brute(t):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
    b = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low) + b"   "
    return sorted(int.from_bytes(bytes([b[i], b[i + 1], b[i + 2], 0 if b[i + 2] == 32 else b[i + 3]]), "little") for i in range(len(b) - 3) if b[i + 1] != 32)


def test_grams_are_those_of_each_text():
    texts = ["", "a", "Ab c!", "", "éa", "x" * 5, "1 2"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    code, doc = language.grams(np.frombuffer(b"".join(raw), np.uint8), off)
    for d, t in enumerate(texts):
        assert sorted(code[doc == d].tolist()) == brute(t)


def test_many_languages_and_filters():
    rng = np.random.default_rng(0)
    for n in (3, 12, 40):
        names = [f"l{k:02d}" for k in range(n)]
        sets = [np.unique(rng.integers(97, 123, (60, 4)) @ np.array([1, 256, 65536, 1 << 24])) for _ in names]
        rows = [(k, int(g), 10) for k, s in enumerate(sets) for g in s]
        f = language.build(names, rows, {k: 10 * len(s) for k, s in enumerate(sets)})
        for k, s in enumerate(sets):
            m = np.bitwise_and.reduce([f.masks[0][x] for x in language.slots(s.astype(np.uint32))])
            keep = np.array([10 / (10 * len(s)) >= language.CONTRAST * max(1 / len(t) for t in sets if g in t) for g in s])
            assert ((m >> np.uint8(k)) & 1)[keep].all()


def test_more_than_64_languages(make):
    import random

    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(30)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 70:02d}"]) for _ in range(40)), f"l{i % 70:02d}") for i in range(1400)]
    got = language.identify(make(rows)).collect()
    held = [r for r in got if r.held_out]
    assert len({r.lang_pred for r in got}) == 70 and sum(r.lang_pred == f"l{r.doc_id % 70:02d}" for r in held) > 0.97 * len(held)


def test_predictions_against_plain_sums(spark):
    """Every prediction and score from the definition: counts of all training grams, exact sets with the filters' false positives taken from the filters themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    train = [(t, x) for i, t, x in rows if i is not None and zlib.crc32(str(i).encode()) % 5 and x is not None and t is not None]
    counts = {x: {} for x in sorted({x for _, x in train})}
    for t, x in train:
        for g in brute(t):
            counts[x][g] = counts[x].get(g, 0) + 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = {x: {g: n / total[x] for g, n in c.items() if n >= language.MIN_SHARE * total[x]} for x, c in counts.items()}
    top = {}
    for c in share.values():
        for g, v in c.items():
            top[g] = max(top.get(g, 0), v)
    kept = {x: {g for g, v in c.items() if v >= language.CONTRAST * top[g]} for x, c in share.items()}
    own = {x: sum(share[x][g] for g in kept[x]) for x in kept}
    slots = lambda g: [int(s[0]) for s in language.slots(np.array([g], np.uint32))]
    full = {x: {s for g in kept[x] for s in slots(g)} for x in kept}
    false = {x: (len(full[x]) / (1 << language.SLOT_BITS)) ** len(language.MULTIPLIERS) for x in kept}
    want = {}
    for i, t, _ in rows:
        g = brute(t or "")
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0)
            continue
        spots = [slots(v) for v in g]
        scaled = {x: max(0, sum(all(s in full[x] for s in v) for v in spots) / max(1, len(g)) - false[x]) / (1 - false[x]) / own[x] for x in kept}
        best = max(sorted(scaled), key=lambda x: scaled[x])
        want[i] = (best, min(1.0, scaled[best])) if scaled[best] > 0 else (max(sorted(total), key=lambda x: total[x]), 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == p and abs(got[i][1] - s) < 1e-9 for i, (p, s) in want.items())
