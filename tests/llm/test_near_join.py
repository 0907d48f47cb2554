import random
import re

import numpy as np
from conftest_rows import texts_of

from quarry.llm import near_join as N
from quarry.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = W.findall(t or "")
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= t * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], min((rows[j][0] for j in seen), key=lambda x: (x is None, x or 0)), len(near[i])))
    return sorted(out, key=repr)


def got(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in N.near_join(docs).collect()), key=repr)


def near_copies(seed, n, families, length, edits):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base = [say(rng.randint(*length)) for _ in range(families)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.9 else say(rng.randint(1, 60))
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


def test_against_brute_force(make):
    rows = near_copies(1, 260, 12, (20, 300), [0, 0, 1, 2, 3, 5, 9])
    want = brute(rows)
    assert sum(n > 0 for _, _, n in want) > 60
    assert got(make(rows)) == want


def test_large_family_in_blocks(make, monkeypatch):
    rows = near_copies(2, 220, 2, (60, 90), [0, 1, 1, 2, 3, 4])
    want = brute(rows)
    for family, block in ((1, 1 << 20), (1, 20_000), (10_000_000, 50_000)):
        for k, v in (("TASK_BYTES", 10_000), ("FAMILY_BYTES", family), ("BLOCK_BYTES", block), ("PAIRS", 50)):
            monkeypatch.setattr(N, k, v)
        assert got(make(rows)) == want


def test_long_family(make, monkeypatch):
    """A chain in which each text is near the next only."""
    w = [f"w{k}" for k in range(1200)]
    rows = [(i if i % 7 else None, " ".join(w[10 * i : 10 * i + 150])) for i in range(100)]
    want = brute(rows)
    assert max(n for _, _, n in want) <= 4
    for family in (1, N.FAMILY_BYTES):
        monkeypatch.setattr(N, "FAMILY_BYTES", family)
        assert got(make(rows)) == want


def test_odd_rows(odd, nothing, make):
    assert got(odd) == brute(texts_of(odd))
    assert got(nothing) == []
    left = N.drop_near(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 6, 7, 8]
    assert N.drop_near(nothing).count() == 0
    twice = make([(5, "a b c"), (5, "a b c"), (6, "a b d"), (7, ""), (7, None)])
    assert sorted(r.doc_id for r in N.drop_near(twice).collect()) == [5, 6, 7, 7]


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute(texts_of(docs))
    assert got(docs) == want
    assert sorted(r.doc_id for r in N.drop_near(docs).collect()) == sorted({c for _, c, _ in want})


def test_posterior_prunes_few_true_pairs():
    rng = np.random.default_rng(0)
    for n in N.STEPS:
        least = N.least_matches(n, 0.8)
        assert 0 < least < 0.8 * n
        assert (rng.binomial(n, 0.8, 100_000) >= least).mean() > 0.9999


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    have = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.root for r in have} == want and len(have) == len(want)


def test_rows_of_null_and_repeated_ids_are_told_apart(make):
    say = lambda k: " ".join(f"w{k}x{m}" for m in range(60))
    rows = [(None, say(1)), (None, say(2)), (None, say(3)), (1, say(3) + " more"), (2, say(4)), (2, say(5)), (3, say(6)), (4, say(6) + " more"), (4, say(7)), (None, "")]
    got = sorted(r.text for r in N.drop_near(make(rows)).collect())
    assert got == sorted([say(1), say(2), say(3) + " more", say(4), say(5), say(6), say(7), ""])


def test_columns_of_any_name(spark):
    rows = [(k, "a b c d e f " + "g" * (k // 2), "x", k) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _place int")
    left = N.drop_near(docs)
    assert left.columns == docs.columns and sorted(r._place for r in left.collect()) == [0, 2]
