import random
import re

import numpy as np
from conftest_rows import texts_of

from quarry.llm import decontaminate as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else []


def brute(docs, items, threshold=0.8):
    """All windows of all documents against all items, by weighted Jaccard similarity of shingle sets."""
    sets = {i: set(shingles(words(t))) for i, t in items if words(t)}
    n = len(sets)
    weight = {x: np.log((1 + n) / sum(x in s for s in sets.values())) for s in sets.values() for x in s}
    out = []
    for d, t in docs:
        w = words(t)
        for i, text in items:
            L = len(words(text))
            if not L or not w or len(w) < min(5, L):
                continue
            best = 0.0
            k = min(5, L)
            m = min(L, len(w))
            for a in range(len(w) - m + 1):
                s = {tuple(w[b : b + k]) for b in range(a, a + m - k + 1)}
                if s & sets[i]:
                    f = lambda z: sum(weight.get(x, np.log(1 + n)) for x in z)
                    best = max(best, f(s & sets[i]) / f(s | sets[i]) if f(s | sets[i]) > 0 else 1.0 if s == sets[i] else 0.0)
            if best >= threshold:
                out.append((d, i, round(best, 9)))
    return sorted(out)


def got(spark, docs, items, **k):
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in D.contaminated(docs, b, **k).collect())


def test_planted(spark, make):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([2, 5, 15, 30, 45, 60])))) for i in range(25)] + [(90, ""), (91, None)]
    docs = []
    for i in range(70):
        w = say(rng.choice([3, 40, 200]))
        t = words(rng.choice(items)[1])
        if i % 2:
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if t:
                    p = rng.randrange(len(t))
                    t[p : p + 1] = rng.choice([[], ["zzz"], [t[p], "yy"]])
            p = rng.randint(0, len(w))
            w[p:p] = t
        docs.append((i, ", ".join(w).upper() if i % 3 else "\n".join(w)))
    want = brute(docs, items)
    assert len(want) > 12
    assert got(spark, make(docs), items) == want
    # the same in passes of a few items
    assert got(spark, make(docs), items, pass_items=4) == want


def test_odd_rows(spark, odd, nothing):
    items = [(1, "word word word word word word"), (2, "a b"), (3, ""), (4, None), (5, "NAÏVE")]
    want = brute([r for r in texts_of(odd) if r[0] is not None], items)
    assert [x for x in got(spark, odd.where("doc_id is not null"), items)] == want
    assert got(spark, nothing, items) == [] and got(spark, odd, []) == []
    left = D.drop_contaminated(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 6, 7}


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(4)
    items = D.prepare([(k, " ".join(map(str, rng.integers(0, 99, 20)))) for k in range(50)])
    (_, _, (group,)), = items.sizes.values()
    for k in range(50):
        for _ in range(20):
            bits = np.unpackbits(group.prints[k])
            bits[rng.choice(128, D.RADIUS, replace=False)] ^= 1
            p = np.packbits(bits)
            assert any(group.index[b, p[b], k // 8] & 128 >> k % 8 for b in range(D.BLOCKS))


def test_the_index_alone_proposes(spark, make):
    items = [(1, " ".join(f"w{k}" for k in range(30)))]
    text = "before " + items[0][1] + " after"
    held = D.prepare(items)
    (_, h, _), = D._words(D.pa.array([text], D.pa.large_string()))
    assert [x[:2] for x in D.matches(h, held, 0.8)] == [(0, 1)]
    held.sizes[5][2][0].index[:] = 0
    assert D.matches(h, held, 0.8) == []


def test_recall_near_the_threshold():
    """Items of all lengths with as many edits as 0.8 allows, against the exact similarity of all windows."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60)))) for k in range(300)]
    held, found, all_of_them = D.prepare(items), 0, 0
    for k, t in items:
        w = t.split()
        for _ in range(max(1, len(w) // 30)):
            w[rng.choice([0, 1, len(w) - 2, len(w) - 1])] = rng.choice(vocabulary)
        full = [rng.choice(vocabulary) for _ in range(40)] + w + [rng.choice(vocabulary) for _ in range(40)]
        (_, h, _), = D._words(D.pa.array([" ".join(full)], D.pa.large_string()))
        s = D.window_hashes(h, 5)
        n = held.lengths[k] - 4
        best = max(D.similarity(held.sets[k], set(s[a : a + n].tolist()), held) for a in range(len(s) - n + 1))
        if best >= 0.8:
            all_of_them += 1
            found += any(x[0] == k for x in D.matches(h, held, 0.8))
    assert all_of_them > 100 and found >= 0.99 * all_of_them


def test_long_text_of_one_shingle(spark, make):
    items = [(1, "go " * 40), (2, "a b c d e f g h i j k l m n")]
    docs = [(1, "go " * 30_000), (2, "x " * 9_000 + items[1][1] + " x" * 9_000 + " go" * 50)]
    assert got(spark, make(docs), items) == [(1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0)]


def test_weights_do_not_depend_on_passes(spark, make):
    phrase = "choose the best answer to the following question about the text"
    items = [(k, f"{phrase} " + " ".join(f"w{k}x{m}" for m in range(12))) for k in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(k, f"{phrase} " + " ".join(f"w{k}x{m}" for m in range(12 - k % 3)) + f" tail{k} end{k}") for k in range(6)] + [(9, f"{phrase} nothing else of it")])
    def rows(most):
        return sorted((r.doc_id, r.item_id, r.first_word, r.hamming, round(r.similarity, 9)) for r in D.contaminated(docs, benchmark, 0.3, 60, most).collect())
    assert rows(1) == rows(2) == rows(2048) != []
