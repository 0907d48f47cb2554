import hashlib
import random
import re

import numpy as np
import pytest
from conftest_rows import texts_of

from quarry.llm import substring_dedup as S

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first, docs = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        docs.append((i, W.findall(t or "")))
    for i, w in docs:
        for a in range(len(w) - size + 1):
            first.setdefault(tuple(w[a : a + size]), (i, a))
    out = []
    for i, w in docs:
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] != (i, a):
                gone |= set(range(a, a + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs, size=20):
    rows = S.remove_repeats(docs, size).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr)


def planted(seed, n, vocabulary, most):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [say(rng.choice([10, 19, 20, 21, 35, 80])) for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else say(rng.randint(1, most))
            if rng.random() < 0.1:
                w += [rng.choice(words)] * rng.randint(15, 50)
            if rng.random() < 0.1:
                w += say(2) * rng.randint(8, 30)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "vocabulary", "most", "size"), [(1, 400, 120, 20), (2, 3, 60, 20), (3, 40, 90, 6)])
def test_against_brute_force(make, seed, vocabulary, most, size):
    rows = planted(seed, 90, vocabulary, most)
    want = brute(rows, size)
    assert sum(n for _, _, n, _ in want) > 500
    assert got(make(rows), size) == want


def test_odd_rows(odd, nothing, make):
    assert got(odd.where("doc_id is not null")) == brute([r for r in texts_of(odd) if r[0] is not None], 20)
    assert got(nothing) == []
    # repeated rows are one document; rows with null ids come last
    t = " ".join(map(str, range(30)))
    rows = S.remove_repeats(make([(4, t), (4, t), (None, t), (4, t + " x")])).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in rows if r.doc_id is None) == [(99, 30, 30)]
    assert sorted(r.n_removed for r in rows if r.doc_id == 4) in ([0, 0, 30], [0, 30, 30])


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(docs) == brute(texts_of(docs), 20)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    for alphabet in (2, 5, 1000):
        h = S.mix(rng.integers(0, alphabet, 4000).astype(np.uint64))
        h[3000:3100] = h[100:200]
        h[3500:3520] = h[50:70]
        off = np.array([0, 1000, 1000, 1019, 2500, 4000])
        at, name, spot, own = S.anchors(h, off, 20)
        seen = {}
        for a, x, s in zip(at.tolist(), name.tolist(), spot.tolist(), strict=True):
            assert seen.setdefault(h[a : a + 20].tobytes(), (x, s - a)) == (x, s - a)
        assert (own < 0).mean() < 0.05


def test_rows_of_one_id_are_told_apart(make):
    """Texts of null and of repeated ids: each passage stays once."""
    say = lambda k: [f"w{k}x{m}" for m in range(25)]
    rows = [(None, " ".join(say(k) + say(k % 5 + 100))) for k in range(40)] + [(7, " ".join(say(k))) for k in range(200, 230)] + [(8, " ".join(say(203)))]
    got = S.remove_repeats(make(rows)).collect()
    assert sum(r.n_removed for r in got if r.doc_id is None) == 35 * 25
    assert [r.n_removed for r in got if r.doc_id == 7] == [0] * 30 and [r.n_removed for r in got if r.doc_id == 8] == [25]
    kept = " ".join(r.kept for r in got).split()
    assert len(kept) == len(set(kept))
