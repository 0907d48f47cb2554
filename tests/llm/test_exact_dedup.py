import hashlib
import re

from conftest_rows import texts_of

from quarry.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm, strict=True):
        group = [(j, u or "") for (j, u), m in zip(rows, norm, strict=True) if m == n]
        keep = min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0] or 0))[0]
        out.append((i, keep, len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    rows = texts_of(docs)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    # of each group just one row stays
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    return got


def test_odd_rows(odd):
    check(odd)


def test_random_copies(make):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6000))) for _ in range(25)]
    rows = []
    for i in range(80):
        t = rng.choice(base)
        rows.append((i, t if rng.random() < 0.5 else t.replace(" ", rng.choice(["  ", "\n", ""]), 3)))
    rows += [(100, base[0] + "x"), (101, "x" + base[0])]
    check(make(rows))


def test_drop_copies(odd, make):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None and r.doc_id < 7) == [(3, " \n\t"), (6, "x" * 70_000)]
    assert left.count() == 5


def test_empty(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_smallest_id_and_clashing_names(spark):
    rows = [(-(2**63), "a b", "x", {"k": 1}), (3, "ab", "y", None), (3, "ab", "z", None), (3, "ab", "y", None), (None, "c", "q", None), (None, "d", "r", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, `q0` map<string,int>")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()} == {(-(2**63), -(2**63), 4), (3, -(2**63), 4), (None, None, 1)}
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["a b", "c", "d"]
    first = [tuple(r) for r in exact_dedup.drop_copies(docs.where("doc_id = 3").repartition(3)).select("_id").collect()]
    assert len(first) == 1 and all([tuple(r) for r in exact_dedup.drop_copies(docs.where("doc_id = 3").repartition(k)).select("_id").collect()] == first for k in (1, 2))
