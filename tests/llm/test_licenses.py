import re

from conftest_rows import texts_of

from quarry.llm import licenses

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = W.findall(low)
    spots, labels = [], set()
    for p, label in licenses.PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        spots += at
        if at:
            labels.add(label)
    return len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels))


def check(docs):
    want = sorted(((i, *brute(t)) for i, t in texts_of(docs)), key=repr)
    got = licenses.scan(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    return {r.doc_id: r for r in got}


def test_documents(spark, data):
    got = check(spark.read.parquet(f"{data}/documents.parquet"))
    assert any(r.n_base for r in got.values())


def test_odd_rows(odd, nothing):
    check(odd)
    assert licenses.scan(nothing).count() == 0


def test_phrases_and_edits(make):
    rows = [
        (1, "MIT License. mit-LICENSE mit\nlicense"),
        (2, "gnu general public license, GNU GENERAL PUBLIC LICENSES"),
        (3, "cc by cc by cc"),
        (4, "xmit license mit licensee"),
        (5, "Relased under the MIT Lcense."),
        (6, "some words  Licensed   under the\nApache Licence, Version 2.0! more"),
        (7, "commit licensed apacheé license"),
        (8, "Mozila Public License"),
        (9, "the quick brown fox"),
        (10, "mit"),
        (11, "license"),
    ]
    got = check(make(rows))
    assert got[5].labels == "mit" and got[5].n_base == 0 and 0 < got[5].score < 1
    assert "apache" in got[6].labels and [(s.first, s.last) for s in got[6].spans if s.label == "apache"] == [(2, 9)]
    assert got[8].labels == "mpl"
    assert got[9].labels == "" and got[9].score == 0
    assert got[10].labels == got[11].labels == ""


def test_every_text_within_the_edits_is_found(make):
    """Pigeonhole: with so many edits as are allowed, wherever they stand, one seed is left."""
    import random

    rng = random.Random(2)
    notice = "mozilla public license"
    e = licenses.edits_allowed(notice)
    rows = []
    for i in range(150):
        t = list(notice)
        for p in rng.sample(range(len(t)), e):
            t[p] = "q"
        rows.append((i, "before " + "".join(t) + " after"))
    got = licenses.scan(make(rows), {notice: "mpl"}, {"mit license": "mit"}).collect()
    assert all(r.labels == "mpl" and r.spans[0].edits <= e for r in got)


def test_labels_and_scores_against_a_search_of_whole_texts(make):
    """No seeds and no regions: the regex library searches every notice in every text."""
    import random

    import regex

    rng = random.Random(9)
    notices = list(licenses.NOTICES.items())
    rows = []
    for i in range(300):
        t = list(rng.choice(notices)[0])
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], [rng.choice("abcq")], [t[p], rng.choice("xyz")]])
        rows.append((i, f"some {rng.choice(['words', 'of the', 'license'])} " + "".join(t) + " and other words"))
    got = {r.doc_id: r for r in licenses.scan(make(rows)).collect()}
    size = {}
    for n, label in notices:
        size[label] = max(size.get(label, 0), len(n))
    for i, t in rows:
        joined = " ".join(W.findall(t))
        labels, score = {x for x in brute(t)[4].split(",") if x}, 1.0 if brute(t)[1] else 0.0
        for n, label in notices:
            e = licenses.edits_allowed(n)
            if m := regex.search(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}", joined):
                labels.add(label)
                score = max(score, 1 - sum(m.fuzzy_counts) / size[label])
        assert (got[i].labels, round(got[i].score, 9)) == (",".join(sorted(labels)), round(score, 9)), t
