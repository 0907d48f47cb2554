import random
import re

import numpy as np
import pyarrow as pa
from conftest_rows import texts_of

from quarry.llm import lm_score as L
from quarry.llm._arrays import blocks, segments, word_hashes

W = re.compile(r"[^\x20\x09-\x0D]+")


def word_id(net, w):
    (_, _, data, off), = blocks(pa.array([w], pa.large_string()))
    return int(L.tokens(net, word_hashes(data, segments(data, off)[0]))[0])


def brute(net, t):
    """Each token's probability from both sides, one by one in plain formulas."""
    e, w1, b1, wg, wm = (x.astype(np.float64) for x in net.weights)
    ids = [word_id(net, w) for w in W.findall(t or "")]
    total = 0.0
    for i, y in enumerate(ids):
        near = [ids[k] if 0 <= k < len(ids) else L.OUTSIDE for k in (i - 2, i - 1, i + 1, i + 2)]
        hidden = np.tanh(np.concatenate([e[k] for k in near]) @ w1 + b1)
        g, m = divmod(y, L.MEMBERS)
        for z, k in ((hidden @ wg[:-1] + wg[-1], g), (hidden @ wm[g, :-1] + wm[g, -1], m)):
            total += z[k] - z.max() - np.log(np.exp(z - z.max()).sum())
    return len(ids), total


def test_sums_are_those_of_the_formula(spark, data, odd, nothing):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    net = L.fit(docs)
    for some in (docs, odd.where("doc_id < 7")):
        want = sorted((i if i is not None else -1, *brute(net, t)) for i, t in texts_of(some))
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.sum_log_prob) for r in L.score(some, net).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-4, atol=1e-4)
    blank = [r for r in L.score(odd, net).collect() if r.n_tokens == 0]
    assert len(blank) == 3 and all(r.sum_log_prob == 0 and r.mean_log_prob is None for r in blank)
    assert L.score(nothing, L.fit(nothing)).count() == 0


def test_held_out_texts_score_above_shuffled_ones(spark, make):
    rng = random.Random(4)
    def say(n):
        out = []
        while len(out) < n:
            k = rng.randrange(20)
            out += [f"a{k}", f"b{k}", f"c{k}"]
        return out
    train = make([(i, " ".join(say(150))) for i in range(1500)])
    net = L.fit(train, rounds=3)
    fresh = [say(120) for _ in range(20)]
    mixed = [rng.sample(w, len(w)) for w in fresh]
    rows = L.score(make([(i, " ".join(w)) for i, w in enumerate(fresh + mixed)]), net).collect()
    mean = {r.doc_id: r.mean_log_prob for r in rows}
    assert all(mean[i] > mean[i + 20] for i in range(20))
    untrained = {r.doc_id: r.mean_log_prob for r in L.score(make([(i, " ".join(w)) for i, w in enumerate(fresh)]), L.fit(train, rounds=0)).collect()}
    assert np.mean([mean[i] - untrained[i] for i in range(20)]) > 0.5


def test_gradients():
    rng = np.random.default_rng(0)
    net = L.start([(k, 9) for k in range(L.FREQUENT)], [])
    ctx, y = rng.integers(0, L.OUTSIDE + 1, (6, 4)), rng.integers(0, L.OUTSIDE, 6)
    w = [x.astype(np.float64) for x in net.weights]
    g = L.gradients([x.copy() for x in w], ctx, y)
    loss = lambda v: -L.log_probs(v, ctx, y).sum()
    for k in range(5):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w[k].shape)
            if k == 0:
                at = (ctx[rng.integers(6), rng.integers(4)], at[1])
            if k == 4:
                at = (y[rng.integers(6)] // L.MEMBERS, *at[1:])
            d = 1e-4
            up, down = [x.copy() for x in w], [x.copy() for x in w]
            up[k][at] += d
            down[k][at] -= d
            assert abs((loss(up) - loss(down)) / (2 * d) - g[k][at]) < 1e-4


def test_lookup():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 40)))
        ask = np.concatenate([h, rng.integers(0, 1 << 64, 200, dtype=np.uint64)])
        where = {x: k for k, x in enumerate(h.tolist())}
        assert L.Lookup(h).find(ask).tolist() == [where.get(x, -1) for x in ask.tolist()]


def test_counts_start_the_output_layer(spark, make):
    net = L.fit(make([(1, "x x x y"), (2, "x z")]), rounds=0)
    p = (np.exp(net.weights[3][-1])[:, None] * np.exp(net.weights[4][:, -1])).ravel()
    assert p.argmax() == word_id(net, "x") and abs(p.sum() - 1) < 1e-5


def test_large_and_small_logits():
    for z in (np.array([[900.0, 0.0], [3.0, 4.0]], np.float32), np.array([[-900.0, -901.0], [1.0, 1.0]], np.float32)):
        exact = z.astype(np.float64) - z.max(1, keepdims=True)
        want = exact[:, 0] - np.log(np.exp(exact).sum(1))
        assert np.allclose(L._log_softmax_at(z.copy(), np.zeros(2, int)), want, atol=1e-5)


def test_words_have_their_own_probabilities(spark, data, odd, nothing, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    counts = L.word_counts(docs)
    net = L.fit(docs, counts=counts)
    seen = {}
    for _, t in texts_of(docs):
        for w in W.findall(t or ""):
            seen[w] = seen.get(w, 0) + 1
    size = {}
    for w, n in seen.items():
        b = word_id(net, w)
        size[b] = size.get(b, 0) + n + 1
    own = lambda w: 0.0 if (b := word_id(net, w)) < L.FREQUENT else np.log((seen.get(w, 0) + 1) / (size.get(b, 0) + 1))
    for known in (10, L.KNOWN):
        monkeypatch.setattr(L, "KNOWN", known)
        for some in (docs.limit(8), odd.where("doc_id < 6 OR doc_id = 7 OR doc_id IS NULL")):
            want = sorted((i if i is not None else -1, brute(net, t)[0], brute(net, t)[1] + sum(map(own, W.findall(t or "")))) for i, t in texts_of(some))
            got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.sum_log_prob) for r in L.score_words(some, net, counts).collect())
            assert [x[:2] for x in got] == [x[:2] for x in want]
            assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-4, atol=1e-4)
    assert L.score_words(nothing, L.fit(nothing), L.word_counts(nothing)).count() == 0


def test_every_position_trains(monkeypatch):
    net = L.start([(k, 9) for k in range(L.FREQUENT)], [])

    class Held:
        value = net

    trained = []
    monkeypatch.setattr(L.Adam, "step", lambda self, ctx, y: trained.append((ctx.copy(), y.copy())))
    monkeypatch.setattr(L, "POSITIONS", 1000)
    texts = ["a b c", "d", "", "e f g h i j k l m n", "o p"] * 300 + ["q " * 3000]
    read = L._tokenise(iter([pa.record_batch([pa.nulls(len(texts), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]), Held, None)
    out = list(L._train(iter([pa.record_batch([x.column(2)], names=["ids"]) for x in read]), Held, 0.01))
    assert out[0].column(1).to_pylist() == [300 * 16 + 3000] * 5 and sum(len(y) for _, y in trained) == 300 * 16 + 3000
    # a document's first word has nothing to its left, its last nothing to its right
    ctx = np.concatenate([c for c, _ in trained])
    assert (ctx[:, 1] == L.OUTSIDE).sum() == (ctx[:, 2] == L.OUTSIDE).sum() == 300 * 4 + 1
