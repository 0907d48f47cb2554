"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from SIDE tokens on both sides of it, itself hidden; a document's score is the sum of the logarithms of
these conditional probabilities. Tokens are words [^\\x20\\x09-\\x0D]+. The network has a vocabulary of FREQUENT + BUCKETS symbols: the FREQUENT most frequent
words of the whole corpus are symbols of their own, all others are in BUCKETS symbols by hash. Its output is factored: a softmax over
GROUPS groups of symbols, neighbours in frequency, times a softmax over the MEMBERS symbols of a group. A rare word's probability is its bucket's times its
own given the bucket, from the counts of all words of the corpus: (count + 1) / (tokens + words + 1 of the bucket), and 1 / (...) for
all unseen words of the bucket together. The table of counts is written and grows with the corpus; its KNOWN most frequent words are broadcast, the
others joined. The counts also start the output layer.

Texts are read twice: for the counts, and to be turned into symbols, which are written with each document's rare words; training and scoring read these.

The network (embeddings, a tanh layer, the two softmaxes) is trained in numpy where the texts are: in each round all tasks start from the same weights, go
once through every position of all their documents by Adam, and return weights with the number of
positions; Spark sums the weighted parts, and the driver takes their mean. What is gathered so grows with the corpus (a model for each task),
and what the driver gets has the size of one model.

Defined cases: a null, empty or blank text has no tokens, sum 0 and a null mean; places beyond a document's ends are a token of their own; repeated rows count as often as
they occur; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrays import blocks, column, segments, word_hashes
from quarry.llm._shared import written

#: Symbols: GROUPS * MEMBERS, of which the last BUCKETS are of all words that have none of their own.
GROUPS, MEMBERS, BUCKETS = 32, 64, 64
FREQUENT = GROUPS * MEMBERS - BUCKETS
OUTSIDE = FREQUENT + BUCKETS
SIDE, WIDTH, HIDDEN = 2, 12, 32
ROUNDS, BATCH, RATE = 2, 4096, 0.01
#: Positions whose neighbours are laid out at once.
POSITIONS = 1 << 17
#: Words whose probabilities are broadcast; rarer ones are joined.
KNOWN = 1 << 18

SCHEMA = "doc_id long, n_tokens long, sum_log_prob double, mean_log_prob double"
TOKENS = "row long, doc_id long, ids binary, base double, words array<long>, times array<long>"


class Lookup:
    """Places of 64-bit hashes in a sorted array of them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.first: np.ndarray | None = None

    def __getstate__(self):
        return {"words": self.words, "first": None}

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't there."""
        if not len(self.words):
            return np.full(len(h), -1, np.int64)
        bits = max(8, len(self.words).bit_length() + 1)
        if self.first is None:
            self.first = np.searchsorted(self.words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        at, stop = self.first[slot].astype(np.int64), self.first[slot + 1]
        out = np.full(len(h), -1, np.int64)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            here = at[todo]
            same = self.words[here] == h[todo]
            out[todo[same]] = here[same]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out


@dataclass
class Network:
    #: Hashes of the frequent words, sorted, and their ids in that order.
    words: Lookup
    ids: np.ndarray
    #: Embeddings; first layer and its bias; output layers of the groups and of the members of each, whose last rows are biases.
    weights: list[np.ndarray]


def start(words: list[tuple[int, int]], rest: list[tuple[int, int]]) -> Network:
    """A network before training: ``words`` (hash, count) most frequent first, ``rest`` (bucket, count)."""
    h = np.array([w for w, _ in words], np.int64).view(np.uint64)
    order = np.argsort(h)
    counts = np.ones(OUTSIDE)
    counts[: len(words)] += [n for _, n in words]
    for b, n in rest:
        counts[FREQUENT + b] += n
    rng = np.random.default_rng(11)
    f = np.float32
    each = counts.reshape(GROUPS, MEMBERS)
    weights = [
        rng.normal(0, 0.3, (OUTSIDE + 1, WIDTH)).astype(f),
        rng.normal(0, 1 / np.sqrt(2 * SIDE * WIDTH), (2 * SIDE * WIDTH, HIDDEN)).astype(f),
        np.zeros(HIDDEN, f),
        rng.normal(0, 0.1, (HIDDEN + 1, GROUPS)).astype(f),
        rng.normal(0, 0.1, (GROUPS, HIDDEN + 1, MEMBERS)).astype(f),
    ]
    weights[3][HIDDEN] = np.log(each.sum(1) / counts.sum())
    weights[4][:, HIDDEN] = np.log(each / each.sum(1, keepdims=True))
    return Network(Lookup(h[order]), order, weights)


def tokens(net: Network, h: np.ndarray) -> np.ndarray:
    """Ids of words with these hashes."""
    at = net.words.find(h)
    return np.where(at < 0, FREQUENT + (h % np.uint64(BUCKETS)).astype(np.int64), net.ids[at] if len(net.ids) else 0)


def contexts(ids: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of the neighbours (positions, 2 * SIDE), OUTSIDE beyond a document's ends; own ids) of POSITIONS positions at a time."""
    n, docs = len(ids), len(off) - 1
    padded = np.full(n + (docs + 1) * SIDE, OUTSIDE, np.int16)
    for a in range(0, n, POSITIONS):
        b = min(n, a + POSITIONS)
        padded[np.arange(a, b) + _gaps(off, a, b)] = ids[a:b]
    for a in range(0, n, POSITIONS):
        b = min(n, a + POSITIONS)
        place = np.arange(a, b) + _gaps(off, a, b)
        yield np.stack([padded[place + shift] for shift in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1), ids[a:b]


def _gaps(off: np.ndarray, a: int, b: int) -> np.ndarray:
    """Padding before each of the positions ``a`` to ``b``: SIDE before each document."""
    first, last = np.searchsorted(off, [a, b - 1], side="right") - 1
    inner = np.clip(off[first : last + 2], a, b)
    return np.repeat(np.arange(first + 1, last + 2) * SIDE, np.diff(inner))


def _settle(z: np.ndarray) -> None:
    """Shifts the rows of ``z`` where exp could leave float32."""
    if z.max() > 80 or z.min() < -80:
        z -= z.max(1, keepdims=True)


class Space:
    """Buffers of the gradients of up to ``n`` positions, and of the weights."""

    def __init__(self, weights: list[np.ndarray], n: int):
        kind = weights[0].dtype
        self.n, self.kind = n, kind
        self.x, self.dx = np.empty((n, 2 * SIDE * WIDTH), kind), np.empty((n, 2 * SIDE * WIDTH), kind)
        self.hidden, self.scaled, self.own = np.ones((n, HIDDEN + 1), kind), np.empty((n, HIDDEN + 1), kind), np.empty((n, HIDDEN), kind)
        self.back, self.group, self.member = np.empty((n, HIDDEN), kind), np.empty((n, GROUPS), kind), np.empty(n * MEMBERS, kind)
        self.sorted, self.rows = np.empty((2 * SIDE * n, WIDTH), kind), np.arange(n)
        self.grad = [np.zeros_like(w) for w in weights]


def _by_group(y: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order of positions by the group of their symbol, and where each group begins in it."""
    group = (y // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()


def gradients(weights: list[np.ndarray], ctx: np.ndarray, y: np.ndarray, space: Space | None = None) -> list[np.ndarray]:
    """Those of the sum of -log P over the positions, in the buffers of ``space``."""
    e, w1, b1, wg, wm = weights
    n = len(y)
    s = space or Space(weights, n)
    order, edge = _by_group(y)
    ctx, y = ctx[order], y[order]
    group = y // MEMBERS
    member = y - group * MEMBERS
    rows, x, z, hidden, scaled, back, p = s.rows[:n], s.x[:n], s.own[:n], s.hidden[:n], s.scaled[:n], s.back[:n], s.group[:n]
    np.take(e, ctx, axis=0, out=x.reshape(n, -1, WIDTH), mode="clip")
    np.dot(x, w1, out=z)
    z += b1
    np.tanh(z, out=z)
    hidden[:, :HIDDEN] = z
    # of a softmax p = exp / sum: (exp - sum at the symbol) / sum is the gradient, and the division is left to the narrow side
    np.dot(hidden, wg, out=p)
    _settle(p)
    np.exp(p, out=p)
    sums = p @ np.ones(GROUPS, s.kind)
    p[rows, group] -= sums
    inverse = (1 / sums)[:, None]
    np.multiply(hidden, inverse, out=scaled)
    np.dot(p, wg[:HIDDEN].T, out=back)
    back *= inverse
    np.dot(scaled.T, p, out=s.grad[3])
    one = np.ones(MEMBERS, s.kind)
    for g in range(GROUPS):
        a, b = edge[g], edge[g + 1]
        if a == b:
            s.grad[4][g] = 0
            continue
        q = s.member[: (b - a) * MEMBERS].reshape(b - a, MEMBERS)
        np.dot(hidden[a:b], wm[g], out=q)
        _settle(q)
        np.exp(q, out=q)
        sums = q @ one
        q[rows[: b - a], member[a:b]] -= sums
        inverse = (1 / sums)[:, None]
        np.multiply(hidden[a:b], inverse, out=scaled[a:b])
        np.dot(scaled[a:b].T, q, out=s.grad[4][g])
        own = q @ wm[g, :HIDDEN].T
        own *= inverse
        back[a:b] += own
    z *= z
    np.subtract(1, z, out=z)
    back *= z
    np.dot(x.T, back, out=s.grad[1])
    back.sum(0, out=s.grad[2])
    dx = s.dx[:n]
    np.dot(back, w1.T, out=dx)
    flat = ctx.ravel()
    by = np.argsort(flat, kind="stable")
    flat = flat[by]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    each = s.sorted[: len(flat)]
    np.take(dx.reshape(-1, WIDTH), by, axis=0, out=each, mode="clip")
    s.grad[0][:] = 0
    s.grad[0][flat[first]] = np.add.reduceat(each, first, axis=0)
    return s.grad


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float):
        self.w, self.rate, self.t = [x.copy() for x in weights], rate, 0
        self.m, self.v, self.buffer = ([np.zeros_like(x) for x in weights] for _ in range(3))
        self.space = Space(weights, BATCH)

    def step(self, ctx: np.ndarray, y: np.ndarray) -> None:
        self.t += 1
        for w, m, v, g, buffer in zip(self.w, self.m, self.v, gradients(self.w, ctx, y, self.space), self.buffer, strict=True):
            g /= len(y)
            m *= 0.9
            v *= 0.999
            m += np.multiply(g, 0.1, out=buffer)
            g *= g
            v += np.multiply(g, 0.001, out=buffer)
            np.sqrt(np.divide(v, 1 - 0.999**self.t, out=buffer), out=buffer)
            buffer += 1e-8
            np.divide(m, buffer, out=buffer)
            w -= np.multiply(buffer, self.rate / (1 - 0.9**self.t), out=buffer)


def _log_softmax_at(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    _settle(z)
    own = z[np.arange(len(z)), k]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def log_probs(weights: list[np.ndarray], ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each token's symbol, given its neighbours."""
    e, w1, b1, wg, wm = weights
    # the first layer of each neighbour is a row of a table
    parts = [e @ w1[k * WIDTH : (k + 1) * WIDTH] for k in range(ctx.shape[1])]
    out = np.empty(len(y))
    for at in range(0, len(y), BATCH):
        order, edge = _by_group(y[at : at + BATCH])
        c, own = ctx[at : at + BATCH][order], y[at : at + BATCH][order]
        hidden = np.ones((len(own), HIDDEN + 1), e.dtype)
        z = parts[0][c[:, 0]] + b1
        for k in range(1, c.shape[1]):
            z += parts[k][c[:, k]]
        np.tanh(z, out=hidden[:, :HIDDEN])
        logs = _log_softmax_at(hidden @ wg, own // MEMBERS).astype(np.float64)
        for g in range(GROUPS):
            a, b = edge[g], edge[g + 1]
            if a < b:
                logs[a:b] += _log_softmax_at(hidden[a:b] @ wm[g], own[a:b] - g * MEMBERS)
        out[at + order] = logs
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [word_hashes(data, segments(data, off)[0]) for _, _, data, off in blocks(column(batch, "text"))]
        if held:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(word), 50_000):
                yield pa.record_batch([pa.array(word[a : a + 50_000].view(np.int64)), pa.array(n[a : a + 50_000])], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """The words of all ``docs`` (text) by hash, with their counts: word, n; a written table."""
    rows = docs.select(docs["text"].cast("string").alias("text"))
    return written(rows.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _bucket() -> Column:
    """The bucket of an unsigned hash; BUCKETS is a power of two."""
    return F.col("word").bitwiseAND(F.lit(BUCKETS - 1))


def vocabulary(counts: DataFrame) -> Network:
    """The network before training, of ``word_counts``."""
    frequent = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    net = start(frequent, [])
    other = _others(counts, net).groupBy(_bucket().alias("b")).agg(F.sum("n").alias("n")).collect()
    return start(frequent, [(r.b, r.n) for r in other])


def _others(counts: DataFrame, net: Network) -> DataFrame:
    """The counts of words without a symbol of their own."""
    own = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(net.words.words.view(np.int64), pa.int64())}))
    return counts.join(F.broadcast(own), "word", "left_anti")


@dataclass
class Known:
    """Words by hash with the logarithms of their probabilities given their buckets; those of an unseen word, for each bucket."""

    words: Lookup
    logs: np.ndarray
    unseen: np.ndarray
    #: Whether these are all words of the table.
    all: bool


def known_words(counts: DataFrame, net: Network) -> Known:
    own = _others(counts, net)
    sizes = {r.b: (r.n, r.words) for r in own.groupBy(_bucket().alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    unseen = -np.log([sum(sizes.get(b, (0, 0))) + 1.0 for b in range(BUCKETS)])
    # counts in narrow ranges show which words are the KNOWN most frequent at most, without sorting the table
    level = F.floor(F.log2("n") * 16)
    levels = {r.level: r.words for r in own.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    high = [x for x in levels if sum(n for y, n in levels.items() if y >= x) <= KNOWN]
    top = own.where(level >= min(high) if high else F.lit(False)).toArrow()
    h = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    logs = np.log(top["n"].to_numpy().astype(np.float64) + 1) + unseen[(h % np.uint64(BUCKETS)).astype(np.int64)]
    return Known(Lookup(h[order]), logs[order], unseen, top.num_rows == sum(words for _, words in sizes.values()))


def _tokenise(batches: Iterator[pa.RecordBatch], held, known) -> Iterator[pa.RecordBatch]:
    """Rows of TOKENS: the symbols of each document (16 bits each), what the broadcast words add to its score, and the other words with their counts in the document."""
    from pyspark import TaskContext

    net: Network = held.value
    k: Known | None = known and known.value
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 36
    for batch in batches:
        for i, j, data, off in blocks(column(batch, "text")):
            starts, _, words = segments(data, off)
            h = word_hashes(data, starts)
            y = tokens(net, h)
            each, rest = np.zeros(len(y)), np.zeros(0, np.int64)
            if k:
                inner = np.flatnonzero(y >= FREQUENT)
                at = k.words.find(h[inner])
                found = at >= 0
                each[inner[found]] = k.logs[at[found]]
                rest = inner[~found]
                if k.all:
                    each[rest] = k.unseen[y[rest] - FREQUENT]
                    rest = rest[:0]
            total = np.concatenate([[0.0], np.cumsum(each)])
            # distinct (document, word) of the words to be joined
            doc = np.searchsorted(words, rest, side="right") - 1
            order = np.lexsort((h[rest], doc))
            doc, w = doc[order], h[rest][order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])])) if len(doc) else doc
            times = np.diff(np.concatenate([first, [len(doc)]]))
            cut = pa.array(np.searchsorted(doc[first], np.arange(j - i + 1)), pa.int32())
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((words * 2).astype(np.int64)), pa.py_buffer(y.astype(np.uint16))]).cast(pa.binary())
            yield pa.record_batch(
                [pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), ids, pa.array(total[words[1:]] - total[words[:-1]]), pa.ListArray.from_arrays(cut, pa.array(w[first].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times, pa.int64()))],
                names=["row", "doc_id", "ids", "base", "words", "times"],
            )
            row += j - i


def tokenised(docs: DataFrame, net: Network, known: Known | None = None) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): TOKENS; a written table. Without ``known`` words have the probabilities of their symbols only."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return written(rows.mapInArrow(functools.partial(_tokenise, held=context.broadcast(net), known=known and context.broadcast(known)), TOKENS), "tokens")


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most POSITIONS tokens (or of one longer row), with their ids and offsets."""
    for batch in batches:
        a = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
        _, off, data = a.buffers()
        off = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8) // 2 if len(a) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, np.uint16) if data is not None and data.size else np.zeros(0, np.uint16)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + POSITIONS, side="right")) - 1)
            yield batch.slice(i, j - i), ids[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def _train(batches: Iterator[pa.RecordBatch], held, rate: float) -> Iterator[pa.RecordBatch]:
    net: Network = held.value
    adam, seen, left = Adam(net.weights, rate), 0, []
    for _, ids, off in _symbols(batches):
        seen += len(ids)
        for part in contexts(ids, off):
            left.append(part)
            if sum(len(y) for _, y in left) >= BATCH:
                c, y = np.concatenate([c for c, _ in left]), np.concatenate([y for _, y in left]).astype(np.int64)
                for a in range(0, len(y) - BATCH + 1, BATCH):
                    adam.step(c[a : a + BATCH], y[a : a + BATCH])
                a = len(y) // BATCH * BATCH
                left = [(c[a:], y[a:])]
    if seen:
        if rest := sum(len(y) for _, y in left):
            # the last few positions move the weights in proportion to their number
            adam.rate *= rest / BATCH
            adam.step(np.concatenate([c for c, _ in left]), np.concatenate([y for _, y in left]).astype(np.int64))
        yield pa.record_batch([pa.array(range(len(adam.w)), pa.int32()), pa.array([seen] * len(adam.w)), pa.array([(w.astype(np.float64) * seen).tobytes() for w in adam.w], pa.binary())], names=["part", "n", "sums"])


def _sum(t: pa.Table) -> pa.Table:
    total = np.zeros(len(t["sums"][0].as_py()) // 8)
    for x in t["sums"]:
        total += np.frombuffer(x.as_py())
    return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what one task of the first level got, for each part."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = held.setdefault(part, [0, 0.0])
            x[0] += n
            x[1] = x[1] + np.frombuffer(sums)
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tobytes() for _, s in held.values()], pa.binary())], names=["part", "n", "sums"])


def train(table: DataFrame, net: Network, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """``net`` trained on all positions of ``tokenised`` documents."""
    context = table.sparkSession.sparkContext
    # models are summed in as many tasks as each then has models
    groups = max(1, int(table.select("ids").rdd.getNumPartitions() ** 0.5))
    for _ in range(rounds):
        models = table.select("ids").mapInArrow(functools.partial(_train, held=context.broadcast(net), rate=rate), "part int, n long, sums binary")
        few = models.repartition(groups).mapInArrow(_in_groups, "part int, n long, sums binary")
        found = {r.part: (r.n, r.sums) for r in few.groupBy("part").applyInArrow(lambda t: _sum(t), "part int, n long, sums binary").collect()}
        if found:
            net = Network(net.words, net.ids, [(np.frombuffer(found[k][1]) / found[k][0]).reshape(w.shape).astype(np.float32) for k, w in enumerate(net.weights)])
    return net


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, counts: DataFrame | None = None) -> Network:
    """Trains on all ``docs`` (text), whose ``word_counts`` are ``counts``."""
    net = vocabulary(word_counts(docs) if counts is None else counts)
    return train(tokenised(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), net), net, rounds, rate)


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Rows of TOKENS without their symbols: number of tokens, and the sum of the logarithms so far."""
    net: Network = held.value
    for batch, ids, off in _symbols(batches):
        total = np.concatenate([[0.0], *(log_probs(net.weights, ctx, y.astype(np.int64)) for ctx, y in contexts(ids, off))])
        np.cumsum(total, out=total)
        sums = total[off[1:]] - total[off[:-1]] + batch.column(3).to_numpy()
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(off)), pa.array(sums), *batch.columns[4:]], names=["row", "doc_id", "n_tokens", "sum_log_prob", "words", "times"])


def score_tokens(table: DataFrame, net: Network, counts: DataFrame | None = None, known: Known | None = None) -> DataFrame:
    """One row for each ``tokenised`` document: SCHEMA. ``counts`` has the words that ``known`` doesn't."""
    held = table.sparkSession.sparkContext.broadcast(net)
    kind = "row long, doc_id long, n_tokens long, sum_log_prob double, words array<long>, times array<long>"
    if known is None or known.all:
        found = table.mapInArrow(functools.partial(_score, held=held), kind)
    else:
        # none of the joined words has over 1 / KNOWN of the tokens
        tail = table.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        log = F.log(F.coalesce(F.col("n"), F.lit(0)) + 1.0) + F.element_at(F.array(*map(F.lit, known.unseen.tolist())), (_bucket() + 1).cast("int"))
        added = tail.join(_others(counts, net).hint("merge"), "word", "left").groupBy("row").agg(F.sum(F.col("times") * log).alias("more"))
        found = table.withColumns({"words": F.array().cast("array<long>"), "times": F.array().cast("array<long>")}).mapInArrow(functools.partial(_score, held=held), kind)
        found = found.drop("words", "times").join(added.hint("merge"), "row", "left").withColumn("sum_log_prob", F.col("sum_log_prob") + F.coalesce("more", F.lit(0.0)))
    return found.select("doc_id", "n_tokens", "sum_log_prob", F.when(F.col("n_tokens") > 0, F.col("sum_log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def score_words(docs: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): SCHEMA, of the words themselves, by the ``word_counts`` that ``net`` was fitted with."""
    known = known_words(counts, net)
    return score_tokens(tokenised(docs, net, known), net, counts, known)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): SCHEMA, of the words' symbols only; ``score_words`` has the words' own probabilities."""
    return score_tokens(tokenised(docs, net), net)


def fit_and_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) under the network trained on them: SCHEMA."""
    counts = word_counts(docs)
    net = vocabulary(counts)
    known = known_words(counts, net)
    table = tokenised(docs, net, known)
    return score_tokens(table, train(table, net, rounds), counts, known)
