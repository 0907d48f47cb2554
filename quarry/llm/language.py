"""Language identification by bit-sliced Bloom filters of byte n-grams.

One table of masks holds a Bloom filter for each language, a bit each: the AND of a gram's few slots has the bits of
all languages that contain it. A text's grams are looked up once for all languages; the bits are counted for each
language, corrected for that filter's rate of false positives, and compared with the share that the language's own
texts reach. Which grams a language contains comes from counts over all training rows.

A gram is four bytes of the lower-cased text with its second a letter (so one-letter words have one, too), all
but letters being a space. A language contains a gram that makes up MIN_SHARE of its grams, and CONTRAST of the highest share in any language.
The grams with such a share are at most 1 / MIN_SHARE a language, whatever the size of the corpus: that bounds the model and what
the driver collects. Masks of over 64 languages take several planes of 64 each.

Defined cases: text that is null or has no letter: `und`, score 0; a text without a known gram: the language
with the most training grams, score 0; ties: the first language in order of name; no training rows: `und`; rows with null lang or null doc_id don't train;
long texts are read whole, in blocks; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrays import blocks, column

MIN_SHARE = 2e-5
CONTRAST = 0.15
#: Slots (a power of two) and hash functions of the filters.
SLOT_BITS = 20
#: Fixed odd multipliers, one for each hash function.
MULTIPLIERS = (2654435769, 2246822507, 3266489909)

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes (uint32) and the document of each, with a space on both sides of each document."""
    n, docs = len(data), len(off) - 1
    padded = np.full(n + docs + 4, 32, np.uint8)
    doc = np.repeat(np.arange(docs), np.diff(off))
    padded[np.arange(n) + doc + 1] = _LETTER[data]
    size = n + docs
    b = [padded[k : size + k] for k in range(4)]
    full = b[1] != 32
    at = np.flatnonzero(full)
    code = b[0][at].astype(np.uint32)
    code |= b[1][at].astype(np.uint32) << np.uint32(8)
    third = b[2][at].astype(np.uint32)
    code |= third << np.uint32(16)
    code |= np.where(third == 32, np.uint32(0), b[3][at].astype(np.uint32)) << np.uint32(24)
    # a gram's second byte at padded position p + 1 belongs to the document whose text covers it
    return code, np.searchsorted(off[1:] + np.arange(1, docs + 1), at, side="right")


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    index = {x: k for k, x in enumerate(languages)}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in held])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    size = 0
    for batch in batches:
        texts = column(batch, "text")
        langs = np.array([index[x] for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.uint64)
        for i, _, data, off in blocks(texts):
            code, doc = grams(data, off)
            k, c = np.unique(code | langs[i + doc] << np.uint64(32), return_counts=True)
            held.append((k, c))
            size += len(k)
        if size > 4_000_000:
            held[:] = [merged()]
            size = len(held[0][0])
    if size:
        k, c = merged()
        for a in range(0, len(k), 50_000):
            s = slice(a, a + 50_000)
            yield pa.record_batch([pa.array((k[s] >> np.uint64(32)).astype(np.int32)), pa.array((k[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(c[s].astype(np.int64))], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Filters:
    languages: list[str]
    #: For each 64 languages, the masks of the slots.
    masks: list[np.ndarray]
    #: For each language: rate of false positives, share of its own grams that it contains, and training grams.
    false_rate: np.ndarray
    own: np.ndarray
    total: np.ndarray


def slots(code: np.ndarray) -> list[np.ndarray]:
    return [(code * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS]


def build(languages: list[str], rows: list[tuple[int, int, int]], totals: dict[int, int]) -> Filters:
    """The filters of the grams in ``rows`` (language, gram, count), all of at least MIN_SHARE."""
    n = len(languages)
    kinds = [next(k for bits, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if min(64, n - p) <= bits) for p in range(0, n, 64)]
    masks = [np.zeros(1 << SLOT_BITS, kind) for kind in kinds]
    total = np.array([totals.get(k, 0) for k in range(n)], float)
    own = np.zeros(n)
    if rows:
        lang, gram, count = (np.array(x) for x in zip(*rows, strict=True))
        share = count / total[lang]
        _, g = np.unique(gram, return_inverse=True)
        top = np.zeros(g.max() + 1)
        np.maximum.at(top, g, share)
        keep = share >= CONTRAST * top[g]
        for k in range(n):
            mine = keep & (lang == k)
            own[k] = share[mine].sum()
            for s in slots(gram[mine].astype(np.uint32)):
                masks[k // 64][s] |= kinds[k // 64](1 << k % 64)
    fill = np.array([np.count_nonzero(masks[k // 64] & kinds[k // 64](1 << k % 64)) for k in range(n)]) / (1 << SLOT_BITS)
    return Filters(languages, masks, fill ** len(MULTIPLIERS), np.maximum(own, 1e-9), total)


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> Filters:
    """Learns from text and lang of the rows that aren't held out."""
    rows = docs.select(docs["doc_id"].alias("i"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where((F.crc32(F.col("i").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    counts = rows.mapInArrow(functools.partial(_count, languages=languages), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from quarry.llm._shared import written

    counts = written(counts, "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.element_at(F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, MIN_SHARE * n)]), F.col("lang")) if totals else F.lit(0.0)
    kept = [(r["lang"], r["gram"], r["n"]) for r in counts.where(F.col("n") >= least).collect()]
    return build(languages, kept, totals)


def hits(f: Filters, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each document, and for each document and language the grams that the filter contains."""
    docs, n = len(off) - 1, len(f.languages)
    code, doc = grams(data, off)
    at, found = slots(code), []
    for p, masks in enumerate(f.masks):
        mask, here = masks[at[0]], min(64, n - 64 * p)
        for x in at[1:]:
            mask &= masks[x]
        if n <= 8:
            table = np.bincount(doc * 256 + mask, minlength=docs * 256).reshape(docs, 256)
            return table.sum(1), table @ ((np.arange(256)[:, None] >> np.arange(n)) & 1)
        kind = masks.dtype.type
        found += [np.bincount(doc[(mask & kind(1 << k)) != 0], minlength=docs) for k in range(here)]
    return np.bincount(doc, minlength=docs), np.stack(found, 1)


def _predict(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    f: Filters = held.value
    n = len(f.languages)
    common = int(np.argmax(f.total)) if n else 0
    for batch in batches:
        texts = column(batch, "text")
        for i, j, data, off in blocks(texts):
            docs = j - i
            if n:
                total, found = hits(f, data, off)
                share = np.maximum(0, found / np.maximum(total, 1)[:, None] - f.false_rate) / (1 - f.false_rate)
                scaled = share / f.own
                best = scaled.argmax(1)
                score = np.clip(scaled[np.arange(docs), best], 0, 1)
                best = np.where(score > 0, best, common)
            else:
                best, score = np.zeros(docs, int), np.zeros(docs)
            ascii_letter = np.add.reduceat(np.concatenate([(_LETTER[data] != 32) & (data < 128), [False]]), off[:-1]) * (np.diff(off) > 0) > 0
            pred = []
            for d in range(docs):
                letter = ascii_letter[d] or (off[d + 1] > off[d] and any(c.isalpha() for c in texts[i + d].as_py()))
                pred.append(f.languages[best[d]] if n and letter else "und")
                if not (n and letter):
                    score[d] = 0
            yield pa.record_batch([batch.column(0).slice(i, docs), batch.column(1).slice(i, docs), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): SCHEMA. The broadcast model has 2 ** SLOT_BITS masks."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select(docs["doc_id"].cast("long"), _held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string")).mapInArrow(functools.partial(_predict, held=held), SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


#: Texts with a lower score resemble no language that was learnt.
LEAST_SCORE = 0.2


def _accept(batches: Iterator[pa.RecordBatch], held, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        none = pa.nulls(len(texts), pa.int64())
        plain = pa.record_batch([none, pa.nulls(len(texts), pa.bool_()), texts], names=["doc_id", "held_out", "text"])
        keep = [p != "und" and s >= least for out in _predict(iter([plain]), held) for p, s in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def accepted(docs: DataFrame, filters: Filters, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those of language `und` or a score below ``least``; all columns, in one narrow stage."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.mapInArrow(functools.partial(_accept, held=held, least=least), docs.schema)
