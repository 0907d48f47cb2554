"""License scan: exact phrases, and short notices with a few edits.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII bytes. Base phrases are found as
runs of whole words. For the notices, each is split into one piece more than the edits allowed: by the pigeonhole principle one piece
stands unchanged in any text within that distance. An Aho-Corasick automaton over all pieces
finds these seeds, and only around a seed does the regex library match the notice with
its bounded number of edits; the spans it reports are given in words, with their edits.

Defined cases: null is the empty text; texts without a match get no labels, score 0 and null positions; every text is read whole, in blocks of bytes;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._arrays import blocks, column, segments, word_hashes

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices searched with edits, in words of the scan, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit is allowed for so many characters of a notice.
CHARS_AN_EDIT = 12

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,edits:int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())]))

#: Each byte as the scan sees it: A-Z lower-cased, other ASCII but letters and digits a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32
GAP = np.zeros(256, bool)
GAP[32] = True


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of ``text`` of nearly equal length, with their offsets."""
    at = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_AN_EDIT)


@functools.cache
def _prepared(notices: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    automaton = ahocorasick.Automaton()
    seeds: dict[str, list[tuple[int, int]]] = {}
    compiled = []
    for k, (notice, label) in enumerate(notices):
        text = notice.encode().decode("latin-1")
        e = edits_allowed(text)
        compiled.append((regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}"), label, len(text), e))
        for at, piece in pieces(text, e):
            seeds.setdefault(piece, []).append((k, at))
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    spelled = []
    for phrase, label in phrases:
        raw = phrase.encode()
        data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        starts, _, _ = segments(data, off, GAP)
        spelled.append((raw.split(b" "), word_hashes(data, starts, 0, GAP), label))
    return automaton, compiled, spelled


def _base(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, spelled) -> dict[int, list[tuple[int, str]]]:
    """For each document with a phrase: (first word, label) of all places."""
    h = word_hashes(data, starts, 0, GAP)
    found: dict[int, list[tuple[int, str]]] = {}
    for parts, want, label in spelled:
        at = np.flatnonzero(h[: max(0, len(h) - len(want) + 1)] == want[0])
        for k in range(1, len(want)):
            at = at[h[at + k] == want[k]]
        doc = np.searchsorted(words, at, side="right") - 1
        for i, d in zip(at.tolist(), doc.tolist(), strict=True):
            if i + len(want) <= words[d + 1] and all(data[starts[i + k] : ends[i + k]].tobytes() == p for k, p in enumerate(parts)):
                found.setdefault(d, []).append((i - int(words[d]), label))
    return found


def _fuzzy(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, automaton, compiled) -> dict[int, list[tuple[str, int, int, int]]]:
    """For each document with a notice: (label, first word, last word, edits)."""
    # words joined by one space; a document's end is a zero, which no piece holds
    keep = np.zeros(len(data) + 1, bool)
    if not len(starts):
        return {}
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    keep = np.cumsum(inside)[:-1] > 0
    joined = np.full(int(keep.sum()) + len(starts), 32, np.uint8)
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1  # of each word in joined
    at = np.arange(int(keep.sum())) + np.repeat(np.arange(len(starts)), lengths)
    joined[at] = data[keep]
    full = np.flatnonzero(words[:-1] < words[1:])
    limit = begin[words[full + 1] - 1] + lengths[words[full + 1] - 1]  # the byte after each document
    joined[limit] = 0
    text = joined.tobytes().decode("latin-1")
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for last, (size, uses) in automaton.iter(text):
        d = int(np.searchsorted(limit, last, side="right"))
        low, high = int(begin[words[full[d]]]), int(limit[d])
        for k, offset in uses:
            _, _, length, e = compiled[k]
            a = last + 1 - size - offset
            a, b = max(low, a - e), min(high, a + length + e)
            runs = regions.setdefault((d, k), [])
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
    found: dict[int, list[tuple[str, int, int, int]]] = {}
    for (d, k), runs in regions.items():
        pattern, label, _, _ = compiled[k]
        base = int(words[full[d]])
        for a, b in runs:
            for m in pattern.finditer(text, a, b):
                if m.end() > m.start():
                    first = int(np.searchsorted(begin, m.start(), side="right")) - 1 - base
                    last = int(np.searchsorted(begin, m.end() - 1, side="right")) - 1 - base
                    found.setdefault(int(full[d]), []).append((label, first, last, sum(m.fuzzy_counts)))
    return found


def _scan(batches: Iterator[pa.RecordBatch], notices: tuple, phrases: tuple) -> Iterator[pa.RecordBatch]:
    automaton, compiled, spelled = _prepared(notices, phrases)
    size = {label: max(n for _, x, n, _ in compiled if x == label) for _, label, _, _ in compiled}
    for batch in batches:
        texts, ids = column(batch, "text"), batch.column(0)
        for i, j, data, off in blocks(texts):
            data = FOLD[data]
            starts, ends, words = segments(data, off, GAP)
            base, fuzzy = _base(data, starts, ends, words, spelled), _fuzzy(data, starts, ends, words, automaton, compiled)
            cols: list[list] = [[], [], [], [], [], [], []]
            for d in range(j - i):
                b, f = base.get(d, []), fuzzy.get(d, [])
                spots = [x for x, _ in b]
                own = {x for _, x in b}
                score = 1.0 if b else max((1 - e / size[x] for x, _, _, e in f), default=0.0)
                for c, v in zip(cols, (len(b), min(spots, default=None), max(spots, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in f})), score, [dict(zip(("label", "first", "last", "edits"), x, strict=True)) for x in sorted(set(f), key=lambda x: (x[1], x[2], x[0]))]), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
            yield pa.record_batch([ids.slice(i, j - i), pa.array(np.diff(words)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan(docs: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): SCHEMA. Notices and phrases: words in lower case, joined by spaces, to their label."""
    f = functools.partial(_scan, notices=tuple((notices or NOTICES).items()), phrases=tuple((phrases or PHRASES).items()))
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(f, SCHEMA)
