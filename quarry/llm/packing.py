"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's cost is linear plus quadratic in its length (projections plus attention). Tasks
tokenise their rows and pack them in groups of about ``group_tokens`` tokens: whole
sequences are cut from long documents first; what is left goes, most costly first, to the
lowest-cost sequence that has room for all of it, and is cut only where none has. Groups
are independent, so the operator is one narrow stage: nothing is shuffled, memory is bounded by
the group and the longest document, and a lost task gives the same rows when it runs again.

The capacity of a group's sequences is exactly its number of tokens: after the full sequences,
the rest is laid out in sequences of powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed
each by itself; an empty table gives no rows; other columns are ignored; a text of any length is packed whole.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._arrays import column, spans

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A space between white space on both sides, or between white space and the end: the only places where a text can't be cut before a space.
_INNER = re.compile(r"\s (?:\s|\Z)")
#: The characters for which the two libraries' tables of letters and digits surely agree.
_PLAIN = re.compile(r"[\x00-ɏ]*\Z")


class Units(dict):
    """Token ids of the texts between spaces, each encoded once; ``documents`` joins them."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        super().__init__()
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.most = most
        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):  # the same vocabulary as ranks: the same ids, in a third of the time
            import public_tokenizers

            with open(ranks, "rb") as f:
                pairs = [line.split() for line in f]
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.begin = array("I"), array("q", [0])

    def __missing__(self, unit: str) -> int:
        plain = self.fast is not None and _PLAIN.match(unit)
        self.ids.extend(self.fast.encode_ordinary(unit) if plain else self.slow.encode(unit, add_special_tokens=False).ids)
        self.begin.append(len(self.ids))
        self[unit] = k = len(self)
        return k

    def document(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _INNER.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > self.most:
            self.reset()
        parts = text.split(" ")
        units = [self[parts[0]]] if parts[0] else []
        units += [self[" " + p] for p in parts[1:]]
        if not units:
            return np.zeros(0, np.uint32)
        begin, ids = np.frombuffer(self.begin, np.int64), np.frombuffer(self.ids, np.uint32)
        u = np.array(units)
        run, place = spans(begin[u + 1] - begin[u])
        return ids[begin[u][run] + place]


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the number of sequences."""
    pieces: list[tuple[int, int, int, int, int]] = []
    n = 0
    for d in np.flatnonzero(lengths >= size):
        for k in range(int(lengths[d]) // size):
            pieces.append((int(d), k * size, size, n, 0))
            n += 1
    rest = lengths % size
    total = int(rest.sum())
    room = np.full(total // size, size, np.int64)
    room = np.concatenate([room, [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]]).astype(np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for d in np.lexsort((np.arange(len(rest)), -rest)):
        left, at = int(rest[d]), int(lengths[d] - rest[d])
        while left:
            fits = np.flatnonzero(room >= left)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            k = min(left, int(room[s]))
            pieces.append((int(d), at, k, n + s, int(used[s])))
            room[s] -= k
            used[s] += k
            cost[s] += linear * k + quadratic * k * k
            left, at = left - k, at + k
    return pieces, n + len(room)


_units: dict[str, Units] = {}


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, size: int, end_id: int, group_tokens: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 36
    if vocabulary not in _units:
        _units[vocabulary] = Units(vocabulary)
    units = _units[vocabulary]
    ids: list[np.ndarray] = []
    docs: list[int | None] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, held
        lengths = np.array([len(x) for x in ids], np.int64)
        pieces, n = assign(lengths, size, linear, quadratic)
        d, start, length, seq, off = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[i][s : s + k].astype("<u4").tobytes()) for i, s, k in zip(d, start, length, strict=True)]
        out = pa.record_batch([pa.array([docs[i] for i in d], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, lengths[d], seq + number, off))], names=[x.split()[0] for x in SCHEMA.split(", ")])
        number, held = number + n, 0
        ids.clear()
        docs.clear()
        return out

    for batch in batches:
        names = batch.column(0).to_pylist()
        texts = column(batch, "text")
        for i, name in enumerate(names):
            x = np.append(units.document(texts[i].as_py()), np.uint32(end_id)).astype(np.uint32)
            ids.append(x)
            docs.append(name)
            held += len(x)
            if held >= group_tokens:
                yield flush()
    if ids:
        yield flush()


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, group_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): SCHEMA. ``vocabulary``: a tokenizer's file, at the same place on every machine."""
    f = functools.partial(_pack, vocabulary=vocabulary, size=size, end_id=end_id, group_tokens=group_tokens, linear=linear, quadratic=quadratic)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(f, SCHEMA)
