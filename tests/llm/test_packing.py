import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_rows import texts_of
from tokenizers import Tokenizer

from quarry.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", "a   b ", "a \n b", "x\n y", "é ü 漢字", "don't stop", "tab\t\tx", "a <|endoftext|> b", "a  b", "٣ ६", "12 3.4", " lead", "trail ", "a\r\n\r\n b", "🙂 ok", "ǅ Ⅷ ª"])
def test_units_give_the_tokenizers_ids(text, slow):
    assert packing.Units(PATH).document(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_units_of_documents(spark, data, slow):
    units = packing.Units(PATH, most=500)
    for (t,) in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect():
        assert units.document(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def verify(docs, got, slow, size):
    want = defaultdict(list)
    for i, t in texts_of(docs):
        want[i].append([*slow.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) == 1:
            ids, at = np.array(want[i][0], "<u4"), 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                at += p.length
                assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, want[i]))
    padding = 0
    for spots in by_seq.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at and n > 0
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_round_trip(spark, data, slow):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    verify(docs, packing.pack(docs, PATH, group_tokens=20_000).collect(), slow, 2048)


def test_odd_rows(odd, nothing, slow):
    verify(odd, packing.pack(odd, PATH).collect(), slow, 2048)
    assert packing.pack(nothing, PATH).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 900)
    pieces, n = packing.assign(lengths, 2048, 1.0, 1 / 4096)
    cost, used = np.zeros(n), np.zeros(n)
    for _, _, k, s, _ in pieces:
        cost[s] += k + k * k / 4096
        used[s] += k
    assert used.sum() == lengths.sum()
    full = cost[used == 2048]
    assert full.std() / full.mean() < 0.05
    assert len(pieces) < 1.2 * len(lengths)
