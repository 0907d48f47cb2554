import importlib

import pytest
import test_decontaminate
import test_near_join
import test_packing
from conftest_rows import texts_of

pipeline = pytest.importorskip("corpus_pipeline")


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_stages_against_brute_force(spark, data, tmp_path):
    """Every stage on what its predecessor kept, its decisions against those of a brute-force version."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = texts_of(docs)
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            from tokenizers import Tokenizer

            test_packing.verify(docs, out.collect(), Tokenizer.from_file(test_packing.PATH), 2048)
            break
        assert out.columns == columns
        after = texts_of(out)
        assert set(after) <= set(before)
        if name == "language_id":
            want = [r for r in before if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact_dedup":
            best = {}
            for i, t in sorted(before):
                key = norm(t)
                if key not in best or len(t) > len(best[key][1]):
                    best[key] = (i, t)
            want = list(best.values())
        elif name == "jaccard_join":
            top = {i: c for i, c, _ in test_near_join.brute(before)}
            want = [r for r in before if top[r[0]] == r[0]]
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            bad = {d for d, _, _ in test_decontaminate.brute(before, items)}
            assert bad
            want = [r for r in before if r[0] not in bad]
        assert sorted(after) == sorted(want)
        docs = out


def test_odd_rows(spark, data, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, data)
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), docs.schema)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries()
    assert [s for s, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "packing"]
