"""The corpus pipeline: language identification, exact dedup, near dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as Parquet and read
again for the next. All but the last return the columns of ``docs``.

Defined cases, in all stages: other columns are kept as they are, whatever their names; null doc_ids stay null; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, exact_dedup, language, near_join, packing
from quarry.llm._shared import table, written
from quarry.shipping import ship


#: Bytes of a batch on its way to Python. Each task holds several copies of its batch on both sides, all within an executor's memory.
BATCH_BYTES = 4 << 20


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents at hand; those without a letter (null, empty and blank texts among them), or that hardly resemble any language, go. Repeated rows all stay or go."""
    _ready(spark)
    return language.accepted(docs, language.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the smallest doc_id (null last); of repeated rows one. Null, empty and blank texts are one group."""
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of the smallest doc_id (null last) stays; of repeated rows one. Blank texts all stay."""
    _ready(spark)
    return near_join.drop_near(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like an item of the benchmark go, each row by itself; null and empty texts, and items without id or words, match nothing."""
    _ready(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens; a null or empty text is the end id alone, repeated rows are packed each."""
    import public_tokenizers

    _ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL has no language model, MinHash or tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
