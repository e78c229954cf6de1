"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm import bpe_trie, common, decontaminate, exact_dedup, language_id, near_dedup
from sparkquarry.llm.queries import tokenizer_file

#: Least posterior of a language that a document is kept for.
SURE = 0.5
#: Chunks of text whose encodings a worker keeps, fewer than by default, as executors still hold memory of the stages before.
CHUNKS = 80_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text, by itself, is in a learned language, with all their columns, whatever their names.

    Documents without letters (null and empty texts too), or with no language of posterior SURE, go. Ties go to the first
    language in order. Rows of one id go together; null ids count as one. Without labelled documents there is no language,
    and all go; an empty table gives an empty one; texts may have any length.
    """
    file = tokenizer_file("piece_bpe_32k.model")
    model = language_id.fit(docs.where(~language_id.held_out()), file)
    return language_id.drop_rejected(docs, model, file, SURE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents with equal texts but for white space, that of the smallest id, with all columns, whatever their names.

    Null text counts as empty. A null id goes if a document with an id has its text. Rows of one id stay together.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest id, of each component of near duplicates, with all columns, whatever their names.

    Texts without words and null ids are linked with nothing and stay. Rows of one id are one document.
    """
    return near_dedup.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no item of the benchmark table, with all columns, whatever their names.

    Null texts and null ids hold nothing and stay; rows of one id go together; with an empty benchmark all stay.
    """
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a row: number of tokens, and digests of its ids and of what they decode to. Null text counts as empty."""
    return bpe_trie.encoding_digests(docs, tokenizer_file("word_bpe_49k.json"), chunks=CHUNKS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again by the next stage, after
    which the one before is removed. The last such table is what the result reads and stays."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = common.shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            common.removed(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)


#: Segmentation-marginalised language ID and the merges of BPE aren't SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None
