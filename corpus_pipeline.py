"""Training-corpus pipeline over ``documents``: each stage gets what the one before kept.

The result is the last stage's: doc_id, ids, n_tokens, nbest_scores, alternatives, decoded_crc32 and round_trip of each
document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depsight.llm import decontaminate, line_dedup, pieces, quality, simhash
from depsight.llm.common import read, spool
from depsight.llm.queries import tokenizer_path


#: Rows that go to Python at once: some MB of texts, where Spark's own 10,000 are tens of MB, on both sides of each task.
ROWS = "1000"


def few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", encoding),
]

#: Trained weights, fingerprints and piece lattices have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
