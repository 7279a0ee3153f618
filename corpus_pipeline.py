"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages take empty tables (and give empty ones), null ids, texts and sources, texts of any length, and keep columns they don't
know, whatever their names. What each does with null, empty and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacunae.llm import benchmark_decontamination, language_cnn, pivotal_mix, simhash_pivots, token_planes
from lacunae.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts and those without a letter, and all if no row has a lang to
    learn from. Repeated rows are judged alike. The longest texts count whole, window by window."""
    return language_cnn.keep_identified(docs, language_cnn.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of several texts of that id in the group the one with the
    least text hash, of equal rows one. Texts without words are near-duplicates of each other. Rows without an id stay."""
    return simhash_pivots.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, each row judged by its whole text. Null and empty texts hold none; null and empty
    items and an empty benchmark have none."""
    return benchmark_decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document enters as often as the mix takes it: texts without words never, rows of one id with different texts each by itself, rows
    that repeat id, source and text as often together as the mix takes them. Null is a source of its own."""
    return pivotal_mix.repeat_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: what the written files hold of each document, repeats each on their own, in ascending order of doc_id, null
    first. A text without tokens is its end id."""
    return token_planes.encode_corpus(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language-id", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source-mix", source_mix),
    ("token-output", token_output),
]

#: SQL can't train the network or draw the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
