"""A corpus pipeline of five stages over ``documents``.

Quality rules reject documents, near copies leave one document of each class,
contaminated documents go, sources are mixed to equal shares, and what is left is
encoded and written as token lists, in the global random order of the mix.  Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and hands the next stage what it reads back.

Defined cases: a document with null or empty text has no words and goes in the first stage; a null id
or source is carried as it is, and a null source is a source of its own; repeated rows are copies, of
which the second stage leaves one; among documents of one class the least id stays, a null id only
where all are null; copies that the fourth stage makes are equal rows, each encoded; empty tables give
empty tables; texts are taken whole; further columns are carried up to the last stage.  The last stage
reads the order in which its documents were written, so it wants a table of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, jaccard_join, mixing, quality_rules, token_output
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.shared import table, tune

#: Chunks that a worker of the last stage remembers; executors still hold memory of the stages before.
TOKEN_CACHE = 120_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does."""
    tune(spark)
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies."""
    tune(spark)
    return jaccard_join.filter_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    tune(spark)
    return decontaminate.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents such that sources have equal shares in the mean, in a global random order."""
    tune(spark)
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each copy, from the token files, written in the order of docs' files."""
    tune(spark)
    tokens = token_output.token_table(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, cache=TOKEN_CACHE, order=token_output.written_order())
    return token_output.digest(tokens)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token-ID output", write_token_ids),
]

#: SQL has no tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
