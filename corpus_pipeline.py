"""From raw documents to token files: five stages, each written and read again by the next.

Toxic documents go, one document of each group of near copies stays, documents that
hold benchmark passages go, sources are mixed to equal weights, and what remains is
written as token codes in the shuffled order that mixing gave it.

Edge cases: rows with a null or empty text stay unless the toxicity stage scores empty
texts as toxic, and each becomes the end id alone; rows with a null ``doc_id`` stay as
copies, as no id tells which to drop; repeated rows are one document by their id, so
they stay or go together; an empty table gives no rows; columns beside those of
``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatix.llm import common, decontaminate, jaccard_join, mixing, token_codes, toxicity

COLUMNS = list(mixing.COLUMNS)
#: Near copies share this percentage of their runs of so many words; op8's own contract is tighter.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.table(spark, sf_dir, "documents")
    return jaccard_join.keep_one(docs.select(*COLUMNS), NEAR_WORDS, NEAR_PERCENT).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.settle_executors(spark)  # the tokenizers of the workers need room beside the heaps
    return token_codes.encode_documents(docs, order=())


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token_codes", write_tokens)]

#: The stages learn and align, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
