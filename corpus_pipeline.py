"""From raw documents to token digests: five stages, each over all that the one before kept.

Every row is a document of its own, whatever its doc_id: equal rows, repeated ids and null ids pass the filters one by one,
and near duplicates are told apart by their place. Null and empty texts are rejected by the classifier; the later stages
keep them if they are given any. Empty tables pass through. Columns beside doc_id, lang and text stay as they are.

A stage may be called alone, on any table, and leaves all tables alone that it did not make. What its result still reads lies
under spark.checkpoint.dir; `run` deletes that once the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.bpe import token_digests
from scorewright.llm.common import discard, forget, materialize, recorded, table
from scorewright.llm.decontaminate import contamination
from scorewright.llm.neardup import without_near_duplicates
from scorewright.llm.quality import accepted
from scorewright.llm.secrets import scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the trusted texts of their language bear out; all others go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no secret is found."""
    return scan(docs).filter(F.size("secrets") == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document and the digests of its ids and decoded bytes."""
    return token_digests(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: The classifier's and MinHash's stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again. Once it is there, what its stage wrote
    on the way and the result before it go; only this run's own tables do."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        discard(spark, made, docs)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
