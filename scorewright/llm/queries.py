"""Queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm.bpe import token_digests
from scorewright.llm.common import table
from scorewright.llm.decontaminate import REPORT_SQL, contamination_report
from scorewright.llm.lexical import RANKED_SQL, ranked_report
from scorewright.llm.neardup import near_duplicate_classes
from scorewright.llm.neighbours import NEAREST_SQL, nearest
from scorewright.llm.packing import packed_documents
from scorewright.llm.pii import pseudonym_report
from scorewright.llm.quality import classify
from scorewright.llm.repeats import REPORT_SQL as REPEATS_SQL
from scorewright.llm.repeats import repeat_report
from scorewright.llm.resampling import RESAMPLING_SQL, resampling_report
from scorewright.llm.secrets import report_sql, secret_report
from scorewright.llm.sharding import SHARD_SQL, shard_report
from scorewright.llm.warc import archive_round_trip, round_trip_sql


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_bpe": op1_bpe, "op2_secrets": op2_secrets, "op3_pseudonyms": op3_pseudonyms, "op4_near_duplicates": op4_near_duplicates, "op5_packing": op5_packing, "op6_decontaminate": op6_decontaminate, "op7_warc": op7_warc, "op8_repeats": op8_repeats, "op9_quality": op9_quality, "op10_neighbours": op10_neighbours, "op11_sharding": op11_sharding, "op12_lexical": op12_lexical, "op13_resampling": op13_resampling}

ORACLES: dict[str, str] = {"op2_secrets": report_sql(), "op6_decontaminate": REPORT_SQL, "op7_warc": round_trip_sql(), "op8_repeats": REPEATS_SQL, "op10_neighbours": NEAREST_SQL, "op11_sharding": SHARD_SQL, "op12_lexical": RANKED_SQL, "op13_resampling": RESAMPLING_SQL}
