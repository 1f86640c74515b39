"""Registry of the engine's queries over the driver's tables and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewright.plans import admission_queries, canonical_queries, evidence_queries, mapping_queries, policy_queries, provenance_queries, release_queries, retrieval_queries, structure_queries

QUERIES: dict = {**retrieval_queries.QUERIES, **evidence_queries.QUERIES, **policy_queries.QUERIES, **canonical_queries.QUERIES, **admission_queries.QUERIES, **provenance_queries.QUERIES, **mapping_queries.QUERIES, **release_queries.QUERIES, **structure_queries.QUERIES}
ORACLES: dict[str, str] = {**retrieval_queries.ORACLES, **evidence_queries.ORACLES, **policy_queries.ORACLES, **canonical_queries.ORACLES, **admission_queries.ORACLES, **provenance_queries.ORACLES, **mapping_queries.ORACLES, **release_queries.ORACLES, **structure_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregated retrieval metrics of the derived trace."""
    return retrieval_queries.metric_aggregate(spark, sf_dir)
