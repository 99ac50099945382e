"""Registry of the queries and their SQL, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.plans import corpus, ledger, projects, search, vault

QUERIES = search.QUERIES | corpus.QUERIES | ledger.QUERIES | vault.QUERIES | projects.QUERIES
ORACLE_SQL = search.ORACLE_SQL | corpus.ORACLE_SQL | ledger.ORACLE_SQL | vault.ORACLE_SQL | projects.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item search with two terms a query."""
    return search.known_item(spark, sf_dir, m=2)
