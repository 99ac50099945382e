"""Every query with SQL agrees with DuckDB; streams agree with their batch twins."""

import pytest
from helpers import SF, duck_rows, spark_rows

from mnemora.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == duck_rows(catalogue.ORACLE_SQL[name])


def test_all_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_session_windows_agree_with_batch(spark):
    stream = catalogue.QUERIES["stream_session_window"](spark, SF).count()
    batch = catalogue.QUERIES["session_blocks"](spark, SF).count()
    assert 0 < stream <= batch  # sessions whose watermark hasn't passed stay open


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
