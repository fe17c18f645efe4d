"""Every core query with oracle SQL gives the oracle's rows; the others run."""

import pytest

import __spark_entry__
from tests.oracle import DATA, connect, rows_of_spark, rows_of_sql
from threadloom.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    got = rows_of_spark(registry.QUERIES[name](spark, DATA))
    want = rows_of_sql(connect(), registry.ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_a_wrong_query_fails(spark):
    wrong = registry.ORACLE["url_source_counts"].replace("count(*)", "count(*) + 1")
    assert rows_of_spark(registry.QUERIES["url_source_counts"](spark, DATA)) != rows_of_sql(connect(), wrong)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["concept_id", "name", "doc_freq"] and df.count() > 0
