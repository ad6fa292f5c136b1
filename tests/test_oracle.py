"""Every registered query against its DuckDB statement (small scale)."""

import pytest

from conftest import SF001
from oracle_compare import compare


#: An iterative fit, compared with plain Newton steps in test_models.py instead.
WITHOUT_SQL = {"readmission_model"}


@pytest.fixture(scope="module")
def results(spark):
    from staylens.registry import QUERIES
    return compare(spark, SF001, sorted(QUERIES))


def test_all_queries_match_duckdb(results):
    bad = {k: v for k, v in results.items() if v[0] != "OK"}
    assert set(bad) == WITHOUT_SQL and all(bad[k][0] == "rows-only" for k in bad), bad


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["medical_condition", "avg_los", "n_patients"]
    assert df.count() == 6
    from staylens.registry import QUERIES
    assert set(QUERIES) <= set(e.queries()) and set(QUERIES) - WITHOUT_SQL <= set(e.oracle_sql()) <= set(e.queries())


def test_query_schemas_are_stable(spark):
    from staylens.registry import QUERIES
    for name, fn in QUERIES.items():
        first, second = fn(spark, SF001), fn(spark, SF001)
        assert first.schema == second.schema, name
        assert len(set(first.columns)) == len(first.columns), name
