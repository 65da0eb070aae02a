"""Every registered query against its DuckDB oracle at sf0.001 (the driver runs sf0.01)."""

import pytest

import __spark_entry__ as E
from flowlens.plans import catalog
from tests.conftest import SF001
from tests.oracle_check import compare, duck

ORACLE = E.oracle_sql()
ROWS_ONLY = [k for k in catalog.queries() if k not in ORACLE]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF001), ORACLE[name], con)
    assert ok, msg


def test_every_query_has_oracle_or_is_iterative():
    assert set(ROWS_ONLY) <= {"one_class_fit", "tuning_results", "training_run_summary", "model_description"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 83
