import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle  # noqa: E402

from corpusloom.operators import catalogue  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.of_spark(catalogue.queries()[name](spark, FOLDER)) == oracle.of_sql(con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs_the_same_twice(spark, name):
    f = catalogue.queries()[name]
    assert oracle.of_spark(f(spark, FOLDER)) == oracle.of_spark(f(spark, FOLDER))


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
