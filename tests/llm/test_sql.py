import pytest
from comparing import FOLDER, spark_rows, sql_rows

from skarn.llm import queries

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, str(FOLDER))) == sql_rows(queries.oracle_sql()[name])
