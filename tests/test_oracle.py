"""Every query with oracle SQL beside DuckDB on the smallest tables; the others run and are counted."""

import pytest
from compare import DATA, difference

from claimloom import registry

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert difference(df, registry.ORACLE_SQL[name], SF) == ""
    else:
        df.write.format("noop").mode("overwrite").save()  # all columns are computed
        assert df.count() > 0


def test_oracles_have_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
