import pytest

from check_queries import connect, difference

from __spark_entry__ import oracle_sql, queries

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    if name in ORACLES:
        assert difference(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["id", "scores", "flags", "any_over_half", "verdict"]
    assert df.count() > 0
