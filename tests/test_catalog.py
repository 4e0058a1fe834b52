"""Every query with SQL gives the same rows in both engines."""

import differential
import pytest

from factloom.queries import oracle_sql, queries

Q, O = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_same_rows(spark, name):
    said = differential.differences(spark, name, Q[name], O[name], differential.DATA)
    assert said is None, said


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, name):
    assert Q[name](spark, differential.DATA).count() >= 0


def test_flagship(spark):
    from factloom.queries import flagship

    out = flagship(spark, differential.DATA)
    assert out.where("evaluated + not_applicable + unreadable <> total").count() == 0
    assert out.count() > 0
