import pytest

from spanloom.plans.oracles import ORACLES
from spanloom.plans.queries import queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(agree, name):
    agree(queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries().keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
