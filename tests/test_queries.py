"""Every registered query against its SQL, on the smallest tables."""

import __spark_entry__ as contract
from catalog.oracles import ORACLES
from catalog.queries import REGISTRY
from check import differences
from conftest import SF_SMALL


def test_entry(spark):
    assert contract.entry(spark).count() == 10


def test_every_query_has_sql():
    assert REGISTRY.keys() == ORACLES.keys()


def test_queries_match_their_sql(spark):
    problems = {name: problem for name, problem, _ in differences(spark, SF_SMALL, set(REGISTRY)) if problem}
    assert problems == {}
