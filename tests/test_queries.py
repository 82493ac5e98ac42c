"""Every registered query of the engine against its SQL."""

import pytest

from ringwork.plans.oracles import ORACLES
from ringwork.plans.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees_with_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_only_full_keys_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"maccs_full"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["mol_id", "bit"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
