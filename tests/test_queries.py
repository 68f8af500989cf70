"""Every registered query that SQL can express equals it in DuckDB."""

import pytest
from helpers import SF, same

from quarry import registry
from quarry.plans import queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), registry.ORACLES[name]) > 0


def test_without_sql(spark):
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"ann_ivf_recall", "mmr_select", "context_assemble"}
    assert registry.QUERIES["ann_ivf_recall"](spark, SF).agg({"recall": "avg"}).first()[0] >= 0.9


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
