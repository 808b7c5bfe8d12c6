"""Every query with an SQL form gives the same rows as DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle_compare

from gridlark.plans import catalog

SF = f"{oracle_compare.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, name):
    ours, theirs, more, less, n = oracle_compare.differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ours == theirs
    assert not more and not less
    assert n


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert __spark_entry__.entry(spark).columns == ["frame_id", "i", "j", "terrain", "valid", "code"]
