"""Every registered query of the engine: against its oracle, or rows with a stable schema where there is none."""

import pytest
from oracle import connect, rows

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    if name in registry.ORACLES:
        assert rows(got) == rows(connect(SF).sql(registry.ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows > 0 and len(set(got.column_names)) == len(got.column_names)
