"""Every query of the subpackage that has SQL, against DuckDB at two scales."""

import pytest
from oracle import differ

from boxtide.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    assert differ(QUERIES[name](spark, folder), SQL[name], folder) == ""
