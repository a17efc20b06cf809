"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare

from palisade.plans.queries import ORACLES, QUERIES

# Slow ones are covered by their own tests or by tests/compare.py on demand.
SKIP = {"chunked_detect"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SKIP])
def test_query(spark, con, sf, name):
    rows, theirs, _, diff = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert not diff, "\n".join(diff)
    if theirs is None:
        assert rows > 0 or name == "flow_003"
