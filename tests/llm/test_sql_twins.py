from __future__ import annotations

import pytest

from tests.compare import connect, difference
from tests.llm.conftest import SF
from triagemill.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    want = connect(SF).execute(ORACLE[name]).fetchdf()
    assert difference(QUERIES[name](spark, SF).toPandas(), want) is None
