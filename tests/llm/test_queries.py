from __future__ import annotations

import pytest

from corpusmill.llm import registry

# Rows at sf0.001 of queries that SQL does not say.
ROWS = {"p2_groups": 164, "p5_pieces": 173, "p5_report": 4, "p6_assign": 103, "p6_fill": 1, "p7_mix": 32, "p7_shares": 10, "p8_found": 2, "p8_rates": 21, "p8_scores": 100}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows(spark, sf, sql, told, name):
    df, said = registry.queries()[name](spark, sf), registry.oracle_sql()
    if name in said:
        assert told(df) == sql(said[name])
    else:
        assert df.count() == ROWS[name]
