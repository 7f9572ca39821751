from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from corpusmill.plans import registry

ROOT = Path(__file__).resolve().parents[1]


# Rows at sf0.001 of queries that SQL does not say.
ROWS = {"claim_segments": 1632, "judged_claims": 164, "rerank_pool": 151, "structured_chunks": 144}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows(spark, sf, sql, told, name):
    df, said = registry.queries()[name](spark, sf), registry.oracle_sql()
    if name in said:
        assert told(df) == sql(said[name])
    else:
        assert df.count() == ROWS[name]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "corpusmill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("corpusmill.llm") for n in names), path
