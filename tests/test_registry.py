import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 8


def test_nothing_else_imports_the_llm_package():
    for f in (ROOT / "sessionloom").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            if isinstance(node, ast.ImportFrom):
                assert "llm" not in (node.module or "").split(".") and "llm" not in [a.name for a in node.names], f


def test_queries_equal_their_oracle(spark):
    from oracle_compare import compare, tables

    con = tables("/root/testdata/sf0.001")
    bad = []
    for name in entry.oracle_sql():
        text, ok = compare(spark, con, name, "/root/testdata/sf0.001")
        if not ok:
            bad.append(text)
    assert not bad
