"""Each query against its SQL: on the driver's tables, on odd tables, and on empty ones."""

import pytest

from gneiss.llm.queries import ORACLE, QUERIES

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, same, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), ORACLE[name])


@pytest.mark.parametrize("name", ["op1_quality", "op2_decontam", "op8_chat", "op9_neardup", "op11_overlap", "op13_spelling"])
def test_odd_rows_equal_sql(spark, edge, edge_same, name):
    edge_same(QUERIES[name](spark, edge), ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name == "op8_chat" else 0)  # op8 adds a conversation


@pytest.mark.parametrize("name", ["op1_quality", "op8_chat", "op10_secrets"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
