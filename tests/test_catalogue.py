"""Every query of the catalogue against its SQL, and plans without nested loops."""

import pytest

from gneiss.plans import catalogue, catalogue_more  # noqa: F401

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001"), catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["tanimoto_pairs", "layer_class", "pair_gates"])
def test_pairs_have_an_equi_key(spark, name):
    plan = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(v.strip().upper().startswith(("WITH", "SELECT")) for v in e.oracle_sql().values())
