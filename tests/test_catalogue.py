import pytest
from oracle import connection, rows

from veilmill import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = rows(catalogue.QUERIES[name](spark, FOLDER).toPandas())
    if name in catalogue.ORACLES:
        assert found == rows(connection(FOLDER).execute(catalogue.ORACLES[name]).df())
    else:
        assert found[0]


def test_questions_and_flows_of_the_whole_table(spark):
    n = catalogue.load(spark, FOLDER, "events").count()
    run = lambda name: catalogue.QUERIES[name](spark, FOLDER)
    assert run("decision_coverage_whole").count() == n
    assert sum(r["n"] for r in run("questions_by_type_whole").collect()) == n
    assert sum(r["n_http"] + r["n_connect"] + r["n_error"] for r in run("egress_by_host_whole").collect()) == n
    assert [r["host"] for r in run("connect_only_hosts_whole").collect()] == ["h3.example.com"]
    assert all("WHERE user_id %" not in sql for sql in catalogue.ORACLES.values())


def test_entry_imports_without_the_corpus_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(__spark_entry__)
    assert set(again.queries()) == set(catalogue.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
