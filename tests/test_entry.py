import importlib
import sys

import __spark_entry__
from kinlode.plans import queries


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(queries.oracle_sql()) >= 45


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("kinlode.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "kinlode.llm", None)
    module = importlib.reload(__spark_entry__)
    assert module.corpus is None and set(module.queries()) == set(queries.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
