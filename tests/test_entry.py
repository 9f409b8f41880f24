"""The registered queries without the training-data package, or without what it needs."""

import importlib
import sys
import warnings

import __spark_entry__ as E
from quarry.suite import registry


def test_queries_stay_when_an_import_of_the_others_fails(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quarry.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert E.queries().keys() == registry.spark_queries().keys()
        assert E.oracle_sql().keys() == registry.oracle_sql().keys()


def test_queries_stay_when_the_package_is_gone(monkeypatch):
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert E.queries().keys() == registry.spark_queries().keys()
