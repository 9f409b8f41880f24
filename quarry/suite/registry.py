"""Collects the query keys of every suite module."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "safety", "tokens", "chat", "logs", "evals", "streams", "ingest")


def _mods():
    return [importlib.import_module(f"quarry.suite.{m}") for m in MODULES]


def spark_queries() -> dict:
    from quarry.session import prepare

    out = {}
    for m in _mods():
        for k, fn in m.QUERIES.items():
            def wrapped(spark, sf_dir, _fn=fn):
                prepare(spark)
                return _fn(spark, sf_dir)
            wrapped.__name__ = k
            wrapped.__doc__ = fn.__doc__
            out[k] = wrapped
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(getattr(m, "SQL", {}))
    return out
