"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_bars", "queries_levels", "queries_patterns", "queries_signals", "queries_sources", "queries_screen", "queries_rank", "queries_crossover", "queries_learn", "queries_streaming")


def _registries():
    for name in MODULES:
        yield import_module(f"candlemill.plans.{name}").reg


def flagship(spark, sf_dir):
    return import_module("candlemill.plans.queries_bars").flagship(spark, sf_dir)


def queries() -> dict:
    out: dict = {}
    for reg in _registries():
        out.update(reg.queries)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for reg in _registries():
        out.update(reg.sql)
    return out
