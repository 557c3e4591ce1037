"""Registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from loomscribe import queries_corpus, queries_plans, queries_runs

_MODULES = (queries_corpus, queries_plans, queries_runs)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
