"""All registered queries and their SQL, by module."""

from __future__ import annotations

from . import kept, knowledge, lifecycle, names, relational, rows, search, streams, text, texts

MODULES = (relational, rows, text, texts, names, search, knowledge, lifecycle, streams, kept)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
