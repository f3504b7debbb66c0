"""Registered queries over the test tables, and their SQL."""

from . import definitions, evaluation, features, modelling, relational, results, storage, textual

_MODULES = (relational, textual, features, definitions, evaluation, results, storage, modelling)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
