"""Registered queries: every operator applied to the standard tables, with equivalent SQL."""

from . import blocks, catalog, events, indexes, labels, outlines, texts, transcripts, trees

_MODULES = (catalog, events, texts, outlines, blocks, labels, transcripts, trees, indexes)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
