"""All queries of the conversion engine, with their SQL for DuckDB where there is one."""

from __future__ import annotations

from . import assembly, batch, convert, layouts, parsing, planning

ALL = {**assembly.QUERIES, **parsing.QUERIES, **layouts.QUERIES, **planning.QUERIES, **convert.QUERIES, **batch.QUERIES}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLE = {name: sql for name, (_, sql) in ALL.items() if sql}
