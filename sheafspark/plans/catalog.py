"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from sheafspark.plans import documents, graphs, order, rules, structure, tables

PARTS = (documents.register, tables.register, order.register, rules.register, structure.register, graphs.register)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.sql.items()}
