"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import q_op1, q_op2, q_op3, q_op4, q_op5, q_op6, q_op7, q_op8, q_op9, q_op10

_MODULES = (q_op1, q_op2, q_op3, q_op4, q_op5, q_op6, q_op7, q_op8, q_op9, q_op10)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
