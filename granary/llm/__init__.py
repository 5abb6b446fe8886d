"""Operators for preparing training text, each with a query over whole tables.

Nothing outside this package imports it. ``load`` returns the registered queries and their SQL.
"""

from __future__ import annotations

from granary.llm.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    """Import every module that registers queries; (queries, SQL)."""
    from granary.llm import queries  # noqa: F401

    return QUERIES, ORACLES


__all__ = ["ORACLES", "QUERIES", "load"]
