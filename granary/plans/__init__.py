"""Registered queries, each with SQL for the same result where SQL can express it."""

from __future__ import annotations

from granary.plans.registry import ORACLES, QUERIES


def load() -> None:
    """Import every module that registers queries."""
    from granary.plans import (  # noqa: F401
        boosting,
        cleaning,
        encoding,
        features,
        logs,
        memory,
        profiles,
        relations,
        scoring,
        splits,
        storage,
        streams,
        synthesis,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
