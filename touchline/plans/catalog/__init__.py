"""Registered queries, grouped by operator family."""

from touchline.plans.catalog import (  # noqa: F401
    actions,
    audit,
    evaluation,
    features,
    learning,
    outputs,
    trajectory,
    views,
)
from touchline.plans.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
