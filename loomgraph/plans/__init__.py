"""Registered queries over the driver tables."""

from loomgraph.plans import graph_queries, markup_queries, note_queries, rule_queries, stream_queries, table_queries  # noqa: F401
from loomgraph.plans.registry import ORACLES, PLANS, runner

__all__ = ["ORACLES", "PLANS", "runner"]
