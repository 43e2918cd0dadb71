"""The public names in one place."""

from weftgraph.graph import Graph
from weftgraph.plans.compile import ask, construct, count, query
from weftgraph.plans.stats import Stats
from weftgraph.sources.tables import tables_graph

__all__ = ["Graph", "Stats", "ask", "construct", "count", "query", "tables_graph"]
