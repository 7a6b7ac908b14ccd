"""All queries of the library: importing the modules fills the registry."""

from lodestone.plans import queries_graph, queries_history, queries_search, queries_sources  # noqa: F401
from lodestone.plans.registry import QUERIES, SQL  # noqa: F401
